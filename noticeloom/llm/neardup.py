"""Near-duplicate detection with HyperMinHash sketches.

A text's set holds the 64-bit hashes of its distinct word shingles. The hashes' first bits choose a
bucket; a bucket's register stores, of its smallest hash, the number of leading zeros (6 bits) and
the 10 bits that follow the first one. Empty buckets borrow from buckets chosen by a fixed hash.

1. Equal sets are one class: a hash of the sorted set groups them, pre-aggregated.
2. Classes are banded on their compressed registers. In each band bucket every class is compared
   with one leader only, so a bucket of n classes makes n candidates. Candidates whose
   collision-corrected estimate is far too low are dropped, the others are verified on full sets.
   Bands have leaders of their own, so members of a large group meet many of them.
3. Verified links are thinned: what a class's leaders are to each other through it needs one link
   each, and most classes of a group have the same leaders. What is left gives components. Buckets
   that still hold several are compared fully, block against block inside tasks: sketches first, then
   full sets, skipping what is already connected, and only links between components are returned.
4. Those links merge components; the smallest id of a component's rows names it.

Intermediate tables are deleted as soon as nothing reads them any more.

Candidates are found with a chance of 1 - (1 - J^ROWS)^BANDS: beyond 1 - 1e-5 from J = 0.75 on.

Defined results: a text with fewer words than a shingle is one shingle; texts without words (or
null) have an empty set and are linked with nothing; repeated rows are exact copies; a null doc_id
takes part and is never chosen as a name unless all ids of its component are null; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import dropped, mapped, slices, stored, unused

WORDS, SIMILAR = 5, 75  # shingle length; percent of the union
BUCKETS, BANDS, ROWS = 128, 32, 4
ZERO_BITS, MANTISSA = 6, 10
#: Estimates this far below the threshold are not verified (over 6 standard deviations of 128 buckets).
MARGIN = 0.25
#: Most ids that are broadcast, some 16 bytes each.
GONE_IDS = 2_000_000
#: Classes of a bucket that are compared at once.
BLOCK = 512

#: Longest text, in bytes, for which powers stay in memory between texts.
KEPT_POWERS = 1 << 20

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
    return out


_POWERS = [_powers(1 << 12, _BASE), _powers(1 << 12, pow(_BASE, -1, 1 << 64))]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for texts of at most KEPT_POWERS bytes."""
    size = 1 << max(0, n - 1).bit_length()
    if size > KEPT_POWERS:
        return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
    if len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased, words parted by one space."""
    found = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    up, down = powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[:-1], out=sums[1:])
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ends) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mixed((sums[ends] - sums[starts]) * down[starts]))


_BORROW = mixed(np.arange(BUCKETS * 64, dtype=np.uint64)).reshape(64, BUCKETS) % np.uint64(BUCKETS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: leading zeros and mantissa of each bucket's least hash."""
    bits = BUCKETS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])  # sorted: a bucket's least comes first
    least = hashes[first] << np.uint64(bits)
    exponent = np.floor(np.log2(np.maximum(least, np.uint64(1)).astype(np.float64)))
    zeros = np.clip(63 - exponent, 0, (1 << ZERO_BITS) - 1).astype(np.uint64)
    mantissa = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    out = np.full(BUCKETS, -1, np.int64)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.int64)
    own = out >= 0
    if not own.all():
        for row in _BORROW:
            take = (out < 0) & own[row.astype(np.int64)]
            out[take] = out[row[take].astype(np.int64)]
        if (out < 0).any():  # the next bucket that has its own
            places = np.flatnonzero(own)
            empty = np.flatnonzero(out < 0)
            out[empty] = out[places[np.searchsorted(places, empty) % len(places)]]
    return out.astype(np.uint16)


#: Chance that unequal registers agree: the mantissas collide where the exponents do (1/3 of the time).
COLLIDE = 2.0**-MANTISSA / 3


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, corrected for collisions of compressed values."""
    same = (a == b).mean(axis=-1)
    return np.clip((same - COLLIDE) / (1 - COLLIDE), 0, 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """Whether two sorted sets share at least this percentage of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bands(registers: np.ndarray) -> np.ndarray:
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = rows[:, 0]
    for i in range(1, ROWS):
        key = key << np.uint64(16) | rows[:, i]
    return mixed(mixed(key) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, names, registers = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), words)
                counts.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_bands(np.frombuffer(r.as_py(), np.uint16)) for r in batch.column("registers")]
        if keys:
            places = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(places), pa.array(np.concatenate(keys))], names=["node", "band"])


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what links (member, leader) do, nearly one for each member.

    A member has at most one leader a band. It stays linked with the least of its leaders, and so do
    the others: members of a large group share most leaders, so most of those links are the same."""
    of = links.groupBy("member").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    first = F.element_at("leaders", 1)
    own = F.array(F.struct(F.col("member").alias("a"), first.alias("b")))
    others = F.transform(F.slice("leaders", 2, BANDS), lambda x: F.struct(x.alias("a"), first.alias("b")))
    return of.select(F.explode(F.concat(own, others)).alias("x")).select("x.*").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links(a, b): the least node that a chain of links reaches.

    Each round every node hands the least name among its neighbours and itself to them all, and
    names are then followed once more (pointer jumping), until nothing changes."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    names = stored(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "names")
    while True:
        near = edges.join(names, edges["v"] == names["node"]).groupBy("u").agg(F.min("component").alias("near"))
        step = names.join(near, names["node"] == near["u"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        above = names.select(F.col("node").alias("n"), F.col("component").alias("up"))
        new = stored(step.join(above, F.col("c") == F.col("n"), "left").select("node", "old", F.least("c", "up").alias("component")), "names")
        changed = new.where(F.col("old") != F.col("component")).limit(1).count()
        dropped(names)
        names = new.drop("old")
        if not changed:
            dropped(edges)
            return names


def _verifier(percent: int):
    """Of (member, leader, set_a, set_b) the pairs that are similar on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b")]
            keep = pa.array([similar(a, b, percent) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["member", "leader"]).filter(keep)

    return run


def _estimator(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS) for c in ("reg_a", "reg_b"))
                yield batch.select(["member", "leader"]).filter(pa.array(estimate(a, b) >= percent / 100 - MARGIN))

    return run


def _set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            full = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
            own = [hashlib.blake2b(f, digest_size=16).digest() == n.as_py() for f, n in zip(full, batch.column("node"), strict=True)]  # ids may repeat
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(full, pa.binary())], names=["node", "full"]).filter(pa.array(own, pa.bool_()))

    return run


def _connect(percent: int):
    """Links between components that the members of one pair of blocks of a bucket show."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] != 1].reset_index(drop=True), pdf[pdf["side"] != 0].reset_index(drop=True)
        up: dict[bytes, bytes] = {}

        def top(x):
            while up.get(x, x) != x:
                up[x] = x = up[up[x]] if up[x] in up else up[x]
            return x

        regs = [np.frombuffer(b"".join(d["registers"]), np.uint16).reshape(len(d), BUCKETS) for d in (left, right)]
        sizes = [d["n_shingles"].to_numpy() for d in (left, right)]
        found = []
        for i in range(len(left)):
            near = np.flatnonzero((estimate(regs[0][i], regs[1]) >= percent / 100 - MARGIN) & (100 * np.minimum(sizes[0][i], sizes[1]) >= percent * np.maximum(sizes[0][i], sizes[1])))
            a = np.frombuffer(left["full"].iat[i], np.uint64) if len(near) else None
            for j in near:
                x, y = top(left["component"].iat[i]), top(right["component"].iat[j])
                if x != y and similar(a, np.frombuffer(right["full"].iat[j], np.uint64), percent):
                    up[max(x, y)] = min(x, y)
                    found.append((x, y))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(mapped(docs.select("doc_id", "text"), _sketches(words), f"doc_id {kind}, n_shingles long, set_id binary, registers binary"), "sketches")
    classes = stored(
        rows.where(F.col("n_shingles") > 0).groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .withColumnRenamed("set_id", "node"), "classes")

    # one leader a bucket: the class with the least hash of its own and the bucket's name
    bands = stored(classes.select("node", "registers").mapInArrow(_exploded, "node binary, band long"), "bands")
    leaders = bands.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band"), "node"))["node"].alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    shared = stored(bands.join(leaders, "band"), "shared")
    dropped(bands)
    pairs = shared.where(F.col("node") != F.col("leader")).groupBy(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).agg(F.min("leader").alias("leader"))
    pairs = pairs.select(F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"), "leader")
    reg = lambda x, y: classes.select(F.col("node").alias(x), F.col("registers").alias(f"reg_{y}"))
    pair = "member binary, leader binary"
    candidates = stored(pairs.join(reg("member", "a"), "member").join(reg("leader", "b"), "leader").select("member", "leader", "reg_a", "reg_b").mapInArrow(_estimator(percent), pair), "candidates")

    # full sets of the classes that stand in a candidate or in a shared bucket
    wanted = shared.select("node").distinct()
    owner = classes.join(wanted, "node", "left_semi").select("node", F.col("first").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(owner, docs["doc_id"].eqNullSafe(owner["doc_id"])).select("node", "text")
    made = mapped(texts, _set_maker(words), "node binary, full binary")
    sets = stored(made.groupBy("node").agg(F.first("full").alias("full")), "sets")
    full = lambda x, y: sets.select(F.col("node").alias(x), F.col("full").alias(f"set_{y}"))
    links = stored(candidates.join(full("member", "a"), "member").join(full("leader", "b"), "leader").select("member", "leader", "set_a", "set_b").mapInArrow(_verifier(percent), pair), "links")
    dropped(candidates)
    named = components(stars(links))
    dropped(links)

    # buckets that still hold several components, compared block against block
    member = stored(shared.select("band", "node").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    dropped(shared)
    # the largest component of a bucket is compared with the rest only, the rest with itself too
    tally = member.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("n"))
    open_ = tally.where("main.k < n AND n > 2").select("band", F.col("main.component").alias("main"), F.ceil(F.col("main.k") / BLOCK).alias("mains"), F.ceil((F.col("n") - F.col("main.k")) / BLOCK).alias("rests"))  # of two, one is the leader
    blocks = member.join(open_, "band").withColumn("is_main", F.col("component") == F.col("main"))
    blocks = blocks.withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))))
    cell = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = F.col("at")
    with_main = F.when(F.col("is_main"), F.transform(upto("rests"), lambda p: cell("main", p, at, F.lit(1)))).otherwise(F.transform(upto("mains"), lambda q: cell("main", at, q, F.lit(0))))
    with_rest = F.when(~F.col("is_main"), F.transform(upto("rests"), lambda q: cell("rest", F.least(at, q), F.greatest(at, q), F.when(at == q, -1).when(at < q, 0).otherwise(1))))
    met = stored(blocks.select("band", "node", "component", F.explode(F.concat(with_main, F.coalesce(with_rest, F.array().cast("array<struct<kind:string,p:bigint,q:bigint,side:int>>")))).alias("x")).select("band", "node", "component", "x.*"), "met")
    dropped(member)
    # buckets with the same members are one: a digest of the members' hashes names them
    parts = met.groupBy("band", "kind", "p", "q").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("digest"), F.count("*").alias("k"))
    once = parts.groupBy("digest", "k", "kind", "p", "q").agg(F.min("band").alias("band")).select("band", "kind", "p", "q")
    compared = met.join(once, ["band", "kind", "p", "q"]).join(classes.select("node", "registers", "n_shingles"), "node").join(sets, "node")
    more = stored(compared.groupBy("band", "kind", "p", "q").applyInPandas(_connect(percent), "a binary, b binary"), "more")
    dropped(met, sets)
    # components that such links connect take the least name among them
    tops = components(more)
    dropped(more)

    # the least id of all rows of a component; rows without words keep their own
    top = tops.select(F.col("node").alias("inner"), F.col("component").alias("outer"))
    of = classes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("inner"), "first").join(top, "inner", "left").select("node", F.coalesce("outer", "inner").alias("component"), "first")
    ids = of.join(of.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    out = rows.select("doc_id", "n_shingles", "set_id").join(ids.select(F.col("node").alias("set_id"), "component_id"), "set_id", "left")
    name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", name.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = stored(out, "near-duplicates")
    dropped(rows, classes, named, tops)
    return out


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILAR) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Of repeated rows with
    that id and the same text one stays; documents without words all stay.

    The ids of those that go are broadcast if they are at most GONE_IDS, so that texts are not shuffled."""
    id_ = unused(docs, "gone")[0]
    ids = stored(near_duplicates(docs, words, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count_if("kept").alias("n")), "ids")
    gone = ids.where("NOT kept").select(F.col("doc_id").alias(id_))
    few = gone.limit(GONE_IDS + 1).count() <= GONE_IDS
    out = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(F.col(id_)), "left_anti")
    if ids.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out
