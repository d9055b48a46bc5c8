"""Near-duplicate vectors by sorted projection passes.

Vectors are compared within their label and length. Equal vectors of a label are one class.

1. Each pass gives every class a key: concatenated random hashes, each the largest of DIRECTIONS random
   projections and its sign. Classes are sorted by pass, label and key, and each is compared with the
   WINDOW classes before it, in double precision. A partition compares its own rows and hands on those
   near its ends, which are compared across. What a batch shows to be connected leaves as a forest, one
   link a class, however many pairs are close.
2. Links of all passes are united into components. Passes are as many as leave a pair at the threshold
   unseen with a chance of MISSED, from the size of the largest label; a component needs one path only.
3. A window sees part of a large group's pairs, so links are counted within components, over all pairs.
   Components of at most CELL classes are counted by one matrix product. Larger ones are cut into
   rings by the angle to a pivot, and rings into cells. By the triangle inequality two rings are close as
   wholes (their counts are added), apart as wholes (nothing to do) or are compared cell by cell.
   A tight group lies in inner rings and costs no comparison, however many vectors it has; pairs of
   cells that the bounds leave open grow with the square of their number, in bounded tasks.

Pairs are never emitted. Counts are exact for a component; what may be missed is a link whose ends no
pass connects.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do rows with a null label; labels are compared as text. Vectors of any finite size are
scaled before they are multiplied. Repeated ids are rows of their own; a null id takes part and names a
component only if all its ids are null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import dropped, mapped, stored
from noticeloom.llm.neardup import components

COSINE = 0.93
#: Hashes of a key, projections of a hash, classes before each that it is compared with.
HASHES, DIRECTIONS, WINDOW = 12, 16, 128
#: Chance that a pair at the threshold meets in no pass; least number of passes.
MISSED, PASSES = 1e-3, 8
#: Classes of a cell, rings up to the threshold's angle, rows of a sorted partition, bytes of pivots that are broadcast.
CELL, RINGS, PART, PIVOTS = 2048, 64, 50_000, 32 << 20
_SLACK = 1e-6


def unit(column: pa.Array) -> np.ndarray:
    """Unit vectors, one a row; all of the same length."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the places that links i - j connect each of n places with."""
    names = np.arange(n)
    while True:
        low = np.minimum(names[i], names[j])
        new = names.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == names).all():
            return names
        names = new


@functools.lru_cache(maxsize=16)
def _projections(turn: int, size: int) -> np.ndarray:
    return np.random.default_rng((20240517, turn, size)).standard_normal((HASHES * DIRECTIONS, size)).astype(np.float32)


def keys(x: np.ndarray, turn: int) -> np.ndarray:
    """Concatenated hashes of unit vectors as numbers that sort alike."""
    p = (x.astype(np.float32) @ _projections(turn, x.shape[1]).T).reshape(len(x), HASHES, DIRECTIONS)
    top = np.abs(p).argmax(axis=2)
    value = 2 * top + (np.take_along_axis(p, top[:, :, None], 2)[:, :, 0] > 0)
    return value.astype(np.int64) @ ((2 * DIRECTIONS) ** np.arange(HASHES - 1, -1, -1, dtype=np.int64))


def passes_for(n: int, cosine: float = COSINE) -> int:
    """Passes after which a pair at the threshold has met with a chance of 1 - MISSED, among n classes of a label."""
    r = np.random.default_rng(1)  # the chance that a hash agrees, by simulation: it hardly depends on the length
    a, b = r.standard_normal((2, 4000, DIRECTIONS))
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    place = lambda y: 2 * np.abs(y).argmax(1) + (np.take_along_axis(y, np.abs(y).argmax(1)[:, None], 1)[:, 0] > 0)
    agree = min(0.999, (place(a) == place(b)).mean())
    hashes = max(0.0, math.log(n / WINDOW, 2 * DIRECTIONS)) if n else 0.0
    met = agree**hashes
    return PASSES if met > 0.9 else max(PASSES, math.ceil(math.log(MISSED) / math.log(1 - met)))


def _keyed(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = unit(own.column("v"))
                for turn in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), turn, np.int32)), own.column("label"), own.column("size"), pa.array(keys(x, turn)), own.column("node"), own.column("v")], names=["turn", "label", "size", "key", "node", "v"])

    return run


def _close(x: np.ndarray, lists: np.ndarray, cosine: float, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j at most a window apart, of one list, that are close."""
    found = []
    for at in range(0, len(x), 256):
        left, right = slice(at, at + 256), slice(at, at + 256 + window)
        s = x[left] @ x[right].T
        i, j = np.nonzero((s >= cosine) & (lists[left][:, None] == lists[right][None, :]))
        own = (j > i) & (j <= i + window)
        found.append((i[own] + at, j[own] + at))
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


SORTED = ["turn", "label", "size", "node", "v"]


def links_of(rows: pa.Table, cosine: float) -> tuple[pa.Array, pa.Array]:
    """Links (a, b), one a class at most, that connect what the windows of sorted rows show to be close."""
    rows = rows.combine_chunks()
    n = len(rows)
    turn, size = rows.column("turn").to_numpy(), rows.column("size").to_numpy()
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    new = lambda *cs: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cs], axis=0)]) if n else np.zeros(0, bool)
    lists = np.cumsum(new(turn, label, size))
    pairs = [(np.zeros(0, np.int64),) * 2]
    starts = np.flatnonzero(new(size)).tolist()
    for lo, hi in zip(starts, [*starts[1:], n], strict=True):
        i, j = _close(unit(rows.column("v").combine_chunks().slice(lo, hi - lo)), lists[lo:hi], cosine)
        pairs.append((i + lo, j + lo))
    names = forest(n, *(np.concatenate(c) for c in zip(*pairs, strict=True)))
    own = np.flatnonzero(names != np.arange(n))
    node = rows.column("node").combine_chunks()
    return node.take(pa.array(own)), node.take(pa.array(names[own]))


def _windows(cosine: float, schema: pa.Schema):
    """Of a sorted partition: links (a, b); then rows near its ends, with their places; then its number of rows (no a)."""

    def filled(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, tail = TaskContext.get().partitionId(), 0, None

        def ends(rows: pa.Table, place: int) -> pa.RecordBatch:
            values = {c: rows.column(c).combine_chunks() for c in SORTED}
            return filled(a=values.pop("node"), part=[part] * len(rows), place=np.arange(place, place + len(rows)), **values)

        for batch in batches:
            own = pa.Table.from_batches([batch.select(SORTED)])
            both = own if tail is None else pa.concat_tables([tail, own])
            a, b = links_of(both, cosine)
            if len(a):
                yield filled(a=a, b=b)
            if count < WINDOW and len(own):
                yield ends(own.slice(0, WINDOW - count), count)
            count += len(own)
            tail = both.slice(max(0, len(both) - WINDOW))
        if tail is not None and count > WINDOW:
            first = max(WINDOW, count - WINDOW)  # those before were handed on already
            yield ends(tail.slice(len(tail) - (count - first)), first)
        yield filled(part=[part], place=[count])

    return run


def _at_borders(borders: np.ndarray, starts: np.ndarray):
    """Rows near the ends of partitions, once for each border that lies within a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = starts[batch.column("part").to_numpy()] + batch.column("place").to_numpy()
            lo, hi = np.searchsorted(borders, rank - WINDOW, "right"), np.searchsorted(borders, rank + WINDOW, "right")
            row = np.repeat(np.arange(len(rank)), hi - lo)
            border = borders[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(row))]
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(border), pa.array(rank[row]), took.column("a"), *(took.column(c) for c in ("turn", "label", "size", "v"))], names=["border", "rank", "node", "turn", "label", "size", "v"])

    return run


def _across(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        a, b = links_of(rows.sort_by("rank").select(SORTED), cosine)
        return pa.table({"a": a, "b": b})

    return run


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links (a, b) between classes(node, label, size, v) that connect those found close in sorted passes."""
    spark, vector = classes.sparkSession, dict(classes.dtypes)["v"]
    total, largest = classes.groupBy("label", "size").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    passes = passes_for(largest, cosine)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), passes * total // PART)
    keyed = mapped(classes.select("node", "label", "size", "v"), _keyed(passes), f"turn int, label string, size int, key long, node string, v {vector}")
    order = ["turn", "label", "size", "key", "node"]
    kind = f"a string, b string, part int, place long, turn int, label string, size int, v {vector}"
    arrow = pa.schema([("a", pa.string()), ("b", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("turn", pa.int32()), ("label", pa.string()), ("size", pa.int32()), ("v", pa.list_(pa.float32() if "float" in vector else pa.float64()))])
    seen = stored(mapped(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order), _windows(cosine, arrow), kind), "windows")
    counts = np.zeros(parts + 1, np.int64)
    for row in seen.where("a IS NULL").select("part", "place").collect():  # one row a partition
        counts[row["part"] + 1 : row["part"] + 2] = row["place"]
    starts = np.cumsum(counts)
    borders = np.unique(starts[(starts > 0) & (starts < starts[-1])])
    near = seen.where("b IS NULL AND a IS NOT NULL").mapInArrow(_at_borders(borders, starts), f"border long, rank long, node string, turn int, label string, size int, v {vector}")
    out = stored(seen.where("b IS NOT NULL").select("a", "b").unionByName(near.groupBy("border").applyInArrow(_across(cosine), "a string, b string")).distinct(), "links")
    dropped(seen)
    return out


def _within(cosine: float):
    """Of rows sorted by component: (node, near), how many other vectors of its component each class is close to."""

    def counted(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        x, copies = unit(rows.column("v").combine_chunks()), rows.column("copies").to_numpy()
        s = x @ x.T >= cosine
        np.fill_diagonal(s, False)
        return pa.RecordBatch.from_arrays([rows.column("node").combine_chunks(), pa.array(s @ copies)], names=["node", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            name = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])).tolist() if len(rows) else []
            for lo, hi in zip(starts, starts[1:]):
                yield counted(rows.slice(lo, hi - lo))
            rest = rows.slice(starts[-1]) if starts else None
        if rest is not None:
            yield counted(rest)

    return run


def _pivot(rows: pa.Table) -> pa.Table:
    x = unit(rows.column("v").combine_chunks())
    mean = x.mean(axis=0)
    mean = mean if np.linalg.norm(mean) > 1e-9 else x[0]
    return pa.table({"component": rows.column("component").slice(0, 1), "pivot": pa.array([(mean / np.linalg.norm(mean)).tolist()], pa.list_(pa.float64()))})


def _ringed(width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                pivot = np.asarray(own.column("pivot").flatten()).reshape(len(own), -1)
                angle = np.arccos(np.clip((unit(own.column("v")) * pivot).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("component", "node", "copies", "v")), pa.array((angle / width).astype(np.int32))], names=["component", "node", "copies", "v", "ring"])

    return run


def _cells(cosine: float):
    """Counts of one pair of cells: side 0 with side 1, or (-1) a cell with itself."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, copies, x = rows.column("side").to_numpy(), rows.column("copies").to_numpy(), unit(rows.column("v").combine_chunks())
        if (side < 0).all():
            s = x @ x.T >= cosine
            np.fill_diagonal(s, False)
            near = s @ copies
        else:
            near, a, b = np.zeros(len(side), np.int64), side == 0, side == 1
            s = x[a] @ x[b].T >= cosine
            near[a], near[b] = s @ copies[b], copies[a] @ s
        return pa.table({"node": rows.column("node"), "near": pa.array(near)})

    return run


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _large(members: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """(node, near) of components that are too large for one task: members(component, node, copies, v, size)."""
    vector, width = dict(members.dtypes)["v"], math.acos(cosine) / RINGS
    some = members.join(_few(sizes, 100_000), "component").where(F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / CELL)) == 0)
    pivots = stored(some.groupBy("component").applyInArrow(_pivot, "component string, pivot array<double>"), "pivots")
    length = members.agg(F.max("size")).first()[0]
    rings = stored(mapped(members.join(_few(pivots, PIVOTS // (8 * length)), "component"), _ringed(width), f"component string, node string, copies long, v {vector}, ring int"), "rings")
    ring = stored(rings.groupBy("component", "ring").agg(F.count("*").alias("k"), F.sum("copies").alias("c")), "ring-sizes")
    p, q = ring.select("component", F.col("ring").alias("i"), "k"), ring.select("component", F.col("ring").alias("j"), F.col("k").alias("l"), "c")
    both = p.join(q, "component").withColumn("all", (F.col("i") + F.col("j") + 2) * width <= math.acos(cosine) - _SLACK)
    sure = both.where("all").groupBy("component", "i").agg(F.sum("c").alias("c")).select("component", F.col("i").alias("ring"), "c")
    itself = (2 * F.col("ring") + 2) * width <= math.acos(cosine) - _SLACK
    whole = rings.join(_few(sure, 500_000), ["component", "ring"]).select("node", (F.col("c") - F.when(itself, F.col("copies")).otherwise(0)).alias("near"))
    # cells of the pairs of rings that the bounds leave open
    subs = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CELL) - 1)
    open_ = both.where(~F.col("all") & (F.col("i") <= F.col("j")) & ((F.col("j") - F.col("i") - 1) * width <= math.acos(cosine) + _SLACK))
    open_ = open_.withColumn("s", F.explode(subs("k"))).withColumn("t", F.explode(subs("l"))).where("i < j OR s <= t")
    same = (F.col("i") == F.col("j")) & (F.col("s") == F.col("t"))
    ends = F.when(same, F.array(F.struct(F.col("i").alias("ring"), F.col("s").alias("sub"), F.lit(-1).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("ring"), F.col("s").alias("sub"), F.lit(0).alias("side")), F.struct(F.col("j").alias("ring"), F.col("t").alias("sub"), F.lit(1).alias("side"))))
    ends = open_.select("component", F.struct("i", "s", "j", "t").alias("pair"), F.explode(ends).alias("x")).select("component", "pair", "x.*")
    cut = rings.join(_few(ring.select("component", "ring", "k"), 500_000), ["component", "ring"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / CELL)))
    met = cut.join(ends, ["component", "ring", "sub"]).select("component", "pair", "side", "node", "copies", "v")
    compared = met.groupBy("component", "pair").applyInArrow(_cells(cosine), "node string, near long")
    out = stored(whole.unionByName(compared).groupBy("node").agg(F.sum("near").alias("near")), "near")
    dropped(pivots, rings, ring)
    return out


def grouped(rows: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id_column, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    element = rows.schema[vector].dataType.elementType
    v = F.col(f"`{vector}`").cast("array<float>" if isinstance(element, T.FloatType) else "array<double>")
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    given = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.transform(v, lambda x: x + F.lit(0).cast("float")).alias("v"))
    name = F.concat_ws("-", F.xxhash64("label", "v"), F.xxhash64(F.lit(7), "v", "label"))
    given = given.withColumn("node", F.when(F.coalesce(good, F.lit(False)), name))
    named = stored(given.select("id", "node"), "named")
    classes = stored(given.where("node IS NOT NULL").groupBy("node", "label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("size", F.size("v")), "classes")
    linked = links(classes, cosine)
    of = components(linked)
    dropped(linked)
    members = stored(classes.join(of, "node").select("component", "node", "copies", "v", "size"), "members")
    sizes = stored(of.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > CELL), "sizes")
    if sizes.isEmpty():
        small, large = members, None
    else:
        few = _few(sizes.select("component"), 100_000)
        small, large = members.join(few, "component", "left_anti"), _large(members.join(few, "component", "left_semi"), sizes, cosine)
    near = small.select("component", "node", "copies", "v").repartition("component").sortWithinPartitions("component", "node").mapInArrow(_within(cosine), "node string, near long")
    near = near if large is None else near.unionByName(large)
    firsts = classes.select("node", "first").join(of, "node").groupBy("component").agg(F.min("first").alias("least"))
    found = classes.select("node", "first", "copies").join(near, "node", "left").join(of, "node", "left").join(firsts, "component", "left")
    found = found.select("node", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    out = named.join(found, "node", "left").select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = stored(out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id"))), "vector-groups")
    dropped(named, classes, of, members, sizes, *([large] if large is not None else []))
    return out
