"""Removal of repeated passages: every byte covered by a string of WINDOW bytes that starts anywhere else too.

Texts are compared as UTF-8 bytes. Every window has one anchor, the GRAM bytes inside it with the
least hash (leftmost of equal ones), so equal windows have equal anchors at equal places. Windows
that share an anchor occurrence lie side by side; together with their bytes they are one context.

1. Texts are named by their SHA-256; equal texts of at least WINDOW bytes are repeated throughout.
2. Anchor hashes that occur once in all distinct texts rule their windows out. The others mark texts.
3. Equal contexts of marked texts become one class; a class that occurs twice is repeated throughout.
4. Classes with the same anchor are compared by suffix array. Their left and right parts are sorted
   to find where any two of them part; between such places the bytes are one symbol, so matches
   begin and end at symbols exactly. Strings of symbols of many anchors form one text, whose suffix
   array is built by the linear grouping construction (below). The longest common prefix with a
   suffix's neighbours in the array is the longest repeat that starts there.
5. Anchors with more than GROUP classes are divided: windows by how far they begin before the
   anchor, and by the bytes that such windows have in common. This repeats on ever smaller ranges
   down to single windows, where equal keys mean equal windows, so no group is unbounded.

Defined results: null and empty texts have no bytes and lose none; texts shorter than WINDOW lose
nothing; repeated rows are copies of each other; a null doc_id is a row like any other; an empty
table gives an empty result; extra columns are ignored. Long texts are processed whole.
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
from noticeloom.llm.neardup import _BYTE, mixed, powers

WINDOW, GRAM = 400, 64
#: Classes of one anchor that a task compares, and classes that it takes at once.
GROUP, BUCKET = 1000, 2000
#: How far apart windows of one divided range may begin, by level.
RANGES = (48, 8, 1)
#: Bits of a key that hold the place; texts are anchored in overlapping parts of that length.
PLACE = 24


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a text of positive numbers, by grouping suffixes by their Lyndon prefixes.

    First, suffixes are grouped by their first symbol. Groups are processed from the highest down:
    each member points to the nearest place before it that is in a lower, unprocessed group, and
    what is pointed to leaves its group for a new one just above, the more pointers the higher, as
    the processed group's prefix extends its own so many times. Then the suffixes are emitted:
    from each suffix in turn, the place before it and the places that it points back to take the
    next free seats of their groups. Nothing is renamed and no smaller text is made."""
    symbols = [*text, 0]
    n = len(symbols)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by.setdefault(c, []).append(i)
    members = [by[c] for c in sorted(by)]
    up, down = list(range(1, len(members) + 1)), list(range(-1, len(members) - 1))  # neighbours in the order of groups
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    processed = [False] * len(members)
    before = [-1] * n
    downward: list[int] = []
    now = len(members) - 1
    up[now] = -1
    while now >= 0:
        own = members[now] = sorted(i for i in members[now] if group[i] == now)
        processed[now] = True
        downward.append(now)
        pointers: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and processed[group[j]]:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        leaving: dict[tuple[int, int], list[int]] = {}
        for j, k in pointers.items():
            leaving.setdefault((-k, group[j]), []).append(j)
        for most, g in sorted(leaving):  # the most pointers first: later groups come in below them
            new = len(members)
            members.append(leaving[most, g])
            processed.append(False)
            above = up[g]
            up.append(above)
            down.append(g)
            up[g] = new
            if above >= 0:
                down[above] = new
            for j in leaving[most, g]:
                group[j] = new
        now = down[now]
    seat, seats = 0, [0] * len(members)
    for g in reversed(downward):
        seats[g] = seat
        seat += len(members[g])
    order, placed = [n - 1] + [-1] * (n - 1), [False] * n
    placed[n - 1] = True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[seats[g]] = j
            seats[g] += 1
            placed[j] = True
            j = before[j]
    return order[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in the array with the one before it."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, k = [0] * n, 0
    for i in range(n):
        if rank[i] == 0:
            k = 0
            continue
        j = order[rank[i] - 1]
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[rank[i]] = k
        k = max(0, k - 1)
    return out


# anchors and contexts


def anchored(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of each anchor: the windows that it serves start at first to last."""
    parts = []
    step = (1 << PLACE) - 2 * WINDOW
    for at in range(0, max(1, len(raw) - WINDOW + 1), step):
        found = _anchored(raw[at : at + step + WINDOW - 1])
        if len(found[0]):
            parts.append((found[0], *(x + at for x in found[1:])))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchored(raw: bytes):
    x = np.frombuffer(raw, np.uint8)
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    rise, fall = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[x] * rise[:-1], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * fall[: n - GRAM + 1])
    low = np.uint64((1 << PLACE) - 1)
    least, width, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], place[first], first, np.append(first[1:] - 1, len(place) - 1)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [anchored(t.as_py())[0].view(np.int64) for t in batch.column("raw")]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), batch.column("n_bytes"), lists], names=["doc_id", "name", "n_bytes", "anchors"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, key, class, place, low, high) of the contexts of marked texts; low and high are the
    least and largest distances of windows before the anchor."""
    for batch in slices(batches):
        for name, raw, marks in zip(batch.column("name").to_pylist(), batch.column("raw").to_pylist(), batch.column("marks"), strict=True):
            hashes, place, first, last = anchored(raw)
            use = np.flatnonzero(np.isin(hashes.view(np.int64), np.asarray(marks.values)))
            if len(use):
                h, p, f, e = (x[use] for x in (hashes.view(np.int64), place, first, last))
                head = [f"{k}:{a}:".encode() for k, a in zip(h.tolist(), (p - f).tolist(), strict=True)]
                classes = [digest(t + raw[s : z + WINDOW]) for t, s, z in zip(head, f.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(use)), pa.array(h), pa.array(classes, pa.binary()), pa.array(p), pa.array(p - e), pa.array(p - f)], names=["name", "key", "class", "place", "low", "high"])


def _context_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of chosen contexts: wanted holds structs (class, key, n, place, low, high, k)."""
    for batch in slices(batches):
        for raw, wanted in zip(batch.column("raw").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            rows = [(w["class"], w["key"], w["n"], w["low"], w["high"], w["k"], raw[w["place"] - w["high"] : w["place"] - w["low"] + WINDOW]) for w in wanted]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["class", "key", "n", "low", "high", "k", "context"])


# comparison of classes


def partings(parts: list[bytes], keys: list[int]) -> tuple[list[list[int]], dict[int, list[int]]]:
    """Symbols of each part, and the places where parts of the same key part from each other.

    Sorted parts with the same key part from their neighbours where any two of them part. Up to
    the furthest place that a part shares with another it is a string of symbols, one for the
    bytes between two such places; equal prefixes have equal symbols."""
    order = sorted(range(len(parts)), key=lambda i: (keys[i], parts[i]))
    width = max(map(len, parts))
    grid = np.zeros((len(parts), width + 1), np.uint8)
    lengths = np.array([len(parts[i]) for i in order])
    for row, i in enumerate(order):
        grid[row, : len(parts[i])] = np.frombuffer(parts[i], np.uint8)
    differs = grid[1:] != grid[:-1]
    differs[:, width] = True
    common = np.minimum(differs.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1])).tolist()
    same = [keys[a] == keys[b] for a, b in zip(order, order[1:], strict=False)]
    shared = [c if s else -1 for c, s in zip(common, same, strict=True)]
    places: dict[int, list[int]] = {}
    for row, c in enumerate(shared):
        if c >= 0:
            places.setdefault(keys[order[row]], []).append(c)
    places = {k: sorted(set(v)) for k, v in places.items()}
    symbols: list[list[int]] = [[] for _ in parts]
    fresh = 0
    current: list[int] = []  # symbols of the row before, by place
    for row, i in enumerate(order):
        back = shared[row - 1] if row else -1
        ahead = shared[row] if row < len(shared) else -1
        most, mine = max(back, ahead), []
        for depth, at in enumerate(places.get(keys[i], ())):
            if at > most:
                break
            if at <= back and depth < len(current):
                mine.append(current[depth])
            else:
                fresh += 1
                mine.append(fresh)
        symbols[i] = current = mine
    return symbols, places


def repeated_ranges(keys: list[int], contexts: list[bytes], low: list[int], high: list[int]) -> list[tuple[int, int, int]]:
    """(row, from, to): windows that start from..to bytes before their anchor occur in another row with the same key."""
    if len(keys) < 2:
        return []
    right, right_at = partings([c[h:] for c, h in zip(contexts, high, strict=True)], keys)
    left, left_at = partings([c[:h][::-1] for c, h in zip(contexts, high, strict=True)], keys)
    names: dict[tuple, int] = {}
    number = lambda *x: names.setdefault(x, len(names) + 1)
    text: list[int] = []
    starts: list[tuple[int, int, int]] = []  # place in text, row, symbols left of the anchor
    for row, key in enumerate(keys):
        if not right[row]:
            continue
        reach = len(left[row])
        for k in range(reach + 1):
            starts.append((len(text) + k, row, reach - k))
        text += [number("l", x) for x in reversed(left[row])] + [number("anchor", key)] + [number("r", x) for x in right[row]] + [number("end", row)]
    order = suffix_array(text)
    common = common_prefixes(text, order)
    common.append(0)
    rank = [0] * len(text)
    for r, i in enumerate(order):
        rank[i] = r
    out = []
    for at, row, reach in starts:
        both = max(common[rank[at]], common[rank[at] + 1]) - reach - 1
        if both > 0:
            key = keys[row]
            back = left_at[key][reach - 1] if reach else 0
            a, z = max(low[row], WINDOW - right_at[key][both - 1]), min(high[row], back)
            if a <= z:
                out.append((row, a, z))
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    found = repeated_ranges(*(pdf[c].tolist() for c in ("key", "context", "low", "high")))
    names = pdf["class"].tolist()
    return pd.DataFrame([(names[r], a, z) for r, a, z in found], columns=["class", "from", "to"]).astype({"from": "int64", "to": "int64"})


def _divided(step: int):
    """Contexts of large groups cut into ranges of windows, keyed by what all windows of a range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, key, n, low, high, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for base in range(low // step * step, high + 1, step):
                    core = context[high - base : high - (base + step - 1) + WINDOW]  # in every window of the range
                    sub = int.from_bytes(digest(f"{key}:{base}:".encode() + core)[:8], "little", signed=True)
                    p, q = max(low, base), min(high, base + step - 1)
                    piece = context[high - q : high - p + WINDOW]
                    out.append((name, sub, digest(f"{sub}:{p}:{q}:".encode() + piece), n, p, q, piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                                 names=["parent", "key", "class", "n", "low", "high", "context"])

    return run


def sized(classes: DataFrame, label: str) -> DataFrame:
    """classes with k, the number of classes with their key.

    The counts are a table of their own, so that a key with very many classes is joined in parts."""
    sizes = stored(classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), f"{label}-sizes")
    out = stored(classes.join(sizes, "key", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long"))), label)
    dropped(sizes)
    return out


def repeated_classes(classes: DataFrame, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(class, from, to) of classes(class, key, n, low, high, context, k), and the tables that it reads."""
    found = classes.where("n > 1").select("class", F.col("low").alias("from"), F.col("high").alias("to"))
    several = classes.where((F.col("k") > 1) & (F.col("k") <= GROUP))  # at the last level equal keys mean equal windows, so k is 1
    total = several.count()
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, total // BUCKET + 1)))
    small = several.select(bucket.alias("bucket"), "class", "key", "low", "high", "context")
    pairs = stored(small.groupBy("bucket").applyInPandas(_compare, "class binary, from long, to long"), f"repeat-found-{level}")
    found, used = found.unionByName(pairs), [classes, pairs]
    large = classes.where(F.col("k") > GROUP)
    if level == len(RANGES) or not large.limit(1).count():
        return found, used
    parts = stored(large.select("class", "key", "n", "low", "high", "context").mapInArrow(_divided(RANGES[level]), "parent binary, key long, class binary, n long, low long, high long, context binary"), "repeat-parts")
    merged = parts.groupBy("class").agg(*(F.first(c).alias(c) for c in ("key", "low", "high", "context")), F.sum("n").alias("n")).select("class", "key", "n", "low", "high", "context")
    ranges, more = repeated_classes(sized(merged, "repeat-classes"), level + 1)
    return found.unionByName(parts.select("parent", "class").join(ranges, "class").select(F.col("parent").alias("class"), "from", "to")), [*used, parts, *more]


# documents


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of byte ranges (start, end), in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names, removed, spans, kept = batch.column("name"), [], [], []
        for raw, starts in zip(batch.column("raw").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            runs = covered([(x["first"], x["last"] + WINDOW) for x in starts])
            at, rest = 0, []
            for s, e in runs:
                rest.append(raw[at:s])
                at = e
            left = b"".join([*rest, raw[at:]])
            removed.append(len(raw) - len(left))
            spans.append([{"start": s, "end": e} for s, e in runs])
            kept.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([names, pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept)], names=["name", "n_removed", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) of every row of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", raw.alias("raw"), F.sha2(raw, 256).alias("name"), F.octet_length(raw).cast("long").alias("n_bytes"))
    seen = stored(mapped(rows, _hashes, f"doc_id {kind}, name string, n_bytes long, anchors array<long>"), "repeat-anchors")

    # distinct texts, and the anchors that they do not have alone
    texts = stored(seen.groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("anchors").alias("anchors")).where(F.size("anchors") > 0), "repeat-texts")
    anchors = texts.select("name", F.explode("anchors").alias("h"))
    common = stored(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeat-common")
    marks = anchors.join(common, "h").groupBy("name").agg(F.collect_set("h").alias("marks"))
    marks = marks.join(texts.select("name", "first"), "name").select(F.col("name").alias("own"), "first", "marks")
    mine = rows.select("doc_id", "name", "raw").join(marks, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("name") == F.col("own")))
    marked = stored(mine.select("name", "raw", "marks"), "repeat-marked")
    dropped(common)

    # contexts, their classes, and the bytes of one context of each class that is not alone in its key
    contexts = stored(mapped(marked, _contexts, "name string, key long, class binary, place long, low long, high long"), "repeat-contexts")
    classes = contexts.groupBy("class").agg(F.min(F.struct("name", "place", "low", "high", "key")).alias("x"), F.count("*").alias("n"))
    classes = sized(classes.select("class", "n", "x.*"), "repeat-classes")
    whole = classes.where("k = 1 AND n > 1").select("class", F.col("low").alias("from"), F.col("high").alias("to"))
    compared = classes.where("k > 1").groupBy("name").agg(F.collect_list(F.struct("class", "key", "n", "place", "low", "high", "k")).alias("wanted"))
    texts_of = marked.select("name", "raw")
    filled = mapped(texts_of.join(compared, "name").select("raw", "wanted"), _context_bytes, "class binary, key long, n long, low long, high long, k long, context binary")
    filled = stored(filled.dropDuplicates(["class"]), "repeat-filled")
    found, used = repeated_classes(filled)
    ranges = whole.unionByName(found)

    # ranges of windows become ranges of starts in each text, and those what is left of it
    starts = contexts.join(ranges, "class").groupBy("name").agg(F.collect_set(F.struct((F.col("place") - F.col("to")).alias("first"), (F.col("place") - F.col("from")).alias("last"))).alias("starts"))
    starts = stored(starts, "repeat-starts")
    dropped(contexts, classes, *used)
    cut = mapped(texts_of.join(starts, "name").select("name", "raw", "starts"), _removed, "name string, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    cut = stored(cut.dropDuplicates(["name"]), "repeat-cut")
    dropped(marked, starts)
    copies = texts.where("copies > 1").select(F.col("name").alias("copied"))
    out = seen.select("doc_id", "name", "n_bytes").join(cut, "name", "left").join(copies, F.col("name") == F.col("copied"), "left")
    all_ = F.col("copied").isNotNull() & (F.col("n_bytes") >= WINDOW)
    span = F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    empty = hashlib.sha256(b"").hexdigest()
    out = stored(out.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.array(span)).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("spans"),
        F.when(all_, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "name")).alias("kept_sha256")), "repeats")
    dropped(seen, texts, cut)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut from text; bytes of characters that a cut splits are dropped."""
    i, n, cuts_of = unused(docs, "id", "n", "cuts")
    spans = repeated_spans(docs).where("n_removed > 0").select(F.col("doc_id").alias(i), F.col("n_bytes").alias(n), F.col("spans").alias(cuts_of)).dropDuplicates([i, n, cuts_of])
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(i)) & (F.octet_length("text") == F.col(n)), "left").select(*(docs[c] for c in docs.columns), cuts_of)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, cuts in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if cuts:
                    raw, bounds = t.encode(), [0, *(x for c in cuts for x in (c["start"], c["end"]))]
                    t = "".join(raw[s:e].decode("utf-8", "ignore") for s, e in zip(bounds[::2], [*bounds[1::2], len(raw)], strict=True))
                texts.append(t)
            columns = [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return mapped(joined, run, docs.schema)
