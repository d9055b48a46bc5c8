"""Text boxes of documents: acceptance, collation of overlapping readings, voting, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.geometry import overlap_share, rectangles_touch
from noticeloom.functions.text import let, ngrams, tokens
from noticeloom.sources.shared import shared_folder

BOX = "doc_id long, ord int, text string, confidence double, x double, y double, width double, height double"
COMPLETE = ("text", "confidence", "x", "y", "width", "height")


def is_repetitive(text: Column) -> Column:
    """More than half of the bytes are i, l or I."""
    return F.char_length(F.regexp_replace(text, "[^ilI]", "")) > F.floor((F.octet_length(text) + 1) / 2)


def has_triple(text: Column) -> Column:
    """A character three times in a row."""
    return text.rlike(r"(?s)(.)\1\1")


def is_garbage(text: Column, compat: bool = False) -> Column:
    """A run of four equal characters; with compat, one that ends before the text does."""
    return text.rlike(r"(?s)(.)\1{3,}(?!\1)." if compat else r"(?s)(.)\1{3}")


def acceptable(text: Column, confidence: Column) -> Column:
    """Whether a reading is kept: long and sure enough, and neither doubled nor repetitive."""
    n = F.octet_length(text)
    doubled = (n == 2) & (F.substring(text, 1, 1) == F.substring(text, 2, 1))
    return ~((n < 2) | (confidence < 51) | doubled | ((n < 4) & (confidence < 60)) | is_repetitive(text))


def complete(boxes: DataFrame) -> DataFrame:
    """Boxes with all their members."""
    return boxes.na.drop(subset=list(COMPLETE))


#: Documents with more boxes are cut into cells of a grid, so that they spread over tasks.
SPLIT = 1000
#: The level of documents that are not cut.
_WHOLE = -(1 << 20)


def _level(width: Column, height: Column) -> Column:
    """The power of two that neither side exceeds."""
    return F.ceil(F.log2(F.greatest(width, height, F.lit(1e-9)))).cast("int")


def _met(boxes: DataFrame, key: str, order: str, split: int) -> tuple[DataFrame, Column]:
    """(a_ and b_ columns of boxes of one document that may meet, the condition under which a pair counts).

    In a large document a box stands in the cells (two by two at most) of a grid as wide as its longer side,
    rounded up to a power of two, and in those of all wider grids that the document's boxes have. Two boxes are
    compared in the grid of the larger one, and count in the cell of their overlap's lower corner only."""
    large = boxes.groupBy(key).agg(F.count("*").alias("_n"), F.max(_level(F.col("width"), F.col("height"))).alias("_top")).where(F.col("_n") > split).select(F.col(key).alias("_key"), "_top")
    placed = boxes.join(large, F.col(key) == F.col("_key"), "left").withColumn("_own", _level(F.col("width"), F.col("height")))
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level))
    span = lambda v, size, level: F.sequence(cell(v, level), cell(v + size, level))
    at = lambda level: F.flatten(F.transform(span(F.col("x"), F.col("width"), level), lambda cx: F.transform(span(F.col("y"), F.col("height"), level), lambda cy: F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy")))))
    whole = F.array(F.struct(F.lit(_WHOLE).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))
    placed = placed.withColumn("_at", F.explode(F.when(F.col("_top").isNull(), whole).otherwise(F.flatten(F.transform(F.sequence(F.col("_own"), F.col("_top")), at)))))
    names = ("x", "y", "width", "height", order, "_own")
    side = lambda p: placed.select(key, "_at", *(F.col(c).alias(f"{p}_{c}") for c in names))
    level = F.col("_at.level")
    corner = lambda v: cell(F.greatest(f"a_{v}", f"b_{v}"), level)
    once = (level == _WHOLE) | ((level == F.greatest("a__own", "b__own")) & (F.col("_at.cx") == corner("x")) & (F.col("_at.cy") == corner("y")))
    return side("a").join(side("b"), [key, "_at"]), once & (F.col(f"a_{order}") < F.col(f"b_{order}"))


_SIDES = ("a_x", "a_y", "a_width", "a_height", "b_x", "b_y", "b_width", "b_height")


def overlap_pairs(boxes: DataFrame, least: float = 0.8, key: str = "doc_id", order: str = "ord", split: int = SPLIT) -> DataFrame:
    """(key, a, b, share): pairs of a document's boxes whose common area exceeds a share of the larger.

    The join is by document, and by cell where a document has more than split boxes."""
    both, counts = _met(boxes, key, order, split)
    share = overlap_share(*map(F.col, _SIDES))
    return both.where(counts & (share > least)).select(key, F.col(f"a_{order}").alias("a"), F.col(f"b_{order}").alias("b"), share.alias("share"))


def touching_pairs(boxes: DataFrame, key: str = "doc_id", order: str = "ord", split: int = SPLIT) -> DataFrame:
    """(key, a, b): pairs of a document's boxes that touch as closed rectangles; joined as in ``overlap_pairs``."""
    both, counts = _met(boxes, key, order, split)
    return both.where(counts & rectangles_touch(*map(F.col, _SIDES))).select(key, F.col(f"a_{order}").alias("a"), F.col(f"b_{order}").alias("b"))


def _winner(a: dict, b: dict) -> int:
    """0 if the first box stays, 1 if the second, -1 for both: the surer one, the first if they tie in length too."""
    if a["confidence"] != b["confidence"]:
        return int(b["confidence"] > a["confidence"])
    return 0 if len(a["text"]) == len(b["text"]) else -1


def collate_boxes(rows: list[dict], least: float) -> list[dict]:
    """Greedy collation in order; winners take over what losers replaced, and the losers."""
    boxes = [r | {"replaces": list(r.get("replaces") or [])} for r in rows]

    def share(a, b):
        wide = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
        high = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
        larger = max(a["width"] * a["height"], b["width"] * b["height"])
        return wide * high / larger if wide > 0 and high > 0 and larger > 0 else 0.0

    i = 0
    while i < len(boxes):
        j, lost = i + 1, False
        while j < len(boxes) and not lost:
            who = _winner(boxes[i], boxes[j]) if share(boxes[i], boxes[j]) > least else -1
            if who < 0:
                j += 1
                continue
            stays, goes = (boxes[i], boxes[j]) if who == 0 else (boxes[j], boxes[i])
            stays["replaces"] += [*goes["replaces"], {"text": goes["text"], "confidence": goes["confidence"]}]
            boxes.remove(goes)
            lost = who == 1
        i += not lost
    return boxes


def collate(boxes: DataFrame, least: float = 0.8, split: int = SPLIT) -> DataFrame:
    """boxes (see BOX) with near-equal readings merged, and replaces: what each winner stands for.

    Order decides, but only among boxes that overlap, directly or through others. So a document's boxes are
    one group, or, where it has more than split of them, each connected set is one. Groups without an
    overlapping pair pass through, the others are handed to Python. Boxes of one order number go by their members."""
    full = complete(boxes).select("doc_id", F.col("ord").cast("int").alias("ord"), "text", *(F.col(c).cast("double").alias(c) for c in COMPLETE[1:]))
    members = [c.split()[0] for c in BOX.split(", ") if not c.startswith("doc_id")]
    kind = dict(boxes.dtypes)["doc_id"]
    schema = BOX.replace("doc_id long", f"doc_id {kind}") + ", replaces array<struct<text:string,confidence:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | {"doc_id": d} for d, boxes in zip(batch.column("doc_id").to_pylist(), batch.column("boxes").to_pylist(), strict=True) for r in collate_boxes(boxes, least)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", batch.schema.field("doc_id").type), ("ord", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in COMPLETE[1:]),
                                                                  ("replaces", pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64())])))]))

    sides = lambda a, b: (a[c] for x in (a, b) for a, c in ((x, "x"), (x, "y"), (x, "width"), (x, "height")))
    meets = lambda rows: F.exists(F.transform(rows, lambda a, i: F.exists(F.slice(rows, i + 2, F.size(rows)), lambda b: overlap_share(*sides(a, b)) > least)), lambda x: x)
    large = full.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > split).select("doc_id")
    groups = full
    group = ["doc_id"]
    if not large.isEmpty():
        groups, group = _connected(full, large, members, least), ["doc_id", "part"]
    documents = groups.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*members))).alias("boxes"))
    documents = documents.withColumn("meets", let(F.col("boxes"), meets))
    merged = documents.where("meets").select("doc_id", "boxes").mapInArrow(run, schema)
    rest = documents.where("NOT meets").select("doc_id", F.explode("boxes").alias("b")).select("doc_id", "b.*").withColumn("replaces", F.array().cast("array<struct<text:string,confidence:double>>"))
    return merged.unionByName(rest)


def _connected(full: DataFrame, large: DataFrame, members: list[str], least: float) -> DataFrame:
    """full with part: 0 in small documents, in large ones a name of the set of boxes that overlaps connect."""
    spark, folder = full.sparkSession, shared_folder(full.sparkSession, "collate")
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    name = F.xxhash64(*members).alias("box")  # equal boxes are one here, and copies of it in their group
    cut = full.join(large, "doc_id", "left_semi").select("*", name)
    pairs = kept(overlap_pairs(cut.select("doc_id", "box", "x", "y", "width", "height").distinct(), least, order="box", split=0), "pairs")
    edges = pairs.select("doc_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select("doc_id", F.col("b").alias("u"), F.col("a").alias("v")))
    names = kept(edges.groupBy("doc_id", "u").agg(F.least(F.first("u"), F.min("v")).alias("part")), "names0")
    turn = 0
    while True:  # each box takes the least name around it, and then that box's own, until none changes
        turn += 1
        near = edges.join(names.select("doc_id", F.col("u").alias("v"), "part"), ["doc_id", "v"]).groupBy("doc_id", "u").agg(F.min("part").alias("near"))
        step = names.join(near, ["doc_id", "u"]).select("doc_id", "u", F.col("part").alias("old"), F.least("part", "near").alias("c"))
        above = names.select("doc_id", F.col("u").alias("c"), F.col("part").alias("up"))
        new = kept(step.join(above, ["doc_id", "c"], "left").select("doc_id", "u", "old", F.least("c", F.coalesce("up", "c")).alias("part")), f"names{turn}")
        names = new.select("doc_id", "u", "part")
        if new.where("old <> part").isEmpty():
            break
    parts = cut.join(names.withColumnRenamed("u", "box"), ["doc_id", "box"], "left").withColumn("part", F.coalesce("part", "box")).drop("box")
    return full.join(large, "doc_id", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(parts)


def title_pool(boxes: DataFrame, entities: DataFrame, compat: bool = False) -> DataFrame:
    """Boxes that may be titles: sure, no garbage, and without facts of other kinds."""
    facts = entities.where(F.col("kind").isin("date", "datetime", "dayofweek", "streetaddress", "city", "price")).select("doc_id", "ord").distinct()
    return complete(boxes).where((F.col("confidence") > 70) & ~is_garbage(F.col("text"), compat)).join(facts, ["doc_id", "ord"], "left_anti")


def largest(boxes: DataFrame, count: int = 5, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """The boxes with the largest areas of each document; of equal areas the last one stands."""
    area = F.col("width") * F.col("height")
    one = boxes.withColumn("area", area).withColumn("r", F.row_number().over(W.partitionBy(key, "area").orderBy(F.col(order).desc()))).where("r = 1").drop("r")
    return one.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col("area").desc()))).where(F.col("rank") <= count)


def without_overlaps(boxes: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Of touching boxes the less sure ones go; of equally sure ones the earlier."""
    pairs = touching_pairs(boxes, key, order)
    sure = boxes.select(key, F.col(order).alias("o"), F.col("confidence").alias("c"))
    a, b = sure.select(key, F.col("o").alias("a"), F.col("c").alias("ca")), sure.select(key, F.col("o").alias("b"), F.col("c").alias("cb"))
    loser = F.when(F.col("ca") <= F.col("cb"), F.col("a")).otherwise(F.col("b"))
    gone = pairs.join(a, [key, "a"]).join(b, [key, "b"]).select(key, loser.alias(order)).distinct()
    return boxes.join(gone, [key, order], "left_anti")


#: Members of a box that may be a title, in the order by which boxes are compared.
TITLE_BOX = ("area", "ord", "confidence", "x", "y", "width", "height", "text")


def title_boxes(boxes: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """(key, pool): the boxes of each document as one array."""
    box = F.struct((F.col("width") * F.col("height")).alias("area"), F.col(order).alias("ord"), *TITLE_BOX[2:])
    return boxes.groupBy(key).agg(F.collect_list(box).alias("pool"))


def title_of(pool: Column) -> Column:
    """(title, description) of an array of boxes: the five largest (see largest and without_overlaps) by
    distance from the origin; the first is the title, the others the description."""
    first_of_area = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (x["area"] != F.get(rows, i - 1)["area"]))
    sides = lambda a: (a["x"], a["y"], a["width"], a["height"])
    beaten = lambda a, b: ((a["ord"] < b["ord"]) & (a["confidence"] <= b["confidence"])) | ((a["ord"] > b["ord"]) & (a["confidence"] < b["confidence"]))
    left = lambda rows: F.filter(rows, lambda a: ~F.exists(rows, lambda b: beaten(a, b) & rectangles_touch(*sides(a), *sides(b))))
    place = lambda a: F.struct((a["x"] * a["x"] + a["y"] * a["y"]).alias("d"), a["ord"].alias("ord"), a["text"].alias("text"))
    five = let(F.sort_array(pool, asc=False), lambda rows: F.filter(F.slice(first_of_area(rows), 1, 5), lambda x: ~has_triple(x["text"])))
    ordered = let(five, lambda rows: F.array_sort(F.transform(left(rows), place)))
    return let(ordered, lambda s: F.when(F.size(s) > 0, F.struct(F.get(s, F.lit(0))["text"].alias("title"), F.array_join(F.transform(F.slice(s, 2, 5), lambda x: x["text"]), "\n").alias("description"))))


def titles(boxes: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """(key, title, description) of the documents that have a title."""
    return title_boxes(boxes, key, order).select(key, title_of(F.col("pool")).alias("t")).where("t IS NOT NULL").select(key, "t.title", "t.description")


def box_ngrams(boxes: DataFrame, key: tuple[str, ...] = ("doc_id", "ord"), text: str = "text", longest: int | None = None) -> DataFrame:
    """(key, base, n, ngram, confidence): every run of a box's words (of at most so many characters); confidence is the box's own."""
    more = ["confidence"] if "confidence" in boxes.columns else []
    return boxes.select(*key, *more, F.posexplode(ngrams(tokens(F.col(text)), longest)).alias("n", "ngram"))


# voting


def alignment(winner: str, reading: str) -> list[str]:
    """What of a reading stands for each character of the winner.

    A character takes any stretch of the reading at a cost of 1 plus the stretch's distance from
    one character, with a bonus of 5 where the characters after both agree. So a row's costs follow from
    the one before: an empty stretch costs 2 and any other its length less the bonus at its start,
    which is a running minimum. Stretches are read off backwards: each begins at the first of the
    cheapest places in its row that are not behind the one before."""
    if not winner:
        return []
    place = np.arange(len(reading) + 1)
    after = np.array([*map(ord, reading[1:]), 0, 0][: len(place)])
    costs = [np.zeros(len(place), np.int64)]
    for follows in [*map(ord, winner[1:]), 0]:
        starts = np.minimum.accumulate(costs[-1] - place - 5 * (after == follows))
        row = costs[-1] + 2
        row[1:] = np.minimum(row[1:], starts[:-1] + place[1:])
        costs.append(row)
    bounds = [len(reading)]
    for row in reversed(costs):
        bounds.append(int(row[: bounds[-1] + 1].argmin()))
    bounds.reverse()
    return [reading[s:e] for s, e in zip(bounds[:-2], bounds[1:-1], strict=True)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def aligned(winner: pd.Series, reading: pd.Series) -> pd.Series:
    return pd.Series([alignment(w or "", r or "") for w, r in zip(winner, reading, strict=True)])


def ballots(collated: DataFrame, key: tuple[str, ...] = ("doc_id", "ord")) -> DataFrame:
    """(key, pos, own, candidate, confidence, reading): what each reading puts at each place of the winner."""
    some = collated.where(F.size("replaces") > 0)
    others = some.select(*key, "text", F.posexplode("replaces").alias("reading", "r")).select(*key, "text", "reading", F.col("r.confidence").alias("confidence"), aligned("text", F.col("r.text")).alias("parts"))
    own = some.select(*key, "text", F.size("replaces").alias("reading"), "confidence", F.regexp_extract_all("text", F.lit(r"(?s)."), F.lit(0)).alias("parts"))
    every = others.unionByName(own)
    return every.select(*key, "text", "reading", "confidence", F.posexplode("parts").alias("pos", "candidate")).select(*key, "pos", F.expr("substring(text, pos + 1, 1)").alias("own"), "candidate", "confidence", "reading")


def elected(votes: DataFrame, key: tuple[str, ...] = ("doc_id", "ord")) -> DataFrame:
    """(key, text): at each place the candidate with the most confidence; of equals the one that got there first."""
    by = W.partitionBy(*key, "pos", "candidate").orderBy("reading").rowsBetween(W.unboundedPreceding, 0)
    run = votes.withColumn("sum", F.sum("confidence").over(by))
    best = run.groupBy(*key, "pos").agg(F.max(F.struct("sum", (-F.col("reading")).alias("first"), "candidate")).alias("b"))
    return best.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("b.candidate").alias("c")))), lambda x: x["c"]), "").alias("text"))


def vote(collated: DataFrame) -> DataFrame:
    """collated boxes with the elected text; those without other readings keep theirs."""
    won = elected(ballots(collated)).withColumnRenamed("text", "elected")
    return collated.join(won, ["doc_id", "ord"], "left").withColumn("text", F.coalesce("elected", "text")).drop("elected", "replaces")


def substitution_costs(votes: DataFrame) -> DataFrame:
    """(a, b, n, cost): how often characters stand for one another, in both directions; cost is 1 - n / most."""
    low = votes.select(F.lower("own").alias("a"), F.lower("candidate").alias("b")).where("a != b")
    both = low.unionByName(low.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy(F.lit(0)))  # pairs of characters are few
    return counts.select("a", "b", "n", (1 - F.col("n") / most).alias("cost"))
