"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document d of source s gets a rate r_d. Among all rates with the source's token total at its
target and 0 <= r_d <= 2, entropy balancing takes those closest to 1 in weighted relative entropy. The dual
is convex with one multiplier per source, and its solution tilts the rates exponentially:

    r_d = min(2, exp(lambda_s * z_d)),   z_d = size_d / (mean size + size_d)

Relative entropy counts a document with the weight mean size + size, so that neither a few very long
documents nor very many short ones bear the whole change. Newton iterations on the multipliers run over the histogram (source, size, documents), which is
all the dual needs; they are joins and aggregates over that table, with nothing gathered on the
driver but the largest relative error. Rates become copies per size class: cumulated copies are
rounded along the sizes, which misses the target by little more than the largest document, and
what is amiss is made up among the smallest ones. No document is taken more than twice.

Defined results: a null text has size 0; null sources come last and form one source; documents
of size 0 take 0 words; an empty table gives an empty result. Repeated rows are documents of their
own. Order within a class is by a hash of doc_id, so reruns agree. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeloom.llm.common import WORD, dropped, stored, unused

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
#: Newton ends when every source is this near its target, or after so many steps.
TOLERANCE, STEPS = 1e-6, 30
#: Most classes that are broadcast, some 50 bytes each.
CLASS_ROWS = 200_000
#: Rows of one window: classes with more documents are ranked in parts.
PART_ROWS = 1000


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(hist: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target): shares of the budget by weight, stopped at most * source_size.

    Sources that stop give their excess to the others by weight; this fills up to a common level,
    found by ordering the sources by cap per weight. One row a source: the windows are small."""
    s = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    done = by.rowsBetween(W.unboundedPreceding, -1)
    rest = by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(0))
    s = s.withColumn("level", (budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that does not stop sets the level
    s = s.withColumn("share", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))).cast("double").alias("target"))


def _rate(lam: Column, z: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(lam * z, F.lit(3.0))))


def balanced(hist: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """(source, size, docs, rate): Newton iterations on the dual, one multiplier per source.

    A source whose target equals its bound has no finite multiplier; its rates are the bound."""
    joined = hist.join(targets, hist["source"].eqNullSafe(targets["source"])).select(hist["source"], "size", "docs", "source_size", "target")
    total = F.sum("docs").over(W.partitionBy("source"))
    base = stored(joined.where(F.col("size") > 0).withColumn("z", F.col("size") / (F.col("source_size") / total + F.col("size"))).withColumn("w", F.col("size") * F.col("docs")), "mix-base")
    lam = base.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    lam = stored(lam, "mix-lam")
    for _ in range(steps):
        m = lam.withColumnRenamed("source", "s").select("s", "lam")
        rated = base.join(m, base["source"].eqNullSafe(m["s"])).withColumn("r", _rate(F.col("lam"), F.col("z"), most))
        sums = rated.groupBy("s").agg(F.sum(F.col("w") * F.col("r")).alias("got"), F.sum(F.when(F.col("r") < most, F.col("w") * F.col("z") * F.col("r")).otherwise(0.0)).alias("slope"))
        step = lam.join(sums, lam["source"].eqNullSafe(sums["s"]))
        gap = F.col("got") - F.col("target")
        # the multiplier stays between the bounds that the signs of earlier gaps have set
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        fallback = F.when(high >= 1e6, F.greatest(low * 2, F.lit(1.0))).when(low <= -1e6, F.least(high * 2, F.lit(-1.0))).otherwise((low + high) / 2)
        step = step.select("source", "target", "source_size", F.when(gap == 0, F.col("lam")).when(inside, newton).otherwise(fallback).alias("lam"), low.alias("low"), high.alias("high"),
                           F.when(F.col("target") >= most * F.col("source_size"), 0.0).otherwise(F.abs(gap) / F.col("target")).alias("error"))
        new = stored(step, "mix-lam")
        worst = new.agg(F.max("error")).first()[0] or 0.0
        dropped(lam)
        if worst <= tolerance:
            lam = new.drop("error")
            break
        lam = new.drop("error")
    m = lam.select(F.col("source").alias("s"), "lam")
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("z"), most))
    return base.join(m, base["source"].eqNullSafe(m["s"])).select(base["source"], "size", "docs", rate.alias("rate"))


def hash_part(docs: Column, part_rows: int) -> Column:
    """Part of a class of that many documents into which the hash of doc_id falls."""
    return F.pmod(F.xxhash64("doc_id"), F.ceil(docs / part_rows))


def hash_order(docs: Column, part_rows: int = PART_ROWS) -> Column:
    """By what the documents of a class are ordered."""
    return F.struct(hash_part(docs, part_rows).alias("p"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("i"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) of every row of docs(doc_id, text, source)."""
    rows = stored(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), "mix-rows")
    hist = stored(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-hist")
    targets = stored(source_targets(hist, weights, budget, most), "mix-targets")
    rates = balanced(hist, targets, most)  # reads two tables of its own

    by_size = W.partitionBy("source").orderBy(F.col("size").desc())
    upto = by_size.rowsBetween(W.unboundedPreceding, 0)
    cum = F.floor(F.sum(F.col("docs") * F.col("rate")).over(upto) + F.lit(0.5 - 1e-9))
    classes = rates.withColumn("cum", cum).withColumn("n", F.greatest(F.col("cum") - F.coalesce(F.lag("cum").over(by_size), F.lit(0)), F.lit(0)))
    # what a source still lacks or has too much, less than its largest document, is made up among its smallest ones
    whole = W.partitionBy("source")
    classes = classes.join(F.broadcast(targets) if targets_small(targets) else targets, rates["source"].eqNullSafe(targets["source"])).select(rates["source"], "size", "docs", "rate", "n", "target")
    classes = classes.withColumn("gap", F.col("target") - F.sum(F.col("n") * F.col("size")).over(whole))
    below = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    room = F.when(F.col("gap") > 0, most * F.col("docs") - F.col("n")).otherwise(F.col("n"))
    classes = classes.withColumn("room", room)
    done = F.coalesce(F.sum(F.col("room") * F.col("size")).over(below), F.lit(0.0))
    change = F.least(F.greatest(F.floor((F.abs("gap") - done) / F.col("size")), F.lit(0)), F.col("room")).cast("long")
    classes = classes.withColumn("n", F.col("n") + F.signum("gap").cast("long") * change)
    classes = classes.select(F.col("source").alias("s"), F.col("size").alias("z"), "docs", "rate", "n")
    plan = stored(classes, "mix-classes")
    dropped(rates, hist)

    # documents of a class in an order of hashes; large classes are ranked in parts, whose sizes are added up first
    h = F.xxhash64("doc_id")
    marked = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["size"] == plan["z"]), "left").drop("s", "z")
    marked = marked.withColumn("part", F.coalesce(hash_part(F.col("docs"), part_rows), F.lit(0)))
    sizes = marked.groupBy("source", "size", "part").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), before.alias("before"))
    ranked = marked.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "part").orderBy(h, "doc_id")))
    ranked = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["s"]) & (ranked["size"] == offsets["z"]) & (ranked["part"] == offsets["p"]))
    copies = F.floor(F.col("n") / F.col("docs")) + F.when(F.col("before") + F.col("rank") <= F.col("n") % F.col("docs"), 1).otherwise(0)
    out = ranked.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int"))
    t = targets.withColumnRenamed("source", "s")
    out = out.drop("s").join(F.broadcast(t) if targets_small(targets) else t, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies")
    out = stored(out, "mix")
    dropped(rows, targets, plan)
    return out


def targets_small(targets: DataFrame, most_rows: int = 5000) -> bool:
    """Whether a table of sources may be broadcast; beyond that many rows it is joined by shuffling."""
    return targets.limit(most_rows + 1).count() <= most_rows


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """docs with every row as often as the mix takes it.

    A class (source, size) takes its documents up to a hash once more than the others, so rows meet
    one row of their class, and texts are not shuffled unless the table of classes is too large to broadcast.
    Rows that id, source and size do not tell apart are told apart by their texts, in a shuffle."""
    taken = mix(docs, weights, budget, most).select("doc_id", "source", "size", "copies")
    size, turn, mark, copies, copy, i, s, z, t = unused(docs, "size", "turn", "mark", "copies", "copy", "i", "s", "z", "t")
    sized = docs.withColumn(size, text_size(F.col("text")))
    key = ["doc_id", "source", "size"]
    if taken.groupBy(*key).count().where("count > 1").limit(1).count():
        by = lambda *order: F.row_number().over(W.partitionBy(*order[:3]).orderBy(order[3]))
        sized = sized.withColumn(turn, by("doc_id", "source", size, "text"))
        rows = taken.withColumn("turn", by(*key, "copies")).where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z), F.col("turn").alias(t), F.col("copies").alias(copies))
        out = sized.join(rows, sized["doc_id"].eqNullSafe(F.col(i)) & sized["source"].eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)) & (F.col(turn) == F.col(t)))
    else:
        few = taken.groupBy("source", "size").agg(F.min("copies").alias("few"), F.max("copies").alias("many"), F.count("*").alias("docs")).select(F.col("source").alias("s"), F.col("size").alias("z"), "few", "many", "docs")
        last = taken.join(few, taken["source"].eqNullSafe(F.col("s")) & (taken["size"] == F.col("z"))).where("copies > few").groupBy("source", "size").agg(F.max(hash_order(F.col("docs"))).alias("last"))
        last = last.select(F.col("source").alias("ls"), F.col("size").alias("lz"), "last")
        classes = few.join(last, few["s"].eqNullSafe(F.col("ls")) & (few["z"] == F.col("lz")), "left").where("many > 0").select(F.struct("few", "many", "docs", "last").alias(mark), F.col("s").alias(s), F.col("z").alias(z))
        classes = stored(classes, "mix-marks")
        out = sized.join(F.broadcast(classes) if targets_small(classes, CLASS_ROWS) else classes, sized["source"].eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)))
        m = F.col(mark)
        out = out.withColumn(copies, F.when(m["last"].isNotNull() & (hash_order(m["docs"]) <= m["last"]), m["many"]).otherwise(m["few"]))
        dropped(taken)
    return out.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
