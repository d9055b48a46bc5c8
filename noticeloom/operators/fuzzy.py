"""Spelling: dictionaries, edit distances and the fuzzy join.

The fuzzy join is an equi-join on delete keys: two words within k edits share a string that is at
most k deletions away from each. Candidates are verified by distance, and only the nearest stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeloom.functions.text import escape_umlauts, let
from noticeloom.sources.files import chosen, qualified

MOST, SHARE = 2, 0.2


def dictionary(terms: DataFrame, term: str = "term", keys: tuple[str, ...] = ("dict_key", "subkey")) -> DataFrame:
    """(keys, term, count) of a table of terms: lower-cased, counted; missing keys are null."""
    named = terms.select(*(F.col(k) if k in terms.columns else F.lit(None).cast("string").alias(k) for k in keys), F.lower(F.trim(F.col(term))).alias("term"))
    return named.where("term != ''").groupBy(*keys, "term").agg(F.count("*").alias("count"))


def read_dictionaries(spark: SparkSession, path: str, glob: str = "*.txt", pattern: str | None = None, depth: int = -1) -> DataFrame:
    """(dict_key, subkey, term) of text files with a term a line; the file's name is the key.

    Files may be chosen by a glob, by a pattern that their whole name has to fit, and by a depth (see ``files.located``)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    if pattern is not None or depth >= 0:
        lines = lines.where(chosen(F.col("_metadata.file_path"), qualified(spark, path), pattern, depth))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return lines.select(F.substring_index(name, "_", 1).alias("dict_key"), F.when(name.contains("_"), F.regexp_replace(name, "^[^_]*_", "")).alias("subkey"), F.col("value").alias("term"))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, cost) of lines ``a|b|cost``; lines with fewer fields are skipped, fields may be empty or a space."""
    parts = F.split("value", r"\|", -1)
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("p")[2].cast("double").alias("cost"))


def cost_lines(costs: DataFrame) -> DataFrame:
    """One text column ``a|b|cost``, to be written with write.text."""
    return costs.select(F.concat_ws("|", "a", "b", F.col("cost").cast("string")).alias("value"))


def default_costs(spark: SparkSession, characters: str) -> DataFrame:
    """(a, b, cost) of all pairs from a fixed, small alphabet: 0 for equal ones, else 1."""
    one = spark.createDataFrame([(c,) for c in sorted(set(characters))], "a string")
    every = F.array(*(F.lit(c) for c in sorted(set(characters))))
    return one.select("a", F.explode(every).alias("b")).select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0).alias("cost"))


def deletes(word: Column, most: int = MOST) -> Column:
    """Distinct strings that at most that many deletions leave of a word, the word included."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
    shorter = lambda w: F.when(F.char_length(w) > 0, once(w)).otherwise(F.array().cast("array<string>"))

    def layers(layer: Column, left: int) -> Column:
        if not left:
            return layer
        return let(F.array_distinct(F.flatten(F.transform(layer, shorter))), lambda x: F.array_union(layer, layers(x, left - 1)))

    return let(F.array(word), lambda x: layers(x, most))


#: Characters of a word that delete keys are made of.
PREFIX = 8


def delete_index(terms: DataFrame, term: str = "term", most: int = MOST, prefix: int | None = None) -> DataFrame:
    """terms with one row for each delete key, of the whole term or of its first characters.

    Prefixes lose no pair: if a and b are within k edits, the first p characters of the one meet those of
    the other, or fewer, within k edits, and what is over can be deleted for the insertions that pushed it out.
    So a word has a fixed number of keys, however long it is."""
    word = F.col(term) if prefix is None else F.substring(term, 1, prefix)
    return terms.select("*", F.explode(deletes(word, most)).alias("delete_key"))


def candidates(words: DataFrame, known: DataFrame, most: int = MOST, prefix: int = PREFIX) -> DataFrame:
    """(_w, _t): pairs that share a delete key of their prefixes and differ by at most so many characters in length.

    Lengths are part of the key, so words of other lengths never meet, and many words of one beginning are cut by their lengths."""
    left = delete_index(words.withColumn("_n", F.char_length("_w")), "_w", most, prefix)
    right = delete_index(known.withColumn("_n", F.explode(F.sequence(F.greatest(F.char_length("_t") - most, F.lit(0)), F.char_length("_t") + most))), "_t", most, prefix)
    return left.join(right, ["delete_key", "_n"]).select("_w", "_t").distinct()


#: Characters beyond which a pair's distance is found by jumps over equal stretches; the built-in function reads long strings from their start for each character.
LONG = 400


def bounded_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or -1 if it exceeds most.

    For each number of edits and each shift between the strings the furthest place is kept that can be reached,
    so the work is equal stretches, compared at once, times (most + 1) squared."""

    def equal(i: int, j: int) -> int:
        start, step = i, 64
        while step:
            if a[i : i + step] == b[j : j + step] and i < len(a) and j < len(b):
                done = min(step, len(a) - i, len(b) - j)
                i, j, step = i + done, j + done, step * 2
                if i >= len(a) or j >= len(b):
                    break
            else:
                step //= 2
                if i >= len(a) or j >= len(b) or a[i] != b[j]:
                    break
        return i - start

    shift = len(b) - len(a)
    if abs(shift) > most:
        return -1
    reach = {0: equal(0, 0)}
    for edits in range(most + 1):
        if reach.get(shift, -1) >= len(a):
            return edits
        new = {}
        for d in range(-edits - 1, edits + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            if 0 <= i <= len(a) and i + d <= len(b) and i + d >= 0:
                new[d] = i + equal(i, i + d)
        reach = new
    return -1


def _measured(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs (_w, _t) with their distance, where that is at most so many edits."""

    @F.pandas_udf("int")
    def long_distance(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([bounded_distance(x, y, most) for x, y in zip(xs, ys, strict=True)])

    far = F.char_length("_w") > LONG
    near = pairs.where(~far).withColumn("distance", F.levenshtein("_w", "_t", most))
    return near.unionByName(pairs.where(far).withColumn("distance", long_distance("_w", "_t"))).where("distance >= 0")


def fuzzy_join(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", most: int = MOST, nearest: bool = True, share: float | None = SHARE,
               costs: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """texts with the terms within most edits, and distance: by default the nearest ones, if nearer than a share of the text.

    Both sides are compared lower-cased and with German letters escaped, distinct texts once. With
    costs, the candidates within most edits are measured by that table (cost_distance) instead."""
    folded = lambda x: escape_umlauts(F.lower(x))
    words = texts.select(folded(F.col(text)).alias("_w")).where("_w IS NOT NULL").distinct()
    known = terms.select(folded(F.col(term)).alias("_t")).distinct()
    found = _measured(candidates(words, known, most), most)
    if costs is not None:
        found = cost_distance(found, costs, "_w", "_t")
    if nearest:
        found = found.withColumn("_least", F.min("distance").over(W.partitionBy("_w"))).where("distance = _least").drop("_least")
    if share is not None:
        found = found.where(F.col("distance") < share * F.char_length("_w"))
    out = texts.withColumn("_k", folded(F.col(text))).join(found, F.col("_k") == F.col("_w")).drop("_k", "_w")
    return out.join(terms, F.col("_t") == folded(F.col(term))).drop("_t")


def suggestions(found: DataFrame, keys: tuple[str, ...], verbose: int = 1) -> DataFrame:
    """Suggestions ranked by term count (verbose 1), by 2 * distance - count (2), or only the first of each text (0)."""
    by = (2 * F.col("distance") - F.col("count")).asc() if verbose == 2 else F.col("count").desc()
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(by, "term")))
    return ranked.where("rank = 1") if verbose == 0 else ranked


def push_to_base(found: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = ("doc_id",), parts: int | None = None) -> DataFrame:
    """Suggestions for n-grams (base_id) as entities of their base boxes (box_id).

    parts is the number of tasks that both tables are dealt to (see ``shared.tasks_of``); by default it is Spark's, whatever their size."""
    base = boxes.select(*keys, "box_id")
    if parts:
        found, base = found.repartition(parts, *keys, "base_id"), base.repartition(parts, *keys, "box_id")
    base = base.distinct()
    return found.join(base, [*(found[k] == base[k] for k in keys), found["base_id"] == base["box_id"]]).select(*(base[k] for k in keys), "box_id", F.col("dict_key").alias("kind"), "subkey", F.col("term").alias("value")).distinct()


class CostTable:
    """Costs of replacing short strings by others; what is not in the table costs the longer one's length, or nothing between equal strings."""

    def __init__(self, costs: list[tuple[str, str, float]]):
        self.longest = max([1, *(max(len(x), len(y)) for x, y, _ in costs)])
        self.code = {c: i for i, c in enumerate(sorted({c for x, y, _ in costs for c in x + y}), 1)}  # 0: any other
        base = self.base = len(self.code) + 1
        number = lambda x: sum(self.code[c] * base**k for k, c in enumerate(reversed(x)))
        tables: dict[tuple[int, int], dict[int, float]] = {}
        for x, y, c in costs:
            tables.setdefault((len(x), len(y)), {})[number(x) * base ** len(y) + number(y)] = c
        self.tables = {k: (np.array(sorted(t)), np.array([t[x] for x in sorted(t)])) for k, t in tables.items()}

    def prices(self, p: int, q: int, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """What it costs to replace strings of length p by strings of length q (their codes, last character first)."""
        out = np.full(len(equal), float(max(p, q)))
        if p == q:
            out[equal] = 0.0
        if (p, q) in self.tables:
            known, cost = self.tables[p, q]
            digits = [*x, *y]
            whole = sum(d * self.base**k for d, k in zip(digits, [*range(q, q + p), *range(q)], strict=True))
            at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
            hit = (known[at] == whole) & np.all([d > 0 for d in digits], axis=0)
            out[hit] = cost[at[hit]]
        return out


def weighted_distances(left: list[str], right: list[str], costs: CostTable) -> np.ndarray:
    """Edit distances whose steps replace up to costs.longest characters by as many.

    All pairs are worked on side by side: the cost of two prefixes is the least, over the strings that
    they end in, of what stands before those and the price of replacing one by the other."""
    n, m = max(map(len, left), default=0), max(map(len, right), default=0)
    raw = [np.array([[ord(c) for c in s.ljust(k, "\0")] for s in words], np.int64).reshape(len(words), k).T for words, k in ((left, n), (right, m))]
    codes = [np.vectorize(lambda c: costs.code.get(chr(c), 0), otypes=[np.int64])(r) if r.size else r for r in raw]
    best = np.full((n + 1, m + 1, len(left)), np.inf)
    best[0, 0] = 0.0
    alike = np.zeros((n + 1, m + 1, len(left)), np.int64)  # length of the longest equal ends
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                alike[i, j] = np.where(raw[0][i - 1] == raw[1][j - 1], alike[i - 1, j - 1] + 1, 0)
            for p in range(min(costs.longest, i) + 1):
                for q in range(min(costs.longest, j) + 1):
                    if p or q:
                        price = costs.prices(p, q, codes[0][i - p : i][::-1], codes[1][j - q : j][::-1], alike[i, j] >= p)
                        np.minimum(best[i, j], best[i - p, j - q] + price, out=best[i, j])
    return best[[len(x) for x in left], [len(y) for y in right], np.arange(len(left))]


#: Pairs that are worked on side by side.
PAIRS = 1000


def cost_distance(pairs: DataFrame, costs: list[tuple[str, str, float]], a: str = "a", b: str = "b", name: str = "distance") -> DataFrame:
    """pairs with their distance by a table of substitution costs (small, given as rows); null if either is."""
    table = CostTable(costs)

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            out = np.full(len(xs), np.nan)
            known = np.flatnonzero((xs.notna() & ys.notna()).to_numpy())
            known = known[np.argsort([len(xs.iat[i]) + len(ys.iat[i]) for i in known], kind="stable")]
            for start in range(0, len(known), PAIRS):
                some = known[start : start + PAIRS]
                out[some] = weighted_distances(xs.iloc[some].tolist(), ys.iloc[some].tolist(), table)
            yield pd.Series(out).astype("Float64").mask(np.isnan(out))

    return pairs.withColumn(name, distance(a, b))


def transposition_distance(a: Column, b: Column) -> Column:
    """Edit distance with swaps of neighbours as one step, for short words; in functions only.

    Rows of the table are folded over the first word; the state keeps the last two."""
    n = F.char_length(b)
    at = lambda s, i: F.substring(s, i, F.lit(1))
    first = F.sequence(F.lit(0), n)

    def row(state: Column, i: Column) -> Column:
        up, upper = state["last"], state["before"]

        def cell(left: Column, j: Column) -> Column:
            same = at(a, i) == at(b, j)
            best = F.least(F.element_at(left, -1) + 1, F.element_at(up, j + 1) + 1, F.element_at(up, j) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j))
            return F.array_append(left, F.when(swap, F.least(best, F.try_element_at(upper, j - 1) + 1)).otherwise(best).cast("int"))

        made = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.array(i.cast("int")), cell)).otherwise(F.array(i.cast("int")))
        return F.struct(up.alias("before"), made.alias("last"))

    start = F.struct(first.alias("before"), first.alias("last"))
    whole = F.aggregate(F.sequence(F.lit(1), F.char_length(a)), start, row)
    return F.when(F.char_length(a) == 0, n).otherwise(F.element_at(whole["last"], -1))
