"""Spatial joins by cells and bounded fuzzy keys, against comparisons of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from noticeloom.functions.text import ngrams, tokens
from noticeloom.operators import boxes, fuzzy

BOX = "doc_id long, ord int, text string, confidence double, x double, y double, width double, height double"


def layout(seed, docs=3, n=60):
    r = random.Random(seed)
    out = []
    for d in range(docs):
        for k in range(n if d else 5):
            size = r.choice([3.0, 10.0, 10.0, 40.0, 300.0])
            out.append((d, k, r.choice(["ab", "abc", "abcd"]), float(r.choice([60, 70, 80])), r.uniform(-50, 400), r.choice([0.0, 10.0, r.uniform(-50, 200)]), size * r.choice([1.0, 1.0, 2.5, 0.0]), size * 0.5))
    out += [(d, 100 + k, t, c + 1, x + r.choice([0.0, 0.5]), y, w, h) for k, (d, _, t, c, x, y, w, h) in enumerate(r.sample(out, 40))]
    return out


def share(a, b):
    wide, high = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
    return wide * high / max(a[6] * a[7], b[6] * b[7]) if wide > 0 and high > 0 else 0.0


def touch(a, b):
    return a[4] <= b[4] + b[6] and b[4] <= a[4] + a[6] and a[5] <= b[5] + b[7] and b[5] <= a[5] + a[7]


@pytest.mark.parametrize("split", [1000, 20])
def test_pairs_of_cut_documents(spark, split):
    rows = layout(3)
    df = spark.createDataFrame(rows, BOX).repartition(4)
    pairs = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    want = {(a[0], a[1], b[1]) for a, b in pairs if share(a, b) > 0.3}
    got = [(x.doc_id, x.a, x.b) for x in boxes.overlap_pairs(df, 0.3, split=split).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    want = {(a[0], a[1], b[1]) for a, b in pairs if touch(a, b)}
    got = [(x.doc_id, x.a, x.b) for x in boxes.touching_pairs(df, split=split).collect()]
    assert set(got) == want and len(got) == len(want)


def plain(rows):
    """Each document collated as one list."""
    out = []
    for d in {r[0] for r in rows}:
        own = sorted(dict(zip(("ord", "text", "confidence", "x", "y", "width", "height"), r[1:])).items() for r in rows if r[0] == d)
        out += [(d, b["ord"], b["text"], b["confidence"], sorted(x["text"] for x in b["replaces"])) for b in boxes.collate_boxes([dict(x) for x in own], 0.3)]
    return sorted(out)


@pytest.mark.parametrize("split", [1000, 20])
def test_collation_by_connected_boxes(spark, split):
    rows = layout(5)
    rows += [rows[9], rows[9]]  # equal boxes
    rows += [(1, 7, "tied", 60.0, *rows[30][4:]), (7, 1, "one", 60.0, 0.0, 0.0, 9.0, 9.0), (7, 1, "two", 60.0, 0.0, 0.0, 9.0, 9.0)]  # one order number
    got = boxes.collate(spark.createDataFrame(rows, BOX).repartition(4), 0.3, split)
    want = []
    for d in sorted({r[0] for r in rows}):
        own = [dict(zip(("doc_id", "ord", "text", "confidence", "x", "y", "width", "height"), r)) for r in sorted(r for r in rows if r[0] == d)]
        want += [(d, b["ord"], b["text"], b["confidence"], sorted(x["text"] for x in b["replaces"])) for b in boxes.collate_boxes(own, 0.3)]
    assert sorted((x.doc_id, x.ord, x.text, x.confidence, sorted(y.text for y in x.replaces)) for x in got.collect()) == sorted(want)
    assert got.where("doc_id = 7").count() == 1


def test_a_large_document_spreads_over_tasks(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), (F.col("id") % 200 * 10.0).alias("x"), (F.floor(F.col("id") / 200) * 10.0).alias("y"), F.lit(11.0).alias("width"), F.lit(11.0).alias("height"))
    met, _ = boxes._met(df, "doc_id", "ord", 1000)
    assert met.count() < 60 * n  # not n * n
    assert boxes.touching_pairs(df).count() == sum(c for c in (199 * 100, 200 * 99, 199 * 99, 199 * 99))


def test_runs_of_words_are_bounded(spark):
    df = spark.createDataFrame([("a bb ccc dddd",), ("",), (None,), ("w" * 30 + " x y",)], "t string")
    for longest in (1, 3, 6, 40):
        got = [r for r in df.select(F.col("t"), ngrams(tokens(F.col("t")), longest).alias("g"), ngrams(tokens(F.col("t"))).alias("all")).collect()]
        assert all(r.g == [x for x in r["all"] if len(x) <= longest] for r in got if r.t is not None)
    long = spark.range(1).select(F.repeat(F.lit("word "), 20_000).alias("t"))  # 100,000 characters
    assert long.select(F.size(ngrams(tokens(F.col("t")), 12)).alias("n")).first().n == 20_000 + 19_999


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_prefix_keys_lose_no_pair(spark):
    r = random.Random(11)
    words = {"".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(150)} | {"x" * 200 + s for s in ("abc", "abd", "bbbb", "")}
    base = list(words)
    for w in r.sample(base, 60):
        for _ in range(2):
            i = r.randint(0, len(w))
            w = r.choice([w[:i] + "b" + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :]])
        words.add(w)
    known = r.sample(sorted(words), 90)
    a, b = spark.createDataFrame([(w,) for w in words], "_w string"), spark.createDataFrame([(w,) for w in known], "_t string")
    got = {(x._w, x._t) for x in fuzzy.candidates(a, b, 2, prefix=5).collect()}
    want = {(x, y) for x in words for y in known if distance(x, y) <= 2}
    assert want <= got and all(abs(len(x) - len(y)) <= 2 for x, y in got)


def test_bounded_distance():
    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.choice([0, 1, 3, 8, 90, 200])))
        b = a
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(b))
            b = r.choice([b[:i] + "b" + b[i:], b[:i] + b[i + 1 :], b[:i] + "a" + b[i + 1 :], b[i:]]) if r.random() < 0.97 else "".join(r.choice("ab") for _ in range(5))
        for most in (0, 2, 3):
            if len(a) < 100 or most == 2:
                d = distance(a, b) if abs(len(a) - len(b)) <= most else most + 1
                assert fuzzy.bounded_distance(a, b, most) == (d if d <= most else -1), (a, b)


def test_long_texts_have_few_keys(spark):
    long = spark.range(3).select(F.concat(F.repeat(F.lit("lorem ipsum "), 9000), F.col("id").cast("string")).alias("text"))  # 108,001 characters
    terms = spark.createDataFrame([("lorem", 1)], "term string, count int")
    index = fuzzy.delete_index(long.select(F.col("text").alias("_w")), "_w", 2, fuzzy.PREFIX)
    assert index.count() <= 3 * (1 + 8 + 28) and index.agg(F.max(F.length("delete_key"))).first()[0] == 8
    assert fuzzy.fuzzy_join(long, terms).count() == 0
    assert fuzzy.fuzzy_join(long, long.select(F.col("text").alias("term"), F.lit(1).alias("count")), nearest=False, share=None).count() == 9


def test_prices_of_equal_strings_come_from_the_table():
    table = fuzzy.CostTable([("a", "a", 0.5), ("b", "c", 0.25)])
    assert fuzzy.weighted_distances(["a", "b", "x", "ab"], ["a", "c", "x", "ac"], table).tolist() == [0.5, 0.25, 0.0, 0.75]
