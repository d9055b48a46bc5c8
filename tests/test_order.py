"""Places in an order without one task that holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from noticeloom.sources import files


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nth_id(spark, kind):
    r = random.Random(4)
    ids = [r.randint(0, 3000) for _ in range(4000)] + [7] * 900 + [None, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(F.col("doc_id").cast(kind)).repartition(5)
    want = sorted((x for x in ids if x is not None), key=(str if kind == "string" else None))
    for n in (0, 1, 2, 5, 400, 1000, 2222, 4500, len(ids) - 1):
        got = files.nth_id(df, n, few=50).collect()
        assert [x.doc_id for x in got] == [None if n < 2 else str(want[n - 2]) if kind == "string" else want[n - 2]], n
    assert files.nth_id(df, len(ids)).count() == 0 and files.nth_id(df.limit(0), 0).count() == 0
    few = spark.createDataFrame([(3,), (1,), (1,)], "doc_id long")
    assert [files.nth_id(few, n).first().doc_id for n in range(3)] == [1, 1, 3]


def test_newest_first_when_all_have_one_time(spark):
    rows = [(i * 7 % 500, "2024-01-01 00:00:00") for i in range(500)] + [(1000 + i, None if i % 3 else f"2024-01-0{2 + i % 5} 10:00:0{i % 7}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, t string").select("doc_id", F.to_timestamp("t").alias("created")).repartition(6)
    got = [(x.place, x.doc_id) for x in files.newest_first(df).collect()]
    known = sorted((x for x in rows if x[1]), key=lambda x: x[0])
    known.sort(key=lambda x: x[1], reverse=True)
    want = [x[0] for x in known] + sorted(x[0] for x in rows if x[1] is None)
    assert got == list(enumerate(want, 1))
    assert files.newest_first(df.limit(0)).count() == 0


def test_no_window_holds_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("2024-01-01").cast("timestamp").alias("created"))
    plan = files.newest_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
