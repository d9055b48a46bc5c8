"""Steps of queries whose tasks must not grow with the tables."""

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from noticeloom.operators import entities, fuzzy, quads, resolve
from noticeloom.sources import segments
from noticeloom.sources.segments import Segments
from noticeloom.sources.shared import tasks_of
from noticeloom.streaming import state


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_venues_keep_repeated_rows_and_divide_a_city(spark):
    cities = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("A").alias("city")).unionByName(spark.createDataFrame([(0, "A"), (1, "C"), (2, None)], "doc_id long, city string"))
    known = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "z"), (None, "n")], "subkey string, value string")
    found = resolve.known_venues(cities, known)
    assert found.count() == 1001 * 3 and found.where("doc_id = 0 AND venue = 'x'").count() == 4
    assert found.select(F.spark_partition_id()).distinct().count() > 4
    above = plan_of(found).split("HashJoin")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_known_venues_in_cells_lose_and_repeat_no_pair(spark, monkeypatch):
    for name, n in {"KEYS": 40, "VENUES": 7, "PAIRS": 100, "LONG": 5, "SHORT": 3, "FEW": 2}.items():
        monkeypatch.setattr(resolve, name, n)
    cities = spark.range(900).selectExpr("IF(id % 50 = 0, NULL, id div 2) AS doc_id", "element_at(array('A', 'B', 'C', NULL), cast(id % 4 + 1 AS int)) AS city")
    known = spark.range(80).selectExpr("element_at(array('A', 'B', 'D', NULL), cast(id % 4 + 1 AS int)) AS subkey", "IF(id < 4, NULL, string(id div 12)) AS value")
    pairs = cities.join(known, F.col("city") == F.col("subkey")).select("doc_id", "city", F.col("value").alias("venue"))
    found = resolve.known_venues(cities, known)
    assert found.schema == pairs.schema and found.count() == 2 * 225 * 20
    assert found.exceptAll(pairs).isEmpty() and pairs.exceptAll(found).isEmpty()
    for cities, known in ((cities.limit(0), known), (cities, known.limit(0))):
        assert resolve.known_venues(cities, known).isEmpty()


def test_known_venues_take_little_disk(spark, tmp_path):
    cities = spark.range(2000).selectExpr("id AS doc_id", "string(id % 2) AS city")
    known = spark.range(6000).selectExpr("string(id % 2) AS subkey", "format_string('Venue#%09d', id) AS value")
    found = resolve.known_venues(cities, known)
    # rows leave the blocks' Generate one by one: it is no part of a generated loop that gathers all rows of a block
    assert re.search(r"^[ :+-]*Generate explode\(transform", plan_of(found), re.MULTILINE)
    found.write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 6_000_000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.5 * 6_000_000


def test_suggestions_of_bases_in_parts(spark):
    found = spark.createDataFrame([(1, 1, "city", None, "a"), (1, 1, "city", None, "a"), (1, 2, "city", None, "b"), (2, 9, "city", None, "c")], "doc_id long, base_id int, dict_key string, subkey string, term string")
    boxes = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (3, 1)], "doc_id long, box_id int")
    got = fuzzy.push_to_base(found, boxes, parts=37)
    assert sorted(r["value"] for r in got.collect()) == ["a", "b"]
    assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan_of(got))) == {"37"}
    assert tasks_of(spark.range(1001), 100) == 11 and tasks_of(spark.range(5), 100) == 4


def test_hulls_side_by_side_are_those_of_each_group():
    rng = np.random.default_rng(1)
    for t in range(60):
        parts = [rng.integers(0, (3, 10, 1000)[t % 3], (rng.integers(1, 30), 2)).astype(float) for _ in range(20)]
        parts[0] = np.column_stack([np.arange(40), -(np.arange(40.0) ** 2)])  # an arc, corners all
        group, points = np.repeat(np.arange(20), [len(p) for p in parts]), np.concatenate(parts)
        some = rng.permutation(len(group))
        corners, counts = quads.side_by_side(points[some], group[some])
        assert [c.tolist() for c in np.split(corners, np.cumsum(counts)[:-1])] == [quads.convex_hull(p).tolist() for p in parts]


def test_hulls_over_batches_and_odd_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        square = "posexplode(array(0, 4, 4, 0, 2, 2, 1, 4)) AS (i, x)"
        rows = spark.range(12).selectExpr("CASE id WHEN 0 THEN NULL WHEN 1 THEN 0.0D WHEN 2 THEN -0.0D WHEN 3 THEN double('NaN') ELSE double(id div 2) END AS k", "named_struct('s', IF(id < 4, NULL, string(id div 2))) AS p", square).selectExpr("k", "p", "x", "element_at(array(0, 0, 4, 4, 2, 9 - 8, 1, 4), i + 1) AS y")
        rows = rows.unionByName(rows.where("k = 3")).unionByName(rows.where("k = 3").limit(3)).crossJoin(spark.range(5).select())
        got = quads.hulls(rows.repartition(3), "k", "p")
        assert "Aggregate" not in plan_of(got)
        found = got.select("k", "p.s", F.size("hull").alias("n"), quads.area(F.col("hull")).alias("area")).collect()
        assert sorted((str(r["k"]), str(r["s"]), r["n"], r["area"]) for r in found) == sorted([(k, s, 4, 16.0) for k, s in (("None", "None"), ("0.0", "None"), ("nan", "None"), ("2.0", "2"), ("3.0", "3"), ("4.0", "4"), ("5.0", "5"))])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_keys_of_a_store_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = lambda n, value: spark.range(n).select(F.col("id").alias("doc_id"), F.lit("1-a").alias("rev"), F.lit(value).alias("value"), F.lit(False).alias("deleted"))
    held = Segments(spark, f"file://{tmp_path}/s", buckets=2)
    held.write(rows(800_000, "a"))
    held.merge(rows(600_000, "b"))
    assert held.changed(1, 2) < 16 << 20  # few bytes, many keys
    assert "Broadcast" not in plan_of(held.read()) and held.read().where("value = 'b'").count() == 600_000
    held.merge(rows(10, "c"))
    assert held.changed(2, 3) < segments.BROADCAST < held.changed(1, 3)
    few = Segments(spark, f"file://{tmp_path}/few", buckets=2)
    few.write(rows(1000, "a"))
    few.merge(rows(10, "b"))
    assert "BroadcastHashJoin" in plan_of(few.read()) and few.read().count() == 1000
    made = []
    monkeypatch.setattr(segments, "upserts", lambda base, *_, **__: made.append(base) or base.limit(0))
    held.put(rows(800_000, "d"))
    assert "strategy=merge" in made[0]._jdf.queryExecution().logical().toString()


def test_only_the_latest_changes_of_a_batch_reach_the_state(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("IF(id % 50 = 0, 'odd', string(id % 7)) AS k", "id * 37 % 1000 AS seq", "id AS n", "id % 3 = 0 AS deleted")
    got = state.latest_of_batches(rows, "k", "seq").collect()
    best = {}
    for r in rows.collect():
        if r["k"] not in best or r["seq"] > best[r["k"]]["seq"]:
            best[r["k"]] = r
    assert sorted(map(tuple, got)) == sorted(map(tuple, best.values()))


def test_what_matches_need_loses_none(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    odd = ["", "a@b.de", "x.y@z1 com", "5€", "5 $", "7,-", "3 EUR", "12345 Abcde", "123456 Stadt", "am 5.6.", "20:15 Uhr", "Hauptstr 5", "no digits", "@", "€", None]
    texts = texts.unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for kind in entities.NEEDS:
        found = F.regexp_extract_all("text", F.lit(entities.PATTERNS[kind].replace(r"\b", "(?<![0-9A-Za-z_])")), F.lit(0))
        assert texts.where(~entities.may_match(F.col("text"), kind) & (F.size(found) > 0)).isEmpty()
    assert "CASE WHEN" in texts.select(entities.matches(F.col("text"), "email"))._jdf.queryExecution().analyzed().toString()
    assert texts.where("text IS NULL").select(entities.matches(F.col("text"), "email").alias("m")).first()["m"] is None


def test_normal_forms_are_made_before_the_facts_are_gathered(spark):
    found = spark.createDataFrame([(1, 0, 95.0, "date", None, "5.6.2018"), (1, 1, 10.0, "datetime", None, "20:00 Uhr"), (1, 2, 95.0, "datetime", None, "21:00 Uhr")], "doc_id long, ord int, confidence double, kind string, subkey string, value string")
    got = resolve.gathered(found, found, datetime.date(2018, 6, 1))
    assert got.select("dates", "clock").first() == (["2018-06-05"], ["21:00"])
    aggregate = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line)
    assert "_form" in aggregate and "regexp" not in aggregate
