"""The incremental store, claims that outlive a crash."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from noticeloom.sources import files, store
from noticeloom.sources.segments import Segments
from noticeloom.sources.store import Snapshots
from noticeloom.streaming import claims

NUMBERS = "doc_id long, rev string, value string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def numbers(spark):
    return spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("1-"), F.md5(F.col("id").cast("string"))).alias("rev"), F.concat(F.lit("value "), F.sha2(F.col("id").cast("string"), 256)).alias("value"))


def bytes_below(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_merge_writes_what_changes(spark, tmp_path, numbers):
    held = Segments(spark, f"file://{tmp_path}/s", buckets=8, most=3)
    assert held.read() is None and held.manifest() is None and held.size() == 0
    assert held.write(numbers) == 1
    whole = bytes_below(tmp_path)
    changes = numbers.where("doc_id % 100 = 7").withColumn("value", F.lit("changed")).unionByName(spark.createDataFrame([(-5, None, "new")], NUMBERS))
    assert held.put(changes) == 2
    assert bytes_below(tmp_path) - whole < 0.1 * whole
    want = {r.doc_id: r.value for r in numbers.collect()}
    old = dict(want)
    want |= {i: "changed" for i in range(7, 20_000, 100)} | {-5: "new"}
    got = held.read().collect()
    assert {r.doc_id: r.value for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.value for r in held.read(1).collect()} == old  # readers of the old version
    assert {r.rev.split("-")[0] for r in got if r.value == "changed"} == {"2"}
    # the same changes again are none, and a writer that saw version 1 fails
    assert held.put(changes) == 3 and held.read().count() == len(want) and {r.rev.split("-")[0] for r in held.read().collect()} == {"1", "2"}
    with pytest.raises(RuntimeError):
        held.merge(changes.select(*numbers.columns), after=1)
    with pytest.raises(ValueError, match="kept by"):
        held.merge(changes, key="value")


def test_buckets_are_compacted_and_old_segments_go(spark, tmp_path, numbers):
    held = Segments(spark, f"file://{tmp_path}/s", buckets=4, most=2)
    held.write(numbers.limit(0).unionByName(numbers.where("doc_id < 100")))
    want = {r.doc_id: r.value for r in held.read().collect()}
    for turn in range(4):
        held.put(spark.createDataFrame([(3, None, f"three {turn}"), (1000 + turn, None, "x")], NUMBERS))
        want |= {3: f"three {turn}", 1000 + turn: "x"}
        assert {r.doc_id: r.value for r in held.read().collect()} == want
    assert not held.crowded(held.manifest(), 2) and held.version() > 5  # compactions are versions, too
    before = bytes_below(tmp_path)
    held.compact(1)
    assert held.compact(1) is None and not held.crowded(held.manifest(), 1)
    assert held.vacuum() > 0 and bytes_below(tmp_path) < before
    assert {r.doc_id: r.value for r in held.read().collect()} == want and held.read().where("doc_id = 3").count() == 1
    assert len({s["path"] for s in held.manifest()["segments"]}) == len([f for f in (tmp_path / "s").iterdir() if f.name.startswith("s0")])


def test_large_later_segments_are_not_broadcast(spark, tmp_path, numbers, monkeypatch):
    from noticeloom.sources import segments

    held = Segments(spark, f"file://{tmp_path}/s", buckets=4)
    held.write(numbers)
    held.merge(numbers.where("doc_id % 2 = 0").withColumn("value", F.lit("even")))
    plan = lambda: held.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(segments, "BROADCAST", 10)
    assert "broadcast" not in plan() and held.read().where("value = 'even'").count() == 10_000 and held.read().count() == 20_000


def test_keys_that_stand_twice_and_keys_that_are_missing(spark, tmp_path):
    base = spark.createDataFrame([("a", "1-x", "one", 1)], "doc_id string, rev string, value string, at int")
    twice = spark.createDataFrame([("a", "late", 9), ("a", "early", 2), ("b", "z", 1), ("b", "y", 1), ("c", "same", 1), ("c", "same", 1), (None, "n", 1), (None, "m", 1)], "doc_id string, value string, at int")
    got = store.upsert(base, twice, order="at")
    assert sorted((r.value, r.rev.split("-")[0]) for r in got.collect()) == [("late", "2"), ("m", "1"), ("n", "1"), ("same", "1"), ("z", "1")]
    assert got.where("doc_id IS NULL").count() == 0 and got.select("doc_id").distinct().count() == 5
    assert rows(store.upsert(base, twice, order="at")) == rows(store.upsert(base, twice.repartition(7), order="at"))  # ids come from the content
    numbered = spark.createDataFrame([(1, "1-x", "v")], "doc_id int, rev string, value string")
    with pytest.raises(Exception, match="a change has no doc_id"):
        store.upsert(numbered, spark.createDataFrame([(None, "w")], "doc_id int, value string")).collect()
    with pytest.raises(ValueError, match="ordered by the key"):
        store.upsert(base, twice, order="doc_id")
    # a smaller fence than the stored one changes nothing
    held = Segments(spark, f"file://{tmp_path}/f", buckets=2)
    put = lambda value, fence: held.put(spark.createDataFrame([("a", value, fence)], "doc_id string, value string, fence long"), fence="fence")
    put("first", 5), put("stale", 4), put("next", 6)
    assert [(r.value, r.rev.split("-")[0]) for r in held.read().collect()] == [("next", "2")]


class Killed(Exception):
    """What ends a driver; from then on its stores take nothing from it."""


class Dying(Segments):
    """A store whose first put dies, before or after it has written; ``others`` die with it."""

    dies, others, dead = None, (), False

    def put(self, *args, **kwargs):
        when, self.dies = self.dies, None
        if when == "before":
            self._die()
        out = super().put(*args, **kwargs)
        if when == "after":
            self._die()
        return out

    def _die(self):
        for s in self.others:
            s.dead = True
        raise Killed

    def change(self, *args, **kwargs):
        if self.dead:
            raise Killed
        return super().change(*args, **kwargs)


def run(query):
    try:
        assert query.awaitTermination(120)
        return None
    except Exception as error:  # the query's own failure
        return error


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("kind", ["ledger", "documents"])
def test_a_batch_that_dies_gets_its_claims_back(spark, tmp_path, when, kind):
    picture = F.create_map(F.lit("userimage"), F.struct(F.lit("image/png").alias("content_type"), F.lit("x").cast("binary").alias("data")))
    none = F.lit(None).cast("string")
    docs = spark.range(6).select(F.col("id").cast("string").alias("doc_id"), F.lit("1-a").alias("rev"), none.alias("processed_by"), none.alias("event_id"))
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    sink, held = Dying(spark, f"file://{tmp_path}/sink", buckets=2), Dying(spark, f"file://{tmp_path}/held", buckets=2)
    sink.dies, sink.others = when, [held]
    if kind == "documents":
        held.write(docs.withColumn("attachments", picture))
        claim = {"documents": held, "engine": "one"}
    else:
        claim = {"ledger": claims.Ledger(held, "one", "s")}
    work = lambda df: df.select("doc_id", F.concat(F.lit("worked "), "doc_id").alias("value"))
    start = lambda: claims.processed(files.change_feed(spark, f"{tmp_path}/in", docs.schema, 1), work, sink, f"{tmp_path}/ck", **claim)
    assert run(start()) is not None
    assert held.read().where("processed_by IS NOT NULL" if kind == "documents" else "state = 'held'").count() > 0
    held.dead = False  # another driver starts
    assert run(start()) is None
    got = sink.read().collect()
    assert sorted((r.doc_id, r.value) for r in got) == [(str(i), f"worked {i}") for i in range(6)]
    if kind == "ledger":
        assert {(r.state, r.engine) for r in held.read().collect()} == {("done", "one")} and held.read().count() == 6


def test_ledger_grants_expires_and_fences(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    clock = lambda: at
    held, sink = Segments(spark, f"file://{tmp_path}/l", buckets=2), Segments(spark, f"file://{tmp_path}/o", buckets=2)
    wanted = spark.createDataFrame([("a", "1-x"), ("b", "1-x"), ("b", "1-x")], "doc_id string, rev string")
    one, two = (claims.Ledger(held, e, "s", datetime.timedelta(minutes=5), clock=clock) for e in ("one", "two"))
    first, mine = one.claim(wanted, 0)
    assert sorted(r.doc_id for r in mine.collect()) == ["a", "b"]
    assert two.claim(wanted, 0)[1].count() == 0 and one.claim(wanted, 1)[1].count() == 0
    again, mine = one.claim(wanted, 0)  # the same batch, run again
    assert again > first and mine.count() == 2 and one.fenced(wanted, first).count() == 0
    at += datetime.timedelta(minutes=6)  # one is slow, its time is over
    later, theirs = two.claim(wanted, 7)
    assert theirs.count() == 2
    out = wanted.dropDuplicates().select("doc_id", F.lit("v").alias("value"))
    sink.put(two.fenced(out, later), fence="fence")
    sink.put(one.fenced(out.withColumn("value", F.lit("stale")), again), fence="fence")
    sink.put(out.withColumn("value", F.lit("stale")).withColumn("fence", F.lit(again).cast("long")), fence="fence")  # it had looked before
    assert {r.value for r in sink.read().collect()} == {"v"}
    two.settle(later)
    one.settle(again, claims.FREE)
    assert {r.state for r in held.read().collect()} == {"done"}
    assert one.claim(wanted, 2)[1].count() == 0
    assert one.claim(spark.createDataFrame([("a", "2-y")], wanted.schema), 3)[1].count() == 1  # another revision


def test_a_failed_batch_frees_its_claims(spark, tmp_path):
    docs = spark.createDataFrame([("a", "1-x"), ("b", "1-x")], "doc_id string, rev string")
    docs.write.parquet(f"{tmp_path}/in")
    held, sink, dead = (Segments(spark, f"file://{tmp_path}/{n}", buckets=2) for n in ("l", "o", "d"))

    def fail(df):
        raise ValueError("bad picture")

    feed = lambda: files.change_feed(spark, f"{tmp_path}/in", docs.schema, 9)
    letters = Snapshots(spark, f"file://{tmp_path}/letters")
    claims.processed(feed(), fail, sink, f"{tmp_path}/c1", dead=letters, ledger=claims.Ledger(held, "e", "c1")).awaitTermination()
    assert letters.read().count() == 2 and {r.state for r in held.read().collect()} == {"free"} and sink.read() is None and dead.read() is None
    claims.processed(feed(), lambda df: df.select("doc_id"), sink, f"{tmp_path}/c2", ledger=claims.Ledger(held, "e", "c2")).awaitTermination()
    assert {r.doc_id for r in sink.read().collect()} == {"a", "b"} and json.loads(letters.read().first().record)["rev"] == "1-x"
