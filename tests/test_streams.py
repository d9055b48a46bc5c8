"""Keyed state over change feeds, two-way sync, the store as a data source."""

import random

import pytest
from pyspark.sql import functions as F

from noticeloom.sources.segments import Segments
from noticeloom.sources.store import Snapshots, next_rev
from noticeloom.streaming import state
from noticeloom.streaming.sync import Sync

CHANGES = "event_id string, seq int, deleted boolean, title string"


def feed_of(spark, folder, batches):
    """A stream of files, one batch each, in that order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}/b{n:03d}")
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drain(stream, store, folder):
    """Put each batch's rows into a store of last changes, with the sum of deltas."""
    total = []

    def batch(df, number):
        df = df.persist()
        total.append(df.agg(F.sum("delta")).first()[0] or 0)
        store.put(df.drop("delta"), order="seq")
        df.unpersist()

    q = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", folder).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_last_changes_whatever_the_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"e{r.randrange(12)}", n, r.random() < 0.3, f"t{n}") for n in range(60)]
    rows += [(None, 5, False, "no key"), ("e1", None, False, "no number")]
    again = rows + r.sample(rows, 20)  # some come twice
    r.shuffle(again)
    want = {}
    for k, n, gone, title in sorted((x for x in rows if x[0] and x[1] is not None), key=lambda x: x[1]):
        want[k] = (n, gone, title)
    store = Segments(spark, f"file://{tmp_path}/s", key="event_id", buckets=2, most=20)
    total = drain(state.last_changes(feed_of(spark, tmp_path / "in", [again[:40], again[40:]]), "event_id", "seq"), store, f"{tmp_path}/ck")
    got = {x.event_id: (x.seq, x.deleted, x.title) for x in store.read().collect()}
    assert got == want and sum(total) == sum(not gone for _, gone, _ in want.values())


def test_a_feed_that_starts_now(spark, tmp_path):
    rows = [[("a", 1, False, "x"), ("b", 7, False, "y")], [("a", 8, True, "x"), ("c", 6, False, "z")]]
    store = Segments(spark, f"file://{tmp_path}/s", key="event_id", buckets=2)
    total = drain(state.last_changes(feed_of(spark, tmp_path / "in", rows), "event_id", "seq", since=6), store, f"{tmp_path}/ck")
    assert {(x.event_id, x.seq) for x in store.read().collect()} == {("a", 8), ("b", 7)} and total == [1, 0]


def test_changed_posters(spark):
    posters = spark.createDataFrame([("p1", "e1"), ("p2", "e1"), ("p3", "e2")], "doc_id string, event_id string")
    changes = spark.createDataFrame([("e1", False, "new"), ("e2", True, "gone"), ("e9", None, "unknown")], "event_id string, deleted boolean, title string")
    assert sorted((x.doc_id, x.title) for x in state.changed_posters(changes, posters).collect()) == [("p1", "new"), ("p2", "new")]


ROWS = "doc_id string, rev string, value string"


def revised(df, value):
    new = df.withColumn("value", F.lit(value))
    return new.withColumn("rev", next_rev(F.col("rev"), F.col("value")))


def held(store):
    return {x.doc_id: (x.rev, x.value) for x in store.read().collect()}


def test_two_stores_converge_after_conflicts(spark, tmp_path):
    left, right = (Segments(spark, f"file://{tmp_path}/{n}", buckets=2, most=3) for n in "lr")
    gate = [True]
    sync = Sync(left, right, Snapshots(spark, f"file://{tmp_path}/ck"), gate=lambda: gate[0])
    assert not sync.round()
    left.write(spark.createDataFrame([(k, "1-a", f"left {k}") for k in "abc"], ROWS))
    right.write(spark.createDataFrame([("c", "1-b", "right c"), ("d", "1-b", "right d")], ROWS))
    assert sync.catch_up() > 0 and held(left) == held(right)
    assert held(left)["c"] == ("1-b", "right c") and set(held(left)) == set("abcd") and not sync.round()
    # both sides write: a once here and twice there, b on one side only
    left.merge(revised(left.read().where("doc_id IN ('a', 'b')"), "left again"))
    right.merge(revised(revised(right.read().where("doc_id = 'a'"), "right"), "right twice"))
    gate[0] = False
    before = held(left), held(right)
    assert sync.catch_up() == 0 and (held(left), held(right)) == before
    gate[0] = True
    assert sync.catch_up() > 0 and held(left) == held(right) and held(left)["a"][1] == "right twice" and held(left)["b"][1] == "left again"
    # another peer, for some documents only, from the start
    third = Segments(spark, f"file://{tmp_path}/t", buckets=2)
    some = Sync(left, third, Snapshots(spark, f"file://{tmp_path}/ck"), "third", spark.createDataFrame([("a",), ("d",)], "doc_id string"))
    assert some.catch_up() > 0 and set(held(third)) == {"a", "d"} and held(third)["a"] == held(left)["a"]
    assert sync.seen() == (left.version(), right.version())


def test_a_round_is_tried_again(spark, tmp_path, monkeypatch):
    left, right = (Segments(spark, f"file://{tmp_path}/{n}", buckets=1) for n in "lr")
    left.write(spark.createDataFrame([("a", "1-a", "x")], ROWS))
    sync = Sync(left, right, Snapshots(spark, f"file://{tmp_path}/ck"), pause=0)
    fails, write = [2], right.write

    def busy(*args):
        fails[0] -= 1
        if fails[0] >= 0:
            raise RuntimeError("written meanwhile")
        return write(*args)

    monkeypatch.setattr(right, "write", busy)
    assert sync.catch_up() > 0 and held(right) == held(left)


def test_changes_of_versions(spark, tmp_path):
    store = Segments(spark, f"file://{tmp_path}/s", buckets=1, most=2)
    assert store.changes(0) is None
    store.write(spark.createDataFrame([("a", "1-a", "x"), ("b", "1-a", "x")], ROWS))
    for n in range(3):
        store.merge(spark.createDataFrame([("a", f"{n + 2}-a", "y")], ROWS))
    assert store.version() == 5  # one is a compaction, which changes nothing
    assert sorted((x.rev, x.version) for x in store.changes(1).collect()) == [("2-a", 2), ("3-a", 3), ("4-a", 5)]
    assert store.changes(5).count() == 0 and store.changes(0, 1).count() == 2
    store.vacuum(1)
    assert {x.doc_id for x in store.changes(1).collect()} == {"a", "b"}
