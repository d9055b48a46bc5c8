"""Streams of documents: claims, results, dead letters and change feeds."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeloom.sources.store import Snapshots, upserts


def unclaimed(documents: DataFrame) -> DataFrame:
    """Documents with a picture that nobody works on and no event was made of."""
    return documents.where(F.col("processed_by").isNull() & F.col("event_id").isNull() & F.map_contains_key("attachments", "userimage"))


def claimed(documents: DataFrame, engine: str) -> DataFrame:
    return documents.withColumn("processed_by", F.lit(engine))


def released(documents: DataFrame) -> DataFrame:
    return documents.withColumn("processed_by", F.lit(None).cast("string"))


def mark(engine: str, stream: str | None = None, batch: int | None = None) -> str:
    """The name that a claim puts on a document: the engine's, with the stream and the batch if it is a batch's."""
    return engine if batch is None else f"{engine}/{hashlib.md5((stream or '').encode()).hexdigest()[:12]}/{batch}"


def claim(store: Snapshots, wanted: DataFrame, engine: str, key: str = "doc_id") -> DataFrame | None:
    """Put a name (see ``mark``) on those of the wanted documents that are free and whose revision is still the stored one.

    Returns the documents that have the name, as they are stored: a batch that runs again gets those that it claimed before, too."""
    mine = lambda now: unclaimed(now).join(wanted.select(key, "rev"), [key, "rev"], "left_semi")
    done = store.change(lambda now, _: upserts(now, claimed(mine(now), engine), key), key)
    if done is None:
        return None
    return store.read(done[0]).where(F.col("processed_by") == engine).join(wanted.select(key), key, "left_semi")


def release(store: Snapshots, documents: DataFrame, engine: str, key: str = "doc_id") -> None:
    """Take a name off documents that it has claimed."""
    store.change(lambda now, _: upserts(now, released(now.where(F.col("processed_by") == engine).join(documents.select(key), key, "left_semi")), key), key)


#: Claims: who works on which revision of a document. A fence is the version of the ledger that granted the claim, so later grants have larger ones.
LEDGER = "doc_id {key}, rev string, engine string, stream string, batch long, fence long, until timestamp, state string"
HELD, DONE, FREE = "held", "done", "free"


def granted(ledger: DataFrame, wanted: DataFrame, engine: str, stream: str, batch: int, fence: int, now: datetime.datetime, lease: datetime.timedelta, key: str = "doc_id") -> DataFrame:
    """The rows of the ledger by which a batch gets wanted(key, rev) documents: those that nobody holds, whose holder's
    time is over, that are done in another revision, or that this batch holds already (it runs again)."""
    new = wanted.select(key, "rev").dropDuplicates([key])
    old = ledger.select(key, *[F.col(c).alias(f"_{c}") for c in ("rev", "engine", "stream", "batch", "until", "state")], F.lit(True).alias("_known"))
    at = F.lit(now).cast("timestamp")
    own = (F.col("_engine") == engine) & (F.col("_stream") == stream) & (F.col("_batch") == batch)
    free = F.col("_known").isNull() | (F.col("_state") == FREE) | ((F.col("_state") == HELD) & (own | (F.col("_until") <= at))) | ((F.col("_state") == DONE) & ~F.col("_rev").eqNullSafe(F.col("rev")))
    return new.join(old, key, "left").where(free).select(
        key, "rev", F.lit(engine).alias("engine"), F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"), F.lit(fence).cast("long").alias("fence"), (at + F.lit(lease)).alias("until"), F.lit(HELD).alias("state"))


class Ledger:
    """Claims of engines on documents, in a store of their own that any number of engines write."""

    def __init__(self, store: Snapshots, engine: str, stream: str, lease: datetime.timedelta = datetime.timedelta(minutes=10), key: str = "doc_id", clock: Callable[[], datetime.datetime] = datetime.datetime.now):
        self.store, self.engine, self.stream, self.lease, self.key, self.clock = store, engine, stream, lease, key, clock

    def claim(self, wanted: DataFrame, batch: int) -> tuple[int, DataFrame]:
        """(fence, the claims that this batch now has)."""
        if not self.store.version():
            kind = dict(wanted.dtypes)[self.key]
            with contextlib.suppress(RuntimeError):  # another engine was first
                self.store.write(wanted.sparkSession.createDataFrame([], LEDGER.format(key=kind).replace("doc_id", self.key)), 0)
        fence, _ = self.store.change(lambda now, number: granted(now, wanted, self.engine, self.stream, batch, number, self.clock(), self.lease, self.key), self.key)
        return fence, self._own(fence)

    def _own(self, fence: int) -> DataFrame:
        return self.store.read().where((F.col("fence") == fence) & (F.col("engine") == self.engine) & (F.col("state") == HELD))

    def fenced(self, out: DataFrame, fence: int) -> DataFrame:
        """The rows of out whose documents are still held by the claims of this fence; the number is put in as a column."""
        return out.join(self._own(fence).select(self.key), self.key, "left_semi").withColumn("fence", F.lit(fence).cast("long"))

    def settle(self, fence: int, state: str = DONE) -> None:
        """Mark the claims of a fence as done, or as free after a failure."""
        self.store.change(lambda now, _: now.where((F.col("fence") == fence) & (F.col("engine") == self.engine) & (F.col("state") == HELD)).withColumn("state", F.lit(state)), self.key)


def processed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Snapshots, checkpoint: str, key: str = "doc_id", dead: Snapshots | None = None, dry_run: bool = False,
              interval: str | None = None, documents: Snapshots | None = None, engine: str | None = None, ledger: Ledger | None = None) -> StreamingQuery:
    """Run work on each batch and put its rows into a store.

    With a ledger, each batch first claims its documents there and works on those that it got. The claims
    carry engine, stream and batch, so a batch that runs again after a crash gets its own back,
    whether the crash came before or after the sink was written. Rows reach the sink with their fence, and
    only if the claim still holds and the sink has none of a later one: an engine that was taken for dead
    and comes back changes nothing. With a store of documents and an engine's name, claims are put on the
    documents themselves, likewise by batch; both may be used together.

    Rows of work's result whose status (see registry.table_function) is failed go to the dead letters alone, the
    others of their batch to the sink. A batch that fails goes to the dead letters with its error and its claims are released; the query fails if
    there are none to take it. A batch that runs again puts in the same rows. dry_run writes nothing."""

    def letters(rows: DataFrame, error: Column, number: int) -> None:
        made = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in ("images", "processed_by", "status", "error")])).alias("record"), error.alias("error"), F.lit(number).alias("batch"))
        known = dead.read()
        dead.write(made if known is None else known.where(F.col("batch") != number).unionByName(made))

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        got, fence = None, None
        name = mark(engine, checkpoint, number) if engine else ""
        try:
            some = df
            if documents is not None and not dry_run:
                got = claim(documents, df, name, key)
                some = df if got is None else df.join(got.select(key), key, "left_semi")
            if ledger is not None and not dry_run:
                fence, held = ledger.claim(some, number)
                some = some.join(held.select(key), key, "left_semi")
            out = work(some)
            if {"status", "error"} <= set(out.columns) and not dry_run:
                out = out.persist()
                bad = out.where(F.col("status") == "failed")
                if not bad.isEmpty():
                    if dead is None:
                        raise ValueError(bad.first()["error"])
                    letters(bad.join(df, key, "left_semi") if key in bad.columns else bad, F.col("error"), number)
                out = out.where(F.coalesce(F.col("status") != "failed", F.lit(True))).drop("status", "error")
            if not dry_run:
                if fence is None:
                    sink.put(out, key)
                else:
                    sink.put(ledger.fenced(out, fence), key, fence="fence")
                    ledger.settle(fence)
        except Exception as error:
            if got is not None:
                release(documents, got, name, key)
            if fence is not None:
                ledger.settle(fence, FREE)
            if dead is None or dry_run:
                raise
            letters(df, F.lit(str(error)[:2000]), number)
        finally:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest_state(changes: DataFrame, key: str, when: str) -> DataFrame:
    """The last change of each key, as a running table (output mode complete or update)."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), when).alias("s")).select(key, "s.*")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour", when: str = "ts") -> DataFrame:
    """Counts and sums by event type in windows of time; rows later than the watermark are dropped by a stream."""
    marked = events.withWatermark(when, late) if events.isStreaming else events
    return marked.groupBy(F.window(when, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
