"""Change feeds with a state for each key: last revisions, deletions, late and repeated changes, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LastChange(StatefulProcessor):
    """Keeps the sequence number of a key's last change and whether it lives; hands on what is later.

    A row is handed on for each batch in which the key's last change is new, with ``delta``: +1 if the key came
    into being, -1 if it went, 0 if it was changed. Keys without changes for ttl milliseconds are forgotten."""

    def __init__(self, key: str, sequence: str, deleted: str, columns: list[str], ttl: int | None):
        self.key, self.sequence, self.deleted, self.columns, self.ttl = key, sequence, deleted, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long, alive boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: r[self.sequence])
        held = self.last.get()  # None if the key is new
        number = best[self.sequence]
        if held is not None and number <= held[0]:
            return
        alive, was = not best[self.deleted], held is not None and held[1]
        self.last.update((number, alive))
        yield Row(**{c: best[c] for c in self.columns}, delta=int(alive) - int(was))

    def close(self) -> None:
        pass


def latest_of_batches(changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """changes, for a stream or table, without those that are followed by a later one of their key in the same batch of rows.

    It keeps no state and needs no shuffle, so what comes to the state is nearer to one row a key than to one a change."""

    def latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(key).dictionary_encode().indices.to_numpy()
            order = np.lexsort((-np.arange(batch.num_rows), batch.column(sequence).to_numpy(), code))  # the first of equal ones comes last
            last = np.append(code[order][1:] != code[order][:-1], True)[: len(order)]
            yield batch.take(pa.array(np.sort(order[last])))

    return changes.mapInArrow(latest, changes.schema)


def last_changes(changes: DataFrame, key: str, sequence: str, deleted: str = "deleted", since: int | None = None, ttl: int | None = None) -> DataFrame:
    """A stream of changes(key, sequence long, deleted boolean, ...) reduced to those that are later than all before of their key.

    since leaves out all changes up to that sequence number (a feed that starts now is given the newest one).
    Changes without a key or a sequence number are left out. Whatever the order and however often changes
    come, the last row of a key is its last change, and the deltas add up to the number of living keys."""
    changes.sparkSession.conf.set(PROVIDER, ROCKS)
    some = changes.where(F.col(key).isNotNull() & F.col(sequence).isNotNull()).withColumn(sequence, F.col(sequence).cast("long"))
    some = some if since is None else some.where(F.col(sequence) > since)
    schema = T.StructType([*some.schema.fields, T.StructField("delta", T.IntegerType())])
    simple = not dict(some.dtypes)[key].startswith(("struct", "array", "float", "double"))  # what Arrow and Spark tell apart alike
    some = latest_of_batches(some, key, sequence) if simple else some
    return some.groupBy(key).transformWithState(LastChange(key, sequence, deleted, some.columns, ttl), schema, "Update", "ProcessingTime" if ttl else "None")


def changed_posters(changes: DataFrame, posters: DataFrame, event: str = "event_id") -> DataFrame:
    """Posters with the fresh values of their events, for a stream or table of changes (event, deleted, ...); deletions and unknown ids do nothing."""
    alive = changes.where(~F.coalesce("deleted", F.lit(False)))
    return alive.join(posters, event)
