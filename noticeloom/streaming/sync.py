"""Two stores of documents kept alike while both are written.

Each side's versions are its change sequence. A checkpoint, a store of its own, holds for each peer the
versions up to which its changes were taken over. A round reads only later changes of both sides, finds for
each changed document the last revision (counter, then hash) that the sides hold, and merges it where
it is not held yet; then the checkpoint moves on. A round that ends in between is done again: what was
merged already is not written twice. A gate that is shut stops rounds; they go on where they ended.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeloom.sources.segments import Segments, beside
from noticeloom.sources.store import Snapshots, last_revision


class Sync:
    """Continuous replication between two stores; wanted(changed ids) chooses which documents take part."""

    def __init__(self, left: Segments, right: Segments, checkpoint: Snapshots, peer: str = "peer", wanted: DataFrame | None = None, gate: Callable[[], bool] = lambda: True, tries: int = 5, pause: float = 0.5):
        self.left, self.right, self.checkpoint, self.peer = left, right, checkpoint, peer
        self.wanted, self.gate, self.tries, self.pause = wanted, gate, tries, pause
        self.key = left.key

    def seen(self) -> tuple[int, int]:
        """The versions of both sides whose changes this peer has taken over."""
        held = self.checkpoint.read()
        row = held.where(F.col("peer") == self.peer).first() if held is not None else None
        return (row["left"], row["right"]) if row else (0, 0)

    def _advance(self, left: int, right: int) -> None:
        row = self.left.spark.createDataFrame([(self.peer, left, right)], "peer string, left int, right int")
        self.checkpoint.merge(row, key="peer") if self.checkpoint.version() else self.checkpoint.write(row, 0)

    def _taken(self, side: Segments, winners: DataFrame, size: int) -> int | None:
        """Merge the revisions that a side does not hold, out of changes of so many bytes; the version that did it, None if there were none."""
        have = side.read()
        new = winners if have is None else winners.join(have.select(self.key, F.col("rev")).hint("merge"), [self.key, "rev"], "left_anti")
        if new.isEmpty():
            return None
        if have is None:
            return side.write(new, 0)
        return side.change(lambda now, _: last_revision(new.select(*now.columns).unionByName(now.join(beside(new.select(self.key), size), self.key, "left_semi")), self.key), self.key)[0]

    def round(self) -> bool:
        """Take over both sides' changes since the last round; False if the gate is shut or nothing was new."""
        if not self.gate():
            return False
        seen, now = self.seen(), (self.left.version(), self.right.version())
        if now == seen:
            return False
        keys, size = None, 0
        for side, since, upto in zip((self.left, self.right), seen, now, strict=True):
            changed = side.changes(since, upto) if upto > since else None
            if changed is not None:
                size += side.changed(since, upto)
                keys = changed.select(self.key) if keys is None else keys.unionByName(changed.select(self.key))
        keys = keys.distinct() if self.wanted is None else keys.distinct().join(self.wanted.select(self.key), self.key, "left_semi")
        keys = beside(keys, size)
        held = [side.read(upto).join(keys, self.key, "left_semi") for side, upto in zip((self.left, self.right), now, strict=True) if upto]
        both = held[0] if len(held) == 1 else held[0].unionByName(held[1].select(*held[0].columns))
        winners = last_revision(both, self.key).persist()
        try:
            for side in (self.left, self.right):
                self._taken(side, winners, size)
        finally:
            winners.unpersist()
        # what this round wrote is seen again once, and found on both sides
        self._advance(*now)
        return True

    def catch_up(self) -> int:
        """Rounds until nothing is new or the gate is shut, each tried again if another writer was first; returns their number."""
        rounds = failed = 0
        while True:
            try:
                if not self.round():
                    return rounds
                rounds, failed = rounds + 1, 0
            except RuntimeError:
                failed += 1
                if failed >= self.tries:
                    raise
                time.sleep(self.pause)

    def start(self, ticks: DataFrame, checkpoint: str) -> StreamingQuery:
        """Catch up whenever a stream (of the sides' changes, or a clock) has a batch."""
        return ticks.writeStream.foreachBatch(lambda df, number: self.catch_up() and None).option("checkpointLocation", checkpoint).start()
