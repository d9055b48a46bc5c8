"""Fill-in-the-middle: texts cut into prefix, middle and suffix at units, with the pieces in another order.

Units are lines, words or code points, counted over UTF-8 bytes in blocks. While they are counted, a
sparse index keeps the byte and the code-point offset of every STEP-th unit. A cut looks for the last
checkpoint before it by binary search and scans again from there, at most STEP units. The index of a
text of n units has n / STEP entries, and a scan holds one block of SCAN bytes.

Cuts and forms depend on a row's id and the seed alone, so reruns and other partitions agree.

Defined results: a null text counts as empty; an empty one, and one that contains a sentinel, is
plain, as are texts that the rate leaves out. A null id is read as empty text when it is hashed.
Repeated rows are treated alike, an empty table gives an empty result. ``transform`` carries all
other columns; its own (n, form, prefix_chars, middle_chars, output) replace those of the same name in
either case.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import mapped, slices, unused

#: Units between two checkpoints; bytes that are scanned at once.
STEP, SCAN = 64, 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _characters(block: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (block & 0xC0) != 0x80


#: Which bytes of a block begin a unit, given the byte before the block (-1: none).
STARTS = {
    "line": lambda block, before: np.concatenate([[before in (-1, 10)], block[:-1] == 10]),
    "char": lambda block, before: _characters(block),
    "word": lambda block, before: np.concatenate([[before == -1 or (bool(_SPACE[before]) and not _SPACE[block[0]])], _SPACE[block[:-1]] & ~_SPACE[block[1:]]]),
}


class Checkpoints:
    """The units of a text, with offsets of every step-th of them."""

    def __init__(self, text: bytes, unit: str = "line", step: int = STEP, scan: int = SCAN):
        self.text, self.starts, self.scan = np.frombuffer(text, np.uint8), STARTS[unit], scan
        self.units: list[int] = []  # numbers of units that have a checkpoint
        self.bytes: list[int] = []
        self.chars: list[int] = []
        self.n = self.length = 0
        for at, block in self._blocks(0):
            places = np.flatnonzero(self.starts(block, self._before(at)))
            wanted = places[(-self.n) % step :: step]
            self.units += range(self.n + (-self.n) % step, self.n + len(places), step)
            self.bytes += (at + wanted).tolist()
            counts = np.cumsum(_characters(block))
            self.chars += (self.length + counts[wanted] - 1).tolist()
            self.n += len(places)
            self.length += int(counts[-1])

    def _blocks(self, start: int, size: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        while start < len(self.text):
            block = self.text[start : start + (size or self.scan)]
            yield start, block
            start += len(block)

    def _before(self, at: int) -> int:
        return int(self.text[at - 1]) if at else -1

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first so many units."""
        if units >= self.n:
            return len(self.text), self.length
        c = bisect.bisect_right(self.units, units) - 1
        left, chars = units - self.units[c], self.chars[c]
        for at, block in self._blocks(self.bytes[c], min(self.scan, 1 << 12)):
            places = np.flatnonzero(self.starts(block, self._before(at)))
            if left < len(places):
                return at + int(places[left]), chars + int(_characters(block[: places[left]]).sum())
            left, chars = left - len(places), chars + int(_characters(block).sum())
        raise AssertionError("a unit lies behind the last one")


def draws(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits from the seed and a row's id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: bytes, key: str, unit: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output)."""
    index = Checkpoints(text, unit)
    h = draws(seed, key)
    if not text or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return index.n, "plain", None, None, text
    (a, ca), (b, cb) = (index.cut(u) for u in sorted((h[0] % (index.n + 1), h[1] % (index.n + 1))))
    p, s, m = MARKS
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return index.n, "spm", ca, cb - ca, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", ca, cb - ca, b"".join((p, prefix, s, suffix, m, middle))


MADE = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "binary"}


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; rate and spm are percentages of rows."""
    if unit not in STARTS:
        raise ValueError(f"units are {', '.join(STARTS)}")
    carried = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE or c in (id_column, text)))
    key, raw = unused(docs, "key", "raw")
    given = carried.withColumn(key, F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))).withColumn(raw, F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b"")))
    fields = [f for f in carried.schema.fields if f.name.lower() not in MADE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [rearranged(t.as_py(), k.as_py(), unit, seed, rate, spm) for t, k in zip(batch.column(raw), batch.column(key), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + made, names=[f.name for f in fields] + list(MADE))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} {kind}" for c, kind in MADE.items()])
    return mapped(given, run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No sentinel can arise where pieces meet: none begins inside another."""
    after = lambda x, mark: F.substring(x, F.length(F.substring_index(x, mark, 1)) + len(mark) + 1, F.length(x))
    first = lambda x, mark: F.substring_index(x, mark, 1)
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    psm = F.concat(first(body, SUFFIX), after(body, MIDDLE), first(after(body, SUFFIX), MIDDLE))
    spm = F.concat(first(after(body, PREFIX), MIDDLE), after(body, MIDDLE), first(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
