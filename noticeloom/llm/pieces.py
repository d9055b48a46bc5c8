"""SentencePiece encoding and decoding of BPE models with byte fallback, by suffix-array matching.

Texts are cut where no piece can cross: between characters that stand side by side in none. The
distinct segments that a batch adds are concatenated and indexed by a suffix array; every piece of the
vocabulary finds its range of occurrences by binary search; the ranges become edges (place, piece),
sorted by place in their segments, which are then relaxed from left to right, all segments side by
side. An edge is taken if the piece before it and its own piece stay apart when merged by the model's
ranks: then and only then is it the last piece of the prefix's encoding, so each place keeps one piece,
and the result equals the merges'. Characters without a piece of their own become their UTF-8 bytes' pieces.

The vocabulary (bounded by the model) is broadcast. A task keeps at most CACHE segments.

Defined results: a null text has null ids, an empty one has none; U+2581 reads as a space, as the
model itself has it; repeated rows are encoded alike; an empty table gives an empty result. All
columns but the text are carried by ``encode``; clashing names (ids, n_tokens, round_trip) are replaced.
``decode`` reads a null id, or one outside the vocabulary, as U+FFFD.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from noticeloom.llm.common import mapped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments that a task remembers, characters that it indexes at once, pairs of pieces that it remembers.
CACHE, INDEX_CHARS, PAIRS = 200_000, 1 << 17, 1_000_000
#: Segments with more characters are relaxed one by one.
LONG = 256


class Vocabulary(NamedTuple):
    pieces: list[str]
    kinds: list[str]  # piece, byte or control
    scores: list[float]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece"
        ids = range(m.get_piece_size())
        return Vocabulary([m.id_to_piece(i) for i in ids], [kind(i) for i in ids], [m.get_score(i) for i in ids])


def suffix_array(keys: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Places of a text in the order of their first depth characters at least, by prefix doubling.

    keys hold the first width characters of each place."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], keys[order][1:] != keys[order][:-1]]))
    while width < depth and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]]))
        width *= 2
    return order


def groups(order_of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], order_of[1:] != order_of[:-1]])) if len(order_of) else np.zeros(0, np.int64)
    return list(zip(order_of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order_of)], strict=True))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        known = list(enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)))
        number = {p: i for i, (p, kind) in known if kind == "piece"}
        self.rank = {p: -vocabulary.scores[i] for p, i in number.items()}  # the least is merged first
        self.byte = {int(p[3:5], 16): np.int32(i).tobytes() for i, (p, kind) in known if kind == "byte"}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "piece" else b"" for _, (p, kind) in known]
        self.text = list(number)
        self.at = {p: k for k, p in enumerate(self.text)}
        self.ids = np.array(list(number.values()), np.int32)
        self.lengths = np.array([len(p) for p in self.text])
        self.depth = int(self.lengths.max(initial=1))
        self._characters()
        self._derivations()
        self.cache: dict[str, bytes] = {}
        self.pairs, self.stay = np.zeros(0, np.int64), np.zeros(0, bool)  # known pairs of pieces and whether they stay apart

    def _characters(self) -> None:
        """Classes of characters (0: none of its own in any piece), which of them stand side by side in pieces, packed pieces."""
        alphabet = sorted(p for p in self.text if len(p) == 1)
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        codes = np.zeros((len(self.text), self.depth), np.int64)
        for k, p in enumerate(self.text):
            codes[k, : len(p)] = self.classes[[ord(c) for c in p]]
        self.beside = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        self.beside[codes[:, :-1], codes[:, 1:]] = True
        self.beside[0], self.beside[:, 0] = False, False
        self.bits = len(alphabet).bit_length()
        self.width = 62 // self.bits  # characters of one key
        blocks = -(-self.depth // self.width)
        grid = np.zeros((len(self.text), blocks * self.width), np.int64)
        grid[:, : self.depth] = codes
        top = np.where(np.arange(blocks * self.width)[None, :] < self.lengths[:, None], grid, (1 << self.bits) - 1)
        self.low, self.high = (np.stack([self.packed(g[:, k * self.width : (k + 1) * self.width].T) for k in range(blocks)]) for g in (grid, top))

    def packed(self, columns) -> np.ndarray:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key << self.bits | c
        return key

    def _derivations(self) -> None:
        """Of each piece, what stands at its left and right ends while it is merged, and from which rank on.

        At its right end stands right[k, j] from the rank right_from[k, j] on until the next one's."""
        self.plain = np.zeros(len(self.text), bool)  # made by merges of rising rank, as all of a trained model are
        ends: tuple[list, list] = [], []
        for k, p in enumerate(self.text):
            parts, left, right = list(p), [(p[0], -math.inf)], [(p[-1], -math.inf)]
            rising, before = True, -math.inf
            while len(parts) > 1:
                least, i = self.next_merge(parts)
                if least == math.inf:
                    break
                rising, before = rising and least >= before, least
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append((parts[0], least))
                if i == len(parts) - 1:
                    right.append((parts[-1], least))
            strict = all(a[1] < b[1] for x in (left, right) for a, b in zip(x, x[1:], strict=False))
            self.plain[k] = rising and strict and parts == [p] and all(c in self.at for c in p)
            ends[0].append(left)
            ends[1].append(right)
        longest = max((len(x) for side in ends for x in side), default=1)
        (self.left, self.left_from), (self.right, self.right_from) = ((np.full((len(self.text), longest), -1), np.full((len(self.text), longest + 1), math.inf)) for _ in ends)
        for side, names, times in ((ends[0], self.left, self.left_from), (ends[1], self.right, self.right_from)):
            for k, x in enumerate(side):
                names[k, : len(x)] = [self.at.get(p, -1) for p, _ in x]
                times[k, : len(x)] = [t for _, t in x]
        splits = [(self.at[p[:i]] << 20 | self.at[p[i:]], self.rank[p]) for p in self.text for i in range(1, len(p)) if p[:i] in self.at and p[i:] in self.at]
        splits.sort()
        self.split, self.split_rank = np.array([c for c, _ in splits], np.int64), np.array([r for _, r in splits], float)

    def next_merge(self, parts: list[str]) -> tuple[float, int]:
        return min((self.rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))

    # pieces
    def merged(self, text: str) -> list[str]:
        """Merge neighbours by rank until none is left, leftmost first: for single pieces and pairs."""
        parts = list(text)
        while len(parts) > 1:
            least, i = self.next_merge(parts)
            if least == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stays(self, before: int, piece: int) -> bool:
        """Whether a piece keeps apart from the one before it (its place plus 1; 0 at a start), by merging both."""
        second = self.text[piece]
        want = [self.text[before - 1], second] if before else [second]
        return self.merged("".join(want)) == want

    def stay_apart(self, pairs: np.ndarray) -> np.ndarray:
        """stays() of many pairs (before << 20 | piece).

        Both pieces are merged on their own, in the order of ranks, unless the end of the first and the
        start of the second, as they stand at some time, have a merge that comes before the next one of either."""
        before, piece = (pairs >> 20) - 1, pairs & ((1 << 20) - 1)
        slow = ~self.plain[piece] | ((before >= 0) & ~self.plain[before])
        out = np.ones(len(pairs), bool)
        open_ = np.flatnonzero(~slow & (before >= 0))
        i, j = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        while len(open_):
            a, b, x, y = before[open_], piece[open_], i[open_], j[open_]
            code = self.right[a, x] << 20 | self.left[b, y]
            at = np.minimum(np.searchsorted(self.split, code), len(self.split) - 1)
            rank = np.where(self.split[at] == code, self.split_rank[at], math.inf) if len(self.split) else np.full(len(code), math.inf)
            here = np.maximum(np.maximum(self.right_from[a, x], self.left_from[b, y]), rank)
            next_a, next_b = self.right_from[a, x + 1], self.left_from[b, y + 1]
            out[open_[(here < next_a) & (here <= next_b)]] = False
            first = next_a <= next_b
            i[open_[first]] += 1
            j[open_[~first]] += 1
            open_ = open_[out[open_] & ((next_a < math.inf) | (next_b < math.inf))]
        for k in np.flatnonzero(slow).tolist():
            out[k] = self.stays(int(before[k]) + 1, int(piece[k]))
        return out

    def apart(self, pairs: np.ndarray) -> np.ndarray:
        """stay_apart(), remembered."""
        if not len(self.pairs) or (missing := np.unique(pairs[self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] != pairs])).size:
            missing = missing if len(self.pairs) else np.unique(pairs)
            if len(self.pairs) > PAIRS:
                self.pairs, self.stay, missing = np.zeros(0, np.int64), np.zeros(0, bool), np.unique(pairs)
            every = np.concatenate([self.pairs, missing])
            order = np.argsort(every, kind="stable")
            self.pairs, self.stay = every[order], np.concatenate([self.stay, self.stay_apart(missing)])[order]
        return self.stay[np.searchsorted(self.pairs, pairs)]

    # matching
    def occurrences(self, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of every piece in the suffix array, by binary searches made side by side, a key's characters at a time."""
        first = keys[order]
        low, high = np.searchsorted(first, self.low[0], "left"), np.searchsorted(first, self.high[0], "right")
        later = np.concatenate([keys, np.zeros(len(self.low) * self.width, np.int64)])
        for k in range(1, len(self.low)):
            longer = np.flatnonzero((self.lengths > k * self.width) & (low < high))
            bounds = []
            for wanted, above in ((self.low[k], False), (self.high[k], True)):
                a, z = low[longer].copy(), high[longer].copy()
                while (open_ := np.flatnonzero(a < z)).size:
                    mid = (a[open_] + z[open_]) // 2
                    seen, want = later[order[mid] + k * self.width], wanted[longer[open_]]
                    right = seen <= want if above else seen < want
                    a[open_[right]] = mid[right] + 1
                    z[open_[~right]] = mid[~right]
                bounds.append(a)
            low[longer], high[longer] = bounds
        return low, high

    def learn(self, segments: list[str]) -> None:
        """Encode new segments of known characters and remember them."""
        whole = "\0" + "\0".join(segments) + "\0"
        text = self.classes[np.frombuffer(whole.encode("utf-32-le"), np.uint32)].astype(np.int64)
        n = len(text)
        padded = np.concatenate([text, np.zeros(self.width, np.int64)])
        keys = self.packed([padded[k : k + n] for k in range(self.width)])
        order = suffix_array(keys, self.width, self.depth)
        low, high = self.occurrences(keys, order)
        counts = high - low
        piece = np.repeat(np.arange(len(counts)), counts)
        at = order[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        sizes = np.array([len(s) for s in segments])
        start = np.cumsum(np.concatenate([[1], sizes[:-1] + 1]))
        end = start + sizes
        offset = at - np.repeat(start, sizes + 1)[at - 1]
        # edges by their place in the segment, so that all segments are relaxed side by side, those that are very long by themselves
        last, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)  # by place: the piece that ends there, plus 1, and its start
        last[start] = 0
        reach = self.lengths[piece]
        sort = np.argsort(offset, kind="stable")
        sort = sort[np.repeat(sizes, sizes + 1)[at[sort] - 1] <= LONG]
        piece_, at_, to = piece[sort], at[sort], (at + reach)[sort]
        for _, a, z in groups(offset[sort]):
            before, j = last[at_[a:z]], to[a:z]
            use = np.flatnonzero((before >= 0) & (last[j] < 0))
            p = piece_[a:z][use]
            use = use[self.apart(before[use] << 20 | p)]
            last[j[use]], back[j[use]] = piece_[a:z][use] + 1, at_[a:z][use]
        if (sizes > LONG).any():
            self.relax_long(np.flatnonzero(sizes > LONG), start, end, piece, at, last, back)
        # back from the ends
        owner, place, found = np.arange(len(segments)), end.copy(), []
        while len(owner):
            found.append((owner, last[place] - 1))
            place = back[place]
            more = place > start[owner]
            owner, place = owner[more], place[more]
        owners, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(owners[::-1], kind="stable")
        ids = self.ids[pieces[::-1][by]].tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(segments)))])).tolist()
        for s, a, z in zip(segments, bounds, bounds[1:], strict=False):
            self.cache[s] = ids[a:z]

    def relax_long(self, rows, start, end, piece, at, last, back) -> None:
        """The same edge by edge, for segments with too many places to relax them side by side."""
        sort = np.argsort(at, kind="stable")
        piece, at = piece[sort], at[sort]
        for row in rows.tolist():
            a, z = np.searchsorted(at, (start[row], end[row])).tolist()
            mine, known = {int(start[row]): (0, 0)}, {}
            for i, p in zip(at[a:z].tolist(), piece[a:z].tolist(), strict=True):
                j = i + len(self.text[p])
                if i in mine and j not in mine:
                    pair = mine[i][0] << 20 | p
                    if pair not in known:
                        known[pair] = bool(self.apart(np.array([pair]))[0])
                    if known[pair]:
                        mine[j] = p + 1, i
            places = np.fromiter(mine, np.int64, len(mine))
            last[places], back[places] = np.array(list(mine.values())).T

    def cut(self, text: str) -> list[str]:
        """A text cut between neighbours that stand side by side in no piece."""
        code = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        bounds = (np.flatnonzero(~self.beside[code[:-1], code[1:]]) + 1).tolist()
        return [text[a:z] for a, z in zip([0, *bounds], [*bounds, len(text)], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as 32-bit integers."""
        split = [None if t is None else self.cut((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        every = set().union(*(row for row in split if row))
        if len(self.cache) + len(every) > CACHE:
            self.cache.clear()
        fresh, chars = [], 0
        for s in sorted(every - self.cache.keys()):
            if len(s) == 1 and not self.classes[ord(s)]:
                self.cache[s] = b"".join(self.byte[x] for x in s.encode("utf-8", "replace"))
                continue
            fresh.append(s)
            chars += len(s) + 1
            if chars >= INDEX_CHARS:
                self.learn(fresh)
                fresh, chars = [], 0
        if fresh:
            self.learn(fresh)
        look = self.cache.__getitem__
        return [None if row is None else b"".join(map(look, row)) for row in split]

    def decode(self, ids: bytes | None) -> str | None:
        """The text of 32-bit ids; those outside the vocabulary read as U+FFFD."""
        if ids is None:
            return None
        given = np.frombuffer(ids, np.int32)
        raw = self.raw
        if len(given) and (given.min() < 0 or given.max() >= len(raw)):
            parts = [raw[x] if 0 <= x < len(raw) else b"\xef\xbf\xbd" for x in given.tolist()]
        else:
            parts = map(raw.__getitem__, given.tolist())
        return b"".join(parts).decode("utf-8", "replace").removeprefix(" ")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(key: int, vocabulary: Vocabulary) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


#: Rows that are encoded together.
ROWS = 500


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs without text, with ids, n_tokens and round_trip (whether the decoded ids give the text)."""
    vocabulary = Vocabulary.load(model)
    key = hash((tuple(vocabulary.pieces), model))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    place = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("text", "ids", "n_tokens", "round_trip")]
    names = [docs.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = batch.column(place).to_pylist()
                rows = encoder.encode(texts)
                counts = [0 if r is None else len(r) // 4 for r in rows]
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), np.int32))
                ids = pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in rows]))
                same = [None if t is None else encoder.decode(r) == t.replace(SPACE, " ") for t, r in zip(texts, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), ids, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "round_trip"])

    extra = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return mapped(docs, run, T.StructType([*(docs.schema[i] for i in kept), *extra]))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with text made from ids; a null list gives a null text."""
    vocabulary = Vocabulary.load(model)
    key = hash((tuple(vocabulary.pieces), model))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [i for i, c in enumerate(rows.columns) if c.lower() != "text"]
    place = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, shared.value)
        for batch in batches:
            texts = [encoder.decode(None if x is None else np.array([-1 if i is None or not 0 <= i < len(encoder.raw) else i for i in x], np.int32).tobytes()) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in kept), "text"])

    return mapped(rows, run, T.StructType([*(rows.schema[i] for i in kept), T.StructField("text", T.StringType())]))
