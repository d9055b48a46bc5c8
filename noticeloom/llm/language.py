"""Language identification by cross-parsing entropy over suffix automata.

For every language a bounded sample of labelled text is indexed by a suffix automaton. A text is
parsed greedily into the longest phrases that occur in the sample; the language that needs the
fewest phrases, normalised by the bits that one phrase costs (log2 of the sample's length, and at least
one more than those of any character), wins.
A character that a sample lacks ends the phrase before it and is a phrase of its own.

A missing transition of the automata already holds the restart at the root and the phrases that end,
so parsing is one gather per character and language, made for many whole texts side by side. The
sample is broadcast as text: its bound is LANG_DOCS documents of LANG_CHARS characters in all for
each language. Each Python worker builds the table once.

Defined results: texts that are null or hold no letter are ``und`` with score 0; a text's
prediction depends on the text only, so copies agree; ties go to the language that sorts first;
with no labelled text every prediction is ``und``; an empty table gives an empty result. The score
is the share by which the best language's cost lies below the second best's (1 if there is only
one language). Extra columns are ignored by ``identify`` and carried by ``predict_languages``, where
those named lang_pred, score and bits are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import mapped, slices

#: Bounds of the training sample for each language.
LANG_DOCS, LANG_CHARS = 60, 24_000
#: Characters with dense transitions; bits of a state's number; texts that are worth parsing side by side.
DENSE, STATE_BITS, SIDES = 64, 28, 12
ONE = 1 << STATE_BITS
#: Texts that a task works on at once.
ROWS = 1000
#: Documents that cost at least this share of the bits that random letters do are rejected by keep_identified, but for short ones.
RANDOM_SHARE, SHORT = 1.0, 250
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def folded(text: str) -> str:
    """Lower case, with everything that is no letter as a single space."""
    return re.sub(r"[\W\d_]+", " ", text.lower())


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class CrossParser:
    """Automata of all languages in one table of states.

    Transitions by the most frequent characters are dense: dense[state * DENSE + class] holds the next
    state and, in the bits above STATE_BITS, the phrases that end there. Those by rarer characters are
    sorted keys, so large alphabets cost no more than the samples have characters."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        times = Counter(c for text in samples.values() for c in text)
        alphabet = [c for c, _ in sorted(times.items(), key=lambda x: (-x[1], x[0]))]
        self.width = len(alphabet) + 1  # the last class is any other character
        self.classes = np.full(0x110000, self.width - 1, np.int32)
        self.classes[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.common = min(DENSE, self.width)
        tables, keys, to, self.roots, at = [], [], [], [], 0
        self.root_to = np.full((len(self.languages), self.width), -1, np.int64)
        for j, language in enumerate(self.languages):
            nxt = suffix_automaton(self.encode(samples[language]))
            for c, state in nxt[0].items():
                self.root_to[j, c] = at + state
            # without a transition the phrase ends: the next one starts at the root, or the character is one by itself
            restart = np.where(self.root_to[j] >= 0, self.root_to[j] + ONE, at + 2 * ONE)
            table = np.tile(restart[: self.common], (len(nxt), 1))
            table[0] = np.where(self.root_to[j] >= 0, self.root_to[j], at + ONE)[: self.common]
            for state, moves in enumerate(nxt):
                for c, s in moves.items():
                    if c < self.common:
                        table[state, c] = at + s
                    else:
                        keys.append((at + state) * self.width + c)
                        to.append(at + s)
            tables.append(table.astype(np.int32))
            self.roots.append(at)
            at += len(nxt)
        self.dense = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        # a phrase costs a place in the sample, but no less than naming any character: else a tiny sample would win by cheap phrases
        self.bits = np.array([max(math.log2(max(2, len(samples[x]))), 1 + math.log2(self.width)) for x in self.languages])
        #: what a character costs in a text of random letters of a language: phrases of it are as long as strings of that length are all in the sample
        self.random = {x: math.log2(max(2, len(set(samples[x])))) for x in self.languages}
        self.root = np.array(self.roots, np.int32 if self.dense.size < 1 << 31 else np.int64)[:, None]

    def encode(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states and ended phrases (languages by texts) for one character of each text."""
        if self.width == self.common:
            return self.dense[state * self.common + c]
        v = self.dense[state * self.common + np.minimum(c, self.common - 1)]
        if (rare := np.flatnonzero(c >= self.common)).size:
            v = v.astype(np.int64)
            s, k = state[:, rare], c[rare]
            root = self.root_to[:, k]
            fresh = np.where(root >= 0, root, self.root + ONE) + np.where(s == self.root, 0, ONE)
            if len(self.keys):
                key = s * self.width + k
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                fresh = np.where(self.keys[at] == key, self.to[at], fresh)
            v[:, rare] = fresh
        return v

    def alone(self, codes: np.ndarray, state: int, language: int) -> tuple[int, int]:
        """Last state and ended phrases of one text in one language, character by character."""
        dense, common, ended = memoryview(self.dense), self.common, 0
        for c in codes.tolist():
            state = dense[state * common + c] if c < common else int(self.step(np.full((len(self.languages), 1), state), np.array([c]))[language, 0])
            if state >= ONE:
                ended += state >> STATE_BITS
                state &= ONE - 1
        return state, ended

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs, by language.

        Texts are parsed side by side, all languages at once; when few are left, those go on one by one."""
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if not texts or not self.languages:
            return total
        codes = [self.encode(t) for t in texts]
        lengths = np.array([len(c) for c in codes])
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([codes[i] for i in order])
        lengths = lengths[order]
        starts = np.cumsum(lengths) - lengths
        sides = int(lengths[SIDES - 1]) if len(texts) >= SIDES else 0  # as long as so many texts are left
        active = np.searchsorted(-lengths, -np.arange(sides), side="left").tolist()
        state, ended = np.repeat(self.root, len(texts), axis=1), np.zeros((len(self.languages), len(texts)), self.root.dtype)
        for t, n in enumerate(active):
            v = self.step(state[:, :n], flat[starts[:n] + t])
            ended[:, :n] += v >> STATE_BITS
            np.bitwise_and(v, ONE - 1, out=state[:, :n])
        for k in np.flatnonzero(lengths > sides).tolist():
            for j in range(len(self.languages)):
                state[j, k], more = self.alone(flat[starts[k] + sides : starts[k] + lengths[k]], int(state[j, k]), j)
                ended[j, k] += more
        total[order] = (ended + (state != self.root)).T  # the last phrase ends with the text
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a character) of each text."""
        out = [(UNKNOWN, 0.0, math.inf)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not self.languages or not known:
            return out
        shown = [folded(texts[i]) for i in known]
        cost = self.phrases(shown) * self.bits
        best = cost.argmin(axis=1)
        for row, (i, b) in enumerate(zip(known, best.tolist(), strict=True)):
            rest = np.delete(cost[row], b)
            score = 1.0 if not len(rest) else 1.0 - cost[row, b] / rest.min()
            out[i] = (self.languages[b], float(min(1.0, max(0.0, score))), float(cost[row, b]) / len(shown[row]))
        return out


_PARSERS: dict[int, CrossParser] = {}


def parser_of(key: int, samples: dict[str, str]) -> CrossParser:
    """The parser of these samples, built once in each Python worker."""
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def _least(count: int):
    """The distinct ids with the smallest hashes of each language in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            names, lang = pc.unique(rows.column("lang")), rows.column("lang")
            parts = []
            for name in names:
                some = rows.filter(pc.equal(lang, name)).group_by(["doc_id", "lang", "h"]).aggregate([])
                parts.append(some.sort_by([("h", "ascending"), ("doc_id", "ascending")]).slice(0, count))
            held = pa.concat_tables(parts) if parts else rows.slice(0, 0)
        if held is not None and held.num_rows:
            yield from held.select(["doc_id", "lang", "h"]).combine_chunks().to_batches()

    return run


def training_sample(labelled: DataFrame, lang_docs: int = LANG_DOCS, lang_chars: int = LANG_CHARS) -> dict[str, str]:
    """Text of each language from labelled(doc_id, text, lang), of at most lang_docs documents and
    lang_chars characters. The ids with the smallest hashes are taken, of texts that hold a letter; each
    task hands on its own smallest ones only, and texts are read for those that are chosen."""
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    kind = dict(labelled.dtypes)["doc_id"]
    least = named.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).mapInArrow(_least(lang_docs), f"doc_id {kind}, lang string, h long").distinct()
    chosen = least.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= lang_docs).select("doc_id", "lang")
    cut = F.substring("text", 1, lang_chars)  # of a training text; predictions take whole texts
    texts = named.select("doc_id", "lang", cut.alias("text")).alias("t").join(F.broadcast(chosen.alias("c")), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.lang") == F.col("c.lang")))
    rows = texts.groupBy("t.doc_id", "t.lang").agg(F.min("t.text").alias("text")).collect()  # one of rows that share an id
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is not None, 0 if r["doc_id"] is None else r["doc_id"], r["text"])):
        parts.setdefault(r["lang"], []).append(folded(r["text"]))
    share = {x: max(1, lang_chars // len(p)) for x, p in parts.items()}
    out = {}
    for x, p in parts.items():
        first = " ".join(t[: share[x]] for t in p)
        more = " ".join(t[share[x] :] for t in p)  # fills up where other texts are short
        out[x] = (first + more)[:lang_chars]
    return {x: t for x, t in out.items() if t.strip()}


def predict_languages(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """docs(text, ...) without text, with lang_pred, score and bits: what a character costs in that language (infinite if unknown)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(samples)  # bounded by LANG_CHARS for each language
    key = hash(tuple(sorted(samples.items())))
    place = docs.columns.index("text")
    made = ("lang_pred", "score", "bits")
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("text", *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(key, shared.value)
        for batch in slices(batches, ROWS):
            found = parser.predict(batch.column(place).to_pylist())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[]] * 3, (pa.string(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*(batch.schema.names[i] for i in kept), *made])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    return mapped(docs, run, T.StructType([*(docs.schema[i] for i in kept), *new]))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, lang_docs: int = LANG_DOCS, lang_chars: int = LANG_CHARS) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    samples = training_sample(rows.where(~F.col("held_out")), lang_docs, lang_chars)
    return predict_languages(rows.select("doc_id", "held_out", "text"), samples).drop("bits")


def keep_identified(docs: DataFrame, least_score: float = 0.0, random_share: float = RANDOM_SHARE, lang_docs: int = LANG_DOCS, lang_chars: int = LANG_CHARS) -> DataFrame:
    """The rows of docs, with all columns, whose language is known.

    Rejected are texts without a letter, texts whose best language is less than least_score ahead of the
    second, and texts of SHORT characters or more that read like random letters of their language: that cost
    random_share of what those cost, or more.
    Learns from the rows that are not held out, as ``identify`` does; where no row is labelled, only texts
    without a letter go."""
    samples = training_sample(docs.where(~held_out(F.col("doc_id"))), lang_docs, lang_chars)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = hash(tuple(sorted(samples.items())))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(key, shared.value)
        for batch in slices(batches, ROWS):
            texts = batch.column(place).to_pylist()
            if parser.languages:
                found = zip(texts, parser.predict(texts), strict=True)
                keep = [x != UNKNOWN and s >= least_score and (bits < random_share * parser.random[x] or len(t) < SHORT) for t, (x, s, bits) in found]
            else:
                keep = [bool(t and LETTER.search(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
