"""Ranked lexical search with inverted treaps.

A term's postings in a shard of documents form a treap: a search tree by document number that is a heap
by impact, so a subtree's root bounds all impacts below it. A query walks the treaps of its terms side
by side. A range of documents is bounded by the weighted sum of its roots; ranges are taken by falling
bounds, the walk ends where no bound reaches the k-th best score. A range is cut at the document whose
posting bounds most: that document is scored in full and every treap is split there by following its
search paths. Ranges of at most LEAF documents are scored at once. Nothing is approximate.

Documents of a shard are numbered by multiples of the golden ratio of their ids' ranks: a table whose ids
grow with the texts' lengths would otherwise turn treaps into chains.

Weights need the whole corpus, so a first pass counts terms: texts become bags of the terms asked for, a
table from which statistics and shards are read. Each partition of it makes shards of at most
SHARD postings; only a shard's best k rows of each query are shuffled. Queries go in blocks of about
BLOCK_CHARS characters, whose terms and weights are broadcast.

Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact
(10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L.

Defined results: null texts have no terms; queries without terms, or whose terms stand in no document,
have no rows; equal query texts are searched once; repeated ids of queries or documents are rows of their
own; null ids of documents come last among equal scores. Empty tables give an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import dropped, give_back, mapped, slices, stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Documents of a range that is scored at once (a cut costs as much as some ten thousand postings); postings of a shard; characters of a block of queries.
LEAF, SHARD, BLOCK_CHARS = 2048, 2_000_000, 16_000_000
#: Positions are spread by a bijection of numbers of so many bits, which breaks ties among impacts.
BITS = 40
_MASK, _ODD = (1 << BITS) - 1, 0x9E3779B97F4A7C15 & ((1 << BITS) - 1) | 1
_BACK = pow(_ODD, -1, 1 << BITS)


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").translate(UPPER).decode("utf-8", "surrogatepass")) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + 50 * n * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Treaps:
    """The postings of a shard: terms and documents are numbers, postings distinct pairs of them."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.size = doc[order].astype(np.int64), impact[order].astype(np.int64), n_docs
        term = term[order].astype(np.int64)
        self.place = term * n_docs + self.doc
        self.left, self.right, self.root = np.full(len(doc), -1), np.full(len(doc), -1), np.full(n_terms, -1)
        self._build(term)

    def _build(self, term: np.ndarray) -> None:
        """Level by level: the roots of all segments at once, which cut them into those of the next level."""
        n = len(term)
        heap = np.append(self.impact << BITS | (np.arange(n) * _ODD & _MASK), 0)
        lo = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if n else np.zeros(0, np.int64)
        hi = np.append(lo[1:], n)[: len(lo)]
        top = np.zeros(0, np.int64)
        while len(lo):
            best = (np.maximum.reduceat(heap, np.stack([lo, hi], 1).ravel())[::2] & _MASK) * _BACK & _MASK
            if len(top):
                self.left[top[~side]], self.right[top[side]] = best[~side], best[side]
            else:
                self.root[term[best]] = best
            ends = np.stack([np.stack([lo, best + 1], 1), np.stack([best, hi], 1)])
            lo, hi = ends.reshape(2, -1)
            top, side = np.repeat(best, 2), np.tile([False, True], len(best))
            some = lo < hi
            lo, hi, top, side = lo[some], hi[some], top[some], side[some]

    def _within(self, nodes: np.ndarray, a: int, b: int) -> np.ndarray:
        """The roots of what lies from a to b in the subtrees of these nodes, -1 for nothing."""
        nodes = nodes.copy()
        while True:
            docs = self.doc[nodes]
            low, high = (nodes >= 0) & (docs < a), (nodes >= 0) & (docs >= b)
            if not (low | high).any():
                return nodes
            nodes[low], nodes[high] = self.right[nodes[low]], self.left[nodes[high]]

    def _scores(self, terms: np.ndarray, weights: np.ndarray, a: int, b: int) -> np.ndarray:
        """Scores of the documents from a to b."""
        lo, hi = np.searchsorted(self.place, np.stack([terms * self.size + a, terms * self.size + b]))
        sizes = hi - lo
        at = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros(b - a, np.int64)
        np.add.at(out, self.doc[at] - a, np.repeat(weights, sizes) * self.impact[at])
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1, leaf: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that are among the k best of at least floor, in any order, and few others."""
        leaf = leaf or LEAF
        if not len(self.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nodes = self.root[terms]
        ranges = [(-int((weights * self.impact[nodes])[nodes >= 0].sum()), 0, self.size, terms[nodes >= 0], weights[nodes >= 0], nodes[nodes >= 0])]
        least: list[int] = []
        docs: list[int] = []
        scores: list[int] = []

        def add(doc: int, score: int) -> None:
            nonlocal floor
            if score >= floor:
                docs.append(doc)
                scores.append(score)
                heapq.heappush(least, score)
                if len(least) > k:
                    heapq.heappop(least)
                if len(least) == k:
                    floor = max(floor, least[0])

        while ranges:
            bound, a, b, terms, weights, nodes = heapq.heappop(ranges)
            if -bound < floor:
                break
            if b - a <= leaf:
                s = self._scores(terms, weights, a, b)
                for i in np.flatnonzero(s >= floor).tolist():
                    add(a + i, int(s[i]))
                continue
            d = int(self.doc[nodes[np.argmax(weights * self.impact[nodes])]])
            add(d, int(self._scores(terms, weights, d, d + 1)[0]))
            for from_, to in ((a, d), (d + 1, b)):
                if from_ < to:
                    part = self._within(nodes, from_, to)
                    on = part >= 0
                    bound = int((weights[on] * self.impact[part[on]]).sum())
                    if bound >= floor:
                        heapq.heappush(ranges, (-bound, from_, to, terms[on], weights[on], part[on]))
        return np.array(docs, np.int64), np.array(scores, np.int64)


def bags(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of terms of each text, and those that are known, with their counts."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in slices(batches):
            n, terms, tfs = [], [], []
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                counts = Counter(filter(ids.__contains__, found))
                n.append(len(found))
                terms.append([ids[t] for t in counts])
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _searcher(shared, k: int, n_docs: int, n_terms: int):
    def answered(parts: list[pa.RecordBatch], units, n_known: int, floors: dict[str, int]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("doc_id")
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))  # nulls last
        number = np.empty(len(ids), np.int64)
        number[np.argsort(rank * _ODD & _MASK, kind="stable")] = np.arange(len(ids))
        column = lambda c: table.column(c).combine_chunks()
        sizes = pc.list_value_length(column("terms")).to_numpy(zero_copy_only=False)
        flat = lambda c: column(c).flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), sizes)
        treaps = Treaps(flat("terms"), number[row], impacts(flat("tfs").astype(np.int64), table.column("n").to_numpy()[row], n_docs, n_terms), n_known, len(ids))
        row_of = np.argsort(number)
        names, rows, scores = [], [], []
        for unit, terms, weights in units:
            found, s = treaps.best(terms, weights, k, floors.get(unit, 1))
            found = row_of[found]
            top = np.lexsort((rank[found], -s))[:k]
            if len(top) == k:  # an equal score elsewhere may still win by its id
                floors[unit] = int(s[top[-1]])
            names += [unit] * len(top)
            rows.append(found[top])
            scores.append(s[top])
        rows, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, scores))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), ids.take(pa.array(rows)).combine_chunks(), pa.array(scores)], names=["unit", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, n_known = shared.value
        waiting, held, floors = [], 0, {}
        for batch in slices(batches, 10_000):
            waiting.append(batch)
            held += len(batch.column("terms").flatten())
            if held >= SHARD:
                yield answered(waiting, units, n_known, floors)
                waiting, held = [], 0
        if waiting:
            yield answered(waiting, units, n_known, floors)
        give_back()

    return run


def _block(docs: DataFrame, units: list[tuple[str, list[str]]], k: int, made: list[DataFrame]) -> DataFrame:
    """(unit, doc_id, score): each shard's best documents for a block of queries, given with their distinct terms."""
    known = {t: i for i, t in enumerate(sorted({t for _, terms in units for t in terms}))}
    bag = stored(bags(docs, known), "bags")
    n_docs, n_terms = bag.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(bag.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's terms
    w = {t: weight(n_docs, df[i]) for t, i in known.items() if i in df}
    asked = [(u, np.array([known[t] for t in terms if w.get(t)], np.int64), np.array([w[t] for t in terms if w.get(t)], np.int64)) for u, terms in units]
    shared = docs.sparkSession.sparkContext.broadcast(([a for a in asked if len(a[1])], len(known)))
    out = stored(bag.mapInArrow(_searcher(shared, k, n_docs, n_terms), f"unit string, doc_id {dict(docs.dtypes)['doc_id']}, score long"), "ranked")
    dropped(bag)
    made.append(out)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs(doc_id, text) for each row of items(item_id, text)."""
    named = items.select("item_id", F.md5(F.col("text").cast("binary")).alias("unit"), "text").where(F.col("text").isNotNull())
    texts = stored(named.groupBy("unit").agg(F.first("text").alias("text")), "asked")
    blocks = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    found, made = None, []
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("unit"), F.lit(blocks)) == b).orderBy("unit").collect()
        part = _block(docs, [(r["unit"], sorted(set(terms_of(r["text"])))) for r in rows], k, made)
        found = part if found is None else found.unionByName(part)
    dropped(texts)
    best = Window.partitionBy("unit").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = stored(named.select("item_id", "unit").join(top, "unit").select("item_id", "rank", "doc_id", "score"), "ranks")
    dropped(*made)
    return out
