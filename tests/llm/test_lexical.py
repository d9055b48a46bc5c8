"""Ranked search against scores computed one by one."""

import random

import numpy as np
import pytest

from noticeloom.llm import lexical


def plain(docs, items, k=50):
    bags = [(i, lexical.terms_of(t)) for i, t in docs]
    full = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(full), sum(len(b) for _, b in full)
    df = {t: sum(t in set(b) for _, b in full) for _, text in items for t in lexical.terms_of(text)}
    out = []
    for item, text in items:
        scores = []
        for doc, b in full:
            m = 100 - 50 + (50 * len(b) * n_docs) // n_terms
            s = sum(lexical.weight(n_docs, df[t]) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in set(lexical.terms_of(text)) if t in b)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["ÄÖ", "naïve", "x9", "日本"]
    text = lambda: " ".join(r.choice(vocab[: r.choice([3, 12, 44])]) for _ in range(r.choice([1, 3, 20, 60])))
    docs = [(i * 3 % n, text()) for i in range(n)]
    docs += [(None, docs[0][1]), (None, None), (5, ""), (6, "-- ..!"), (7, docs[3][1]), (7, docs[3][1]), (2 * n, "W1 w1-w1_W2" * 3000), (2 * n + 1, "_".join(vocab * 50))]
    items = [(i, text()) for i in range(12)] + [(90, None), (91, ""), (92, "unheard of"), (93, "W3, w3; w5"), (93, "w3 w5"), (94, "W3, w3; w5"), (None, "w7 w8 日本")]
    return docs, items


@pytest.mark.parametrize(("shard", "chars"), [(2_000_000, 16_000_000), (300, 400)])
def test_equals_plain_scores(spark, monkeypatch, shard, chars):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "LEAF", 16)
    docs, items = corpus(4, 1500)
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(3)
    b = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    got = lexical.ranked(a, b, block_chars=chars)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "k l"), ("a", "k l"), ("c", "l m n"), ("d", "o")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "k n")], "item_id string, text string")
    assert [(x.rank, x.doc_id) for x in sorted(lexical.ranked(docs, items, k=2).collect())] == [(1, "c"), (2, "a")]
    assert lexical.ranked(docs.limit(0), items).count() == lexical.ranked(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["random", "rising", "equal"])
def test_treaps_are_heaps_over_search_trees_and_prune(order):
    r = np.random.default_rng(2)
    n_docs, n_terms = 3000, 30
    pairs = np.unique(r.integers(0, n_docs * n_terms, 40_000))
    term, doc = pairs // n_docs, pairs % n_docs
    impact = {"random": r.integers(1, 10**6, len(pairs)), "rising": doc * 300 + 1, "equal": np.full(len(pairs), 7)}[order]
    shuffled = r.permutation(len(pairs))
    treaps = lexical.Treaps(term[shuffled], doc[shuffled], impact[shuffled], n_terms, n_docs)
    seen = 0
    for t in range(n_terms):
        stack = [(treaps.root[t], -1, n_docs, 1 << 60)]
        while stack:
            v, a, b, above = stack.pop()
            if v >= 0:
                seen += 1
                assert a < treaps.doc[v] < b and treaps.impact[v] <= above
                stack += [(treaps.left[v], a, treaps.doc[v], treaps.impact[v]), (treaps.right[v], treaps.doc[v], b, treaps.impact[v])]
    assert seen == len(pairs)
    terms = np.arange(0, 30, 2)
    weights = 1 + 50 * (np.arange(len(terms)) % 3)
    all_ = np.zeros(n_docs, np.int64)
    for t, w in zip(terms, weights):
        np.add.at(all_, doc[term == t], w * impact[term == t])
    for k, leaf in ((1, 1), (10, 1), (10, 256), (5000, 16)):
        docs, scores = treaps.best(terms, weights, k, leaf=leaf)
        assert (all_[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        cut = max(1, np.sort(all_)[::-1][min(k, n_docs) - 1])
        assert set(np.flatnonzero(all_ >= cut)) <= set(docs.tolist())
    if order == "random":  # few documents of a short query are looked at
        seen = []
        scores_of = treaps._scores
        treaps._scores = lambda t, w, a, b: seen.append(b - a) or scores_of(t, w, a, b)
        treaps.best(np.array([0]), np.array([3]), 5, leaf=1)
        assert sum(seen) <= 20
