"""Nearest neighbours on odd tables, and what a search leaves behind."""

import numpy as np
import pytest

from noticeloom.llm import neighbours
from noticeloom.llm.common import shared_dir


def brute(rows, k=20):
    """The k best of rows (id, vector) for each row whose id is divisible by 20, by exact products."""
    out = {}
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            found = sorted((-float(np.dot(np.array(v), np.array(w))), i) for m, (i, w) in enumerate(rows) if m != n)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e150, 1e-150])
def test_vectors_of_any_size_and_ids_of_any_width(spark, scale):
    r = np.random.default_rng(9)
    rows = [(i, (scale * r.standard_normal(8)).tolist()) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, rows[7][1])], "vec_id int, embedding array<double>").repartition(3)
    got = {}
    for x in neighbours.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and None not in {i for i, _ in found}
        assert all(abs(s - np.dot(np.array(rows[q][1]), np.array(rows[i][1]))) <= 1e-12 * scale * scale * 100 for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, lambda i: i % 20 == 0).count() == 0


def test_tables_are_deleted_when_read(spark):
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file:")) / "noticeloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, r.standard_normal(8).tolist()) for i in range(500)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, lambda i: i % 20 == 0)
    left = {f.name.rsplit("-", 1)[0] for f in set(folder.iterdir()) - before}
    assert left == {"nearest"} and out.count() == 25 * 20


def test_pairs_are_scored_when_one_is_new(spark):
    """A pair of old neighbours is left out, all others are scored."""
    import pyarrow as pa

    right = pa.table({"other": [1, 2, 3], "f": pa.array([[1.0, 0.0], [0.9, 0.1], [0.8, 0.2]], pa.list_(pa.float32())), "worst": pa.array([-np.inf] * 3, pa.float32())})
    for fresh, want in (([True, False, False], {(1, 2), (1, 3), (2, 1), (3, 1)}), ([False, True, True], {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}), ([False] * 3, set())):
        left = pa.table({"node": [9], "near": [[1, 2, 3]], "fresh": [fresh]})
        got = neighbours._local_join(left, right)
        assert set(zip(got["node"].to_pylist(), got["other"].to_pylist())) == want
