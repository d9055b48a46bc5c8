"""Groups of near-duplicate vectors against comparisons of all pairs."""

import math

import numpy as np
import pytest

from noticeloom.llm import vector_groups as vg


def plain(rows, cosine=0.93):
    """Rows (id, vector, label) compared one by one."""
    good = lambda v, label: v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    u = []
    for _, v, label in rows:
        if good(v, label):
            x = np.array(v, float)
            x /= np.abs(x).max()
            u.append(x / np.linalg.norm(x))
        else:
            u.append(None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and rows[i][2] == rows[j][2] and float(u[i] @ u[j]) >= cosine] for i in range(n)]
    out, done = [], {}
    for i in range(n):
        if i not in done:
            seen, stack = {i}, [i]
            while stack:
                for j in near[stack.pop()]:
                    if j not in seen:
                        seen.add(j)
                        stack.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            done |= dict.fromkeys(seen, min(ids) if ids else None)
        out.append((rows[i][0], len(near[i]), done[i], rows[i][0] == done[i]))
    return sorted(out, key=repr)


def table(seed, size=16):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(size).tolist(), int(r.integers(0, 3))) for i in range(150)]

    def around(centre, n, noise, label):
        for _ in range(n):
            rows.append((len(rows) + 1000 - int(r.integers(0, 2)) * 500, (np.array(centre) + noise * r.standard_normal(size)).tolist(), label))

    for k in range(8):
        around(rows[k][1], 5, (0.05, 0.1, 0.25, 0.3)[k % 4], rows[k][2])
    around(rows[20][1], 120, 0.02, 1)  # a tight group, and a loose one
    around(rows[21][1], 120, 0.28, 2)
    rows.extend((5000 + k, rows[9][1], rows[9][2]) for k in range(40))
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * size, 1), (6003, [None] + [1.0] * (size - 1), 1), (6004, [math.nan] * size, 1), (6005, [math.inf] + [0.0] * (size - 1), 1), (6006, rows[9][1], None), (6007, [1.0, 2.0], 1), (6008, [2.0, 4.1], 1), (6009, [-1.0, 2.0], 1)]
    rows += [(6010, [1e200 * x for x in rows[10][1]], rows[10][2]), (6011, [1e-300 * x for x in rows[10][1]], rows[10][2]), (6012, [-0.0, 1.0], 7), (6013, [0.0, 1.0], 7)]
    rows += [(None, rows[11][1], rows[11][2]), (None, [3.0] + [0.0] * (size - 1), 9), (12, rows[12][1], rows[12][2]), (12, rows[13][1], rows[13][2])]
    return rows


@pytest.mark.parametrize(("cell", "window", "part"), [(2048, 128, 50_000), (16, 8, 40)])
def test_equals_all_pairs(spark, monkeypatch, cell, window, part):
    for name, value in (("CELL", cell), ("WINDOW", window), ("PART", part)):
        monkeypatch.setattr(vg, name, value)
    rows = table(cell)
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, node int, component string").repartition(5)
    got = vg.grouped(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_string_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0], "l"), ("a", [1.0, 0.1], "l"), ("c", [0.0, 1.0], "l")], "vec_id string, embedding array<float>, label string")
    assert sorted(map(tuple, vg.grouped(df).collect())) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    assert vg.grouped(df.limit(0)).count() == 0


def test_passes_find_pairs_at_the_threshold():
    """Of pairs at the threshold among random vectors, few share no window in any pass."""
    r = np.random.default_rng(8)
    n, pairs, size = 6000, 400, 64
    x = r.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = r.standard_normal((pairs, size))
    noise -= (noise * x[:pairs]).sum(1)[:, None] * x[:pairs]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    both = np.concatenate([x, 0.9301 * x[:pairs] + math.sqrt(1 - 0.9301**2) * noise])
    met = np.zeros(pairs, bool)
    for turn in range(vg.passes_for(len(both))):
        place = np.empty(len(both), int)
        place[np.argsort(vg.keys(both, turn), kind="stable")] = np.arange(len(both))
        met |= np.abs(place[:pairs] - place[n:]) <= vg.WINDOW
    assert met.mean() > 0.995
    assert vg.passes_for(0) == vg.passes_for(100) == vg.PASSES < vg.passes_for(10**6) < vg.passes_for(10**9) < 150


def test_forest_and_rings():
    names = vg.forest(7, np.array([0, 4, 5]), np.array([2, 5, 6]))
    assert names.tolist() == [0, 1, 0, 3, 4, 4, 4]
