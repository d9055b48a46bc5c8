"""Hulls, corners and rectangles from lines."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.operators import quads


def slow_hull(points):
    """Corners by their definition: no other point is right of an edge, none on it beyond its ends."""
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    out = set()
    for a, b in itertools.permutations(points, 2):
        cross = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in points]
        along = [(b[0] - a[0]) * (c[0] - a[0]) + (b[1] - a[1]) * (c[1] - a[1]) for c in points]
        if all(x >= 0 for x in cross) and all(0 <= t <= (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2 for x, t in zip(cross, along) if x == 0):
            out |= {a, b}
    return out


def test_hulls_of_groups(spark):
    r = random.Random(1)
    rows = [(g, float(r.randint(0, 9)), float(r.randint(0, 9))) for g in range(30) for _ in range(r.choice([1, 2, 3, 8, 30]))]
    rows += [(0, None, 1.0), (0, float("nan"), 1.0), (0, float("inf"), 1.0), (99, None, None), (None, 1.0, 2.0)]
    got = quads.hulls(spark.createDataFrame(rows, "g int, x double, y double").repartition(4), "g").withColumn("area", quads.area(F.col("hull"))).collect()
    want = {}
    for g, x, y in rows:
        if x is not None and abs(x) < 100:
            want.setdefault(g, []).append((x, y))
    assert {x.g for x in got} == set(want)
    for x in got:
        corners = [(p.x, p.y) for p in x.hull]
        assert set(corners) == slow_hull(want[x.g]) and len(set(corners)) == len(corners)
        n = len(corners)
        assert x.area == (abs(sum(corners[i][0] * corners[(i + 1) % n][1] - corners[(i + 1) % n][0] * corners[i][1] for i in range(n))) / 2 if n > 2 else 0.0)


def framed(corners):
    """Lines along the edges of a quadrangle."""
    return [(*corners[i], *corners[(i + 1) % 4]) for i in range(4)]


FRAME = [(10.0, 12.0), (88.0, 10.0), (92.0, 90.0), (8.0, 88.0)]


def test_a_frame_is_found_among_other_points(spark):
    noise = [(50.0, 50.0, 50.0, 60.0), (30.0, 95.0, 60.0, 96.0)]
    lines = [(1, *x) for x in framed(FRAME) + noise] + [(2, *x) for x in framed([(40.0, 40.0), (50.0, 40.0), (50.0, 50.0), (40.0, 50.0)])] + [(3, 0.0, 0.0, 9.0, 9.0), (4, None, 1.0, 2.0, 3.0)]
    pages = spark.createDataFrame([(i, 100, 100) for i in (1, 2, 3, 4)], "doc_id int, width int, height int")
    df = spark.createDataFrame(lines, "doc_id int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    got = {x.doc_id: x for x in quads.rectangles(df, pages).collect()}
    assert {i: x.status for i, x in got.items()} == {1: "found", 2: "too small", 3: "too few corners", 4: "too few corners"}
    assert np.allclose([(p.x, p.y) for p in got[1].corners], FRAME) and got[3].corners is None
    assert {x.status for x in quads.rectangles(df, pages.limit(0)).collect()} == {"no page"} and quads.rectangles(df.limit(0), pages.limit(0)).count() == 0


def slow_rectangle(points, lines, size):
    """All quadrangles of crossings that lines bear out, the one whose corners are nearest to the page's first."""
    page, best = [(0, 0), (size, 0), (size, size), (0, size)], None
    for four in itertools.permutations(points, 4):
        c = np.array(four)
        if all(quads.supported(c[i], c[(i + 1) % 4], lines, size) for i in range(4)):
            cost = sum(((c[i] - np.array(page[i])) ** 2).sum() for i in range(4))
            best = min(best or (cost, four), (cost, four))
    return best and best[1]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_quadrangles(seed):
    r = random.Random(seed)
    for _ in range(8):
        frame = [(r.uniform(5, 20), r.uniform(5, 20)), (r.uniform(75, 95), r.uniform(5, 20)), (r.uniform(75, 95), r.uniform(75, 95)), (r.uniform(5, 20), r.uniform(75, 95))]
        lines = np.array(framed(frame))
        stray = [(r.uniform(30, 70), r.choice([0.5, 99.5])) for _ in range(2)] + [(r.choice([1.0, 99.0]), r.choice([1.0, 99.0]))]
        points = np.array(frame + stray)
        corners, status = quads.fitted(points, lines, 100, 100)
        want = slow_rectangle([tuple(p) for p in points], lines, 100)
        if want is not None and status == "found":
            assert np.allclose(corners, want)
        assert status in ("found", "too few corners")


def test_a_corner_in_doubt_is_repaired():
    lines = np.array(framed(FRAME))
    points = np.array([*FRAME[:1], (99.0, 1.0), FRAME[1], *FRAME[2:]])  # a stray point stands before the top right corner
    corners, status = quads.fitted(points, lines, 100, 100, repair=True)
    assert status == "found" and np.allclose(corners, FRAME)
    assert quads.fitted(points, lines, 100, 100)[1] == "found"  # or is dropped
    assert quads.fitted(np.array([*FRAME[:1], (99.0, 1.0), *FRAME[2:]]), lines, 100, 100, repair=True)[1] == "too few corners"
    assert quads.fitted(np.zeros((0, 2)), lines, 100, 100)[1] == "too few corners"
