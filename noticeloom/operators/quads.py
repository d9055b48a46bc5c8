"""Rectangles from lines: crossings, convex hulls, extreme corners, edges that lines bear out, repair, area.

No pixels are needed: the input is a table of lines (doc_id, x1, y1, x2, y2), however they were found, and a
table of pages (doc_id, width, height).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.geometry import end_crossing, square_crossing

POINTS = "array<struct<x:double,y:double>>"
#: Points of a group in a batch of rows from which only their hull goes on.
FEW = 16
#: How far directions may differ; shares of the longer side: near an end, near the place of a repaired corner, one place.
TOLERANCE, NEAR, REPAIR, SAME = 0.08, 1 / 12, 1 / 5, 1 / 100
#: Least and largest area of a rectangle, as shares of the page.
LEAST_AREA, LARGEST_AREA = 0.2, 1.0


def crossings(lines: DataFrame, ends: bool = False) -> DataFrame:
    """(doc_id, x, y): where two lines of a document that are not nearly alike cross; with ends, at an end of both or of neither."""
    side = lambda p: lines.select("doc_id", *(F.col(c).cast("double").alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")))
    both = side("a").join(side("b"), "doc_id").where(F.struct("ax1", "ay1", "ax2", "ay2") < F.struct("bx1", "by1", "bx2", "by2"))
    columns = [F.col(p + c) for p in "ab" for c in ("x1", "y1", "x2", "y2")]
    point = end_crossing(*columns, far=True) if ends else square_crossing(*columns)
    return both.select("doc_id", point.alias("p")).where("p IS NOT NULL").select("doc_id", "p.x", "p.y").distinct()


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the least point; without those on its edges."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(some):
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def side_by_side(xy: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, number of each group's corners): ``convex_hull`` of the points of groups 0, 1, ... at once, which need not be in order.

    A point on or beyond the line between its neighbours in a chain is no corner, as both are points of the group. Such
    points leave all chains at once, until none is left in any."""
    order = np.lexsort((xy[:, 1], xy[:, 0], group))
    xy, group = xy[order], group[order]
    first = np.ones(len(xy), bool)
    first[1:] = (group[1:] != group[:-1]) | (xy[1:] != xy[:-1]).any(axis=1)
    xy, group = xy[first], group[first]

    def chain(at: np.ndarray) -> np.ndarray:
        """Places of a chain's corners without its last, by groups; at are all places, in the order of the chain."""
        done = []
        while len(at):
            p, g = xy[at], group[at]
            ends = np.ones(len(at), bool)
            ends[1:-1] = (g[:-2] != g[1:-1]) | (g[2:] != g[1:-1])
            gone = np.zeros(len(at), bool)
            one, two = p[1:-1] - p[:-2], p[2:] - p[:-2]
            gone[1:-1] = one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0] <= 0
            gone &= ~ends
            busy = np.zeros(count, bool)
            busy[g[gone]] = True
            last = np.append(g[1:] != g[:-1], True)
            done.append(at[~busy[g] & ~last])
            at = at[busy[g] & ~gone]
        return np.concatenate([*done, np.zeros(0, np.int64)])

    count = int(group[-1]) + 1 if len(group) else 0
    places = np.arange(len(xy))
    alone = np.bincount(group, minlength=count)[group] == 1
    lower, upper = np.sort(np.append(chain(places[~alone]), places[alone])), chain(places[~alone][::-1])
    upper = np.sort(upper)[::-1]
    every = np.append(lower, upper)
    every = every[np.argsort(group[every], kind="stable")]
    return xy[every], np.bincount(group[every], minlength=count)


def _groups(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Numbers that differ in neighbouring rows where their keys do, and in others if they differ."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        part = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (part.max(initial=0) + 1) + part, return_inverse=True)[1]
    return code


def hulls(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, hull): the convex hull of each group's points (x, y); rows that are no points are left out.

    Hulls merge: where a batch of rows holds many points of a group, only their hull goes on. Groups come one after the
    other in sorted parts, and their hulls are found a batch at a time, side by side; of a group that goes on in the
    next batch its hull so far is kept."""
    kinds = dict(points.dtypes)
    even = lambda k: (F.col(k) + F.lit(0.0)).cast(kinds[k]) if kinds[k] in ("float", "double") else F.col(k)  # noqa: E731  (-0.0 is 0.0)
    good = points.select(*(even(k).alias(k) for k in keys), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    good = good.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y") & (F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")))
    # keys that are made of parts are compared as text
    whole = [k for k in keys if kinds[k].startswith(("struct", "array", "map"))]
    good = good.withColumns({f"_text{i}": F.to_json(F.struct(k), {"ignoreNullFields": "false"}) for i, k in enumerate(whole)}) if whole else good
    compared = [f"_text{whole.index(k)}" if k in whole else k for k in keys]
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    texts = "".join(f", _text{i} string" for i in range(len(whole)))
    point = lambda batch: np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y")])

    def fewer(batch: pa.RecordBatch, code: np.ndarray, most: int) -> pa.RecordBatch:
        """The batch with the corners only, each once, of groups of more rows than that."""
        sizes = np.bincount(code)
        if not len(sizes) or sizes.max() <= most:
            return batch
        xy, keep = point(batch), sizes[code] <= most
        for g in np.flatnonzero(sizes > most):
            rows = np.flatnonzero(code == g)
            places, at = np.unique(xy[rows], axis=0, return_index=True)
            corners = {tuple(c) for c in convex_hull(places).tolist()}
            keep[[rows[i] for i, p in zip(at, places.tolist(), strict=True) if tuple(p) in corners]] = True
        return batch.filter(pa.array(keep))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fewer(batch, _groups(batch, compared), FEW)

    def found(batch: pa.RecordBatch, code: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        corners, counts = side_by_side(point(batch), np.cumsum(np.append(0, code[1:] != code[:-1])))
        values = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], names=["x", "y"])
        hull = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(starts)) for k in keys), hull], names=[*keys, "hull"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            code = _groups(batch, compared)
            starts = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
            last = int(starts[-1])
            if last:
                yield found(batch.slice(0, last), code[:last], starts[:-1])
            held = fewer(batch.slice(last), np.zeros(batch.num_rows - last, np.int64), FEW)
        if held is not None:
            yield found(held, np.zeros(held.num_rows, np.int64), np.zeros(1, np.int64))

    # each key's text is next to it, so equal keys are neighbours
    parts = good.mapInArrow(thinned, f"{names}, _x double, _y double{texts}").repartition(*compared).sortWithinPartitions(*compared)
    return parts.mapInArrow(merged, f"{names}, hull {POINTS}")


def area(corners: Column) -> Column:
    """Area of a polygon by its corners in order."""
    n = F.size(corners)
    at = lambda i: F.get(corners, i % n)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda t, i: t + at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.when(n > 2, F.abs(twice) / 2).otherwise(F.lit(0.0))


def extreme_corners(hull: Column, width: Column, height: Column) -> Column:
    """The hull's points nearest to a page's top left, top right, bottom right and bottom left; of equally near ones the least."""
    square = lambda v: v * v
    nearest = lambda x, y: F.array_min(F.transform(hull, lambda p: F.struct((square(p["x"] - x) + square(p["y"] - y)).alias("d"), p.alias("p"))))["p"]
    zero = F.lit(0.0)
    return F.array(nearest(zero, zero), nearest(width, zero), nearest(width, height), nearest(zero, height))


def _directions(v: np.ndarray) -> np.ndarray:
    """Unit vectors that point right, or up where upright; nan for no length."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = v / np.where(size > 0, size, np.nan)
    return np.where(((v[..., 0] < 0) | ((v[..., 0] == 0) & (v[..., 1] < 0)))[..., None], -out, out)


def supported(a: np.ndarray, b: np.ndarray, lines: np.ndarray, longer: float) -> bool:
    """Whether a line runs along the edge from a to b: in its direction, and each end is in line with it or near one of its ends."""
    if (np.abs(a - b) < longer * SAME).all() or not len(lines):
        return False
    alike = lambda u, v, t: (np.abs(u - v) < t).all(axis=-1)  # noqa: E731  (nan is unlike all)
    p, q = lines[:, :2], lines[:, 2:]
    good = alike(_directions(q - p), _directions(b - a), TOLERANCE)
    for end in (a, b):
        near = np.minimum(np.linalg.norm(end - p, axis=1), np.linalg.norm(end - q, axis=1)) < longer * NEAR
        good &= alike(_directions(end - p), _directions(end - q), 2 * TOLERANCE) | near
    return bool(good.any())


#: Corners are top left, top right, bottom right, bottom left; edges go from each to the next.
TOP, RIGHT, BOTTOM, LEFT = range(4)
#: A corner is in doubt if the two edges that do not touch it hold and one of its own does not.
DOUBT = ((BOTTOM, LEFT, 1), (TOP, RIGHT, 3), (LEFT, TOP, 2), (RIGHT, BOTTOM, 0))


def fitted(points: np.ndarray, lines: np.ndarray, width: float, height: float, repair: bool = False) -> tuple[np.ndarray | None, str]:
    """(four corners, status): the quadrangle of crossings whose edges lines bear out.

    The extreme corners of the hull are tried. A corner in doubt is replaced, with repair, by the crossing nearest to
    the place that completes a parallelogram, if that is near enough; else it leaves the points and the next are tried."""
    longer = max(width, height)
    everything = points = np.unique(points[np.isfinite(points).all(axis=1)], axis=0) if len(points) else points
    page = np.array([[0.0, 0.0], [width, 0.0], [width, height], [0.0, height]])
    while len(points) >= 4:
        hull = convex_hull(points)
        nearest = [np.lexsort((hull[:, 1], hull[:, 0], ((hull - c) ** 2).sum(axis=1)))[0] for c in page]
        corners = hull[nearest].copy()
        holds = lambda: [supported(corners[e], corners[(e + 1) % 4], lines, longer) for e in range(4)]
        good = holds()
        doubt = next((c for one, two, c in DOUBT if good[one] and good[two] and not all(good)), None)
        if doubt is not None and repair:
            place = corners[(doubt + 1) % 4] + corners[(doubt + 3) % 4] - corners[(doubt + 2) % 4]
            other = everything[np.lexsort((everything[:, 1], everything[:, 0], ((everything - place) ** 2).sum(axis=1)))[0]]
            if np.linalg.norm(other - place) < longer * REPAIR:
                old, corners[doubt] = corners[doubt].copy(), other
                good = holds()
                if not all(good):
                    corners[doubt] = old
        if all(good):
            apart = [np.abs(corners[i] - corners[j]).max() >= longer * SAME for i in range(4) for j in range(i)]
            if not all(apart):
                return None, "corners overlap"
            x, y = corners.T
            share = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 / (width * height)
            return corners, "too small" if share < LEAST_AREA else "too large" if share > LARGEST_AREA else "found"
        gone = doubt if doubt is not None else 0 if good[BOTTOM] else 2
        points = points[(points != corners[gone]).any(axis=1)]
    return None, "too few corners"


def rectangles(lines: DataFrame, pages: DataFrame, repair: bool = False, points: DataFrame | None = None) -> DataFrame:
    """(doc_id, corners, status) of pages: found, too small, too large, corners overlap, too few corners; corners are null unless four hold.

    A document is one group: its lines and crossings, bounded by the lines that are found on one page."""
    points = crossings(lines, ends=True) if points is None else points
    rows = lambda df, kind, *c: df.select("doc_id", F.lit(kind).alias("kind"), F.array(*(F.col(x).cast("double") for x in c)).alias("v"))
    all_ = rows(lines, "line", "x1", "y1", "x2", "y2").unionByName(rows(points, "point", "x", "y")).unionByName(rows(pages, "page", "width", "height"))

    def run(group: pa.Table) -> pa.Table:
        kind, values = group.column("kind").to_pylist(), group.column("v").to_pylist()
        of = lambda k, n: np.array(sorted(v for g, v in zip(kind, values, strict=True) if g == k and None not in v), float).reshape(-1, n)
        page = of("page", 2)
        corners, status = fitted(of("point", 2), of("line", 4), *page[0], repair) if len(page) else (None, "no page")
        made = pa.array([None if corners is None else [{"x": float(x), "y": float(y)} for x, y in corners]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.table([group.column("doc_id").slice(0, 1).combine_chunks(), made, pa.array([status])], names=["doc_id", "corners", "status"])

    return all_.groupBy("doc_id").applyInArrow(run, f"doc_id {dict(lines.dtypes)['doc_id']}, corners {POINTS}, status string")
