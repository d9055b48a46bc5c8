"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node that keeps its smallest ids, so ties among copies are resolved exactly
and a vector with very many copies is one node of the graph.

Build. Nodes fall into small cells of random hyperplane codes, where all of a cell's nodes are
compared; several such rounds give first lists. Then NN-descent: neighbours of a node, in both
directions, are likely neighbours of each other. Only nodes with a neighbour that they did not have the
round before are looked at, and only pairs with such a neighbour: all others were scored then, and lists
only get better. A Spark join brings to each block of such nodes the vectors of their neighbours, each
vector once a block; the pairs around each node are scored with one small matrix product, those
that would improve a list are kept (the best LIST of each node and block, as many as a list can take), and a
second shuffle merges them into the lists. Rounds end when few lists change.

Graph and search work on vectors in single precision, divided by the largest component of the table where
that is very large or very small.

Search. A query starts from entry nodes, its own node's list if it is a row of the table, and keeps
a beam of the best nodes found. Each round joins the beam's unexpanded nodes with the graph and
their neighbours with the vectors. A query leaves the rounds when nothing in its beam is left to
expand, and they end when all have left. What is returned is scored in double precision on the original vectors.

Every list, beam and reverse list has a fixed length; no pairs of a group and no vectors are
collected on the driver. Blocks hold a fixed number of nodes, so memory in tasks is bounded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those of another length than the most common one, nor rows without an id. Ids are whole
numbers of any width. Repeated ids are rows of their own.
A table with one valid vector, or none, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import dropped, stored

#: Length of neighbour lists, most reverse neighbours, cells' size, first rounds.
LIST, REVERSE, CELL, FIRST = 32, 32, 400, 4
#: Nodes of a block.
BLOCK = 4096
#: Largest components beyond (or below one over) which vectors are scaled before they are cut to single precision.
FAR = 1e12
#: Rounds end when less than this share of the list entries is new.
QUIET = 0.02
BEAM, QUERY_BLOCK = 320, 512
LOW = -np.inf


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v as doubles) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    out = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(good)
    length = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.where(F.size("v") == (length["n"] if length else 0))


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(node, v, f, ids): distinct vectors, as they are and in single precision, with their smallest ids; a node is named by its smallest id.

    Ids are first cut to the keep smallest in as many parts as the root of the number of rows, so neither
    the ids of a part nor those of all parts of a very common vector are many."""
    key = F.xxhash64("v")
    salt = F.pmod(F.xxhash64("id"), F.lit(max(64, int(vectors.count() ** 0.5))))
    some = vectors.groupBy(key.alias("k"), "v", salt.alias("s")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    merged = some.groupBy("k", "v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    scale = most if most > FAR or most < 1 / FAR else 1.0
    return merged.select(F.element_at("ids", 1).alias("node"), "v", F.transform("v", lambda x: (x / scale).cast("float")).alias("f"), "ids")


def _matrix(column, dtype=np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten(), dtype)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _best(node: np.ndarray, other: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the keep best distinct entries (node, other) of each node."""
    order = np.lexsort((other, -score, node))
    n, o = node[order], other[order]
    pair = np.lexsort((np.arange(len(n)), o, n))
    twin = np.zeros(len(n), bool)
    twin[pair[1:]] = (n[pair][1:] == n[pair][:-1]) & (o[pair][1:] == o[pair][:-1])
    order = order[~twin]
    n = node[order]
    if not len(n):
        return order
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    rank = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
    return order[rank < keep]


ENTRIES = "node long, other long, score float"


def _entries(node=(), other=(), score=()) -> pa.Table:
    return pa.table({"node": pa.array(np.asarray(node, np.int64)), "other": pa.array(np.asarray(other, np.int64)), "score": pa.array(np.asarray(score, np.float32))})


def _cells(rows: pa.Table) -> pa.Table:
    x, node = _matrix(rows.column("f")), rows.column("node").to_numpy()
    s = x @ x.T
    np.fill_diagonal(s, LOW)
    k = min(LIST, len(x) - 1)
    if k < 1:
        return _entries()
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return _entries(np.repeat(node, k), node[top].ravel(), np.take_along_axis(s, top, 1).ravel())


def _merged(keep: int):
    """The best entries of each node in a partition that holds all entries of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        waiting: list[list] = []
        held = 0

        def pack():
            nonlocal columns, waiting, held
            columns = [np.concatenate([c, *(w[i] for w in waiting)]) for i, c in enumerate(columns)]
            top = _best(*columns, keep)
            columns, waiting, held = [c[top] for c in columns], [], 0

        for batch in batches:
            waiting.append([np.asarray(c) for c in batch.columns])
            held += batch.num_rows
            if held > 1 << 20:
                pack()
        pack()
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "other", "score"])

    return run


def merged(entries: DataFrame, keep: int, parts: int) -> DataFrame:
    return entries.select("node", "other", "score").repartition(parts, "node").mapInArrow(_merged(keep), ENTRIES)


def first_lists(nodes: DataFrame, count: int, seed: int, parts: int) -> DataFrame:
    """Neighbours within the cells of FIRST random hyperplane codes; cells too large are dealt out by hashes."""
    size = len(nodes.select("f").first()["f"])
    bits = max(0, int(np.ceil(np.log2(max(1, count / CELL)))))
    rng = np.random.default_rng(seed)
    out, made = None, []
    for turn in range(FIRST):
        planes = rng.standard_normal((bits, size)).astype(np.float32)

        def coded(batches: Iterator[pa.RecordBatch], planes=planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                side = _matrix(batch.column("f")) @ planes.T > 0 if len(planes) else np.zeros((batch.num_rows, 1))
                code = (side * (1 << np.arange(side.shape[1]))).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("f"), pa.array(code)], names=["node", "f", "code"])

        codes = nodes.select("node", "f").mapInArrow(coded, "node long, f array<float>, code long")
        sizes = stored(codes.groupBy("code").agg(F.count("*").alias("n")), "code-sizes")
        made.append(sizes)
        cells = codes.join(sizes, "code").withColumn("cell", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / (2 * CELL))))
        found = cells.groupBy("code", "cell").applyInArrow(_cells, ENTRIES)
        out = found if out is None else out.unionByName(found)
    out = stored(merged(out, LIST, parts), "graph")
    dropped(*made)
    return out


def around(graph: DataFrame, parts: int) -> DataFrame:
    """(node, other): the neighbours of each node in both directions, at most LIST and REVERSE of them."""
    back = merged(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score"), REVERSE, parts)
    return graph.select("node", "other").unionByName(back.select("node", "other")).distinct()


def _local_join(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs around the nodes of a block that improve a list: left (node, near, fresh), right (other, f, worst)."""
    if not len(right) or not len(left):
        return _entries()
    names = right.column("other").to_numpy()
    order = np.argsort(names)
    names, x, worst = names[order], _matrix(right.column("f"))[order], right.column("worst").to_numpy()[order]
    near, fresh = left.column("near").combine_chunks(), left.column("fresh").combine_chunks()
    ends = np.cumsum(np.asarray(near.value_lengths()))
    near, fresh = np.searchsorted(names, near.flatten().to_numpy()), np.asarray(fresh.flatten().to_numpy(zero_copy_only=False), bool)
    found: list[tuple] = []
    held = 0

    def pack():
        nonlocal held, found
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        top = _best(a, b, s, LIST)
        found, held = [(a[top], b[top], s[top])], len(top)

    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        at, new = near[lo:hi], fresh[lo:hi]
        s = x[at] @ x[at].T
        np.fill_diagonal(s, LOW)
        i, j = np.nonzero((s > worst[at][:, None]) & (new[:, None] | new[None, :]))
        if len(i):
            found.append((at[i], at[j], s[i, j]))
            held += len(i)
            if held > 4_000_000:
                pack()
    if not found:
        return _entries()
    pack()
    a, b, s = found[0]
    return _entries(names[a], names[b], s)


def list_parts(spark: SparkSession, count: int) -> int:
    """Partitions of the lists of that many nodes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 20_000)


def block_count(spark: SparkSession, count: int, most: int) -> int:
    """Blocks of at most that many rows, and enough of them for all cores."""
    return max(-(-count // most), 2 * spark.sparkContext.defaultParallelism)


def neighbour_graph(nodes: DataFrame, count: int, seed: int = 20240311) -> DataFrame:
    """(node, other, score): lists of about LIST nearest nodes, by NN-descent."""
    parts = list_parts(nodes.sparkSession, count)
    blocks = block_count(nodes.sparkSession, count, BLOCK)
    graph = first_lists(nodes, count, seed, parts)
    share, before = 1.0, None
    while share >= QUIET:  # lists only get better, so this ends
        flagged = around(graph, parts)
        old = F.lit(False) if before is None else F.coalesce("old", F.lit(False))
        flagged = flagged if before is None else flagged.join(before.select("node", F.explode("near").alias("other"), F.lit(True).alias("old")), ["node", "other"], "left")
        pairs = F.collect_list(F.struct("other", (~old).alias("fresh")))
        near = stored(flagged.groupBy("node").agg(pairs.alias("x")).select("node", F.col("x.other").alias("near"), F.col("x.fresh").alias("fresh")), "near")
        block = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks))
        left = near.where(F.exists("fresh", lambda x: x)).select(block.alias("block"), "node", "near", "fresh")
        worst = graph.groupBy("node").agg(F.when(F.count("*") < LIST, float("-inf")).otherwise(F.min("score")).cast("float").alias("worst"))
        vectors = nodes.select(F.col("node").alias("other"), "f").join(worst.withColumnRenamed("node", "other"), "other", "left").select("other", "f", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        wanted = left.select("block", F.explode("near").alias("other")).distinct()
        right = wanted.join(vectors, "other").select(F.col("block").alias("to"), "other", "f", "worst")
        better = left.groupBy("block").cogroup(right.groupBy("to")).applyInArrow(_local_join, ENTRIES)
        new = stored(merged(graph.unionByName(better), LIST, parts), "graph")
        kept = new.join(graph.select("node", "other"), ["node", "other"], "left_semi").count()
        total = new.count()
        share = 1 - kept / total if total else 0.0
        dropped(graph, *([] if before is None else [before]))
        graph, before = new, near
    dropped(before)
    return graph


def _beams(k: int):
    """One round of search for a block of queries: left (query, qv, beam, scores, seen, fresh), right (other, f)."""

    def run(rows: pa.Table, right: pa.Table) -> pa.Table:
        left, names = rows.to_pandas(), right.column("other").to_numpy()
        order = np.argsort(names)
        names, x = names[order], _matrix(right.column("f"))[order]
        rows = []
        for query, qv, beam, scores, seen, fresh in zip(*(left[c] for c in ("query", "qv", "beam", "scores", "seen", "fresh")), strict=True):
            new = np.setdiff1d(np.asarray(fresh, np.int64), np.asarray(beam, np.int64))
            at = np.searchsorted(names, new)
            s = x[at] @ np.asarray(qv, np.float32) if len(new) else np.zeros(0, np.float32)
            nodes, all_ = np.concatenate([np.asarray(beam, np.int64), new]), np.concatenate([np.asarray(scores, np.float32), s])
            top = np.lexsort((nodes, -all_))[:k]
            rows.append((query, qv, nodes[top], all_[top], np.union1d(np.asarray(seen, np.int64), np.asarray(beam, np.int64))))
        return pa.Table.from_pandas(pd.DataFrame(rows, columns=["query", "qv", "beam", "scores", "seen"]), pa.schema([("query", pa.int64()), ("qv", pa.list_(pa.float32())), ("beam", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("seen", pa.list_(pa.int64()))]), preserve_index=False)

    return run


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, count: int, beam: int = BEAM, made: list[DataFrame] | None = None) -> DataFrame:
    """(query, beam, scores): for queries(query, qv, entry array) the best nodes that greedy search finds. Tables that the result reads are added to made."""
    near = stored(around(graph, list_parts(graph.sparkSession, count)).groupBy("node").agg(F.collect_list("other").alias("near")), "near")
    blocks = block_count(nodes.sparkSession, queries.count(), QUERY_BLOCK)
    none = F.expr("cast(array() as array<bigint>)")
    state = queries.select("query", "qv", none.alias("beam"), F.expr("cast(array() as array<float>)").alias("scores"), none.alias("seen"), F.col("entry").alias("fresh"))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    vectors = nodes.select(F.col("node").alias("other"), "f")
    unseen = F.size(F.array_except("beam", "seen"))
    finished = None
    while True:
        left = state.select(block, "*")
        wanted = left.select("block", F.explode("fresh").alias("other")).distinct()
        right = wanted.join(vectors, "other").select(F.col("block").alias("to"), "other", "f")
        done = stored(left.groupBy("block").cogroup(right.groupBy("to")).applyInArrow(_beams(beam), "query long, qv array<float>, beam array<long>, scores array<float>, seen array<long>"), "beams")
        if made is not None:
            made.append(done)
        ended = done.where(unseen == 0).select("query", "beam", "scores")
        finished = ended if finished is None else finished.unionByName(ended)
        going = done.where(unseen > 0)
        if going.isEmpty():  # every round adds nodes to seen, so this comes
            dropped(near)
            return finished
        open_ = going.select("query", F.explode(F.array_except("beam", "seen")).alias("node"))
        fresh = open_.join(near, "node").select("query", F.explode("near").alias("other")).distinct().groupBy("query").agg(F.collect_list("other").alias("fresh"))
        state = going.join(fresh, "query", "left").withColumn("fresh", F.coalesce("fresh", none))


def nearest(rows: DataFrame, queries, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that queries (a condition) selects."""
    vectors = stored(valid_vectors(rows, id_column, vector), "vectors")
    nodes = stored(nodes_of(vectors, k + 1), "nodes")
    count = nodes.count()
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = neighbour_graph(nodes, count) if count > 1 else nodes.select("node", F.col("node").alias("other"), F.lit(0.0).cast("float").alias("score")).limit(0)
    asked = vectors.where(queries(F.col("id"))).select(F.col("id").alias("query_id"), "v")
    lists = graph.groupBy("node").agg(F.collect_list("other").alias("entry"))
    # queries with equal vectors are searched once, by their node
    node_of = nodes.select("node", F.col("v").alias("nv"))
    named = stored(asked.join(node_of, F.xxhash64("v").eqNullSafe(F.xxhash64("nv")) & (F.col("v") == F.col("nv"))).select("query_id", "node"), "asked")
    starts = named.select("node").distinct().join(nodes.select("node", "f"), "node").join(lists, "node", "left").select(
        F.col("node").alias("query"), F.col("f").alias("qv"), F.array_union(F.array("node"), F.coalesce("entry", F.expr("cast(array() as array<bigint>)"))).alias("entry"))
    made: list[DataFrame] = [stored(starts, "starts")]
    found = search(made[0], nodes, graph, count, made=made)
    # exact scores of the best, with the ids of their nodes; a few more than k, as float scores may tie
    some = found.select("query", F.explode(F.slice("beam", 1, 2 * k + 12)).alias("other"))
    v = nodes.select(F.col("node").alias("other"), F.col("v").alias("ov"), "ids")
    q = nodes.select(F.col("node").alias("query"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "ov", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    scored = some.join(v, "other").join(q, "query").select("query", "ids", dot.alias("score"))
    best = scored.select("query", F.struct((-F.col("score")).alias("down"), "ids").alias("x")).groupBy("query").agg(F.slice(F.sort_array(F.collect_list("x")), 1, 2 * k + 12).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda x: F.transform(x["ids"], lambda i: F.struct(x["down"].alias("down"), i.alias("id")))))
    ordered = best.select("query", F.slice(F.sort_array(pairs), 1, 2 * k + 2).alias("found"))
    out = named.join(ordered, named["node"] == ordered["query"]).select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    out = out.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.down")).alias("score"))
    out = stored(out, "nearest")
    dropped(vectors, nodes, named, *([graph] if count > 1 else []), *made)
    return out
