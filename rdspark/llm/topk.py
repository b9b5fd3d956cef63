"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments. Of each segment its mean and deviation are kept. With x = mean + rest on a segment of length L,
|x - y|^2 >= sum of L (mean_x - mean_y)^2 + (dev_x - dev_y)^2, where dev is the length of the rest (Cauchy-Schwarz), so
<x, y> = (|x|^2 + |y|^2 - |x - y|^2) / 2 <= sum of L mean_x mean_y + dev_x dev_y. The bounds go from coarse to fine; a candidate leaves when its
bound cannot reach the k-th best score found so far. Survivors get exact integer scores.

Work is dealt as (block of queries) x (block of rows): every pair of blocks is one group of bounded size, gives k rows a query, and
those meet in a last ranking. Blocks are made by a hash of the id, their number by counts.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; a query meets
only rows of its own length; rows that repeat id and vector count once, and no row with the query's id is its candidate; ties go
to the smaller id; an id with several vectors asks with each and keeps its k best answers; components beyond +-2^28 (after scaling) raise an error, as their scores would not fit; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rdspark.llm.tables import written

SEGMENTS = (1, 4, 16)
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
LIMIT = float(1 << 28)
#: Bounds that are held at once: queries of a step times rows of a block.
CELLS = 1 << 20


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), x as double. Unfit vectors are left out."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad)
    big = F.exists(v, lambda x: F.abs(x.cast("double") * scale) >= LIMIT)
    ints = F.when(~big, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))).otherwise(
        F.raise_error(F.lit("a component is too large for exact scores")))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).dropDuplicates()


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows x 2 segments: sqrt(L) * mean and deviation of each segment (the last ones may be shorter)."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    rest = np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(rest)], 1)


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query position, id, score) of the k best rows of a block for each query; ids ascending."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    exact_float = float(np.abs(qf).max(initial=0)) * float(np.abs(xf).max(initial=0)) * x.shape[1] < 2 ** 52
    levels = [(statistics(qf, s), statistics(xf, s)) for s in SEGMENTS]
    slack = 1e-9 * np.linalg.norm(qf, axis=1) * float(np.linalg.norm(xf, axis=1).max(initial=0)) + 1e-6

    exact_x = (qf, xf) if exact_float else (q, x)
    step = max(1, CELLS // max(1, len(ids)))
    for a in range(0, len(q_ids), step):
        part = slice(a, a + step)
        left = _left(q_ids[part], ids, [(sq[part], sx) for sq, sx in levels], exact_x[0][part], exact_x[1], slack[part], k)
        rows = np.flatnonzero(left.any(0))
        # One product for all rows that some of these queries have left; what a query itself has not left does not count for it.
        s, left, at = exact_x[0][part] @ exact_x[1][rows].T, left[:, rows], ids[rows]
        for j in range(len(s)):
            own = np.flatnonzero(left[j])
            if len(own) > k:
                own = own[s[j, own] >= np.partition(s[j, own], len(own) - k)[len(own) - k]]
            scores = np.rint(s[j, own]).astype(np.int64) if exact_float else s[j, own]
            top = np.lexsort((at[own], -scores))[:k]
            yield a + j, at[own[top]], scores[top]


def _left(q_ids: np.ndarray, ids: np.ndarray, levels: list, q: np.ndarray, x: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Queries x rows: the rows whose bounds, from coarse to fine, reach a threshold, which the exact scores of the best bounds at each level raise."""
    left, floor, some = ids != q_ids[:, None], np.full(len(q_ids), -np.inf), 2 * k + 1
    for sq, sx in levels:
        bound = sq @ sx.T
        if len(ids) > 2 * some:
            if not left.all():
                bound[~left] = -np.inf
            best = np.argpartition(bound, len(ids) - some, axis=1)[:, -some:]
            s = np.einsum("qd,qrd->qr", q, x[best]).astype(np.float64)
            s[~np.take_along_axis(left, best, 1)] = -np.inf
            floor = np.maximum(floor, np.partition(s, some - k, axis=1)[:, some - k] - slack)
        left &= bound >= (floor - slack)[:, None]
    return left


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds for, the k rows with the highest inner products."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "vectors").withColumn("n", F.size("v"))
    asked = rows.where(queries)
    sizes = rows.agg(F.count("*").alias("rows"), F.count(F.when(queries, 1)).alias("asked")).first()
    row_blocks, query_blocks = max(1, -(-sizes["rows"] // ROW_BLOCK)), max(1, -(-sizes["asked"] // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = lambda own, other, blocks, others: F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
    left = asked.select("n", block(query_blocks).alias("qb"), dealt("qb", "rb", query_blocks, row_blocks), "vec_id", "v")
    right = rows.select("n", block(row_blocks).alias("rb"), dealt("rb", "qb", row_blocks, query_blocks), "vec_id", "v").select("n", "qb", "rb", "vec_id", "v")

    def matrix(t: pa.Table):
        t = t.sort_by("vec_id").combine_chunks()
        ids = t.column("vec_id").to_numpy()
        flat = t.column("v").combine_chunks()
        flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else flat.chunk(0).flatten()
        return ids, flat.to_numpy().reshape(len(ids), -1)

    def search(query_table: pa.Table, row_table: pa.Table) -> pa.Table:
        out = ([], [], [])
        if query_table.num_rows and row_table.num_rows:
            (q_ids, q), (ids, x) = matrix(query_table), matrix(row_table)
            for a, found, s in block_top(q_ids, q, ids, x, k):
                out[0].append(np.full(len(found), q_ids[a]))
                out[1].append(found)
                out[2].append(s)
        cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))
    found = left.groupBy("n", "qb", "rb").cogroup(right.groupBy("n", "qb", "rb")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
