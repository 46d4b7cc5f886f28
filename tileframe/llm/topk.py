"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments at several resolutions, coarse to fine. With segment length L, means m and deviations s, the squared distance of
two vectors is at least the sum over segments of L * ((m1 - m2)^2 + (s1 - s2)^2); as the inner product is half of the two squared
norms less the squared distance, this bounds the score from above. In each block of queries and candidates the best by the
coarsest bound are scored exactly first, which gives a floor; pairs below it are dropped at each finer resolution, and only the
survivors are scored exactly. The best k of each block are merged by rank.

Queries meet candidates in blocks of bounded size: queries are dealt into groups, candidates into chunks, and each (group, chunk)
pair is one task's work. NULL vectors, those with NULL or non-finite components and empty ones take no part; vectors of different
lengths are not compared. Repeated ids are candidates each; rows with the query's own id are not its candidates. Ties go to
the smaller id. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 256
CHUNK_ROWS = 2048


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled by the root of its length, so that products bound inner products."""
    parts = np.array_split(x, segments, axis=1)
    means = np.stack([p.mean(1) * math.sqrt(p.shape[1]) for p in parts], 1)
    spread = np.stack([p.std(1) * math.sqrt(p.shape[1]) for p in parts], 1)
    return np.concatenate([means, spread], 1)


def resolutions(dim: int) -> list[int]:
    return sorted({max(1, min(dim, n)) for n in (4, 8, 16)})


def pieces(n: int, size: int = 65_536) -> list[slice]:
    return [slice(at, at + size) for at in range(0, n, size)]


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a[i], b[j])


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and rows with their scores: at least the k best of each query (ties with the k-th included)."""
    levels = resolutions(queries.shape[1])
    own = query_ids[:, None] == row_ids[None, :]
    norm_q, norm_r = (queries**2).sum(1), (rows**2).sum(1)
    slack = 1e-9 * (1 + norm_q.max() + norm_r.max())

    # Half of (|q|^2 + |r|^2 - least squared distance) is the product of the statistics.
    best = segment_statistics(queries, levels[0]) @ segment_statistics(rows, levels[0]).T + slack
    best[own] = -np.inf
    m = min(k, len(rows))
    first = np.argpartition(-best, m - 1, axis=1)[:, :m]
    exact = np.einsum("qd,qmd->qm", queries, rows[first])
    exact[np.take_along_axis(own, first, 1)] = -np.inf
    floor = exact.min(1)  # -inf if there are fewer than k candidates
    qi, ri = np.nonzero((best >= floor[:, None]) & ~own)
    del best
    for n in levels[1:]:
        a, b = segment_statistics(queries, n), segment_statistics(rows, n)
        keep = np.concatenate([pair_products(a, b, qi[s], ri[s]) + slack >= floor[qi[s]] for s in pieces(len(qi))] or [np.empty(0, bool)])
        qi, ri = qi[keep], ri[keep]
    score = np.concatenate([pair_products(queries, rows, qi[s], ri[s]) for s in pieces(len(qi))] or [np.empty(0)])
    order = np.lexsort((row_ids[ri], -score, qi))
    qi, ri, score = qi[order], ri[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[rank < k], ri[rank < k], score[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (double) of the k best other rows of each query row.

    scale: each component x becomes floor(scale * x) first, so that scores are exact integers.
    """
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * scale).cast("double") if scale else v)
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(fine, F.col(vector_col)).alias(vector_col), F.coalesce(is_query, F.lit(False)).alias("wanted")).where(F.col(vector_col).isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "wanted", x.alias("x")).withColumn("dim", F.size("x"))
    asked = rows.where("wanted").select("vec_id", "dim", "x").distinct()
    n_rows, n_asked = rows.count(), asked.count()
    chunks, groups = max(8, math.ceil(n_rows / CHUNK_ROWS)), max(1, math.ceil(n_asked / QUERY_ROWS))
    left = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # Copies of a row are dealt by a hash of the row and a random-free salt: their ids.
    right = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(chunks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if q.empty or r.empty:
            return empty
        qx, rx, qid, rid = np.stack(q["x"].tolist()), np.stack(r["x"].tolist()), q["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        out = []
        for at in range(0, len(rid), CHUNK_ROWS):
            part = slice(at, at + CHUNK_ROWS)
            a, b, s = search_block(qx, qid, rx[part], rid[part], k)
            out.append(pd.DataFrame({"query_id": qid[a], "vec_id": rid[part][b], "score": s}))
        return pd.concat(out)

    left = left.select(F.col("group").cast("int").alias("group"), "chunk", "dim", "vec_id", "x")
    right = right.select("group", "chunk", "dim", "vec_id", "x")
    found = left.groupBy("group", "chunk", "dim").cogroup(right.groupBy("group", "chunk", "dim")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
