"""Exact top-k search by inner product, term at a time.

Vectors are sparse rows of integer weights by dimension. Candidates are taken in
blocks, each with the postings of every dimension; a query scatters its weights,
times those of the postings, into a dense array of scores, one dimension after
another. A partition of that array selects the block's best, and the blocks'
are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.vectors import blocks, matrix, to_every

CANDIDATES, QUERIES = 4096, 1024


def postings(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows with a weight, and the weights."""
    found = [np.flatnonzero(column) for column in weights.T]
    return [(rows, weights[rows, j]) for j, rows in enumerate(found)]


def accumulated(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of all n rows for a query."""
    scores = np.zeros(n, dtype=np.int64)
    for j in np.flatnonzero(query[: len(lists)]):
        rows, weights = lists[j]
        scores[rows] += query[j] * weights
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, ties to the lower position."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        at = np.concatenate((above, np.flatnonzero(scores == kth)[: k - len(above)]))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products.

    Both tables: ``id long, weights array<long>``; a candidate with the query's id
    is left out, ties go to the smaller id, missing dimensions are zeros. Every
    pair of blocks is a task's work of bounded size; k rows a query and block are
    merged. Rows with a null id or null weights take no part; of rows that share an
    id the least weights count. Scores are 64-bit. An empty table gives no rows.
    """
    candidates, queries = (df.dropna(subset=["id", "weights"]).groupBy("id").agg(F.min("weights").alias("weights")) for df in (candidates, queries))
    n, m = candidates.count(), queries.count()
    left = blocks(queries.select("id", "weights"), QUERIES, "qb", m, "id")
    right = blocks(candidates.select("id", "weights"), CANDIDATES, "cb", n, "id")
    left = to_every(left, max(1, -(-n // CANDIDATES)), "cb")
    right = to_every(right, max(1, -(-m // QUERIES)), "qb")

    def score(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("id")
            ids, weights = candidates["id"].to_numpy(), matrix(candidates["weights"], np.int64)
            lists = postings(weights)
            for query, row in zip(queries["id"], matrix(queries["weights"], np.int64), strict=True):
                scores = accumulated(row, lists, len(ids))
                at = best(scores, k + 1)
                at = at[ids[at] != query][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})

    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
    found = pairs.applyInPandas(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
               FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
"""
