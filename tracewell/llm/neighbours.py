"""Approximate nearest neighbours: one navigable small-world hierarchy per shard.

Equal vectors are one node, with their ids. Nodes are dealt to shards of bounded
size by a hash; a shard's graph is a row of flat arrays: vectors, the level of
each node, and fixed-width neighbour arrays, those of the ground level and those
of the levels above. A query descends each shard's hierarchy and the shards'
nearest are merged by exact distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import written
from tracewell.llm.vectors import blocks, matrix, to_every

SHARD, QUERIES = 4096, 256
#: Queries of a block where shards are many (a shard is moved once for each block), and the pairs of blocks and shards that smaller blocks are taken for.
BLOCK, PAIRS = 4096, 256
#: Partitions for each shard or pair, as hashes collide, the most of them, and the rows that a task makes of queries for all shards.
SPREAD, TASKS, COPIES = 4, 4096, 1 << 16
#: Neighbours a node keeps (twice as many on the ground level), and the widths of the searches.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 60, 128
#: Nodes expanded in one step of a search.
STEP = 4


def squares(vectors: np.ndarray, nodes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of nodes from the centre."""
    between = vectors.take(nodes, axis=0) - centre
    between *= between
    return between.sum(axis=1)


@dataclass
class Graph:
    """``links[level][node]``: neighbours, filled up with -1; on levels above its own a node has none."""

    vectors: np.ndarray
    levels: np.ndarray
    links: list[np.ndarray]
    entry: int

    def nearest(self, distance, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` nodes near, nearest first, and their distances, from ``start`` along one level."""
        links = self.links[level]
        # by node, and a last place that -1 stands for
        unseen, waiting = np.ones(len(self.vectors) + 1, dtype=bool), np.ones(len(self.vectors), dtype=bool)
        unseen[-1] = unseen[start] = False
        nodes, far = start, distance(start)
        order = far.argsort(kind="stable")
        nodes, far = nodes[order], far[order]
        while True:
            at = nodes[waiting[nodes].nonzero()[0][:STEP]]
            if not len(at):
                return nodes, far
            waiting[at] = False
            new = links.take(at, axis=0).ravel()
            new = new[unseen[new]]
            if not len(new):
                continue
            unseen[new] = False
            new.sort()
            first = np.ones(len(new), dtype=bool)
            np.not_equal(new[1:], new[:-1], out=first[1:])
            new = new[first]
            d = distance(new)
            if len(nodes) >= width:
                keep = d < far[-1]
                new, d = new[keep], d[keep]
                if not len(new):
                    continue
            nodes, far = np.concatenate((nodes, new)), np.concatenate((far, d))
            order = far.argsort(kind="stable")[:width]
            nodes, far = nodes[order], far[order]

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        distance = lambda nodes: squares(self.vectors, nodes, query)
        at = np.array([self.entry])
        for level in range(len(self.links) - 1, 0, -1):
            at = self.nearest(distance, at, 1, level)[0][:1]
        return self.nearest(distance, at, width, 0)


def diverse(nodes: np.ndarray, far: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of nodes by distance, those nearer to the centre than to any taken before; filled up with the nearest others."""
    if len(nodes) <= most:
        return nodes
    own = vectors[nodes]
    squares = (own * own).sum(axis=1)
    between = squares[:, None] + squares[None, :] - 2 * (own @ own.T)
    taken, free = np.zeros(len(nodes), dtype=bool), np.ones(len(nodes), dtype=bool)
    at = 0
    for _ in range(most):
        taken[at] = True
        free &= between[at] >= far
        free[: at + 1] = False
        at = int(free.argmax())
        if not free[at]:
            break
    kept = np.flatnonzero(taken)
    return nodes[np.concatenate((kept, np.flatnonzero(~taken)[: most - len(kept)]))]


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 0) -> Graph:
    """The hierarchy over the vectors, put in one after another.

    A node takes half as many links again as it keeps before they are thinned out.
    """
    n = len(vectors)
    levels = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links), 8).astype(np.int64)
    graph = Graph(vectors, levels, [np.full((n, links * (1 + (level == 0)) * 3 // 2), -1, dtype=np.int32) for level in range(int(levels.max(initial=0)) + 1)], 0)
    for i in range(1, n):
        distance = lambda nodes, x=vectors[i]: squares(vectors, nodes, x)
        at, top = np.array([graph.entry]), int(levels[graph.entry])
        for level in range(top, int(levels[i]), -1):
            at = graph.nearest(distance, at, 1, level)[0][:1]
        for level in range(min(top, int(levels[i])), -1, -1):
            nodes, far = graph.nearest(distance, at, width, level)
            at, table = nodes, graph.links[level]
            mine = diverse(nodes, far, vectors, links)
            table[i, : len(mine)] = mine
            for node in mine:
                row = table[node]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    every = np.append(row, i)
                    d = squares(vectors, every, vectors[node])
                    order = d.argsort(kind="stable")
                    kept = diverse(every[order], d[order], vectors, len(row) * 2 // 3)
                    row[:] = -1
                    row[: len(kept)] = kept
        if levels[i] > top:
            graph.entry = i
    return graph


def nodes(df: DataFrame, most: int) -> DataFrame:
    """``vector, ids``: each distinct vector with its ``most`` smallest ids; a result of ``most - 1`` rows can't need more."""
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return df.select("id", "vector").withColumn("nth", order).where(F.col("nth") <= most).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


INDEX = "shard int, n int, dims int, entry int, vectors binary, levels binary, links array<binary>, ids array<array<long>>"


def index(df: DataFrame, k: int, shard: int = SHARD, **options) -> DataFrame:
    """The index of ``df`` (id long, vector array<float>): a row of flat arrays for each shard, every row of ``df`` in one.

    ``k`` is the longest result it will be asked for. Vectors are usable ones (see
    ``vectors.usable``), shorter ones filled with zeros; rows with a null id take no
    part, of rows that share an id the least vector counts. Of equal vectors the
    graph has one node, so a vector that a third of the rows share costs no more.
    """
    df = df.dropna(subset=["id", "vector"]).groupBy("id").agg(F.min("vector").alias("vector"))
    distinct = written(nodes(df, k + 1), "nodes")

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[x[0] for x in frame["ids"]]).sort_values("first")
        vectors = matrix(frame["vector"], np.float32)
        g = build(vectors, **options)
        return pd.DataFrame([{"shard": frame["shard"].iloc[0], "n": len(frame), "dims": vectors.shape[1], "entry": g.entry, "vectors": vectors.tobytes(), "levels": g.levels.astype(np.int8).tobytes(), "links": [x.tobytes() for x in g.links], "ids": [list(x) for x in frame["ids"]]}])

    rows = distinct.count()
    # so many parts that few shards share one: a graph takes seconds, and the graphs in a file are read into memory at once
    parts = min(TASKS, SPREAD * max(1, -(-rows // shard)))
    return blocks(distinct, shard, "shard", rows, "vector").repartition(parts, "shard").groupBy("shard").applyInPandas(graph, INDEX)


def search(indexed: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found by Euclidean distance, a row with the query's id left out.

    ``queries``: id long, vector array<float>. Every query visits every shard. A shard
    meets a block of ``QUERIES`` to ``BLOCK`` queries in one task's group, by a
    cogroup, as what all blocks take to all shards is too much for a broadcast.
    Ties go to the smaller id. An empty table on either side gives no rows.
    """
    queries = queries.dropna(subset=["id", "vector"]).groupBy("id").agg(F.min("vector").alias("vector"))
    m, last = queries.count(), indexed.agg(F.max("shard")).first()[0]
    shards = (last or 0) + 1
    block = min(BLOCK, max(QUERIES, m * shards // PAIRS))
    count = max(1, -(-m // block))
    n = min(TASKS, SPREAD * count * shards)
    asked = blocks(queries.select("id", "vector"), block, "qb", m, "id").repartition(min(TASKS, 1 + m * shards // COPIES), "id")
    asked = to_every(asked, shards, "shard").repartition(n, "qb", "shard")
    held = to_every(indexed, count, "qb").repartition(n, "qb", "shard")

    def find(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        for row in held.itertuples(index=False):
            vectors = np.frombuffer(row.vectors, dtype=np.float32).reshape(row.n, row.dims).astype(np.float64)
            links = [np.frombuffer(x, dtype=np.int32).reshape(row.n, -1) for x in row.links]
            g = Graph(vectors, np.frombuffer(row.levels, dtype=np.int8), links, row.entry)
            for q in asked.itertuples(index=False):
                vector = np.zeros(row.dims)
                given = np.asarray(q.vector, dtype=np.float64)[: row.dims]
                vector[: len(given)] = given
                near, far = g.search(vector, max(width, 2 * k))
                far = np.sqrt(far)
                # one of k + 1 nodes may be the query itself; what is as far as the last may have a smaller id
                enough = np.searchsorted(far, far[min(k, len(far) - 1)], side="right")
                own = [(q.id, i, d) for node, d in zip(near[:enough], far[:enough], strict=True) for i in row.ids[node] if i != q.id]
                out += sorted(own, key=lambda x: (x[2], x[1]))[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})

    pairs = asked.groupBy("qb", "shard").cogroup(held.groupBy("qb", "shard"))
    found = pairs.applyInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
