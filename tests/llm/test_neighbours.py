"""Shards and blocks of queries of the neighbour search: what meets where, and what a file or a broadcast holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, neighbours


def vectors(spark, n, dims=6, seed=3):
    r = np.random.default_rng(seed)
    data = {i: [float(np.float32(x)) for x in r.normal(size=dims)] for i in range(n)}
    return spark.createDataFrame(list(data.items()), "id long, vector array<float>"), data


def nearest(data, asked, k):
    out = []
    for q in asked:
        far = sorted((float(np.sqrt(((np.array(x) - np.array(data[q])) ** 2).sum())), i) for i, x in data.items() if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(far)]
    return out


@pytest.mark.parametrize(("queries", "block", "pairs"), [(256, 4096, 256), (5, 4096, 256), (5, 16, 1), (5, 4096, 1)])
def test_blocks_of_queries_meet_every_shard(spark, monkeypatch, queries, block, pairs):
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    monkeypatch.setattr(neighbours, "BLOCK", block, raising=False)
    monkeypatch.setattr(neighbours, "PAIRS", pairs, raising=False)
    table, data = vectors(spark, 400)
    index = common.written(neighbours.index(table, 4, shard=64), "index")
    got = neighbours.search(index, table.where("id % 10 = 0"), 4).orderBy("query_id", "rank").collect()
    want = nearest(data, range(0, 400, 10), 4)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [x[:3] for x in want]
    assert np.allclose([r["score"] for r in got], [x[3] for x in want], rtol=0, atol=1e-12)


def test_queries_for_every_shard_are_made_by_many_tasks(spark, monkeypatch, capsys):
    monkeypatch.setattr(neighbours, "COPIES", 10, raising=False)
    table, data = vectors(spark, 200)
    index = common.written(neighbours.index(table, 3, shard=32), "index")
    found = neighbours.search(index, table.where("id % 10 = 0"), 3)
    capsys.readouterr()
    found.explain("formatted")
    # 20 queries for 7 shards
    assert "hashpartitioning(id#" in (plan := capsys.readouterr().out) and ", 15), REPARTITION_BY_NUM" in plan
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found.orderBy("query_id", "rank").collect()] == [x[:3] for x in nearest(data, range(0, 200, 10), 3)]


def test_queries_for_every_shard_are_not_broadcast(spark, capsys):
    table, _ = vectors(spark, 200)
    index = common.written(neighbours.index(table, 3, shard=32), "index")
    found = neighbours.search(index, table.where("id % 10 = 0"), 3)
    capsys.readouterr()
    found.explain("formatted")
    assert "Broadcast" not in capsys.readouterr().out
    assert found.count() == 60


def test_no_part_of_the_index_has_many_graphs(spark):
    table, _ = vectors(spark, 1_280)
    index = neighbours.index(table, 3, shard=16)
    held = [r["count"] for r in index.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 80 and max(held) <= 8


def test_ties_go_to_the_smaller_id(spark):
    # of 12 corners around a centre, equally far, each twice; graphs put them in the order of their first ids
    corner = {i: [float(x) for x in np.eye(6)[i % 6] * (1 if i % 12 < 6 else -1)] for i in range(24)}
    data = {23 - i: x for i, x in corner.items()} | {100: [0.0] * 6, 101: [0.0] * 6}
    table = spark.createDataFrame(list(data.items()), "id long, vector array<float>")
    index = common.written(neighbours.index(table, 5, shard=1000), "index")
    for k in (1, 4, 5):
        got = neighbours.search(index, table.where("id = 100"), k).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in got] == [(101, 0.0), *((i, 1.0) for i in range(k - 1))]


def test_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TASKS", 3, raising=False)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    table, data = vectors(spark, 120)
    index = neighbours.index(table, 3, shard=16)
    assert index.rdd.getNumPartitions() <= 3
    got = neighbours.search(common.written(index, "index"), table.where("id % 10 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [x[:3] for x in nearest(data, range(0, 120, 10), 3)]
