"""Packing whole documents: coverage, capacity, the configurations' optimum, hot keys."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import grouping, queries


def checked(rows, capacity):
    """The number of sequences of rows (sequence_id, offset, length), which are gapless and within the capacity."""
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    return len(held)


def best_fit(lengths, capacity):
    return len(grouping.fitted(sorted(lengths, reverse=True), [], capacity)[1])


@pytest.mark.parametrize("seed", range(30))
def test_knapsack_and_fit_against_brute_force(seed):
    r = random.Random(seed)
    capacity = r.randint(10, 40)
    sizes = np.array(sorted(r.sample(range(3, capacity + 1), min(4, capacity - 3))))
    worth = np.array([r.choice([0, r.random(), -0.2]) for _ in sizes])
    got = grouping.best_configuration(sizes, worth, capacity)
    every = [c for c in itertools.product(*[range(capacity // s + 1) for s in sizes]) if np.dot(c, sizes) <= capacity]
    assert got @ sizes <= capacity and abs(got @ worth - max(np.dot(c, worth) for c in every)) < 1e-9
    lengths = sorted((r.randint(1, capacity) for _ in range(60)), reverse=True)
    windows, rest = grouping.fitted(lengths, [], capacity)
    room = []
    for size, w in zip(lengths, windows, strict=True):
        fit = [x for x in room if x >= size]
        if fit:
            assert room[w] == min(fit)
        else:
            assert w == len(room)
            room.append(capacity)
        room[w] -= size
    assert room == rest


@pytest.mark.parametrize("seed", range(10))
def test_configurations_hold_the_demand(seed):
    r = random.Random(seed)
    sizes = np.array(sorted(r.sample(range(200, 2048), 12)))
    demand = np.array([r.randint(1, 500) for _ in sizes], dtype=float)
    found = grouping.configurations(sizes, demand)
    assert all(c @ sizes <= 2048 for c, _ in found)
    assert np.allclose(sum(c * x for c, x in found), demand)
    lengths = [int(s) for s, n in zip(sizes, demand, strict=True) for _ in range(int(n))]
    assert sum(lengths) / 2048 <= sum(x for _, x in found) + 1e-6 <= best_fit(lengths, 2048) * (1 + grouping.NEAR) + 1e-6


def test_known_optimum():
    # thirds and halves: every window can be full
    plan, windows = grouping.places(grouping.groups_of([(1100, 90), (900, 180), (248, 90), (600, 0)]), 2048)
    assert windows <= 192
    plan, windows = grouping.places(grouping.groups_of([(1024, 100)], 7), 2048)
    assert windows == 50 and sorted(x for p in plan for x in range(p["lo"], p["hi"])) == list(range(100))
    assert grouping.places([], 2048) == ([], 0)


@pytest.mark.parametrize("case", ["mixed", "large", "small", "one", "equal", "whole", "none"])
def test_every_piece_once(spark, case, monkeypatch):
    monkeypatch.setattr(grouping, "BIN_WINDOWS", 40)
    r = random.Random(case)
    lengths = {
        "mixed": [min(100, int(r.expovariate(1 / 30)) + 1) for _ in range(2000)],
        "large": [r.randint(35, 99) for _ in range(900)],
        "small": [r.randint(1, 12) for _ in range(3000)],
        "one": [7],
        "equal": [34] * 500,
        "whole": [100] * 30 + [99],
        "none": [],
    }[case]
    # one key for all: nothing may hang on it
    rows = [(None, 0, n, i, "x") for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, "key long, start long, length long, n long, offset string")
    got = grouping.pack_whole(grouping.written(cut, "cut"), capacity=100, groups=16).collect()
    assert sorted((x["n"], x["length"]) for x in got) == [(i, n) for i, n in enumerate(lengths)]
    sequences = checked([(x["sequence_id"], x["offset"], x["length"]) for x in got], 100)
    bins = max(1, -(-sum(lengths) // 4000))
    assert sequences <= best_fit(lengths, 100) * 1.03 + bins


def test_query_over_odd_rows(spark, tmp_path):
    r = random.Random(2)
    words = ["alpha", "Beta", "ü", "42", "it's", "日本"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 40, 700, 1500]))), "x") for i in range(60)]
    rows += [(100, None, "a"), (101, "", None), (None, "no id", "b"), (None, "no id", "b"), (5, rows[5][1], "x"), (5, "same id", "x"), (102, "long text " * 9000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, length string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_whole(spark, str(tmp_path))
    assert dict(got.dtypes) | {"piece": "int"} == dict(got.dtypes) and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    got = got.collect()
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for key, text, _ in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(key, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)]
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == Counter(want)
    assert checked([(x["sequence_id"], x["offset"], x["length"]) for x in got], 2048) <= best_fit([x[3] for x in want], 2048) + 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert grouping.pack_documents(docs.where("false")).count() == 0
    ids = grouping.pack_documents(docs.where("doc_id = 102"), with_ids=True).orderBy("start").collect()
    assert [i for x in ids for i in x["ids"]] == [*full.encode("long text " * 9000, add_special_tokens=False).ids, 0]


def test_very_many_pieces_of_one_document_id(spark):
    cut = spark.range(300_000).select(F.lit(1).cast("long").alias("key"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("length"), "id")
    packed = grouping.pack_whole(grouping.written(cut, "cut"))
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count(F.lit(1)).alias("m"))
    most, count, pieces, apart = sizes.agg(F.max("n"), F.count(F.lit(1)), F.sum("m"), F.sum("k")).first()
    assert most <= 2048 and pieces == apart == 300_000 and count <= 900_000 // 2046 + 4
    assert packed.agg(F.countDistinct("id")).first()[0] == 300_000
