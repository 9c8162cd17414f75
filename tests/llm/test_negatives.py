"""Hard negatives against brute force."""

import random

import numpy as np
import pytest

from tracewell.llm import negatives, queries


def brute(rows, anchors, positives=5, k=10, least=30, most=90):
    """rows: id -> (label, weights)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a in anchors:
        label, own = rows[a]
        scores = sorted((-dot(own, w), i) for i, (_, w) in rows.items() if i != a)
        for s, p in [x for x in scores if rows[x[1]][0] == label][:positives]:
            good = [(t, i) for t, i in scores if rows[i][0] != label and least * -s <= 100 * -t <= most * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(good)]
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_pruned_search_of_a_shard(seed):
    r = np.random.default_rng(seed)
    n, dims = 700, 6
    scale = r.choice([1, 5, 40], size=(n, 1))
    weights = np.floor(r.normal(size=(n, dims)) * scale * (8 if seed % 2 else 1)).astype(np.int64)
    weights[:5] = 0
    ids, labels = r.permutation(n).astype(np.int64), r.integers(0, 3, n)
    held = negatives.buckets(ids, labels, weights, 64)
    assert sum(len(b.ids) for b in held) == n and all(a.shortest >= b.longest for a, b in zip(held, held[1:], strict=False))
    tried = wanted = 0
    for at in range(0, n, 7):
        scores = weights @ weights[at]
        windows = [(-(1 << 62), 1 << 62), *[(int(x), int(y)) for x, y in np.sort(r.choice(scores, (4, 2)), axis=1)], (1, 0)]
        for alike in (True, False):
            got = negatives.best_within(ids[at], weights[at], labels[at], alike, windows, held, 5)
            for (lo, hi), (found, s) in zip(windows, got, strict=True):
                want = sorted((-scores[j], ids[j]) for j in range(n) if j != at and (labels[j] == labels[at]) == alike and lo <= scores[j] <= hi)[:5]
                assert list(zip(found, s, strict=True)) == [(i, -t) for t, i in want]
        # a tight window leaves few candidates to verify
        top = int(np.sort(scores)[-4])
        length = float(np.sqrt((weights[at].astype(float) ** 2).sum()))
        if length and top > 0:
            for b in held:
                bounds = negatives.cosines(top, 1 << 62, length, b)
                wanted += len(b.ids)
                if bounds:
                    found = negatives.feasible(b, weights[at] / length, bounds)
                    assert set(np.flatnonzero(b.weights @ weights[at] >= top)) <= set(found)
                    tried += len(found)
    assert tried < wanted / 2


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], r.choice([0, 1, 2, 9, None]), "x") for i in range(700)]
    rows += [(700 + i, rows[3][1], i % 3, "x") for i in range(40)]
    odd = [(900, None, 1, None), (1000, [float("nan")] * 8, 1, None), (1100, [1.0, None], 1, None), (1200, [], 1, None), (None, rows[0][1], 1, None), (1300, [0.0] * 8, 1, None), (1400, [0.5, 0.25], 2, None)]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>, label int, window string")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    data = {}
    for i, v, label, _ in [*rows, *odd[-2:]]:
        if label is not None:
            data[i] = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
    got = queries.op13_negatives(spark, str(tmp_path))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    want = brute(data, [i for i in data if i % 100 == 0])
    assert want and shown(got) == want


def test_ties_one_label_and_nothing(spark):
    rows = spark.createDataFrame([(i, 1 if i < 8 else 2, [1, i % 3], "c") for i in range(30)] + [(5, 9, [100, 100], "c"), (None, 1, [1], "c"), (77, None, [1], "c"), (78, 1, None, "c")], "id long, label long, weights array<long>, windows string")
    data = {i: (1 if i < 8 else 2, [1, i % 3]) for i in range(30)}
    assert shown(negatives.hard_negatives(rows, rows.where("id < 4"), most_percent=100, least_percent=0)) == brute(data, range(4), least=0, most=100)
    assert negatives.hard_negatives(rows.where("label = 1"), rows.where("label = 1")).count() == 0
    assert negatives.hard_negatives(rows.where("false"), rows).count() == 0 == negatives.hard_negatives(rows, rows.where("false")).count()
