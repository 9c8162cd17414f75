"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import periods, queries


def brute(words, least=12, repeats=2):
    """Runs by trying every period at every place."""
    n, found = len(words), {}
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        letters = r.choice(["a", "ab", "abc", "abcdefgh"])
        words = [r.choice(letters) for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            piece, at = [r.choice(letters) for _ in range(r.randrange(1, 12))], r.randrange(len(words) + 1)
            words[at:at] = piece * r.randrange(2, 8) + piece[: r.randrange(len(piece))]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    texts = odd_texts(seed)
    for words, (runs, left, n) in zip(texts, periods.of_texts([" ".join(w) for w in texts]), strict=True):
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert left == collapsed(words, want) and n == len(words)


@pytest.mark.parametrize(("least", "repeats"), [(1, 2), (4, 2), (1, 3), (20, 4)])
def test_other_least_lengths(least, repeats):
    for words, (runs, _, _) in zip(texts := odd_texts(99), periods.of_texts([" ".join(w) for w in texts], least, repeats), strict=True):
        assert [(r["start"], r["length"], r["period"]) for r in runs] == brute(words, least, repeats)


@pytest.mark.parametrize("seed", range(6))
def test_extensions_by_the_grammar(seed):
    r = np.random.default_rng(seed)
    words = np.concatenate(([90], r.integers(0, 3, 150), np.tile(r.integers(0, 3, 7), 12), [5] * 40, r.integers(0, 2, 100), [91]))
    levels = periods.grammar(words)
    # every level spells the sequence
    spelt = {int(s): (int(s),) for s in words}
    for below, level in zip(levels, levels[1:], strict=False):
        for j, s in enumerate(level.symbols):
            body = sum((spelt[int(x)] for x in below.symbols[level.first[j] : level.first[j + 1]]), ())
            assert spelt.setdefault(int(s), body) == body
        assert len(level.symbols) < len(below.symbols)
    n = len(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    a, b = a[a != b], b[a != b]
    for levels, text in ((levels, words), (periods.mirrored(levels), words[::-1])):
        got = periods.extensions(levels, a, b)
        want = np.zeros((n + 1, n + 1), dtype=int)
        for i in range(n - 1, -1, -1):
            want[i, :n] = np.where(text[i] == text, want[i + 1, 1:] + 1, 0)
        assert (got == want[a, b]).all()


def test_small_portions_and_a_long_text(monkeypatch):
    monkeypatch.setattr(periods, "AT_ONCE", 50)
    for words, (runs, _, _) in zip(texts := odd_texts(7), periods.of_texts([" ".join(w) for w in texts]), strict=True):
        assert [(r["start"], r["length"], r["period"]) for r in runs] == brute(words)
    long = "x " * 300_000 + "y " + "p q r " * 100_000
    ((runs, left, n),) = periods.of_texts([long])
    assert [(r["start"], r["length"], r["period"]) for r in runs] == [(0, 300_000, 1), (300_001, 300_000, 3)]
    assert left == "x y p q r" and n == 600_001


def test_query_and_odd_rows(spark, tmp_path):
    r = random.Random(3)
    white = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    rows = []
    for i in range(400):
        words = [r.choice(["a", "b", "ü x", " ", "c\x1cd", "日本"]) for _ in range(r.randrange(0, 90))]
        text = "".join(w + r.choice(white) for w in words)
        rows.append((i, text if i % 17 else None, "x", 1))
    rows += [(None, "a " * 30, "x", 1), (3, "", None, 1), (3, " \n ", "x", None), rows[5], (-7, "z " * 50, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def want(key, text):
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))

    got = queries.op12_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x))
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((want(k, t) for k, t, _, _ in rows), key=key)
    whole = periods.periodic_runs(docs)
    assert whole.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and whole.where("text IS NULL AND n_words = 0 AND collapsed = ''").count() == whole.where("text IS NULL").count()
    assert periods.periodic_runs(docs.where("false")).count() == 0
    assert periods.periodic_runs(docs.select(F.col("text").alias("__found")), "__found").columns == ["__found", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, repeats=1)
