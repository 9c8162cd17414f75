"""SQL functions and the table function, against the DataFrame forms; restored segments against lists."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import seams, visual
from tracewell.operators.spans import merge_spans
from tracewell.streaming import hooks


def test_merge_spans_in_sql(spark):
    hooks.register_functions(spark)
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([1, 2**53 + 1]), a := r.randrange(300), a + r.randrange(-2, 12)) for _ in range(400)] + [("a", 1, 5, None), ("a", 1, None, 5)]
    spans = spark.createDataFrame(rows, "who string, recording_id long, start_us long, end_us long")
    got = spark.sql("SELECT * FROM merge_spans(TABLE({spans}) PARTITION BY (who, recording_id) ORDER BY (start_us, end_us)) WHERE recording_id IS NOT NULL", spans=spans)
    want = merge_spans(spans.where("start_us IS NOT NULL"), ["who", "recording_id"])
    assert got.columns == ["who", "recording_id", "start_us", "end_us"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    with pytest.raises(Exception, match="start_us"):
        spark.sql("SELECT * FROM merge_spans(TABLE(SELECT 1 AS x))").collect()
    with pytest.raises(Exception, match="ordered"):
        spark.sql("SELECT * FROM merge_spans(TABLE({s}) PARTITION BY who ORDER BY end_us DESC)", s=spans.where("who = 'a'").select("who", "start_us", "end_us")).collect()


def test_text_functions_in_sql(spark):
    hooks.register_functions(spark)
    texts = ["Hello, World-wide 1,250.50!", "it's twenty one", "E-409 é ÜBER", "3.0 and 4.", "1,25 .5", "", None, "a.b-c", "ninety-nine"]
    df = spark.createDataFrame([(t, q) for t in texts for q in ("1250.5", "hello world", "e409", "20", "")], "t string, q string")
    mine = df.select("t", "q", text.normalise_words(F.col("t")).alias("w"), text.phrase_match(text.normalise_words(F.col("t")), text.normalise_words(F.col("q"))).alias("m"))
    theirs = spark.sql("SELECT t, q, normalise_words(t) AS w, phrase_match(normalise_words(t), normalise_words(q)) AS m FROM {df}", df=df)
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, theirs.collect()))
    blocks = spark.range(50).selectExpr("id", "transform(sequence(0, 63), i -> CAST((i * 37 + id * i) % 41 AS INT)) AS b")
    mine = blocks.select(visual.difference_hash(F.col("b")).alias("h")).select("h", visual.hash_distance(F.col("h"), F.lit(12345)).alias("d"))
    theirs = spark.sql("SELECT difference_hash(b) AS h, hash_distance(difference_hash(b), 12345L) AS d FROM {blocks}", blocks=blocks)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))


def restored(dropped, kept):
    """By lists of half-open spans of one recording, a microsecond being a hundredth of a second: ordinals that are restored."""
    tolerance, out = seams.HOLE_US // 10_000, set()
    covered = {t for a, b, _ in kept for t in range(a, b)}
    every = {t for a, b, _ in kept + dropped for t in range(a, b)}

    def gaps(of):
        found, run = [], []
        for t in sorted(of) + [10**9]:
            if run and t != run[-1] + 1:
                found.append((run[0], run[-1] + 1))
                run = []
            run.append(t)
        return found

    for lo, hi in gaps(every - covered):
        if hi - lo <= tolerance:
            continue
        near = sorted((max(lo, a) - min(hi, b), a, b, i) for a, b, i in dropped if a < hi and lo < b and i not in out)
        for _, a, b, i in near:
            wide = [g for g in gaps(set(range(lo, hi)) - covered) if g[1] - g[0] > tolerance]
            if not wide:
                break
            if any(a < y and x < b for x, y in wide):
                out.add(i)
                covered |= set(range(a, b))
    return out


def run_restored(spark, recordings):
    unit, schema = 10_000, "recording_id long, ordinal long, start_us long, end_us long, text string"
    make = lambda side: spark.createDataFrame([(rec, i, a * unit, b * unit, "t") for rec, x in recordings.items() for a, b, i in x[side]], schema)
    dropped, kept = make(0), make(1)
    got = seams.restore_lost(dropped, seams.holes(dropped.unionByName(kept), kept)).collect()
    return {rec: {r["ordinal"] for r in got if r["recording_id"] == rec} for rec in recordings}


def test_restoring_goes_by_the_first_overlap(spark):
    recordings = {
        # a hole of ten seconds: all three come back, the middle one although the others leave less than it gave
        1: ([(0, 600, 1), (300, 840, 2), (590, 1000, 3)], [(1000, 1100, 9)]),
        # what an earlier one made needless stays out; a segment over two holes covers both
        2: ([(0, 400, 1), (100, 300, 2), (350, 900, 3), (700, 800, 4)], [(400, 500, 9), (1000, 1100, 10)]),
        3: ([(0, 40, 1)], [(50, 60, 9)]),
        2**53 + 1: ([(0, 100, 2**53 + 3)], [(200, 300, 2**53 + 5)]),
    }
    got = run_restored(spark, recordings)
    assert got == {rec: restored(*x) for rec, x in recordings.items()}
    assert got[1] == {1, 2, 3} and got[3] == set() and got[2**53 + 1] == {2**53 + 3}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_restoring_random_segments(spark, seed):
    r = random.Random(seed)
    recordings = {}
    for rec in range(40):
        spans = [(a := r.randrange(0, 3000), a + r.randrange(10, 500), i) for i in range(r.randrange(1, 25))]
        kept = [s for s in spans if r.random() < 0.4]
        recordings[rec] = ([s for s in spans if s not in kept], kept)
    assert run_restored(spark, recordings) == {rec: restored(*x) for rec, x in recordings.items()}
