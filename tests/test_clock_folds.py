"""Folds over ordered rows: exact values, excursions and turns of clocks against brute force."""

import random

import pytest

from tracewell.operators import clock_sets, clocks
from tracewell.operators.folds import ordered_fold

RUNS = "recording_id long, run long, reads long, advances boolean, low_us long, high_us long"


def brute(runs, depth=0):
    """run -> (part, depth, head), with lists: runs are (run, reads, advances, low, high)."""
    out, rest, turns = {}, list(runs), []
    while rest:
        first, reads, _, low, high = rest.pop(0)
        out[first] = ("other_clock" if depth else "main", depth, first)
        while True:
            later = next((i for i, r in enumerate(rest) if max(low, r[3]) < min(high, r[4]) and max(reads, r[1]) >= 3), None)
            if later is None:
                break
            stretch, met, rest = rest[:later], rest[later], rest[later + 1 :]
            if any(r[1] >= 3 and r[2] for r in stretch):
                turns += stretch
            else:
                out |= {r[0]: ("excursion", depth, first) for r in stretch}
            low, high, reads = max(low, met[3]), min(high, met[4]), reads + met[1]
            out[met[0]] = ("other_clock" if depth else "main", depth, first)
    return out | (brute(turns, depth + 1) if turns else {})


def folded(spark, recordings):
    rows = [(rec, *r) for rec, runs in recordings.items() for r in runs]
    got = clock_sets.fold_excursions(spark.createDataFrame(rows, RUNS)).collect()
    return {rec: {r["run"]: (r["part"], r["depth"], r["head"]) for r in got if r["recording_id"] == rec} for rec in recordings}


def test_runs_that_leave_and_return(spark):
    run = lambda i, low, high, reads=5, advances=True: (i, reads, advances, low, high)
    recordings = {
        # left for two runs at once, and a clock that is left inside another's turn
        1: [run(0, 0, 10), run(1, 50, 60), run(2, 80, 90), run(3, 0, 10)],
        2: [run(0, 0, 10), run(1, 50, 60), run(2, 80, 90, 1), run(3, 50, 60), run(4, 5, 15), run(5, 9, 12)],
        3: [run(0, 0, 10), run(1, 50, 60, 5, False), run(2, 0, 10)],
        # two stray reads don't swallow the clock between them
        4: [run(0, 0, 10, 1), run(1, 50, 60), run(2, 0, 10, 1)],
        # the offset narrows: what met the first run doesn't meet both
        5: [run(0, 0, 10), run(1, 8, 20), run(2, 0, 8), run(3, 50, 60)],
        None: [run(2**53 + 1, 0, 10), run(2**53 + 2, 0, 10)],
    }
    got = folded(spark, recordings)
    assert got == {rec: brute(runs) for rec, runs in recordings.items()}
    assert got[1] == {0: ("main", 0, 0), 1: ("other_clock", 1, 1), 2: ("other_clock", 1, 2), 3: ("main", 0, 0)}
    assert got[2] == {0: ("main", 0, 0), 1: ("other_clock", 1, 1), 2: ("excursion", 1, 1), 3: ("other_clock", 1, 1), 4: ("main", 0, 0), 5: ("main", 0, 0)}
    assert got[3][1] == ("excursion", 0, 0) and got[4][1] == ("main", 0, 1) and got[5][2] == ("main", 0, 2)
    assert got[None][2**53 + 2] == ("main", 0, 2**53 + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_runs_fold_as_lists_do(spark, seed):
    r = random.Random(seed)
    recordings = {}
    for rec in range(60):
        lows = [r.randrange(0, 60) for _ in range(r.randint(1, 5))]
        recordings[rec] = [(i * 3, r.randint(0, 5), r.random() < 0.7, low := r.choice(lows) + r.randint(0, 3), low + r.randint(1, 6)) for i in range(r.randint(1, 120))]
    got = folded(spark, recordings)
    assert got == {rec: brute(runs) for rec, runs in recordings.items()}
    assert max(d for x in got.values() for _, d, _ in x.values()) >= 2


def test_nulls_and_large_ids_in_a_fold(spark):
    big = 2**53 + 1
    rows = [(big, 1, "x"), (big, None, "y"), (None, 3, None), (None, 1, "z"), (big + 1, 5, "w"), (big, 1, "x")]
    df = spark.createDataFrame(rows, "key long, at long, it string")

    def step(state, row):
        if row is None:
            return None, [state]
        key, n, seen = state or (row.key, 0, "")
        return (key, n + 1, f"{seen}{row.at},"), []

    got = {(r["key"], r["n"], r["seen"]) for r in ordered_fold(df.repartition(1), ["key"], ["at"], step, "key long, n long, seen string").collect()}
    assert got == {(big, 3, "None,1,1,"), (None, 2, "1,3,"), (big + 1, 1, "5,")}
    assert ordered_fold(df.where("false"), ["key"], ["at"], step, "key long, n long, seen string").count() == 0


def test_clock_runs_of_null_and_large_recordings(spark):
    second = 1_000_000
    rows = [(rec, t * second, 36_000 * second + t * second, second) for rec in (None, 2**53 + 1, 2**53 + 2) for t in range(4)]
    reads = spark.createDataFrame([*rows, (2**53 + 1, 9 * second, None, second), (2**53 + 2, None, 0, second), (7, 0, 5, second), (7, 500_000, 5, second)], "recording_id long, time_us long, value_us long, unit_us long")
    got = sorted(((r["recording_id"] or 0, r["run"], r["reads"], r["advances"]) for r in clocks.clock_runs(reads).collect()))
    assert got == [(0, 0, 4, True), (7, 0, 2, False), (2**53 + 1, 0, 4, True), (2**53 + 2, 0, 4, True)]
