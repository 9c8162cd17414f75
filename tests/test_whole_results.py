"""Whole results of queries that SQL can't express, by brute force."""

import functools
import random

from tracewell.operators import clocks, listing
from tracewell.plans import speech_queries
from tracewell.plans.registry import QUERIES


def test_word_errors_of_whole_tables(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), None if r.random() < 0.1 else " ".join(r.choice("abcd") for _ in range(r.randrange(0, 9)))) for c in range(12) for t in range(6)]
    got = {x["role"]: (x["errors"], x["words"], x["rate_bp"]) for x in speech_queries.agg19_word_error_rate(spark.createDataFrame([x for x in rows if x[2]], "conv_id long, turn long, role string, text string")).collect()}

    @functools.cache
    def edits(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))

    want = {}
    kept = [x for x in rows if x[2]]
    for (c0, _, _, before), (c1, _, role, text) in zip(kept, kept[1:], strict=False):
        if c0 == c1 and before is not None:
            for key in (role, None):
                errors, words = want.get(key, (0, 0))
                want[key] = (errors + edits(tuple(before.split()), tuple((text or "").split())), words + len(before.split()))
    assert {k: v[:2] for k, v in got.items()} == want and all(v[2] == 10_000 * v[0] // v[1] for v in got.values())


def test_screen_changes_as_lines_and_text(spark):
    r = random.Random(6)
    rows = [(rec, r.choice(["change", "motion"]), r.randrange(10_000) * 1_000_000) for rec in range(5) for _ in range(rec * 7)]
    changes = spark.createDataFrame(rows, "recording_id long, kind string, after_us long")
    clock = lambda us: f"{us // 3_600_000_000:02d}:{us // 60_000_000 % 60:02d}:{us // 1_000_000 % 60:02d}"
    want = {}
    for rec, kind, us in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        want.setdefault(rec, []).append(f"[{clock(us)}] {kind}")
    lines = listing.screen_changes_lines(changes).collect()
    assert {(x["recording_id"], x["place"]): x["line"] for x in lines} == {(rec, i): line for rec, each in want.items() for i, line in enumerate(each, 1)}
    assert {x["recording_id"]: x["text"] for x in listing.screen_changes_text(changes).collect()} == {rec: "\n".join([f"{len(each)} changes", *each]) for rec, each in want.items()}


def test_kinds_of_clocks(spark):
    r = random.Random(7)
    second, rows = 1_000_000, []
    for rec in range(40):
        start = r.choice([0, 1_000, 3_599, 3_600, 40_000, 86_000]) * second
        rows += [(rec, t * second, (start + t * second + r.choice([0, 0, 0, 7_000 * second])) % clocks.DAY_US, second) for t in range(0, r.randrange(2, 30), 3)]
    reads = spark.createDataFrame(rows, "recording_id long, time_us long, value_us long, unit_us long")
    runs = clocks.clock_runs(reads)
    spans = {}
    for x in runs.collect():
        spans.setdefault(x["recording_id"], []).append((x["low_us"], x["high_us"]))
    want = {}
    for rec in range(40):
        mine = [x for x in rows if x[0] == rec]
        duration = max(x[1] for x in mine) + 1
        near = any(lo <= 0 and hi > -duration for lo, hi in spans[rec])
        want[rec] = "counter" if near or any(x[2] < 3_600 * second for x in mine) else "time_of_day"
    assert {x["recording_id"]: x["kind"] for x in clocks.clock_kind(reads, runs).collect()} == want and set(want.values()) == {"counter", "time_of_day"}


def test_every_query_has_a_name_of_its_operator():
    assert all(name.split("_")[0][-1].isdigit() for name in QUERIES)
