"""Diarisation error and the map of speakers, against a grid of 10 ms."""

import itertools
import random

import pytest

from tracewell.operators import more, readings

FRAME = 10_000


def on_grid(reference, hypothesis, unscored, collar, frames=700):
    """speech, missed, false, confused (frames) under the best map, by counting frames; turns are (speaker, from, to)."""
    on = lambda turns: {s: {t for x, a, b in turns if x == s for t in range(a, b)} for s in sorted({x for x, _, _ in turns})}
    ref, hyp = on(reference), on(hypothesis)
    hidden = {t for _, a, b in reference for e in (a, b) for t in range(e - collar, e + collar)} | {t for a, b in unscored for t in range(a, b)}
    scored = set(range(frames)) - hidden
    shared = {(r, h): len(ref[r] & hyp[h] & scored) for r in ref for h in hyp}
    wide = [*hyp, *[None] * len(ref)]
    best = max((dict(zip(ref, p, strict=False)) for p in itertools.permutations(wide, len(ref))), key=lambda m: sum(shared.get((r, h), 0) for r, h in m.items()))
    out = [0, 0, 0, 0]
    for t in scored:
        n, k = sum(t in x for x in ref.values()), sum(t in x for x in hyp.values())
        right = sum(t in ref[r] and h is not None and t in hyp[h] for r, h in best.items())
        out = [a + b for a, b in zip(out, (n, max(0, n - k), max(0, k - n), min(n, k) - right), strict=True)]
    return tuple(out), sum(shared.get((r, h), 0) for r, h in best.items()), shared


@pytest.mark.parametrize("collar", [0, 5, 25])
def test_error_and_map_on_scored_time(spark, collar):
    r = random.Random(collar)
    recordings = {}
    for rec in range(15):
        turns = lambda names, n: [(r.choice(names), a := r.randrange(0, 550), a + r.randrange(20, 150)) for _ in range(n)]
        recordings[rec] = (turns("abc"[: 1 + rec % 3], r.randrange(1, 8)), turns("xyz", r.randrange(1, 8)), [(a := r.randrange(600), a + r.randrange(1, 100)) for _ in range(rec % 3)])
    table = lambda side, name: spark.createDataFrame([(rec, s, a * FRAME, b * FRAME) for rec, x in recordings.items() for s, a, b in x[side]], f"recording_id long, {name} string, start_us long, end_us long")
    unscored = spark.createDataFrame([(rec, a * FRAME, b * FRAME) for rec, x in recordings.items() for a, b in x[2]], "recording_id long, start_us long, end_us long")
    reference, hypothesis = table(0, "ref"), table(1, "hyp")
    pairs = readings.best_map(reference, hypothesis, collar * FRAME, unscored)
    chosen = pairs.collect()
    got = {x["recording_id"]: tuple(x[c] // FRAME for c in ("speech_us", "missed_us", "false_us", "confused_us")) for x in more.diarization_error(reference, hypothesis, pairs, collar * FRAME, unscored).collect()}
    for rec, x in recordings.items():
        want, best, shared = on_grid(*x, collar)
        mine = sum(shared[p["ref"], p["hyp"]] for p in chosen if p["recording_id"] == rec)
        assert mine == best
        assert got.get(rec, (0, 0, 0, 0)) == want
