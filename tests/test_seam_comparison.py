"""Losses at seams: what is one, what the recogniser explains, and what lies away from any seam."""

from tracewell.operators import compare
from tracewell.operators.seams import seam_spans
from tracewell.operators.speech import plan_chunks

SECOND = 1_000_000
COLUMNS = "recording_id long, ordinal long, start_us long, end_us long, text string"


def speech(spark, **changed):
    """Five minutes of sentences of five seconds; ``changed`` gives another text (None: nothing) to the one that starts at that second."""
    rows = [(1, n, n * 5 * SECOND, (n + 1) * 5 * SECOND, changed.get(f"at{n * 5}", " ".join(f"word{n}x{i}" for i in range(10)))) for n in range(60)]
    return spark.createDataFrame([r for r in rows if r[4] is not None], COLUMNS)


def compared(spark, subject, reference):
    ranges = spark.createDataFrame([(1, 0, 300 * SECOND)], "recording_id long, start_us long, end_us long")
    # chunks of thirty seconds, of which five overlap: the second seam is from 50 to 55 s
    seams = seam_spans(plan_chunks(ranges, 30 * SECOND, 5 * SECOND), 0)
    (row,) = compare.seam_comparison(subject, reference, seams, ranges).collect()
    words = compare.stretch_words(reference, subject, compare.seams_inside(seams, ranges))
    return row, [(r["start_us"] // SECOND, r["words"], r["kind"]) for r in compare.seam_losses(words, subject).collect()]


def test_what_is_lost_at_a_seam(spark):
    row, losses = compared(spark, speech(spark), speech(spark))
    assert row["seam_words"] == row["seam_found"] > 0 and row["control_words"] == row["control_found"] and row["controls"] >= 5 and not row["finding"] and losses == []
    row, losses = compared(spark, speech(spark, at50=None), speech(spark))
    assert (losses, row["longest_loss"], row["explained"], row["finding"]) == ([(50, 10, "loss")], 10, 0, True)


def test_the_same_loss_away_from_seams_is_none(spark):
    row, losses = compared(spark, speech(spark, at40=None), speech(spark))
    assert row["seam_words"] == row["seam_found"] and row["control_found"] < row["control_words"] and losses == [] and not row["finding"]


def test_what_the_recogniser_explains(spark):
    loop = speech(spark, at50="we are going to go over here " * 3)
    row, losses = compared(spark, speech(spark, at50=None), loop)
    assert losses == [(50, 21, "repetition")] and row["explained"] == 21 and not row["finding"]
    flipped = speech(spark, at50="я уверен что всё будет хорошо и мы увидимся снова")
    row, losses = compared(spark, flipped, speech(spark))
    assert losses == [(50, 10, "script")] and row["explained"] == 10 and not row["finding"]
