"""Evaluation: word errors, recall of candidates, latencies, trials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: scores this near are equal.
MARGIN = 0.10


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """``struct<substitutions, deletions, insertions, words>`` of two word arrays: an alignment with the fewest edits. A null array has no words."""

    @F.pandas_udf("substitutions long, deletions long, insertions long, words long")
    def edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for refs, hyps in pairs:
            yield pd.DataFrame([aligned([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(refs, hyps, strict=True)], columns=["substitutions", "deletions", "insertions", "words"])

    return edits(reference, hypothesis)


def aligned(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """Substitutions, deletions and insertions of a cheapest alignment, and the reference's words."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64) for words in (reference, hypothesis))
    place = np.arange(len(b) + 1)
    rows = [place.copy()]
    for i, word in enumerate(a):
        best = np.minimum(rows[-1][:-1] + (b != word), rows[-1][1:] + 1)
        row = np.concatenate(([i + 1], best))
        rows.append(np.minimum.accumulate(row - place) + place)  # insertions run to the right
    i, j, found = len(a), len(b), [0, 0, 0]
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            found[0] += int(a[i - 1] != b[j - 1])
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            found[1] += 1
            i -= 1
        else:
            found[2] += 1
            j -= 1
    return found[0], found[1], found[2], len(a)


def pooled_word_error_rate(edits: DataFrame, level: str) -> DataFrame:
    """level (null: all), errors, words, rate_bp: counts are summed, rates never averaged; without words the rate is 0, or 10,000 with errors."""
    rows = edits.rollup(level).agg(F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"), F.sum("words").alias("words"))
    return rows.withColumn("rate_bp", F.expr("CASE WHEN words > 0 THEN errors * 10000 div words WHEN errors > 0 THEN 10000L ELSE 0L END"))


def candidate_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """recording_id, event_id, kind, hit_us, error_us for each event: the first candidate in its window and how far it is from the start."""
    from tracewell.operators.spans import overlap_join

    points = candidates.select("recording_id", F.col("representative_us").alias("start_us"), (F.col("representative_us") + 1).alias("end_us"))
    met = overlap_join(truth.select("recording_id", "event_id", "start_us", "end_us"), points, ["recording_id"]).groupBy("recording_id", "event_id").agg(F.min("r_start_us").alias("hit_us"))
    rows = truth.join(met, ["recording_id", "event_id"], "left")
    return rows.select("recording_id", "event_id", "kind", "hit_us", (F.col("hit_us") - F.col("start_us")).alias("error_us"))


def recall_by_kind(events: DataFrame) -> DataFrame:
    """kind (null: all), events, hits, recall_bp."""
    rows = events.rollup("kind").agg(F.count(F.lit(1)).alias("events"), F.count("hit_us").alias("hits"))
    return rows.withColumn("recall_bp", F.expr("hits * 10000 div events"))


def latency_summary(readings: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """keys, readings, median, p90, total: p90 is the reading at place round(0.9 * (n - 1)), the median the mean of the middle ones.

    Equal readings are counted first, and the different ones are ranked by running counts,
    so a task holds a key's different values, however many readings there are.
    """
    values = readings.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.sum(value).alias("__sum"))
    by = Window.partitionBy(*keys)
    until = F.sum("__c").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = values.withColumn("__until", until).withColumn("__n", F.sum("__c").over(by))
    at = lambda place: F.expr(f"{place} >= __until - __c AND {place} < __until")
    middle = at("(__n - 1) div 2") | at("__n div 2")
    return rows.groupBy(*keys).agg(
        F.sum("__c").alias("readings"), F.avg(F.when(middle, F.col(value))).alias("median"),
        F.max(F.when(at("(18 * (__n - 1) + 10) div 20"), F.col(value))).alias("p90"), F.sum("__sum").alias("total"),
    )


def trial_cells(grades: DataFrame) -> DataFrame:
    """task_id, arm, runs, graded, score, wrong: means of a task and arm; the score only where every run has one."""
    rows = grades.groupBy("task_id", "arm").agg(F.count(F.lit(1)).alias("runs"), F.count("score").alias("graded"), F.sum("score").alias("__score"), F.sum("wrong").alias("wrong"))
    return rows.withColumn("score", F.when(F.col("graded") == F.col("runs"), F.col("__score") / F.col("runs"))).drop("__score")


def compare_arms(cells: DataFrame, arm: str, baseline: str) -> DataFrame:
    """task_id, verdict of an arm against the baseline: ``equal_or_better`` within the margin and without more wrong runs, ``loss`` else, null where a score is missing."""
    side = lambda name, mark: cells.where(F.col("arm") == name).select("task_id", F.col("score").alias(f"{mark}_score"), (F.col("wrong") / F.col("runs")).alias(f"{mark}_wrong"))
    rows = side(arm, "a").join(side(baseline, "b"), "task_id")
    good = (F.col("a_score") >= F.col("b_score") - MARGIN) & (F.col("a_wrong") <= F.col("b_wrong"))
    return rows.select("task_id", F.when(good, "equal_or_better").when(good.isNotNull(), "loss").alias("verdict"))


def gate_lines(grades: DataFrame, least_bp: int) -> DataFrame:
    """arm, rate_bp, gate: ``met``, ``not_met`` or ``no_data`` of the share of good runs."""
    rows = grades.groupBy("arm").agg(F.count("score").alias("n"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("good"))
    rows = rows.withColumn("rate_bp", F.expr("good * 10000 div nullif(n, 0)"))
    return rows.select("arm", "rate_bp", F.when(F.col("n") == 0, "no_data").when(F.col("rate_bp") >= least_bp, "met").otherwise("not_met").alias("gate"))


def estimate_errors(progress: DataFrame, points: tuple[int, ...] = (10, 25, 50, 75)) -> DataFrame:
    """job_id, point, at_us, error_us: at the first sample of each percentage, the estimate against the time that was left."""
    ends = progress.groupBy("job_id").agg(F.max("at_us").alias("end_us"))
    rows = progress.join(ends, "job_id").withColumn("point", F.explode(F.array(*[F.lit(p) for p in points]))).where(F.col("percent") >= F.col("point"))
    first = rows.groupBy("job_id", "point").agg(F.min(F.struct("at_us", "remaining_us", "end_us")).alias("s"))
    return first.select("job_id", "point", "s.at_us", (F.col("s.remaining_us") - (F.col("s.end_us") - F.col("s.at_us"))).alias("error_us"))


def monotonic_growth(samples: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """keys, peak, grows: after a quarter of warm-up, the maxima of four equal parts each rise by over 2% and by over 20% in all."""
    by = Window.partitionBy(*keys)
    rows = samples.withColumn("__i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__skip", F.expr("__n div 4"))
    part = F.expr("IF(__i < __skip, NULL, ((__i - __skip) * 4) div (__n - __skip))")
    peaks = rows.withColumn("__part", part).groupBy(*keys).agg(F.max(value).alias("peak"), *[F.max(F.when(F.col("__part") == p, F.col(value))).alias(f"__p{p}") for p in range(4)])
    rises = (F.col("__p1") > F.col("__p0") * 1.02) & (F.col("__p2") > F.col("__p1") * 1.02) & (F.col("__p3") > F.col("__p2") * 1.02) & (F.col("__p3") > F.col("__p0") * 1.2)
    return peaks.select(*keys, "peak", F.coalesce(rises, F.lit(False)).alias("grows"))
