"""Smaller operators: quarantine flags, plans of reads, progress of streams, budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.speakers import speaking, unscored_time
from tracewell.operators.spans import merge_spans, overlap_join, span_intersect, span_subtract
from tracewell.sources.shared import parts

#: The earliest plausible recording, how long after now, and the latitude of a reading without a zone.
EARLIEST_US, LATER_US, ZONELESS_US = 788_918_400_000_000, 86_400_000_000, 14 * 3_600_000_000
#: Fixed value: time on either side of a true boundary that doesn't count.
COLLAR_US = 250_000
#: Turns that are dealt to one task.
DEALT = 100_000


def plausible_time(reading: str, now_us: int) -> Column:
    """Whether a reading struct (utc_us, local_us) lies between 1995 and a day from now; without a zone with 14 hours' latitude."""
    value = F.coalesce(F.col(f"{reading}.utc_us"), F.col(f"{reading}.local_us"))
    slack = F.when(F.col(f"{reading}.utc_us").isNull(), ZONELESS_US).otherwise(0)
    return F.coalesce((value >= F.lit(EARLIEST_US) - slack) & (value <= F.lit(now_us + LATER_US) + slack), F.lit(False))


def closed_vocabulary(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """``df`` with the allowed spelling in ``column`` where letter case alone differs, and ``noted``: whether it did; null if not allowed."""
    table = F.create_map(*[F.lit(x) for a in allowed for x in (a.lower(), a)])
    spelled = F.try_element_at(table, F.lower(column))
    return df.withColumn("noted", spelled.isNotNull() & (spelled != F.col(column))).withColumn(column, spelled)


def warning_summary(flags: DataFrame) -> DataFrame:
    """recording_id, kind, count, first_ordinal of flags (recording_id, kind, ordinal)."""
    return flags.groupBy("recording_id", "kind").agg(F.count(F.lit(1)).alias("count"), F.min("ordinal").alias("first_ordinal"))


def read_plan(candidates: DataFrame, analysed: DataFrame, period_us: int) -> DataFrame:
    """recording_id, time_us, candidate: times to read, those of candidates and every multiple of the period in analysed ranges; one row for a time."""
    first = F.expr(f"((start_us + {period_us - 1}) div {period_us}) * {period_us}")
    grid = analysed.withColumn("f", first).where("f < end_us").select("recording_id", F.explode(F.sequence("f", F.col("end_us") - 1, F.lit(period_us).cast("long"))).alias("time_us"), F.lit(False).alias("candidate"))
    both = candidates.select("recording_id", "time_us", F.lit(True).alias("candidate")).unionByName(grid)
    return both.groupBy("recording_id", "time_us").agg(F.bool_or("candidate").alias("candidate"))


def pending_targets(plan: DataFrame, done: DataFrame, engine: str) -> DataFrame:
    """Planned reads that this engine hasn't tried."""
    return plan.join(done.where(F.col("engine") == engine), ["recording_id", "time_us"], "left_anti")


def screen_text_coverage(plan: DataFrame, done: DataFrame) -> DataFrame:
    """recording_id, planned, read, failed, pending, complete of planned reads and tried ones (outcome ``read`` or ``failed``)."""
    met = plan.join(done.select("recording_id", "time_us", "outcome"), ["recording_id", "time_us"], "left").groupBy("recording_id")
    rows = met.agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("outcome") == "read").alias("read"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome").isNull()).alias("pending"))
    return rows.withColumn("complete", (F.col("pending") == 0) & (F.col("failed") == 0))


def merge_screen_text(old: DataFrame, new: DataFrame) -> DataFrame:
    """recording_id, pts, outcome, targets: frames of both; a known one only gains targets."""
    met = old.join(new.select("recording_id", "pts", F.col("outcome").alias("__o"), F.col("targets").alias("__t")), ["recording_id", "pts"], "full")
    return met.select("recording_id", "pts", F.coalesce("outcome", "__o").alias("outcome"), F.array_sort(F.array_union(F.coalesce("targets", F.array().cast("array<bigint>")), F.coalesce("__t", F.array().cast("array<bigint>")))).alias("targets"))


def bundle_counts(bundles: DataFrame) -> DataFrame:
    """found, searched, unavailable, duplicates over bundles (manifest_sha256, bundle_rank, readable): of one manifest the first is searched."""
    first = F.row_number().over(Window.partitionBy("manifest_sha256").orderBy("bundle_rank")) == 1
    rows = bundles.withColumn("first", first)
    return rows.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("first") & F.col("readable")).alias("searched"), F.count_if(F.col("first") & ~F.col("readable")).alias("unavailable"), F.count_if(~F.col("first")).alias("duplicates"))


def budget_overruns(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """task_id, measure, used, allowed where a task's calls (task_id, profile, step, tokens, images) pass its profile's limits; images count by the largest step."""
    steps = calls.groupBy("task_id", "profile", "step").agg(F.sum("tokens").alias("tokens"), F.sum("images").alias("images"))
    tasks = steps.groupBy("task_id", "profile").agg(F.sum("tokens").alias("tokens"), F.max("images").alias("images"))
    met = tasks.join(F.broadcast(limits), "profile")  # limits: a row for each named profile
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("used"), F.col(f"max_{m}").alias("allowed")) for m in ("tokens", "images")]))
    return met.select("task_id", each.alias("e")).select("task_id", "e.*").where("used > allowed")


def stream_statuses(progress: DataFrame) -> DataFrame:
    """job_id, stream, state, done, total: the latest progress of each stream."""
    last = F.max_by(F.struct("state", "done", "total"), F.struct("ts", "event_id"))
    return progress.groupBy("job_id", "stream").agg(last.alias("l")).select("job_id", "stream", "l.*")


def carried_untranscribed(untranscribed: DataFrame, replaced: DataFrame, inherited: DataFrame) -> DataFrame:
    """Untranscribed parts outside the replaced ranges that inherited provenance would claim."""
    return span_intersect(span_subtract(untranscribed, replaced, ["recording_id"]), inherited, ["recording_id"])


def labelled_changes(labels: DataFrame, changes: DataFrame, slack_us: int = 500_000) -> DataFrame:
    """recording_id, label_id, bracketed: labels (at_us) inside a change window widened by the slack."""
    points = labels.select("recording_id", "label_id", F.col("at_us").alias("start_us"), (F.col("at_us") + 1).alias("end_us"))
    wide = merge_spans(changes.select("recording_id", (F.col("start_us") - slack_us).alias("start_us"), (F.col("end_us") + slack_us).alias("end_us")), ["recording_id"])
    hit = overlap_join(points, wide, ["recording_id"]).select("recording_id", "label_id").distinct().withColumn("bracketed", F.lit(True))
    return labels.select("recording_id", "label_id").join(hit, ["recording_id", "label_id"], "left").withColumn("bracketed", F.coalesce("bracketed", F.lit(False)))


def rollover_brackets(reads: DataFrame, unit_us: int, wide_us: int = 500_000) -> DataFrame:
    """recording_id, from_us, to_us, read_next_us: reads that follow one another and whose value grows by one unit; a wide one names its middle to read next."""
    order = Window.partitionBy("recording_id").orderBy("time_us")
    rows = reads.withColumn("from_us", F.lag("time_us").over(order)).withColumn("was", F.lag("value_us").over(order)).where(F.col("value_us") - F.col("was") == unit_us)
    middle = F.when(F.col("time_us") - F.col("from_us") > wide_us, F.expr("(from_us + time_us) div 2"))
    return rows.select("recording_id", "from_us", F.col("time_us").alias("to_us"), middle.alias("read_next_us"))


def diarization_error(reference: DataFrame, hypothesis: DataFrame, pairs: DataFrame, collar_us: int = COLLAR_US, unscored: DataFrame | None = None) -> DataFrame:
    """recording_id, speech_us, missed_us, false_us, confused_us under a map (recording_id, ref, hyp) of speakers.

    A speaker counts once at any time. Time within ``collar_us`` of the end of a turn
    of the reference, and in the ranges ``unscored`` (recording_id, start_us, end_us),
    doesn't count.

    One sweep over the boundaries of both sides says how many voices are open on
    each side and how many of them agree, between one boundary and the next.
    Recordings are dealt to more tasks as turns grow.
    """
    key = ["recording_id"]
    n = parts(reference.sparkSession, reference.count() + hypothesis.count(), DEALT)
    reference, hypothesis = reference.repartition(n, *key), hypothesis.repartition(n, *key)
    masked = unscored_time(reference, collar_us, unscored)
    reference, hypothesis = speaking(reference, "ref"), speaking(hypothesis, "hyp")
    agree = overlap_join(reference, hypothesis, key, parts=n).join(pairs, ["recording_id", "ref", "hyp"])
    both = agree.select("recording_id", F.greatest("start_us", "r_start_us").alias("start_us"), F.least("end_us", "r_end_us").alias("end_us"))

    def edges(df: DataFrame, name: str) -> DataFrame:
        step = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("s")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("s"))))
        return df.select("recording_id", step.alias("e")).select("recording_id", "e.t", *[(F.col("e.s") if n == name else F.lit(0)).alias(n) for n in ("r", "h", "c", "m")])

    every = edges(reference, "r").unionByName(edges(hypothesis, "h")).unionByName(edges(both, "c")).unionByName(edges(masked, "m")).repartition(n, *key)
    steps = every.groupBy("recording_id", "t").agg(*[F.sum(n).alias(n) for n in ("r", "h", "c", "m")])
    order = Window.partitionBy("recording_id").orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select("recording_id", (F.lead("t").over(order) - F.col("t")).alias("us"), *[F.sum(n).over(upto).alias(n) for n in ("r", "h", "c", "m")]).where("us IS NOT NULL AND m = 0")
    total = lambda x: F.sum(F.expr(x) * F.col("us"))
    return rows.groupBy("recording_id").agg(total("r").alias("speech_us"), total("greatest(0, r - h)").alias("missed_us"), total("greatest(0, h - r)").alias("false_us"), total("least(r, h) - c").alias("confused_us"))


def changed_tiles(before: DataFrame, after: DataFrame, least_step: int = 32, least_pixels: int = 4) -> DataFrame:
    """change_id, tile_x, tile_y, changed_pixels: 16-pixel tiles of two frames' pixels (change_id, x, y, value) with four changed pixels or more."""
    met = before.withColumnRenamed("value", "__v").join(after, ["change_id", "x", "y"])
    tiles = met.where(F.abs(F.col("value") - F.col("__v")) >= least_step).groupBy("change_id", F.expr("x div 16").alias("tile_x"), F.expr("y div 16").alias("tile_y"))
    return tiles.agg(F.count(F.lit(1)).alias("changed_pixels")).where(F.col("changed_pixels") >= least_pixels)


def change_regions(tiles: DataFrame, width: int, height: int, reach: int = 2, side: int = 16) -> DataFrame:
    """change_id, x, y, width, height, changed_pixels: changed tiles at most ``reach`` apart joined, as rectangles clipped to the frame.

    A frame's grid bounds the tiles of a change; tiles outside the frame are left out.
    """
    box = "array<struct<x: int, y: int, width: int, height: int, changed_pixels: bigint>>"
    # a row of the grid is so wide that no tile reaches the next one's, nor a change the next change's
    wide, high = -(-width // side) + reach, -(-height // side) + reach

    @F.pandas_udf(box)
    def joined(changes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in changes:
            yield _regions(batch) if len(batch) else batch

    def _regions(batch: pd.Series) -> pd.Series:
        """The regions of all changes of a batch at once."""
        change = np.repeat(np.arange(len(batch)), [len(t) for t in batch])
        x, y, n = np.array([(t["x"], t["y"], t["n"]) for tiles in batch for t in tiles], dtype=np.int64).reshape(-1, 3).T
        place = (change * high + y) * wide + x
        order = np.argsort(place, kind="stable")
        change, x, y, n, place = change[order], x[order], y[order], n[order], place[order]
        # neighbours by their places in the grid, those before a tile alone, as each pair is met once
        steps = [dy * wide + dx for dy in range(reach + 1) for dx in range(-reach, reach + 1) if (dy, dx) > (0, 0)]
        found = [np.minimum(np.searchsorted(place, place + step), len(place) - 1) for step in steps]
        pairs = [(np.flatnonzero(place[at] == place + step), at) for step, at in zip(steps, found, strict=True)]
        a, b = np.concatenate([p for p, _ in pairs]), np.concatenate([at[p] for p, at in pairs])
        # the least mark of two neighbours is taken on by the marks that both have, until none changes
        marks = np.arange(len(place))
        while (marks[a] != marks[b]).any():
            least = np.minimum(marks[a], marks[b])
            np.minimum.at(marks, marks[a], least)
            np.minimum.at(marks, marks[b], least)
            while (marks[marks] != marks).any():
                marks = marks[marks]
        own, region = np.unique(marks, return_inverse=True)
        ends = lambda of, values: of.reduceat(values[by], first)
        by = np.argsort(region, kind="stable")
        first = np.searchsorted(region[by], np.arange(len(own)))
        left, top = ends(np.minimum, x) * side, ends(np.minimum, y) * side
        right, under = np.minimum(ends(np.maximum, x) * side + side, width), np.minimum(ends(np.maximum, y) * side + side, height)
        columns = (left, top, right - left, under - top, ends(np.add, n))
        boxes = [dict(zip(("x", "y", "width", "height", "changed_pixels"), row, strict=True)) for row in zip(*(c.tolist() for c in columns), strict=True)]
        at = np.searchsorted(change[own], np.arange(len(batch) + 1))
        return pd.Series([boxes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], dtype=object)

    inside = tiles.where((F.col("tile_x") >= 0) & (F.col("tile_y") >= 0) & (F.col("tile_x") * side < width) & (F.col("tile_y") * side < height))
    grids = inside.groupBy("change_id").agg(F.collect_list(F.struct(F.col("tile_x").cast("long").alias("x"), F.col("tile_y").cast("long").alias("y"), F.col("changed_pixels").cast("long").alias("n"))).alias("tiles"))
    return grids.select("change_id", F.explode(joined("tiles")).alias("r")).select("change_id", "r.*")
