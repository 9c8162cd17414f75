"""Screen changes: windows, sample differences, states, motion and candidates.

A sample is a row (recording_id, time_us, blocks). A window is a minute of a
recording and is worked out by itself, with the last sample up to half a second
before it; a window has at most 122 samples, two a second, so the one thing that
is carried along it, the anchor, stays small. The rest are window functions on
(recording_id, window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.folds import ordered_fold

#: Length of a window, of its cells, of the lead-in; block thresholds; candidates of a window; shortest motion run.
WINDOW_US, CELL_US, LEAD_US = 60_000_000, 10_000_000, 500_000
MIN_BLOCK_DELTA, MIN_BLOCKS, LARGE_BLOCK_DELTA = 4, 2, 6
MAX_CANDIDATES, MOTION_RUN = 32, 3


def tumbling_windows(recordings: DataFrame) -> DataFrame:
    """recording_id, ordinal, start_us, end_us: the windows of recordings (recording_id, duration_us); the last ends with the recording."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(duration_us - 1) div {WINDOW_US}")))
    rows = recordings.where("duration_us > 0").select("recording_id", "duration_us", each.alias("ordinal"))
    return rows.select("recording_id", "ordinal", (F.col("ordinal") * WINDOW_US).alias("start_us"), F.least((F.col("ordinal") + 1) * WINDOW_US, "duration_us").alias("end_us"))


def coverage_cells(windows: DataFrame) -> DataFrame:
    """recording_id, ordinal, cell, start_us, end_us: ten-second cells of windows, the last one cut."""
    each = F.explode(F.expr(f"sequence(0L, (end_us - start_us - 1) div {CELL_US})"))
    rows = windows.select("recording_id", "ordinal", F.col("start_us").alias("w"), F.col("end_us").alias("e"), each.alias("cell"))
    return rows.select("recording_id", "ordinal", "cell", (F.col("w") + F.col("cell") * CELL_US).alias("start_us"), F.least(F.col("w") + (F.col("cell") + 1) * CELL_US, "e").alias("end_us"))


def _steps(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def _delta(a: Column, b: Column) -> tuple[Column, Column]:
    steps = _steps(a, b)
    return F.size(F.filter(steps, lambda d: d >= MIN_BLOCK_DELTA)), F.array_max(steps)


def sample_deltas(samples: DataFrame) -> DataFrame:
    """Samples with changed_blocks and max_block_delta against the sample before (null for a recording's first) and is_change."""
    before = F.lag("blocks").over(Window.partitionBy("recording_id").orderBy("time_us"))
    rows = samples.withColumn("__before", before)
    changed, largest = _delta(F.col("__before"), F.col("blocks"))
    rows = rows.withColumn("changed_blocks", F.when(F.col("__before").isNotNull(), changed)).withColumn("max_block_delta", largest).drop("__before")
    return rows.withColumn("is_change", is_change(F.col("changed_blocks"), F.col("max_block_delta")))


def is_change(changed_blocks: Column, max_block_delta: Column) -> Column:
    """Two changed blocks, or one by much; false where there is nothing to compare with."""
    return F.coalesce((changed_blocks >= MIN_BLOCKS) | (max_block_delta >= LARGE_BLOCK_DELTA), F.lit(False))


def with_lead_in(samples: DataFrame) -> DataFrame:
    """Samples by window ``ordinal``; the last one up to half a second before a window is in it too, as ``lead_in``."""
    own = samples.withColumn("ordinal", F.expr(f"time_us div {WINDOW_US}")).withColumn("lead_in", F.lit(False))
    following = F.lead("time_us").over(Window.partitionBy("recording_id").orderBy("time_us"))
    crossing = own.withColumn("__next", following).where(F.expr(f"__next div {WINDOW_US} = ordinal + 1 AND (ordinal + 1) * {WINDOW_US} - time_us <= {LEAD_US}"))
    lead = crossing.drop("__next").withColumn("ordinal", F.col("ordinal") + 1).withColumn("lead_in", F.lit(True))
    return own.unionByName(lead)


def motion_runs(samples: DataFrame) -> DataFrame:
    """recording_id, ordinal, start_us, end_us, samples: runs of three or more moving samples inside a window."""
    rows = sample_deltas(samples).withColumn("ordinal", F.expr(f"time_us div {WINDOW_US}"))
    order = Window.partitionBy("recording_id", "ordinal").orderBy("time_us")
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy("recording_id", "ordinal", "is_change").orderBy("time_us"))
    runs = rows.withColumn("__run", run).where("is_change").groupBy("recording_id", "ordinal", "__run")
    return runs.agg(F.min("time_us").alias("start_us"), F.max("time_us").alias("end_us"), F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= MOTION_RUN).drop("__run")


def _window_samples(samples: DataFrame) -> DataFrame:
    """A row for each sample of each window: place (from 0), time_us, what has ``changed`` and the ``largest`` step where it differs from
    the sample before or else from the anchor (``is_new``), ``moving``, ``led`` (a sample before the window is known), ``n``.

    The anchor is the last new sample, so it is carried along the window's samples,
    which are few; only its place is held.
    """
    window = samples.groupBy("recording_id", "ordinal").agg(F.sort_array(F.collect_list(F.struct("time_us", F.col("lead_in").alias("lead"), "blocks"))).alias("s"))
    window = window.withColumn("led", F.expr("CAST(s[0].lead AS int)")).where("size(s) > led")
    figures = """transform(array(zip_with(s[{0}].blocks, s[{1}].blocks, (x, y) -> abs(x - y))), d -> named_struct('changed', size(filter(d, x -> x >= {2})), 'largest', array_max(d)))[0]"""
    moves = f"(({{0}}).changed >= {MIN_BLOCKS} OR ({{0}}).largest >= {LARGE_BLOCK_DELTA})"
    window = window.withColumn("step", F.expr(f"transform(sequence(0, size(s) - 1), i -> IF(i = 0, NULL, {figures.format('i - 1', 'i', MIN_BLOCK_DELTA)}))"))
    window = window.withColumn("moving", F.expr(f"transform(step, x -> coalesce({moves.format('x')}, false))"))
    # against the anchor, where the sample before is like this one
    slow = f"filter(array({figures.format('a.anchor', 'i', MIN_BLOCK_DELTA)}), f -> {moves.format('f')})"
    found = F.expr(f"""aggregate(sequence(led, size(s) - 1), named_struct('anchor', led, 'news', CAST(array() AS array<array<struct<changed: int, largest: int>>>)), (a, i) ->
        transform(array(IF(moving[i], array(step[i]), IF(i = led, CAST(array(NULL) AS array<struct<changed: int, largest: int>>), {slow}))),
            f -> named_struct('anchor', IF(size(f) > 0, i, a.anchor), 'news', concat(a.news, array(f))))[0], a -> a.news)""")
    each = F.posexplode(F.arrays_zip(F.expr("slice(s, led + 1, size(s))").alias("s"), F.expr("slice(moving, led + 1, size(s))").alias("moving"), found.alias("news")))
    rows = window.select("recording_id", "ordinal", F.col("led").cast("boolean").alias("led"), F.expr("size(s) - led").alias("n"), each.alias("place", "e"))
    return rows.select("recording_id", "ordinal", "led", "n", "place", "e.s.time_us", "e.moving", (F.size("e.news") > 0).alias("is_new"), F.get("e.news", F.lit(0))["changed"].alias("changed"), F.get("e.news", F.lit(0))["largest"].alias("largest"))


def rate_limited(samples: DataFrame) -> DataFrame:
    """The first sample (recording_id, time_us, blocks and any more) of each half second; of several at one time the least."""
    rest = [c for c in samples.columns if c not in ("recording_id", "time_us")]
    first = samples.groupBy("recording_id", F.expr(f"time_us div {LEAD_US}").alias("__slot")).agg(F.min(F.struct("time_us", *rest)).alias("s"))
    return first.select("recording_id", "s.*")


def candidates(samples: DataFrame) -> DataFrame:
    """Candidates of every window of samples, two a second at most (see :func:`rate_limited`)."""
    ends = samples.groupBy("recording_id").agg((F.max("time_us") + LEAD_US).alias("duration_us"))
    return window_candidates(with_lead_in(samples), ends)


def window_candidates(samples: DataFrame, ends: DataFrame) -> DataFrame:
    """Candidates of whole windows (samples with ``ordinal`` and ``lead_in``): states against the sample before and against the state's first sample, motion runs
    as their start and end, the best 32 with the cells they leave covered by a periodic one.

    Spans run to the next candidate or the end of the window, or of the recording (``ends``: recording_id, duration_us;
    where that is null or missing, the window's end).
    Everything after the anchor is windows by (recording, window), one shuffle.
    """
    by = Window.partitionBy("recording_id", "ordinal")
    order = by.orderBy("place")
    rows = _window_samples(samples).withColumn("cell", F.expr(f"(time_us - ordinal * {WINDOW_US}) div {CELL_US}"))

    # runs of motion: between their ends nothing is a state
    rows = rows.withColumn("run", F.when(F.col("moving"), F.col("place") - F.row_number().over(by.partitionBy("recording_id", "ordinal", "moving").orderBy("place"))))
    same_run = by.partitionBy("recording_id", "ordinal", "run")
    rows = rows.withColumn("run_first", F.min("place").over(same_run)).withColumn("run_last", F.max("place").over(same_run))
    long = F.col("moving") & (F.col("run_last") - F.col("run_first") + 1 >= MOTION_RUN)
    settles = long & (F.col("run_last") < F.col("n") - 1)
    rows = rows.withColumn("starts", long & (F.col("place") == F.col("run_first"))).withColumn("settled", settles & (F.col("place") == F.col("run_last")))
    rows = rows.withColumn("is_state", F.col("is_new") & (~long | F.col("starts") | F.col("settled")))
    still = F.when(F.col("led"), "periodic_coverage").otherwise("first_frame")
    reason = F.when(F.col("starts"), "motion_start").when(F.col("settled"), "settled_after_motion").when((F.col("place") == 0) & ~F.col("moving"), still).otherwise("visual_change")

    # a state holds until the next one
    following = F.min(F.when(F.col("is_state"), F.col("place"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("following", following).withColumn("states", F.count_if("is_state").over(by))
    firm = F.when(F.col("starts"), "in_motion").when(F.coalesce("following", "n") - F.col("place") > 1, "settled").when(F.col("following").isNull(), "open_at_window_end").otherwise("transient")
    rows = rows.withColumn("firm", F.when(F.col("is_state"), firm)).withColumn("firm", F.last("firm", ignorenulls=True).over(order))

    # the best state of a cell stands in for its periodic candidate and so is free; the others share what is left of the budget
    best = (F.col("place") != 0, F.desc_nulls_last("changed"), F.desc_nulls_last("largest"), F.col("place"))
    own = by.partitionBy("recording_id", "ordinal", "is_state")
    rows = rows.withColumn("in_cell", F.row_number().over(own.partitionBy("recording_id", "ordinal", "is_state", "cell").orderBy(*best))).withColumn("free", F.col("is_state") & (F.col("in_cell") == 1))
    rows = rows.withColumn("cells", F.size(F.collect_set("cell").over(by))).withColumn("extra", F.row_number().over(own.partitionBy("recording_id", "ordinal", "is_state", "free").orderBy(*best)))
    rows = rows.withColumn("kept", F.col("is_state") & (F.col("free") | (F.col("extra") <= MAX_CANDIDATES - F.col("cells"))))
    covered = F.bool_or("kept").over(by.partitionBy("recording_id", "ordinal", "cell"))
    first = F.row_number().over(by.partitionBy("recording_id", "ordinal", "cell").orderBy("place")) == 1
    rows = rows.withColumn("dropped", F.col("states") - F.count_if("kept").over(by)).withColumn("periodic", ~covered & first)
    found = rows.where("kept OR periodic").withColumn("until", F.lead("place").over(order)).withColumn("until_us", F.lead("time_us").over(order)).join(ends, "recording_id", "left")
    return found.select(
        "recording_id", "ordinal", F.col("time_us").alias("representative_us"), F.coalesce("until_us", F.least((F.col("ordinal") + 1) * WINDOW_US, "duration_us")).alias("span_end_us"),
        F.when(F.col("kept"), reason).otherwise("periodic_coverage").alias("reason"), F.col("firm").alias("stability"), (F.coalesce("until", "n") - F.col("place")).cast("long").alias("sample_count"),
        F.when(F.col("kept"), F.col("changed")).cast("long").alias("changed_blocks"), F.when(F.col("kept"), F.col("largest")).cast("long").alias("max_block_delta"), F.col("dropped").cast("long").alias("dropped"),
    )


def omit_periodic(found: DataFrame) -> DataFrame:
    return found.where("reason <> 'periodic_coverage'")


def plan_screen_changes(found: DataFrame) -> DataFrame:
    """recording_id, kind, before_us, after_us, motion_part: each visual change is a change; motion is one change from its
    start to its settling where these follow one another in a window that dropped nothing, else each part stands alone."""
    order = Window.partitionBy("recording_id", "ordinal").orderBy("representative_us")
    rows = omit_periodic(found).withColumn("next_reason", F.lead("reason").over(order)).withColumn("next_us", F.lead("representative_us").over(order)).withColumn("last_reason", F.lag("reason").over(order))
    paired = (F.col("reason") == "motion_start") & (F.col("next_reason") == "settled_after_motion") & (F.col("dropped") == 0)
    taken = (F.col("reason") == "settled_after_motion") & (F.col("last_reason") == "motion_start") & (F.col("dropped") == 0)
    rows = rows.where((F.col("reason") != "first_frame") & ~F.coalesce(taken, F.lit(False)))
    part = F.when(F.col("reason") == "motion_start", F.when(F.coalesce(paired, F.lit(False)), F.lit("whole")).otherwise("start")).when(F.col("reason") == "settled_after_motion", "end")
    return rows.select(
        "recording_id", F.when(F.col("reason") == "visual_change", "change").otherwise("motion").alias("kind"), F.col("representative_us").alias("before_us"),
        F.when(part == "whole", F.col("next_us")).otherwise(F.col("representative_us")).alias("after_us"), part.alias("motion_part"),
    )


def settled_screens(found: DataFrame, least_us: int = 5_000_000) -> DataFrame:
    """recording_id, representative_us, reason: first frames and settled screens, and changes at least five seconds after the last one kept."""
    def keep(last: int | None, row) -> tuple[int | None, list[tuple]]:
        if row is None or (row.reason == "visual_change" and last is not None and row.representative_us - last < least_us):
            return last, []
        return row.representative_us, [tuple(row)]

    rows = found.where("reason IN ('first_frame', 'settled_after_motion', 'visual_change')").select("recording_id", "representative_us", "reason")
    return ordered_fold(rows, ["recording_id"], ["representative_us"], keep, f"recording_id {dict(rows.dtypes)['recording_id']}, representative_us long, reason string")


def difference_hash(blocks: Column, width: int = 8, height: int = 8) -> Column:
    """A bit for each pair of neighbouring blocks in a row, 1 if the left one is brighter, row by row from the highest bit; the row's end has 0."""
    bits = F.transform(blocks, lambda x, i: F.when(((i + 1) % width != 0) & (x > F.coalesce(F.get(blocks, i + 1), x)), 1).otherwise(0))
    return F.aggregate(F.slice(bits, 1, width * height), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def index_stats(found: DataFrame) -> DataFrame:
    """recording_id, reason, candidates, windows."""
    return found.groupBy("recording_id", "reason").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("ordinal").alias("windows"))


def frames_to_samples(frames: DataFrame) -> DataFrame:
    """Samples of raw grey frames (recording_id, time_us, pixels binary of 128 x 72): rounded means of the 8 x 8 blocks.

    A frame of another size comes back with null blocks.
    """
    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for pixels in frame["pixels"]:
                grid = np.frombuffer(pixels, dtype=np.uint8) if pixels is not None and len(pixels) == 128 * 72 else None
                out.append(None if grid is None else ((grid.reshape(9, 8, 16, 8).astype(np.int64).sum(axis=(1, 3)) + 32) // 64).ravel())
            yield frame.assign(blocks=out)[["recording_id", "time_us", "blocks"]]

    return frames.select(F.col("recording_id").cast("long"), F.col("time_us").cast("long"), "pixels").mapInPandas(means, "recording_id long, time_us long, blocks array<int>")
