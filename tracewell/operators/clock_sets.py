"""Several clocks of one recording: pairs, rates, excursions, and what an anchor says about their zones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.clocks import DAY_US, QUARTER_US
from tracewell.operators.spans import overlap_join

#: Most anchors kept, slack of an offset, its largest size, slack of a rate, and the reads that make a run a clock.
MOST_ANCHORS, OFFSET_SLACK_US, MOST_OFFSET_US, RATE_SLACK_US = 16, 30_000_000, 14 * 3_600_000_000, 250_000
OWN_CLOCK_READS = 3


def clock_pairs(clocks: DataFrame, jumps: DataFrame) -> DataFrame:
    """recording_id, a, b, overlap_us, a_jumps_in_b, b_jumps_in_a: two clocks of a recording that are shown at one time.

    ``clocks``: recording_id, no, start_us, end_us; ``jumps``: recording_id, no,
    at_us. Counted are jumps of one clock while the other ran on: inside the
    other's span, and at no jump of its own.
    """
    other = clocks.select("recording_id", F.col("no").alias("b"), "start_us", "end_us")
    pairs = overlap_join(clocks.select("recording_id", F.col("no").alias("a"), "start_us", "end_us"), other, ["recording_id"]).where("a < b")
    at = jumps.select("recording_id", "no", "at_us").distinct()

    def inside(jumping: str, running: str, first: str, last: str) -> DataFrame:
        met = pairs.join(at.withColumnRenamed("no", jumping), ["recording_id", jumping]).where((F.col("at_us") > F.col(first)) & (F.col("at_us") < F.col(last)))
        alone = met.join(at.withColumnRenamed("no", running), ["recording_id", running, "at_us"], "left_anti")
        return alone.groupBy("recording_id", "a", "b").agg(F.count(F.lit(1)).alias(f"{jumping}_jumps_in_{running}"))

    keys = ["recording_id", "a", "b"]
    out = pairs.join(inside("a", "b", "r_start_us", "r_end_us"), keys, "left").join(inside("b", "a", "start_us", "end_us"), keys, "left")
    return out.select(*keys, "overlap_us", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a_jumps_in_b", "b_jumps_in_a")])


def clock_rate(stretches: DataFrame) -> DataFrame:
    """recording_id, no, drift_us, differs: over a clock's longest stretch without a jump (ties: the first).

    ``stretches``: recording_id, no, first_us, first_value_us, last_us,
    last_value_us, unit_us. The rate differs if the drift is more than a unit and
    ``RATE_SLACK_US``.
    """
    longest = F.max_by(F.struct(*stretches.columns), F.struct(F.col("last_us") - F.col("first_us"), -F.col("first_us"), "last_value_us"))
    rows = stretches.groupBy("recording_id", "no").agg(longest.alias("s")).select("s.*")
    drift = (F.col("last_value_us") - F.col("first_value_us")) - (F.col("last_us") - F.col("first_us"))
    return rows.select("recording_id", "no", drift.alias("drift_us"), (F.abs(drift) > F.col("unit_us") + RATE_SLACK_US).alias("differs"))


def _folded(low: np.ndarray, high: np.ndarray, reads: np.ndarray, clock: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """head, depth and whether it is an excursion of every run (in order) of one place."""
    n = len(low)
    head, depth, left = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    these, level = np.arange(n), 0
    while len(these):
        turns: list[np.ndarray] = []
        depth[these], at = level, 0
        while at < len(these):
            first = these[at]
            least, most, seen, at = low[first], high[first], reads[first], at + 1
            while (found := _next(these, at, low, high, reads, least, most, seen)) >= 0:
                between, run = these[at:found], these[found]
                if clock[between].any():
                    turns.append(between)
                else:
                    left[between], head[between] = True, first
                least, most, seen, head[run], at = max(least, low[run]), min(most, high[run]), seen + reads[run], first, found + 1
        these, level = np.concatenate(turns) if turns else np.empty(0, dtype=np.int64), level + 1
    return head, depth, left


def _next(these: np.ndarray, at: int, low: np.ndarray, high: np.ndarray, reads: np.ndarray, least: int, most: int, seen: int) -> int:
    """The nearest place from ``at`` on whose run's offset meets (least, most), one of both being long enough; -1 if there is none."""
    width = 64
    while at < len(these):
        some = these[at : at + width]
        met = (np.maximum(low[some], least) < np.minimum(high[some], most)) & (np.maximum(reads[some], seen) >= OWN_CLOCK_READS)
        if met.any():
            return at + int(met.argmax())
        at, width = at + width, width * 2
    return -1


def fold_excursions(runs: DataFrame) -> DataFrame:
    """``runs`` (recording_id, run, reads, advances, low_us, high_us and any more) with ``part``, ``depth`` and ``head``.

    A run takes in the nearest later run whose offset meets its own, if one of both
    has ``OWN_CLOCK_READS`` reads, keeps what both offsets have in common, and goes
    on so; ``head`` is the run that began it. The stretch between is an
    ``excursion`` (its ``head`` the run that it left) unless one of its runs could
    be a clock (``OWN_CLOCK_READS`` reads, not all alike): then it is another
    clock's turn, and all turns of a recording are folded again among themselves,
    one ``depth`` further down. ``part`` is ``main`` at depth 0 and ``other_clock``
    below. A null recording is one; null reads count as none.

    The rule looks ahead as far as a recording goes, so a recording's runs (not its
    reads) meet in one task, as five columns of whole numbers.
    """
    kept = runs.drop("part", "depth", "head")
    kind = dict(kept.dtypes)["run"]

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("run")
        column = lambda name: rows.column(name).fill_null(0).to_numpy().astype(np.int64)
        reads = column("reads")
        advances = rows.column("advances").fill_null(False).to_numpy(zero_copy_only=False)
        head, depth, left = _folded(column("low_us"), column("high_us"), reads, (reads >= OWN_CLOCK_READS) & advances)
        part = np.where(left, "excursion", np.where(depth > 0, "other_clock", "main"))
        return rows.append_column("part", pa.array(part.tolist(), pa.string())).append_column("depth", pa.array(depth)).append_column("head", rows.column("run").take(pa.array(head)))

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.groupBy("recording_id").applyInArrow(fold, f"{schema}, part string, depth long, head {kind}")


def anchors_from_ingest(stated: DataFrame, tags: DataFrame, now_us: int, latest_us: int) -> DataFrame:
    """recording_id, source, utc_us, place: what was stated first, then each source's first plausible tag, ``MOST_ANCHORS`` at most.

    ``stated``: recording_id, utc_us; ``tags``: recording_id, source, pos, utc_us.
    A tag is plausible between 1995 and ``latest_us`` after now.
    """
    own = stated.groupBy("recording_id").agg(F.min("utc_us").alias("utc_us")).select("recording_id", F.lit(0).alias("__first"), F.lit("operator").alias("source"), "utc_us")
    good = tags.where((F.col("utc_us") >= 788_918_400_000_000) & (F.col("utc_us") <= now_us + latest_us))
    first = good.groupBy("recording_id", "source").agg(F.min_by("utc_us", F.struct("pos", "utc_us")).alias("utc_us"))
    both = own.unionByName(first.select("recording_id", F.lit(1).alias("__first"), "source", "utc_us"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("__first", "source"))).where(F.col("place") <= MOST_ANCHORS).drop("__first")


def screen_anchor_top(anchors: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """``anchors`` (recording_id, anchor_id, from_screen, precision_us) that are kept: all others, and the most precise from screens in the room they leave."""
    room = most - F.count_if(~F.col("from_screen")).over(Window.partitionBy("recording_id"))
    place = F.row_number().over(Window.partitionBy("recording_id", "from_screen").orderBy("precision_us", "anchor_id"))
    return anchors.withColumn("__room", room).withColumn("__place", place).where("NOT from_screen OR __place <= __room").drop("__room", "__place")


def offset_observations(clocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """recording_id, no, offset_us: zones (whole quarter hours, 14 hours at most) in which a clock's readings agree with the anchor.

    ``clocks``: recording_id, no, start_us (the recording's start by this clock),
    uncertainty_us, wraps (a time of day, so whole days don't count);
    ``anchors``: recording_id, utc_us (the recording's start). A zone agrees within
    the uncertainty and ``OFFSET_SLACK_US``.
    """
    days = F.explode(F.when(F.col("wraps"), F.array(*[F.lit(d) for d in (-DAY_US, 0, DAY_US)])).otherwise(F.array(F.lit(0).cast("long"))))
    met = clocks.join(anchors.select("recording_id", "utc_us"), "recording_id").withColumn("day_us", days)
    # a time of day is compared with the anchor's own
    apart = met.withColumn("apart_us", F.col("start_us") + F.col("day_us") - F.when(F.col("wraps"), F.pmod("utc_us", F.lit(DAY_US))).otherwise(F.col("utc_us")))
    offset = F.expr(f"CAST(floor((apart_us + {QUARTER_US // 2}) / {QUARTER_US}) AS bigint) * {QUARTER_US}")
    fits = apart.withColumn("offset_us", offset).where((F.abs(F.col("apart_us") - F.col("offset_us")) <= F.col("uncertainty_us") + OFFSET_SLACK_US) & (F.abs("offset_us") <= MOST_OFFSET_US))
    return fits.select("recording_id", "no", "offset_us").distinct()


def confirm_zone(clocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """recording_id, no, utc_us: the recording's start by a clock of known zone (zone_us), on the date that is nearest the anchor (ties: the earlier)."""
    met = clocks.join(anchors.select("recording_id", F.col("utc_us").alias("anchor_us")), "recording_id")
    midnight = F.col("anchor_us") - F.pmod("anchor_us", F.lit(DAY_US))
    dated = met.withColumn("utc_us", F.explode(F.array(*[midnight + F.col("start_us") - F.col("zone_us") + F.lit(d * DAY_US) for d in (-1, 0, 1)])))
    return dated.groupBy("recording_id", "no").agg(F.min_by("utc_us", F.struct(F.abs(F.col("utc_us") - F.col("anchor_us")), "utc_us")).alias("utc_us"))
