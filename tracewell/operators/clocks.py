"""Clocks on screen: runs of reads that agree, jumps between them, and their rate.

The one rule that goes through a recording's reads in order holds a run's bounds
and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.folds import ordered_fold

#: A day; a jump's least size forward and back; another clock's least offset and its unit.
DAY_US, JUMP_US, OTHER_US, QUARTER_US = 86_400_000_000, 2_000_000, 1_800_000_000, 900_000_000
RUNS = "recording_id long, run long, first_us long, last_us long, reads long, low_us long, high_us long, advances boolean"


def clock_runs(reads: DataFrame) -> DataFrame:
    """Runs of reads (recording_id, time_us, value_us, unit_us) whose offsets have a point in common; ``advances``: not all values are equal.

    A read of a value that holds for one unit says that the clock's offset from the
    recording lies in (value - time, value - time + unit]. A run goes on while the
    intervals of its reads meet; times of day are first moved by whole days to lie
    nearest the run. A read without a time, value or unit is none; reads of a null
    recording are one recording's.
    """
    def step(now: tuple | None, read) -> tuple[tuple | None, list[tuple]]:
        if read is None:
            return None, [now[0]]
        low, high = read.value_us - read.time_us, read.value_us - read.time_us + read.unit_us
        if now is None:
            return ((read.recording_id, 0, read.time_us, read.time_us, 1, low, high, False), read.value_us), []
        (recording, run, first, _, reads, least, most, moved), value = now
        days = ((least + most) // 2 - (low + high) // 2 + DAY_US // 2) // DAY_US
        low, high = low + days * DAY_US, high + days * DAY_US
        if max(low, least) < min(high, most):
            return ((recording, run, first, read.time_us, reads + 1, max(low, least), min(high, most), moved or read.value_us != value), value), []
        return ((recording, run + 1, read.time_us, read.time_us, 1, low, high, False), read.value_us), [now[0]]

    rows = reads.select("recording_id", "time_us", "value_us", "unit_us").dropna(subset=["time_us", "value_us", "unit_us"])
    return ordered_fold(rows, ["recording_id"], ["time_us", "value_us"], step, RUNS)


def clock_jumps(runs: DataFrame) -> DataFrame:
    """recording_id, run, kind, low_us, high_us of each run after the first: how its offset differs from the run before.

    ``gap`` two seconds or more forward, ``backward`` two or more back, ``other_clock``
    half an hour or more and near a whole quarter of an hour, else ``continuation``.
    """
    order = Window.partitionBy("recording_id").orderBy("run")
    rows = runs.withColumn("l", F.lag("low_us").over(order)).withColumn("h", F.lag("high_us").over(order)).where("l IS NOT NULL")
    rows = rows.withColumn("jump_low", F.col("low_us") - F.col("h")).withColumn("jump_high", F.col("high_us") - F.col("l"))
    middle = F.expr("(jump_low + jump_high) div 2")
    quarter = F.expr(f"abs(((jump_low + jump_high) div 2) - cast(round(((jump_low + jump_high) div 2) / {QUARTER_US}) AS bigint) * {QUARTER_US}) <= (jump_high - jump_low) div 2")
    kind = F.when((F.abs(middle) >= OTHER_US) & quarter, "other_clock").when(F.col("jump_low") >= JUMP_US, "gap").when(F.col("jump_high") <= -JUMP_US, "backward").otherwise("continuation")
    return rows.select("recording_id", "run", kind.alias("kind"), F.col("jump_low").alias("low_us"), F.col("jump_high").alias("high_us"))


def clock_kind(reads: DataFrame, runs: DataFrame) -> DataFrame:
    """recording_id, kind: ``counter`` if a face in hour 00 is seen or an offset lies in (-duration, 0], else ``time_of_day``; duration is just past the last read."""
    ends = reads.groupBy("recording_id").agg((F.max("time_us") + 1).alias("duration_us"), F.bool_or(F.col("value_us") < 3_600_000_000).alias("early"))
    within = runs.join(ends, "recording_id").groupBy("recording_id").agg(F.bool_or((F.col("low_us") <= 0) & (F.col("high_us") > -F.col("duration_us"))).alias("near"), F.bool_or("early").alias("early"))
    return within.select("recording_id", F.when(F.col("near") | F.col("early"), "counter").otherwise("time_of_day").alias("kind"))


def frozen_stretches(reads: DataFrame) -> DataFrame:
    """recording_id, value_us, first_us, last_us of reads that show one value for longer than its unit."""
    order = Window.partitionBy("recording_id").orderBy("time_us")
    new = F.coalesce((F.lag("value_us").over(order) != F.col("value_us")).cast("int"), F.lit(1))
    rows = reads.withColumn("new", new).withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = rows.groupBy("recording_id", "n", "value_us").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.max("unit_us").alias("unit_us"))
    return same.where("last_us - first_us > unit_us").select("recording_id", "value_us", "first_us", "last_us")
