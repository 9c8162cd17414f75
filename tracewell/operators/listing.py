"""Text listings of transcripts and screen changes, read targets, and checks of windows and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import one_line
from tracewell.operators.spans import asof_join

#: Most samples and candidates of a window, and how far a periodic target may be from its frame.
MAX_SAMPLES, MAX_CANDIDATES, PERIODIC_US = 122, 32, 1_000_000


def stamp(time_us: Column) -> Column:
    """``HH:MM:SS`` of a time."""
    s = F.floor(time_us / 1_000_000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def transcript_entries(segments: DataFrame, gaps: DataFrame) -> DataFrame:
    """recording_id, place, start_us, end_us, kind, text: segments (``speech``) and gaps (``untranscribed``, with the reason as text) as one list by start.

    ``place`` counts a recording's entries from 1; at one time gaps come first, then
    segments by ordinal. Rows, so a recording of any length fits.
    """
    said = segments.select("recording_id", "start_us", F.lit(1).alias("k"), "ordinal", "end_us", F.lit("speech").alias("kind"), one_line(F.col("text")).alias("text"))
    missing = gaps.select("recording_id", "start_us", F.lit(0).alias("k"), F.lit(0).cast("long").alias("ordinal"), "end_us", F.lit("untranscribed").alias("kind"), F.col("reason").alias("text"))
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_us", "k", "ordinal", "end_us", "text"))
    return said.unionByName(missing).select("recording_id", place.cast("long").alias("place"), "start_us", "end_us", "kind", "text")


def transcript_text(segments: DataFrame, gaps: DataFrame) -> DataFrame:
    """recording_id, text: ``[time] words`` lines of segments with ``[from-to] (not transcribed: reason)`` lines of gaps between, by start."""
    speech = F.concat(F.lit("["), stamp(F.col("start_us")), F.lit("] "), "text")
    missing = F.concat(F.lit("["), stamp(F.col("start_us")), F.lit("-"), stamp(F.col("end_us")), F.lit("] (not transcribed: "), "text", F.lit(")"))
    lines = transcript_entries(segments, gaps).select("recording_id", "place", F.when(F.col("kind") == "speech", speech).otherwise(missing).alias("line"))
    rows = lines.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return rows.select("recording_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def screen_changes_lines(changes: DataFrame) -> DataFrame:
    """recording_id, place (from 1), line: a line for each change by time; rows, so a recording of any length fits."""
    line = F.concat(F.lit("["), stamp(F.col("after_us")), F.lit("] "), "kind")
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("after_us", "kind"))
    return changes.select("recording_id", place.cast("long").alias("place"), line.alias("line"))


def screen_changes_text(changes: DataFrame) -> DataFrame:
    """recording_id, text: how many changes there are, then a line for each by time."""
    rows = screen_changes_lines(changes).groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return rows.select("recording_id", F.concat_ws("\n", F.concat(F.size("lines"), F.lit(" changes")), F.transform("lines", lambda x: x["line"])).alias("text"))


def resolve_read_targets(targets: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with the targets that they serve (recording_id, frame_us, targets), and targets without a frame.

    A candidate's target needs a frame at its very time, a periodic one a frame at or
    up to a second after it; targets that meet at one frame share it.
    """
    near = asof_join(targets, frames.select("recording_id", F.col("time_us").alias("frame_us")), ["recording_id"], "time_us", "frame_us")
    allowed = F.when(F.col("candidate"), 0).otherwise(PERIODIC_US)
    met = near.withColumn("frame_us", F.when(F.col("frame_us") - F.col("time_us") <= allowed, F.col("frame_us")))
    found = met.where("frame_us IS NOT NULL").groupBy("recording_id", "frame_us").agg(F.array_sort(F.collect_set("time_us")).alias("targets"))
    return found, met.where("frame_us IS NULL").drop("frame_us")


def window_violations(candidates: DataFrame) -> DataFrame:
    """recording_id, ordinal, violation of windows' candidates: out of order, spans that don't meet, too many, or no candidate first."""
    order = Window.partitionBy("recording_id", "ordinal").orderBy("representative_us")
    rows = candidates.withColumn("next", F.lead("representative_us").over(order)).withColumn("n", F.row_number().over(order))
    kinds = F.array(
        F.when(F.col("span_end_us") <= F.col("representative_us"), "empty"), F.when(F.col("next") != F.col("span_end_us"), "not_contiguous"),
        F.when(F.col("n") > MAX_CANDIDATES, "too_many"), F.when((F.col("sample_count") > MAX_SAMPLES) | (F.col("sample_count") < 1), "samples"),
    )
    return rows.select("recording_id", "ordinal", F.explode(F.array_compact(kinds)).alias("violation"))


def selection_violations(selections: DataFrame, items: DataFrame) -> DataFrame:
    """record_id, violation of selections (record_id, evidence_id, requested_us, actual_us, delta_us): wrong differences, absent items, over 100 of a record."""
    met = selections.join(items.select("evidence_id").distinct().withColumn("held", F.lit(True)), "evidence_id", "left")
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("requested_us", "evidence_id"))
    kinds = F.array(F.when(F.col("delta_us") != F.col("actual_us") - F.col("requested_us"), "delta"), F.when(F.col("held").isNull(), "absent"), F.when(n > 100, "too_many"))
    return met.withColumn("kinds", kinds).select("record_id", F.explode(F.array_compact("kinds")).alias("violation"))


def superseded_citations(citations: DataFrame, segments: DataFrame) -> DataFrame:
    """report_id, segment_id, revision, superseded: which revision a cited segment is of, and whether a newer one of its recording exists."""
    newest = segments.groupBy("recording_id").agg(F.max("revision").alias("newest"))
    return citations.join(segments.select("segment_id", "recording_id", "revision"), "segment_id").join(newest, "recording_id").select("report_id", "segment_id", "revision", (F.col("revision") < F.col("newest")).alias("superseded"))
