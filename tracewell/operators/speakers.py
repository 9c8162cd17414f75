"""Who spoke: labels of turns, attribution of segments, totals and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.spans import merge_spans, overlap_join

#: Fixed values, in basis points: least speech in a segment, and least share of the first speaker in it.
MIN_SPEECH_BP, MIN_SHARE_BP = 5_000, 7_000


def speaking(turns: DataFrame, name: str) -> DataFrame:
    """recording_id, ``name``, start_us, end_us: when each speaker speaks, however many of its turns overlap."""
    return merge_spans(turns.where("end_us IS NOT NULL"), ["recording_id", name])


def unscored_time(reference: DataFrame, collar_us: int, unscored: DataFrame | None = None) -> DataFrame:
    """recording_id, start_us, end_us: within ``collar_us`` of the ends of the reference's turns, and the ranges ``unscored``, merged."""
    ends = reference.select("recording_id", F.explode(F.array("start_us", "end_us")).alias("t"))
    rows = ends.select("recording_id", (F.col("t") - collar_us).alias("start_us"), (F.col("t") + collar_us).alias("end_us"))
    if unscored is not None:
        rows = rows.unionByName(unscored.select("recording_id", "start_us", "end_us"))
    return merge_spans(rows, ["recording_id"])


def label_turns(turns: DataFrame) -> DataFrame:
    """Turns with ``tag``: clusters numbered from 1 by their first appearance (start, end, cluster)."""
    by = Window.partitionBy("recording_id", "cluster")
    first = F.min(F.struct("start_us", "end_us", "cluster")).over(by)
    return turns.withColumn("__first", first).withColumn("tag", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("__first"))).drop("__first")


def attribute_speakers(segments: DataFrame, labelled: DataFrame) -> DataFrame:
    """recording_id, ordinal, start_us, end_us, tag, outcome: the label that dominates each segment.

    ``labelled`` with less than half of the segment under speech gives
    ``little_speech``, ``mixed`` if the first label has under 70% of the speech.
    Shares are whole basis points; of equal labels the lower wins.
    """
    keyed = segments.select("recording_id", "ordinal", "start_us", "end_us")
    spoken = overlap_join(keyed, labelled.select("recording_id", "tag", "start_us", "end_us"), ["recording_id"]).groupBy("recording_id", "ordinal", "tag").agg(F.sum("overlap_us").alias("us"))
    top = spoken.groupBy("recording_id", "ordinal").agg(F.sum("us").alias("speech_us"), F.min(F.struct((-F.col("us")).alias("less"), "tag")).alias("top"))
    rows = keyed.join(top, ["recording_id", "ordinal"], "left")
    length = F.col("end_us") - F.col("start_us")
    enough = F.expr(f"(least(speech_us, end_us - start_us) * 10000) div (end_us - start_us) >= {MIN_SPEECH_BP}")
    clear = F.expr(f"(-top.less * 10000) div speech_us >= {MIN_SHARE_BP}")
    outcome = F.when(F.col("speech_us").isNull() | (length <= 0) | ~enough, "little_speech").when(~clear, "mixed").otherwise("labelled")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("recording_id", "ordinal", "start_us", "end_us", F.when(F.col("outcome") == "labelled", F.col("top.tag")).alias("tag"), "outcome")


def speaker_totals(labelled: DataFrame, attributions: DataFrame) -> DataFrame:
    """recording_id, tag, speech_us, first_us, segments of each label."""
    speech = labelled.groupBy("recording_id", "tag").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"), F.min("start_us").alias("first_us"))
    own = attributions.where("tag IS NOT NULL").groupBy("recording_id", "tag").agg(F.count(F.lit(1)).alias("segments"))
    return speech.join(own, ["recording_id", "tag"], "left").withColumn("segments", F.coalesce("segments", F.lit(0).cast("long")))


def speaker_coverage(attributions: DataFrame) -> DataFrame:
    """recording_id, outcome, segments of each outcome."""
    return attributions.groupBy("recording_id", "outcome").agg(F.count(F.lit(1)).alias("segments"))


def count_shortfall(asked: DataFrame, labelled: DataFrame) -> DataFrame:
    """recording_id, missing: voices asked for (recording_id, voices) that weren't found."""
    found = labelled.groupBy("recording_id").agg(F.countDistinct("tag").alias("found"))
    return asked.join(found, "recording_id", "left").select("recording_id", (F.col("voices") - F.coalesce("found", F.lit(0))).alias("missing")).where("missing > 0")
