"""Search over many recordings: on-screen text, both kinds of hits together, and bundles.

Every operator takes the tables of all recordings at once; ranks are windows by
recording or row numbers over hits, which are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.search import page, search, text_runs, tier_of

HIT = ("recording_id", "kind", "tier", "start_us", "end_us", "ordinal")


def search_screen_text(lines: DataFrame, query: str, *, from_us: int | None = None, to_us: int | None = None, limit: int | None = None) -> DataFrame:
    """Occurrences of on-screen text that match: recording_id, line_no, words, first_us, last_us, frames, tier.

    Runs are worked out over all lines first, so that a range doesn't cut them: it
    keeps runs with a frame in ``[from_us, to_us)``. ``limit`` pages each
    recording's hits by (tier, first_us, line_no, words), with ``has_more``.
    """
    runs = text_runs(lines).withColumn("tier", tier_of(F.col("words"), query)).where("tier IS NOT NULL")
    if from_us is not None:
        runs = runs.where((F.col("first_us") < to_us) & (F.col("last_us") >= from_us))
    return runs if limit is None else page(runs, ("recording_id",), ("tier", "first_us", "line_no", "words"), limit)


def rank_hits(hits: DataFrame) -> DataFrame:
    """``rank`` (from 1) of a recording's hits by (tier, ordinal)."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("recording_id").orderBy("tier", "ordinal")))


def union_hits(transcript: DataFrame, screen_text: DataFrame) -> DataFrame:
    """Both kinds of hits as one table (``HIT``); a run of on-screen text is a hit from its first to its last frame, its line the ordinal."""
    said = transcript.select("recording_id", F.lit("transcript").alias("kind"), "tier", "start_us", "end_us", F.col("ordinal").cast("long").alias("ordinal"))
    shown = screen_text.select("recording_id", F.lit("screen_text").alias("kind"), "tier", F.col("first_us").alias("start_us"), F.col("last_us").alias("end_us"), F.col("line_no").cast("long").alias("ordinal"))
    return said.unionByName(shown)


def distinct_bundles(bundles: DataFrame) -> DataFrame:
    """``bundles`` (bundle_id, digest, ...) with ``first_id``, the least bundle of the same digest, and ``kept``: whether it is that one."""
    first = F.min("bundle_id").over(Window.partitionBy("digest"))
    return bundles.withColumn("first_id", first).withColumn("kept", F.col("bundle_id") == first)


def search_bundles(bundles: DataFrame, segments: DataFrame, lines: DataFrame, query: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The hits of all bundles, and a row for each bundle.

    ``bundles``: bundle_id, digest, recording_id, readable, has_transcript, has_screen_text.
    Of bundles with one digest the first is searched, unreadable ones never are.
    Hits have bundle_id, ``sequence`` (a hit's place in its bundle and tier: by
    time, transcript before on-screen text) and ``rank`` over all bundles by (tier,
    sequence, bundle_id), of which the first ``limit`` come back. Bundles have status (``searched``,
    ``duplicate``, ``unreadable``), ``covered`` (what was looked at) and the exact
    number of their hits.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    known = distinct_bundles(bundles).withColumn("status", F.when(~F.col("readable"), "unreadable").when(~F.col("kept"), "duplicate").otherwise("searched"))
    looked = known.where("status = 'searched'")
    both = union_hits(search(segments, query), search_screen_text(lines, query)).join(looked.select("bundle_id", "recording_id", "has_transcript", "has_screen_text"), "recording_id")
    hits = both.where("IF(kind = 'transcript', has_transcript, has_screen_text)")
    order = Window.partitionBy("bundle_id", "tier").orderBy("start_us", F.col("kind") == "screen_text", "ordinal")
    placed = hits.withColumn("sequence", F.row_number().over(order)).select("bundle_id", *HIT, "sequence")
    first = placed.orderBy("tier", "sequence", "bundle_id").limit(limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("tier", "sequence", "bundle_id")))
    covered = F.concat_ws("+", F.when(F.col("has_transcript"), "transcript"), F.when(F.col("has_screen_text"), "screen_text"))
    counts = hits.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("hits"))
    cover = known.join(counts, "bundle_id", "left").select("bundle_id", "status", F.when(F.col("status") == "searched", covered).alias("covered"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return ranked, cover
