"""Recognised speech in chunks: plans, validation, ownership at seams, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import seam_words
from tracewell.operators.spans import merge_spans, overlap_join, span_subtract

#: Chunk length and overlap, and how far past the audio an end is cut rather than refused.
WINDOW_US, OVERLAP_US = 30_000_000, 5_000_000
LATE_US, LATE_MORE_US = 30_000_000, 1_000_000


def plan_chunks(ranges: DataFrame, window_us: int = WINDOW_US, overlap_us: int = OVERLAP_US, *, most: int | None = None) -> DataFrame:
    """recording_id, idx, win_start_us, win_end_us for ranges (recording_id, start_us, end_us): strides until a chunk reaches the end, the last one cut.

    With ``most`` there is a column ``refused``: a range that needs more chunks
    comes back as one row without a window that gives ``too_many_chunks`` there.
    """
    stride = window_us - overlap_us
    rows = ranges.where("start_us < end_us").withColumn("__n", F.expr(f"greatest(1L, 1 + (end_us - start_us - {window_us} + {stride - 1}) div {stride})"))
    refused = F.col("__n") > most if most is not None else F.lit(False)
    every = F.sequence(F.lit(0).cast("long"), F.when(refused, F.lit(0).cast("long")).otherwise(F.col("__n") - 1))
    rows = rows.withColumn("refused", F.when(refused, "too_many_chunks")).withColumn("idx", F.explode(every))
    rows = rows.withColumn("idx", F.when(F.col("refused").isNull(), F.col("idx")))
    start = F.col("start_us") + F.col("idx") * stride
    # least() passes over nulls, and a refused row has no window
    end = F.when(F.col("idx").isNotNull(), F.least(start + window_us, "end_us"))
    return rows.select("recording_id", "idx", start.alias("win_start_us"), end.alias("win_end_us"), *["refused"] * (most is not None))


def seam_cores(chunks: DataFrame) -> DataFrame:
    """Chunks with core_start_us and core_end_us: each owns up to the middle of its overlap with the next."""
    order = Window.partitionBy("recording_id").orderBy("idx")
    rows = chunks.withColumn("__next", F.lead("win_start_us").over(order)).withColumn("__last", F.lag("win_end_us").over(order))
    return rows.withColumn("core_start_us", F.expr("coalesce((__last + win_start_us) div 2, win_start_us)")).withColumn("core_end_us", F.expr("coalesce((win_end_us + __next) div 2, win_end_us)")).drop("__next", "__last")


def validate_segments(segments: DataFrame) -> DataFrame:
    """Segments (start_us, end_us, text, decoded_us) with ``verdict`` and the end cut at the audio where it is not far past it.

    ``rejected``: reversed, past the audio, or ending too far past it;
    ``removed``: markers such as [music] or nothing at all; else ``kept``.
    """
    far = F.greatest(F.lit(LATE_US), F.col("decoded_us") + LATE_MORE_US)
    marker = F.trim(F.col("text")).rlike(r"^(?:\s*(?:\[[^\[\]]*\]|\([^()]*\)))*\s*$")
    verdict = F.when((F.col("end_us") <= F.col("start_us")) | (F.col("start_us") >= F.col("decoded_us")) | (F.col("end_us") > far), "rejected").when(marker, "removed").otherwise("kept")
    return segments.withColumn("verdict", verdict).withColumn("end_us", F.when(F.col("verdict") == "kept", F.least("end_us", "decoded_us")).otherwise(F.col("end_us")))


def unusable_chunks(validated: DataFrame) -> DataFrame:
    """recording_id, chunk, rejected, total, unusable: all rejected, more than one of under four, or over a quarter."""
    rows = validated.groupBy("recording_id", "chunk").agg(F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))
    bad = (F.col("rejected") == F.col("total")) | ((F.col("total") < 4) & (F.col("rejected") > 1)) | ((F.col("total") >= 4) & (F.col("rejected") * 4 > F.col("total")))
    return rows.withColumn("unusable", bad)


def run_fails(chunks: DataFrame) -> DataFrame:
    """recording_id, unusable, answered, fails: more than half of the answered chunks are unusable."""
    rows = chunks.where("outcome IN ('transcribed', 'unusable')").groupBy("recording_id").agg(F.count_if(F.col("outcome") == "unusable").alias("unusable"), F.count(F.lit(1)).alias("answered"))
    return rows.withColumn("fails", F.col("unusable") * 2 > F.col("answered"))


def agreed_language(chunks: DataFrame, language: str) -> DataFrame:
    """recording_id, language: the one all answering chunks give, else null."""
    return chunks.groupBy("recording_id").agg(F.when(F.min(language) == F.max(language), F.min(language)).alias("language"))


def keep_owned(segments: DataFrame, cores: DataFrame) -> DataFrame:
    """Segments (with ``chunk``) that the chunk owning their middle made, and others where the owner has nothing over them."""
    rows = segments.withColumn("__middle", F.expr("(start_us + end_us) div 2"))
    spans = cores.select("recording_id", F.col("idx").alias("owner"), "core_start_us", "core_end_us")
    points = rows.withColumn("__b", F.expr("__middle div 25000000"))
    buckets = spans.withColumn("__b", F.explode(F.expr("sequence(core_start_us div 25000000, (core_end_us - 1) div 25000000)")))
    owned = points.join(buckets, ["recording_id", "__b"]).where("__middle >= core_start_us AND __middle < core_end_us").drop("__b", "core_start_us", "core_end_us", "__middle")
    mine, foreign = owned.where("owner = chunk"), owned.where("owner <> chunk")
    over = overlap_join(
        foreign.select("recording_id", "ordinal", F.col("owner").alias("o"), "start_us", "end_us"),
        mine.select("recording_id", F.col("chunk").alias("c"), "start_us", "end_us"), ["recording_id"],
    ).where("o = c").select("recording_id", "ordinal").distinct()
    return mine.unionByName(foreign.join(over, ["recording_id", "ordinal"], "left_anti"))


def transcript_coverage(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, kind, start_us, end_us: what of a run's windows is transcribed, without speech, untranscribed or pending.

    Silent windows are covered and hold no speech; unusable ones were looked at and
    cover nothing, nor do pending ones, except where another window or a segment does.
    """
    key = ["recording_id"]
    windows = chunks.withColumnsRenamed({"win_start_us": "start_us", "win_end_us": "end_us"})
    of = lambda *kinds: windows.where(F.col("outcome").isin(*kinds)).select("recording_id", "start_us", "end_us")
    named = lambda df, kind: df.withColumn("kind", F.lit(kind))
    covered = merge_spans(of("transcribed", "silent").unionByName(segments.select("recording_id", "start_us", "end_us")), key)
    transcribed = of("transcribed").unionByName(segments.select("recording_id", "start_us", "end_us"))
    missed = span_subtract(of("unusable"), covered, key)
    pending = span_subtract(of("pending"), covered.unionByName(of("unusable")), key)
    silent = span_subtract(of("silent"), transcribed, key)
    return named(covered, "transcribed").unionByName(named(missed, "untranscribed")).unionByName(named(pending, "pending")).unionByName(named(silent, "no_speech"))


def word_timeline(segments: DataFrame) -> DataFrame:
    """recording_id, ordinal, n, word, at_us: the words of segments, evenly spread over them."""
    # words are split and counted before they are exploded, once a segment
    rows = segments.select("recording_id", "ordinal", "start_us", "end_us", seam_words(F.col("text")).alias("words")).withColumn("m", F.size("words"))
    rows = rows.select("recording_id", "ordinal", "start_us", "end_us", "m", F.posexplode("words").alias("n", "word"))
    return rows.select("recording_id", "ordinal", "n", "word", F.expr("start_us + ((end_us - start_us) * (2 * n + 1)) div (2 * m)").alias("at_us"))


def repeats_before(segments: DataFrame) -> DataFrame:
    """Segments with ``repeats``: the same words as the segment before."""
    order = Window.partitionBy("recording_id").orderBy("ordinal")
    words = seam_words(F.col("text"))
    return segments.withColumn("repeats", F.coalesce(F.lag(words).over(order) == words, F.lit(False)))


def loops(segments: DataFrame, most: int = 4, times: int = 8) -> DataFrame:
    """Segments with ``loops``: a unit of one to four words repeated eight times or more that makes up half of the words."""
    rows = segments.withColumn("__w", seam_words(F.col("text")))
    # the longest stretch in which each word equals the one a unit later
    streak = lambda u: f"aggregate(sequence(0, size(__w) - 1), struct(0 AS now, 0 AS best), (a, i) -> IF(get(__w, i) = get(__w, i + {u}), struct(a.now + 1 AS now, greatest(a.best, a.now + 1) AS best), struct(0 AS now, a.best AS best)), a -> IF(a.best = 0, 0, a.best + {u}))"
    found = F.lit(False)
    for u in range(1, most + 1):
        found = found | F.expr(f"size(__w) > 0 AND {streak(u)} >= {u * times} AND 2 * {streak(u)} >= size(__w)")
    return rows.withColumn("loops", found).drop("__w")


def segment_chains(segments: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us: chains of segments that overlap one another; touching ones don't."""
    return merge_spans(segments, ["recording_id"], strict=True)


def snap_range(segments: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """recording_id, start_us, end_us: the range widened to every chain that it cuts."""
    chains = segment_chains(segments).where((F.col("start_us") < to_us) & (F.col("end_us") > from_us))
    return chains.groupBy("recording_id").agg(F.least(F.min("start_us"), F.lit(from_us)).alias("start_us"), F.greatest(F.max("end_us"), F.lit(to_us)).alias("end_us"))


def align_cues(cues: DataFrame, offset_us: int, source_us: int) -> DataFrame:
    """Cues shifted by the offset, with ``outcome``: kept, or dropped because outside the source or across its edge (never cut)."""
    if abs(offset_us) > 86_400_000_000:
        raise ValueError("an offset is at most a day")
    rows = cues.withColumn("start_us", F.col("start_us") + offset_us).withColumn("end_us", F.col("end_us") + offset_us)
    outside = (F.col("end_us") <= 0) | (F.col("start_us") >= source_us)
    edge = (F.col("start_us") < 0) | (F.col("end_us") > source_us)
    return rows.withColumn("outcome", F.when(outside, "outside").when(edge, "across_edge").otherwise("kept"))


def cue_quality(cues: DataFrame) -> DataFrame:
    """recording_id, kind, cues, first_ordinal: overlapping cues (before the latest end so far) and those out of order."""
    order = Window.partitionBy("recording_id").orderBy("ordinal")
    latest = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kinds = F.array(F.when(F.col("start_us") < latest, "overlapping"), F.when(F.col("start_us") < F.lag("start_us").over(order), "out_of_order"))
    rows = cues.withColumn("kinds", kinds).select("recording_id", "ordinal", F.explode(F.array_compact("kinds")).alias("kind"))
    return rows.groupBy("recording_id", "kind").agg(F.count(F.lit(1)).alias("cues"), F.min("ordinal").alias("first_ordinal"))


def ordinals(segments: DataFrame) -> DataFrame:
    """Segments renumbered from 1 by start, end and the old ordinal."""
    return segments.withColumn("ordinal", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_us", "end_us", "ordinal")).cast("long"))
