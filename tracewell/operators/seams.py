"""Seams of overlapping chunks: repeats, holes, and what a run of chunks may publish."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import seam_words
from tracewell.operators.spans import join_nearest, merge_spans, overlap_join, span_subtract

#: A hole that is closed again, the margin of a cut segment, most stretches kept.
HOLE_US, CUT_US, MAX_STRETCHES = 500_000, 500_000, 1_024


def holes(every: DataFrame, kept: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us: what all segments cover and the kept ones don't, longer than half a second."""
    return span_subtract(every, kept, ["recording_id"]).where(F.col("end_us") - F.col("start_us") > HOLE_US)


def _closed(open_holes: list[tuple[int, int]], dropped: list[tuple[int, int, int]]) -> list[int]:
    """The ordinals of dropped segments (start, end, ordinal) that close holes, both of one stretch of a recording."""
    out: list[int] = []
    restored: list[tuple[int, int]] = []
    for lo, hi in sorted(open_holes):
        left = [(lo, hi)]
        for a, b in restored:
            left = _without(left, a, b)
        near = [(max(lo, a) - min(hi, b), a, b, i) for a, b, i in dropped if a < hi and lo < b]
        for _, a, b, i in sorted(near):
            wide = [x for x in left if x[1] - x[0] > HOLE_US]
            if not wide:
                break
            if i not in out and any(a < y and x < b for x, y in wide):
                out.append(i)
                restored.append((a, b))
                left = _without(left, a, b)
    return out


def _without(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    return [(x, y) for lo, hi in spans for x, y in ((lo, min(hi, a)), (max(lo, b), hi)) if x < y]


def restore_lost(dropped: DataFrame, open_holes: DataFrame) -> DataFrame:
    """Dropped segments (recording_id, ordinal, start_us, end_us and any more) that close holes (recording_id, start_us, end_us).

    Holes are taken from left to right, and for each the segments by how much of it
    they overlap (then start, end, ordinal): one is restored if it overlaps a piece
    that is still open for more than ``HOLE_US``, until there is none. What was
    restored for one hole also covers the next. Segments and holes that don't hang
    together have nothing to do with each other, so a task gets one such stretch,
    not a recording. Rows without an id or a time take no part.
    """
    spans = ["recording_id", "start_us", "end_us"]
    gaps = open_holes.select(*spans).where("start_us < end_us AND recording_id IS NOT NULL")
    rows = dropped.select(*spans, "ordinal").where("start_us < end_us AND recording_id IS NOT NULL AND ordinal IS NOT NULL")
    pairs = overlap_join(gaps, rows, ["recording_id"]).select("recording_id", F.col("r_start_us").alias("start_us"), F.col("r_end_us").alias("end_us"), "ordinal").distinct()
    stretches = merge_spans(gaps.unionByName(pairs.select(*spans)), ["recording_id"])
    every = gaps.withColumn("ordinal", F.lit(None).cast(dict(rows.dtypes)["ordinal"])).unionByName(pairs).withColumnsRenamed({"start_us": "own_start", "end_us": "own_end"})
    # a member of a stretch begins in it, so it lies in the last stretch that begins at or before it
    starts = stretches.select("recording_id", F.col("start_us").alias("own_start"), F.lit(True).alias("begins"))
    order = Window.partitionBy("recording_id").orderBy("own_start", F.col("begins").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = every.unionByName(starts, allowMissingColumns=True).withColumn("stretch", F.last(F.when(F.col("begins"), F.col("own_start")), ignorenulls=True).over(order)).where("begins IS NULL")

    def close(part: pa.Table) -> pa.Table:
        starts, ends, ordinals = (part.column(c).to_pylist() for c in ("own_start", "own_end", "ordinal"))
        found = _closed([(a, b) for a, b, i in zip(starts, ends, ordinals, strict=True) if i is None], [(a, b, i) for a, b, i in zip(starts, ends, ordinals, strict=True) if i is not None])
        return pa.table([part.column("recording_id").slice(0, 1).take(pa.array([0] * len(found), pa.int64())), pa.array(found, part.schema.field("ordinal").type)], names=["recording_id", "ordinal"])

    kinds = dict(placed.dtypes)
    found = placed.groupBy("recording_id", "stretch").applyInArrow(close, f"recording_id {kinds['recording_id']}, ordinal {kinds['ordinal']}")
    return dropped.join(found.distinct(), ["recording_id", "ordinal"], "left_semi")


def seam_duplicates(segments: DataFrame) -> DataFrame:
    """recording_id, ordinal of segments whose words, two or more, stand in a run in an overlapping segment of the chunk before."""
    words = F.array_join(seam_words(F.col("text")), " ")
    rows = segments.select("recording_id", "ordinal", "chunk", "start_us", "end_us", words.alias("words"))
    pairs = overlap_join(rows.withColumnsRenamed({"ordinal": "before", "chunk": "c", "words": "w"}), rows, ["recording_id"]).where("chunk = c + 1")
    held = F.call_function("contains", F.concat(F.lit(" "), "w", F.lit(" ")), F.concat(F.lit(" "), "words", F.lit(" ")))
    return pairs.where(held & (F.size(F.split("words", " ")) >= 2)).select("recording_id", "ordinal").distinct()


def cut_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments (with ``chunk``) and ``cut``: whether they come within half a second of an inner edge of their chunk's window."""
    order = Window.partitionBy("recording_id").orderBy("idx")
    edges = chunks.select("recording_id", F.col("idx").alias("chunk"), "win_start_us", "win_end_us", F.lag("idx").over(order).isNotNull().alias("has_before"), F.lead("idx").over(order).isNotNull().alias("has_after"))
    rows = segments.join(edges, ["recording_id", "chunk"], "left")
    cut = (F.col("has_before") & (F.col("start_us") < F.col("win_start_us") + CUT_US)) | (F.col("has_after") & (F.col("end_us") > F.col("win_end_us") - CUT_US))
    return rows.withColumn("cut", F.coalesce(cut, F.lit(False))).drop("win_start_us", "win_end_us", "has_before", "has_after")


def unplaced_words(rejected: DataFrame, kept: DataFrame) -> DataFrame:
    """Stretches of rejected segments that no kept one covers, over half a second long, at most 1,024 of a recording."""
    left = span_subtract(rejected, kept, ["recording_id"]).where(F.col("end_us") - F.col("start_us") > HOLE_US)
    return join_nearest(left, ["recording_id"], MAX_STRETCHES)


def settled_until(chunks: DataFrame) -> DataFrame:
    """recording_id, settled_us: the start of the first chunk that has no outcome yet (null: all have), before which nothing changes any more."""
    open_ = F.min(F.when(F.col("outcome").isin("pending", "not_reached"), F.col("win_start_us")))
    return chunks.groupBy("recording_id").agg(open_.alias("settled_us"))


def align_to_grid(ranges: DataFrame, stride_us: int, window_us: int) -> DataFrame:
    """Ranges widened to whole chunks of the grid: from a chunk's start to a chunk's end."""
    last = F.expr(f"greatest(0L, (end_us - 1 - {window_us - stride_us}) div {stride_us})")
    return ranges.withColumn("start_us", F.expr(f"(start_us div {stride_us}) * {stride_us}")).withColumn("end_us", F.greatest("end_us", last * stride_us + window_us))


def seam_spans(chunks: DataFrame, margin_us: int) -> DataFrame:
    """recording_id, start_us, end_us: overlaps of chunks that follow one another, widened by the margin and merged."""
    order = Window.partitionBy("recording_id").orderBy("idx")
    rows = chunks.withColumn("n", F.lead("win_start_us").over(order)).where("n < win_end_us")
    return merge_spans(rows.select("recording_id", (F.col("n") - margin_us).alias("start_us"), (F.col("win_end_us") + margin_us).alias("end_us")), ["recording_id"])
