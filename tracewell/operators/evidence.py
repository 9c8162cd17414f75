"""Evidence, revisions and anchors: latest records, lineage, integrity, and clock time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import derive_id
from tracewell.operators.spans import merge_spans, overlap_join, span_subtract

#: Sources of a time anchor from the best to the least, and how far two may be apart.
LADDER = ("operator", "creation_date_tag", "confirmed_screen_clock", "container_time", "screen_timestamp", "screen_clock")
CONSISTENT_US, SAME_GAP_US = 2_000_000, 60_000_000


def reusable_records(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests with the newest complete record of their request key."""
    good = records.where("partial_reason IS NULL AND tool IS NOT NULL").groupBy("request_key").agg(F.max_by("record_id", "number").alias("record_id"))
    return requests.join(good, "request_key")


def item_by_id(items: DataFrame) -> DataFrame:
    """For each item the newest record that holds it."""
    return items.groupBy("evidence_id").agg(F.max_by("record_id", "number").alias("record_id"), F.max("number").alias("number"))


def item_conflicts(items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """evidence_id, versions of ids that name more than one thing."""
    return items.groupBy("evidence_id").agg(F.countDistinct(F.struct(*columns)).alias("versions")).where("versions > 1")


def lineage(segments: DataFrame) -> DataFrame:
    """Segments with the text of the segment they were carried from, found by (revision, segment)."""
    origin = segments.select(F.col("revision_id").alias("from_revision"), F.col("segment_id").alias("from_segment"), F.col("text").alias("origin_text"))
    return segments.join(origin, ["from_revision", "from_segment"], "left")


def splice_revision(base: DataFrame, run: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """The base's segments outside the replaced range and the run's own, renumbered; ``carried`` says which the base gave."""
    outside = base.where((F.col("end_us") <= from_us) | (F.col("start_us") >= to_us)).withColumn("carried", F.lit(True))
    both = outside.unionByName(run.withColumn("carried", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("recording_id").orderBy("start_us", "end_us", F.desc("carried"), "ordinal")
    return both.withColumn("ordinal", F.row_number().over(order).cast("long"))


def verify_revision(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """recording_id, ordinal, violation: ordinals not 1..n in order of start, spans empty or outside the recording."""
    order = Window.partitionBy("recording_id").orderBy("ordinal")
    rows = segments.join(durations, "recording_id").withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("start_us").over(order))
    kinds = F.array(
        F.when(F.col("n") != F.col("ordinal"), "ordinal"), F.when(F.col("start_us") < F.col("before"), "order"),
        F.when(F.col("end_us") <= F.col("start_us"), "empty"), F.when((F.col("start_us") < 0) | (F.col("end_us") > F.col("duration_us")), "outside"),
    )
    return rows.select("recording_id", "ordinal", F.explode(F.array_compact(kinds)).alias("violation"))


def verify_identities(rows: DataFrame, prefix: str, domain: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose ``id`` isn't the one that their columns derive."""
    return rows.where(F.col("id") != derive_id(prefix, domain, *[F.col(c) for c in columns]))


def retained_manifest(artifacts: DataFrame) -> DataFrame:
    """recording_id, artifacts, bytes, manifest_sha256: a digest over each artifact's name and digest, in order.

    Artifacts (recording_id, name, sha256, bytes) are gathered by recording; a manifest is a short list.
    """
    listed = F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha256")))
    return artifacts.groupBy("recording_id").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(listed, "\n"), 256).alias("manifest_sha256"))


def select_anchor(anchors: DataFrame) -> DataFrame:
    """The best anchor of each recording, by source and then rank."""
    place = F.array_position(F.array(*[F.lit(s) for s in LADDER]), F.col("source"))
    best = Window.partitionBy("recording_id").orderBy(place, "rank", "media_us")
    return anchors.where(place > 0).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def anchor_consistency(anchors: DataFrame) -> DataFrame:
    """recording_id, verdict of anchors (utc_us at media_us, precision_us): ``conflicting``, ``consistent``, or ``single`` if none can be compared.

    The start that an anchor implies lies in utc_us - media_us plus or minus its
    precision; two conflict if these are over two seconds apart, which the greatest
    lower and least upper bound show without pairing anchors.
    """
    start = F.col("utc_us") - F.col("media_us")
    rows = anchors.where("utc_us IS NOT NULL").groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(start - F.col("precision_us")).alias("low"), F.min(start + F.col("precision_us")).alias("high")
    )
    return rows.select("recording_id", F.when(F.col("n") < 2, "single").when(F.col("low") - F.col("high") > CONSISTENT_US, "conflicting").otherwise("consistent").alias("verdict"))


def clock_time_at(items: DataFrame, anchors: DataFrame, gaps: DataFrame) -> DataFrame:
    """Items (recording_id, item_id, media_us) with utc_us and part: the anchor's time moved along, plus the accepted gaps between.

    Items and gaps are put in one order of time and the gaps summed up, so none is
    paired. A gap that isn't accepted moves nothing but begins a new part.
    """
    order = Window.partitionBy("recording_id").orderBy("t", F.col("item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    steps = gaps.select("recording_id", F.col("at_us").alias("t"), F.when(F.col("state") == "accepted", F.col("jump_us")).otherwise(0).alias("jump"), F.lit(1).alias("part"))
    asked = items.select("recording_id", F.col("media_us").alias("t"), F.struct("item_id", "media_us").alias("item"))
    marks = anchors.select("recording_id", F.col("media_us").alias("t"), F.struct(F.lit(None).cast("long").alias("item_id"), "media_us").alias("item"), F.col("utc_us"))
    rows = steps.unionByName(asked, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("moved", F.coalesce(F.sum("jump").over(order), F.lit(0))).withColumn("part", F.coalesce(F.sum("part").over(order), F.lit(0)))
    base = rows.where("utc_us IS NOT NULL").select("recording_id", F.col("utc_us").alias("base_us"), F.col("t").alias("base_t"), F.col("moved").alias("base_moved"))
    out = rows.where("item IS NOT NULL AND utc_us IS NULL").join(base, "recording_id", "left")
    return out.select("recording_id", "item.item_id", (F.col("base_us") + F.col("t") - F.col("base_t") + F.col("moved") - F.col("base_moved")).alias("utc_us"), "part")


def same_gap(gaps: DataFrame, jumps: DataFrame) -> DataFrame:
    """recording_id, gap_id, jump_id of gaps and jumps a minute apart at most whose ranges meet."""
    near = overlap_join(
        gaps.select("recording_id", "gap_id", "low", "high", (F.col("at_us") - SAME_GAP_US).alias("start_us"), (F.col("at_us") + SAME_GAP_US + 1).alias("end_us")),
        jumps.select("recording_id", "jump_id", F.col("low").alias("j_low"), F.col("high").alias("j_high"), F.col("at_us").alias("start_us"), (F.col("at_us") + 1).alias("end_us")), ["recording_id"], 60_000_000,
    )
    return near.where("low <= j_high AND j_low <= high").select("recording_id", "gap_id", "jump_id")


def missing_windows(grid: DataFrame, recorded: DataFrame) -> DataFrame:
    return grid.join(recorded, ["recording_id", "ordinal"], "left_anti")


def analysed_ranges(windows: DataFrame) -> DataFrame:
    """Ranges of windows that follow one another, undecodable ones left out."""
    return merge_spans(windows.where("outcome <> 'undecodable'"), ["recording_id"])


def coverage_gaps(grid: DataFrame, windows: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us, reason: windows not analysed, not decodable, or over budget."""
    none = missing_windows(grid, windows).select("recording_id", "start_us", "end_us", F.lit("not_analyzed").alias("reason"))
    bad = windows.where("outcome = 'undecodable'").select("recording_id", "start_us", "end_us", F.lit("undecodable").alias("reason"))
    full = windows.where("dropped > 0").select("recording_id", "start_us", "end_us", F.lit("budget_exhausted").alias("reason"))
    return none.unionByName(bad).unionByName(full)


def envelope_coverage(gaps: DataFrame) -> DataFrame:
    """recording_id, ranges, total_us, reasons: gaps merged across reasons, and the reasons in their fixed order."""
    order = F.array(*[F.lit(r) for r in ("not_analyzed", "undecodable", "budget_exhausted", "no_decoded_frame")])
    merged = merge_spans(gaps, ["recording_id"]).groupBy("recording_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))
    reasons = gaps.groupBy("recording_id").agg(F.array_intersect(order, F.collect_set("reason")).alias("reasons"))
    return merged.join(reasons, "recording_id")


def merge_extension(old: DataFrame, new: DataFrame) -> DataFrame:
    """Windows of both, one for each ordinal, the old one first."""
    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("recording_id", "ordinal").orderBy("__p"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n", "__p")


def pending_ranges(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """What of the ranges still to be published no segment covers."""
    return span_subtract(ranges, segments, ["recording_id"])


def top_regions(regions: DataFrame, n: int = 8) -> DataFrame:
    """The n regions with the most changed pixels of each change (then by y, x), and ``left_out``, how many others it has."""
    by = Window.partitionBy("change_id")
    rows = regions.withColumn("rank", F.row_number().over(by.orderBy(F.desc("changed_pixels"), "y", "x"))).withColumn("left_out", F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)).over(by) - n))
    return rows.where(F.col("rank") <= n)
