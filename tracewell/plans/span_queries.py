"""Queries of the span algebra and the joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import spans
from tracewell.plans.registry import query

KEY = ["recording_id"]
#: A recursive union of spans in DuckDB, for any subquery with recording_id, start_us, end_us.
MERGED = """(SELECT recording_id, min(start_us) AS start_us, max(end_us) AS end_us FROM (
    SELECT *, sum(CASE WHEN before IS NULL OR start_us > before THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT recording_id, start_us, end_us, max(end_us) OVER (PARTITION BY recording_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {} s0 WHERE start_us < end_us) s1) s2
    GROUP BY recording_id, island)"""
TURNS = MERGED.format("{v_turns}")


@query("v_turns", sql=f"SELECT * FROM {TURNS} m")
def agg1_merge_spans(turns: DataFrame) -> DataFrame:
    return spans.merge_spans(turns, KEY)


@query("v_turns", sql=f"SELECT recording_id, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, count(*) AS ranges FROM {TURNS} m GROUP BY recording_id")
def agg2_span_total(turns: DataFrame) -> DataFrame:
    return spans.span_total(turns, KEY)


def _halves(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    return turns.where("cluster IN ('click', 'view')"), turns.where("cluster NOT IN ('click', 'view')")


_A = MERGED.format("(SELECT * FROM {v_turns} t WHERE cluster IN ('click', 'view'))")
_B = MERGED.format("(SELECT * FROM {v_turns} t WHERE cluster NOT IN ('click', 'view'))")
_CUTS = f"""(WITH a AS (SELECT * FROM {_A} x), b AS (SELECT * FROM {_B} x),
    t AS (SELECT recording_id, start_us AS t FROM a UNION SELECT recording_id, end_us FROM a UNION SELECT recording_id, start_us FROM b UNION SELECT recording_id, end_us FROM b),
    p AS (SELECT recording_id, t AS start_us, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS end_us FROM t)
    SELECT p.*, EXISTS (SELECT 1 FROM a WHERE a.recording_id = p.recording_id AND a.start_us < p.end_us AND p.start_us < a.end_us) AS in_a,
           EXISTS (SELECT 1 FROM b WHERE b.recording_id = p.recording_id AND b.start_us < p.end_us AND p.start_us < b.end_us) AS in_b
    FROM p WHERE end_us IS NOT NULL)"""


@query("v_turns", sql="SELECT * FROM " + MERGED.format(f"(SELECT * FROM {_CUTS} c WHERE in_a AND NOT in_b)") + " m")
def set2_span_subtract(turns: DataFrame) -> DataFrame:
    return spans.span_subtract(*_halves(turns), KEY)


@query("v_turns", sql="SELECT * FROM " + MERGED.format(f"(SELECT * FROM {_CUTS} c WHERE in_a AND in_b)") + " m")
def set3_span_intersect(turns: DataFrame) -> DataFrame:
    return spans.span_intersect(*_halves(turns), KEY)


@query("v_turns", sql=f"SELECT * FROM {TURNS} m")
def set1_span_union(turns: DataFrame) -> DataFrame:
    return spans.span_union(*_halves(turns), KEY)


@query("v_turns", sql=f"""SELECT recording_id, start_us, end_us FROM (
    SELECT recording_id, end_us AS start_us, coalesce(lead(start_us) OVER w, 64000000) AS end_us FROM {TURNS} m WINDOW w AS (PARTITION BY recording_id ORDER BY start_us)
    UNION ALL SELECT recording_id, 0, min(start_us) FROM {TURNS} m GROUP BY recording_id) g WHERE start_us < end_us""")
def set4_gaps_within(turns: DataFrame) -> DataFrame:
    bounds = turns.select("recording_id").distinct().selectExpr("recording_id", "0L AS start_us", "64000000L AS end_us")
    return spans.gaps_within(turns, bounds, KEY)


@query("v_turns", sql=f"""SELECT recording_id, min(start_us) AS start_us, max(end_us) AS end_us FROM (
    SELECT *, sum(CASE WHEN gap IS NOT NULL AND nth < 4 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_us) AS part FROM (
        SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY gap DESC NULLS LAST, start_us DESC) AS nth FROM (
            SELECT *, start_us - lag(end_us) OVER (PARTITION BY recording_id ORDER BY start_us) AS gap FROM {TURNS} m) g) n) p GROUP BY recording_id, part""")
def set5_join_nearest(turns: DataFrame) -> DataFrame:
    return spans.join_nearest(turns, KEY, 4)


@query("v_segments", sql="SELECT * FROM {v_segments} s WHERE start_us < 12000000 AND end_us > 7000000")
def flt1_in_range(segments: DataFrame) -> DataFrame:
    return spans.in_range(segments, 7_000_000, 12_000_000)


@query("v_samples", sql="SELECT recording_id, time_us FROM {v_samples} s WHERE time_us >= 5000000 AND time_us < 15000000")
def flt2_points_in_range(samples: DataFrame) -> DataFrame:
    return spans.points_in_range(samples, "time_us", 5_000_000, 15_000_000).select("recording_id", "time_us")


@query("v_turns", "v_segments", sql="""SELECT s.recording_id, s.ordinal, t.event_id, least(s.end_us, t.end_us) - greatest(s.start_us, t.start_us) AS overlap_us
    FROM {v_segments} s JOIN {v_turns} t ON s.recording_id = t.recording_id AND s.start_us < t.end_us AND t.start_us < s.end_us""")
def join1_overlap_join(turns: DataFrame, segments: DataFrame) -> DataFrame:
    return spans.overlap_join(segments.select("recording_id", "ordinal", "start_us", "end_us"), turns.select("recording_id", "event_id", "start_us", "end_us"), KEY).select("recording_id", "ordinal", "event_id", "overlap_us")


_ASOF = """SELECT t.recording_id, t.event_id, t.start_us AS at_us, CASE WHEN abs(f.time_us - t.start_us) <= 1000000 THEN f.time_us END AS time_us
    FROM {{v_turns}} t ASOF LEFT JOIN (SELECT recording_id, start_us AS time_us FROM {{v_segments}} s) f ON t.recording_id = f.recording_id AND t.start_us {} f.time_us"""


def _requests(turns: DataFrame, segments: DataFrame, forward: bool) -> DataFrame:
    frames = segments.select("recording_id", F.col("start_us").alias("time_us"))
    return spans.asof_join(turns.select("recording_id", "event_id", F.col("start_us").alias("at_us")), frames, KEY, "at_us", "time_us", 1_000_000, forward)


@query("v_turns", "v_segments", sql=_ASOF.format("<="))
def join3_frame_at_or_after(turns: DataFrame, segments: DataFrame) -> DataFrame:
    return _requests(turns, segments, True)


@query("v_turns", "v_segments", sql=_ASOF.format(">="))
def join4_frame_displayed_at(turns: DataFrame, segments: DataFrame) -> DataFrame:
    return _requests(turns, segments, False)


@query("v_turns", "v_segments", sql="""WITH f AS (SELECT recording_id, min(start_us) AS first_us, max(start_us) AS last_us, max(end_us) AS cover_us FROM {v_segments} s GROUP BY recording_id)
    SELECT t.recording_id, t.event_id, CASE WHEN f.recording_id IS NULL THEN 'outside_listing' WHEN t.start_us >= f.cover_us THEN 'at_or_after_end' WHEN t.start_us > f.last_us THEN 'after_final_frame'
        WHEN NOT EXISTS (SELECT 1 FROM {v_segments} s WHERE s.recording_id = t.recording_id AND s.start_us BETWEEN t.start_us AND t.start_us + 1000000) THEN 'no_frame_within_tolerance' ELSE 'found' END AS outcome
    FROM {v_turns} t LEFT JOIN f ON f.recording_id = t.recording_id""")
def join5_explain_selection(turns: DataFrame, segments: DataFrame) -> DataFrame:
    cover = segments.groupBy("recording_id").agg(F.max("start_us").alias("last_us"), F.max("end_us").alias("cover_us"))
    found = _requests(turns, segments, True).join(cover, "recording_id", "left")
    outcome = (
        F.when(F.col("cover_us").isNull(), "outside_listing").when(F.col("at_us") >= F.col("cover_us"), "at_or_after_end")
        .when(F.col("at_us") > F.col("last_us"), "after_final_frame").when(F.col("time_us").isNull(), "no_frame_within_tolerance").otherwise("found")
    )
    return found.select("recording_id", "event_id", outcome.alias("outcome"))


@query("v_samples", sql="""WITH n AS (SELECT recording_id, time_us, row_number() OVER (PARTITION BY recording_id ORDER BY time_us) AS rn FROM {v_samples} s)
    SELECT a.recording_id, a.time_us AS anchor_us, f.time_us, f.rn - a.rn AS place FROM n a JOIN n f ON a.recording_id = f.recording_id AND f.rn BETWEEN a.rn - 2 AND a.rn + 2 WHERE f.rn <> a.rn""")
def join6_neighbour_frames(samples: DataFrame) -> DataFrame:
    n = samples.select("recording_id", "time_us", F.row_number().over(Window.partitionBy("recording_id").orderBy("time_us")).cast("long").alias("rn"))
    anchors = n.select("recording_id", F.col("time_us").alias("anchor_us"), F.explode(F.array(*[F.lit(i).cast("long") for i in (-2, -1, 1, 2)])).alias("place"), "rn")
    wanted = anchors.withColumn("rn", F.col("rn") + F.col("place"))
    return wanted.join(n, ["recording_id", "rn"]).select("recording_id", "anchor_us", "time_us", "place")


@query("v_segments", "v_samples", sql="""WITH t AS (SELECT s.recording_id, s.ordinal, s.start_us + k * (s.end_us - s.start_us) // 4 AS target_us, s.end_us FROM {v_segments} s, (SELECT unnest(range(0, 4)) AS k) k),
    f AS (SELECT t.recording_id, t.ordinal, t.end_us, f.time_us FROM t ASOF JOIN {v_samples} f ON t.recording_id = f.recording_id AND t.target_us <= f.time_us)
    SELECT DISTINCT recording_id, ordinal, time_us FROM f WHERE time_us < end_us""")
def join7_burst_frames(segments: DataFrame, samples: DataFrame) -> DataFrame:
    targets = segments.select(F.col("recording_id").cast("int").alias("recording_id"), "ordinal", "end_us", F.explode(F.expr("transform(sequence(0, 3), k -> start_us + k * (end_us - start_us) div 4)")).alias("target_us"))
    found = spans.asof_join(targets, samples.select("recording_id", "time_us"), KEY, "target_us", "time_us")
    return found.where("time_us < end_us").select(F.col("recording_id").cast("long").alias("recording_id"), "ordinal", "time_us").distinct()


@query("v_turns", "v_segments", sql="""SELECT s.recording_id, s.ordinal, t.event_id FROM {v_segments} s JOIN {v_turns} t
    ON s.recording_id = t.recording_id AND s.start_us - 2000000 < t.end_us AND t.start_us < s.end_us + 2000000""")
def join11_candidates_near_hits(turns: DataFrame, segments: DataFrame) -> DataFrame:
    wide = segments.select("recording_id", "ordinal", (F.col("start_us") - 2_000_000).alias("start_us"), (F.col("end_us") + 2_000_000).alias("end_us"))
    return spans.overlap_join(wide, turns.select("recording_id", "event_id", "start_us", "end_us"), KEY).select("recording_id", "ordinal", "event_id")
