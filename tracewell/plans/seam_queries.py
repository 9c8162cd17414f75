"""Queries of seams and of clocks on screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.clock import read_clock_face
from tracewell.operators import clocks, seams
from tracewell.operators.speech import plan_chunks
from tracewell.plans.registry import query
from tracewell.plans.speech_queries import PLAN
from tracewell.plans.span_queries import MERGED


def _plan(segments: DataFrame) -> DataFrame:
    return plan_chunks(segments.groupBy("recording_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")), 10_000_000, 2_000_000)


_HOLES = f"""(WITH a AS (SELECT * FROM {MERGED.format('{v_segments}')} x), b AS (SELECT * FROM {MERGED.format("(SELECT * FROM {v_segments} s WHERE ordinal % 3 <> 0)")} y),
    t AS (SELECT recording_id, start_us AS t FROM a UNION SELECT recording_id, end_us FROM a UNION SELECT recording_id, start_us FROM b UNION SELECT recording_id, end_us FROM b),
    p AS (SELECT recording_id, t AS start_us, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS end_us FROM t)
    SELECT recording_id, start_us, end_us FROM p WHERE end_us IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.recording_id = p.recording_id AND a.start_us < p.end_us AND p.start_us < a.end_us)
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.recording_id = p.recording_id AND b.start_us < p.end_us AND p.start_us < b.end_us))"""


@query("v_segments", sql=f"SELECT * FROM {MERGED.format(_HOLES)} m WHERE end_us - start_us > 500000")
def seam6_holes(segments: DataFrame) -> DataFrame:
    return seams.holes(segments, segments.where("ordinal % 3 <> 0"))


@query("v_segments")
def seam6_restore_lost(segments: DataFrame) -> DataFrame:
    kept = segments.where("ordinal % 3 <> 0")
    return seams.restore_lost(segments.where("ordinal % 3 = 0"), seams.holes(segments, kept)).select("recording_id", "ordinal")


@query("v_segments", sql="SELECT recording_id, ordinal + 1000 AS ordinal FROM {v_segments} s WHERE len(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w <> '')) >= 2")
def seam7_duplicates(segments: DataFrame) -> DataFrame:
    """Every segment once more in the next chunk."""
    again = segments.withColumn("ordinal", F.col("ordinal") + 1000).withColumn("chunk", F.col("ordinal") % 1000 * 2 + 1)
    both = segments.withColumn("chunk", F.col("ordinal") * 2).unionByName(again)
    return seams.seam_duplicates(both).where("ordinal > 1000")


@query("v_segments", sql=f"""SELECT s.recording_id, s.ordinal, s.chunk, coalesce((b AND start_us < win_start_us + 500000) OR (a AND end_us > win_end_us - 500000), false) AS cut FROM (SELECT *, ordinal // 2 AS chunk FROM {{v_segments}} x) s
    LEFT JOIN (SELECT *, lag(idx) OVER w IS NOT NULL AS b, lead(idx) OVER w IS NOT NULL AS a FROM {PLAN} p WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) c ON c.recording_id = s.recording_id AND c.idx = s.chunk""")
def seam5_cut_segments(segments: DataFrame) -> DataFrame:
    return seams.cut_segments(segments.withColumn("chunk", F.expr("ordinal div 2")), _plan(segments)).select("recording_id", "ordinal", "chunk", "cut")


@query("v_segments", sql=f"SELECT * FROM {MERGED.format(_HOLES.replace('ordinal % 3 <> 0', 'ordinal % 2 = 0'))} m WHERE end_us - start_us > 500000")
def seam8_unplaced_words(segments: DataFrame) -> DataFrame:
    return seams.unplaced_words(segments, segments.where("ordinal % 2 = 0"))


@query("v_chunks", sql="SELECT recording_id, min(win_start_us) FILTER (WHERE outcome = 'pending') AS settled_us FROM {v_chunks} c GROUP BY recording_id")
def seam9_settled_until(chunks: DataFrame) -> DataFrame:
    return seams.settled_until(chunks)


@query("v_segments", sql="SELECT recording_id, ordinal, start_us // 8000000 * 8000000 AS start_us, greatest(end_us, greatest(0, (end_us - 1 - 2000000) // 8000000) * 8000000 + 10000000) AS end_us FROM {v_segments} s")
def seam2_align_to_grid(segments: DataFrame) -> DataFrame:
    return seams.align_to_grid(segments, 8_000_000, 10_000_000).select("recording_id", "ordinal", "start_us", "end_us")


@query("v_segments", sql="SELECT * FROM " + MERGED.format(f"(SELECT recording_id, n - 1000000 AS start_us, win_end_us + 1000000 AS end_us FROM (SELECT *, lead(win_start_us) OVER (PARTITION BY recording_id ORDER BY idx) AS n FROM {PLAN} p) x WHERE n < win_end_us)") + " m")
def eva2_seams(segments: DataFrame) -> DataFrame:
    return seams.seam_spans(_plan(segments), 1_000_000)


def _reads(lines: DataFrame) -> DataFrame:
    face = read_clock_face(F.col("text"))
    return lines.select("recording_id", "time_us", face.alias("f")).where("f.refusal IS NULL").select("recording_id", "time_us", "f.value_us", F.lit(1_000_000).cast("long").alias("unit_us"))


@query("v_clock_lines")
def win17_clock_runs(lines: DataFrame) -> DataFrame:
    return clocks.clock_runs(_reads(lines))


@query("v_clock_lines")
def win20_clock_jumps(lines: DataFrame) -> DataFrame:
    return clocks.clock_jumps(clocks.clock_runs(_reads(lines)))


@query("v_clock_lines")
def tim10_clock_kind(lines: DataFrame) -> DataFrame:
    reads = _reads(lines)
    return clocks.clock_kind(reads, clocks.clock_runs(reads))


@query("v_clock_lines", sql="""WITH r AS (SELECT recording_id, time_us, CAST(text[1:2] AS BIGINT) * 3600000000 AS v FROM {v_clock_lines} c WHERE NOT contains(text, ' ')),
    n AS (SELECT *, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY time_us) AS n FROM (SELECT *, lag(v) OVER (PARTITION BY recording_id ORDER BY time_us) AS p FROM r) x)
    SELECT recording_id, v AS value_us, min(time_us) AS first_us, max(time_us) AS last_us FROM n GROUP BY recording_id, n, v HAVING max(time_us) - min(time_us) > 1000000""")
def win20_frozen_stretches(lines: DataFrame) -> DataFrame:
    reads = _reads(lines).withColumn("value_us", F.expr("value_us div 3600000000 * 3600000000"))
    return clocks.frozen_stretches(reads)
