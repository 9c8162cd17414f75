"""Queries of listings, read targets and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import listing as ls
from tracewell.operators import visual
from tracewell.operators.evaluate import estimate_errors
from tracewell.operators.evidence import pending_ranges
from tracewell.plans.registry import query
from tracewell.plans.span_queries import MERGED

_STAMP = "(lpad(({0} // 3600000000)::VARCHAR, 2, '0') || ':' || lpad(({0} // 60000000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 1000000 % 60)::VARCHAR, 2, '0'))"


@query("v_segments", sql=f"""SELECT recording_id, string_agg(line, chr(10) ORDER BY start_us, kind, ordinal) AS text FROM (
    SELECT recording_id, start_us, 1 AS kind, ordinal, '[' || {_STAMP.format('start_us')} || '] ' || regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g') AS line FROM {{v_segments}} s
    UNION ALL SELECT recording_id, end_us, 0, 0, '[' || {_STAMP.format('end_us')} || '-' || {_STAMP.format('(end_us + 4000000)')} || '] (not transcribed: pending)' FROM {{v_segments}} s WHERE ordinal = 2) x GROUP BY recording_id""")
def src13_transcript_text(segments: DataFrame) -> DataFrame:
    gaps = segments.where("ordinal = 2").select("recording_id", F.col("end_us").alias("start_us"), (F.col("end_us") + 4_000_000).alias("end_us"), F.lit("pending").alias("reason"))
    return ls.transcript_text(segments, gaps)


@query("v_segments", sql="""SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, k, ordinal) AS place, start_us, end_us, CASE k WHEN 1 THEN 'speech' ELSE 'untranscribed' END AS kind, md5(text) AS text FROM (
    SELECT recording_id, start_us, 1 AS k, ordinal, end_us, regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g') AS text FROM {v_segments} s UNION ALL SELECT recording_id, end_us, 0, 0, end_us + 4000000, 'pending' FROM {v_segments} s WHERE ordinal = 2) x""")
def set17_transcript_entries(segments: DataFrame) -> DataFrame:
    gaps = segments.where("ordinal = 2").select("recording_id", F.col("end_us").alias("start_us"), (F.col("end_us") + 4_000_000).alias("end_us"), F.lit("pending").alias("reason"))
    return ls.transcript_entries(segments, gaps).withColumn("text", F.md5("text"))


@query("v_samples")
def src14_screen_changes_text(samples: DataFrame) -> DataFrame:
    return ls.screen_changes_text(visual.plan_screen_changes(visual.candidates(samples)))


_TARGETS = "(SELECT recording_id, start_us AS time_us, event_id % 2 = 0 AS candidate FROM {v_turns} t)"


@query("v_turns", "v_segments", sql=f"""SELECT recording_id, frame_us, list_sort(list(DISTINCT time_us)) AS targets FROM (SELECT t.recording_id, t.time_us, t.candidate, f.frame_us FROM {_TARGETS} t
    ASOF JOIN (SELECT DISTINCT recording_id, start_us AS frame_us FROM {{v_segments}} s) f ON t.recording_id = f.recording_id AND t.time_us <= f.frame_us) x WHERE frame_us - time_us <= CASE WHEN candidate THEN 0 ELSE 1000000 END GROUP BY recording_id, frame_us""")
def join19_resolve_read_targets(turns: DataFrame, segments: DataFrame) -> DataFrame:
    targets = turns.select("recording_id", F.col("start_us").alias("time_us"), (F.col("event_id") % 2 == 0).alias("candidate"))
    return ls.resolve_read_targets(targets, segments.select("recording_id", F.col("start_us").alias("time_us")))[0]



@query("v_citations", "v_evidence", sql="""SELECT report_id AS record_id, 'absent' AS violation FROM {v_citations} c WHERE evidence_id NOT IN (SELECT evidence_id FROM {v_evidence} e)
    UNION ALL SELECT report_id, 'delta' FROM {v_citations} c WHERE pos % 3 = 0""")
def int4_selection_violations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    picked = citations.select(F.col("report_id").alias("record_id"), "evidence_id", (F.col("pos") * 10).alias("requested_us"), (F.col("pos") * 10 + 3).alias("actual_us"), F.when(F.col("pos") % 3 == 0, 4).otherwise(3).alias("delta_us"))
    return ls.selection_violations(picked, evidence)


@query("v_citations", "part", sql="""WITH s AS (SELECT p_partkey AS segment_id, p_size AS recording_id, p_partkey % 3 AS revision FROM part) SELECT c.report_id, c.evidence_id AS segment_id, s.revision, s.revision < (SELECT max(revision) FROM s x WHERE x.recording_id = s.recording_id) AS superseded
    FROM {v_citations} c JOIN s ON s.segment_id = c.evidence_id""")
def int7_superseded_citations(citations: DataFrame, part: DataFrame) -> DataFrame:
    segments = part.select(F.col("p_partkey").alias("segment_id"), F.col("p_size").alias("recording_id"), (F.col("p_partkey") % 3).alias("revision"))
    return ls.superseded_citations(citations.select("report_id", F.col("evidence_id").alias("segment_id")), segments)


@query("v_turns", sql="""WITH p AS (SELECT recording_id AS job_id, start_us AS at_us, start_us * 100 // 60000000 AS percent, 60000000 - start_us + event_id AS remaining_us FROM {v_turns} t),
    e AS (SELECT job_id, max(at_us) AS end_us FROM p GROUP BY job_id), f AS (SELECT job_id, k, min({'a': at_us, 'r': remaining_us}) AS s FROM p, (SELECT unnest([10, 25, 50, 75]) AS k) k WHERE percent >= k GROUP BY job_id, k)
    SELECT f.job_id, CAST(k AS INTEGER) AS point, s.a AS at_us, s.r - (end_us - s.a) AS error_us FROM f JOIN e USING (job_id)""")
def eva13_estimate_errors(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("recording_id").alias("job_id"), F.col("start_us").alias("at_us"), F.expr("start_us * 100 div 60000000").alias("percent"), (60_000_000 - F.col("start_us") + F.col("event_id")).alias("remaining_us"))
    return estimate_errors(rows)


@query("v_turns", sql=f"""SELECT recording_id, start_us, end_us FROM (
    SELECT recording_id, end_us AS start_us, coalesce(lead(start_us) OVER w, 70000000) AS end_us FROM {MERGED.format('{v_turns}')} m WINDOW w AS (PARTITION BY recording_id ORDER BY start_us)) g WHERE start_us < end_us""")
def strm5_pending_ranges(turns: DataFrame) -> DataFrame:
    ranges = turns.groupBy("recording_id").agg(F.min("start_us").alias("start_us")).withColumn("end_us", F.lit(70_000_000).cast("long"))
    return pending_ranges(ranges, turns)
