"""Queries of recognised speech, jobs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import seam_words
from tracewell.operators import evaluate as ev
from tracewell.operators import jobs
from tracewell.operators import speech as sp
from tracewell.plans.registry import query
from tracewell.plans.span_queries import MERGED

SEAM_WORDS = "list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))), lambda w: w <> '')"
RANGES = "(SELECT recording_id, min(start_us) AS start_us, max(end_us) AS end_us FROM {v_segments} s GROUP BY recording_id)"
PLAN = f"""(SELECT recording_id, idx, start_us + idx * 8000000 AS win_start_us, least(start_us + idx * 8000000 + 10000000, end_us) AS win_end_us FROM (
    SELECT *, unnest(range(0, greatest(1, 1 + CASE WHEN end_us - start_us > 10000000 THEN (end_us - start_us - 10000000 + 7999999) // 8000000 ELSE 0 END))) AS idx FROM {RANGES} r) x)"""
CORES = f"(SELECT *, coalesce((lag(win_end_us) OVER w + win_start_us) // 2, win_start_us) AS core_start_us, coalesce((win_end_us + lead(win_start_us) OVER w) // 2, win_end_us) AS core_end_us FROM {PLAN} p WINDOW w AS (PARTITION BY recording_id ORDER BY idx))"


def _plan(segments: DataFrame) -> DataFrame:
    return sp.plan_chunks(segments.groupBy("recording_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")), 10_000_000, 2_000_000)


@query("v_segments", sql=f"SELECT * FROM {PLAN} p")
def seam1_plan_chunks(segments: DataFrame) -> DataFrame:
    return _plan(segments)


@query("v_segments", sql=f"SELECT * FROM {CORES} c")
def win24_seam_cores(segments: DataFrame) -> DataFrame:
    return sp.seam_cores(_plan(segments))


OWNED = f"(SELECT s.recording_id, s.ordinal, s.ordinal % 3 AS chunk, c.idx AS owner, s.start_us, s.end_us FROM {{v_segments}} s JOIN {CORES} c ON c.recording_id = s.recording_id AND (s.start_us + s.end_us) // 2 >= c.core_start_us AND (s.start_us + s.end_us) // 2 < c.core_end_us)"


@query("v_segments", sql=f"""SELECT recording_id, ordinal, chunk, owner FROM {OWNED} o WHERE owner = chunk
    OR NOT EXISTS (SELECT 1 FROM {OWNED} m WHERE m.recording_id = o.recording_id AND m.owner = m.chunk AND m.chunk = o.owner AND m.start_us < o.end_us AND o.start_us < m.end_us)""")
def seam4_keep_owned(segments: DataFrame) -> DataFrame:
    marked = segments.withColumn("chunk", F.col("ordinal") % 3)
    return sp.keep_owned(marked, sp.seam_cores(_plan(segments))).select("recording_id", "ordinal", "chunk", "owner")


VALID = """(SELECT recording_id, ordinal, ordinal // 3 AS chunk, start_us, CASE WHEN verdict = 'kept' THEN least(end_us, 20000000) ELSE end_us END AS end_us, verdict FROM (
    SELECT *, CASE WHEN end_us <= start_us OR start_us >= 20000000 OR end_us > 30000000 THEN 'rejected' WHEN trim(text) = '' THEN 'removed' ELSE 'kept' END AS verdict FROM {v_segments} s) x)"""


def _validated(segments: DataFrame) -> DataFrame:
    return sp.validate_segments(segments.withColumn("decoded_us", F.lit(20_000_000)).withColumn("chunk", F.expr("ordinal div 3")))


@query("v_segments", sql=f"SELECT * FROM {VALID} v")
def flt4_validate_segments(segments: DataFrame) -> DataFrame:
    return _validated(segments).select("recording_id", "ordinal", "chunk", "start_us", "end_us", "verdict")


@query("v_segments", sql=f"""SELECT *, rejected = total OR (total < 4 AND rejected > 1) OR (total >= 4 AND rejected * 4 > total) AS unusable FROM (
    SELECT recording_id, chunk, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, count(*) AS total FROM {VALID} v GROUP BY recording_id, chunk) x""")
def agg12_unusable_chunks(segments: DataFrame) -> DataFrame:
    return sp.unusable_chunks(_validated(segments))


@query("v_chunks", sql="SELECT recording_id, count(*) FILTER (WHERE outcome = 'unusable') AS unusable, count(*) AS answered, count(*) FILTER (WHERE outcome = 'unusable') * 2 > count(*) AS fails FROM {v_chunks} c WHERE outcome IN ('transcribed', 'unusable') GROUP BY recording_id")
def agg13_run_fails(chunks: DataFrame) -> DataFrame:
    return sp.run_fails(chunks)


@query("documents", sql="SELECT source AS recording_id, CASE WHEN min(lang) = max(lang) THEN min(lang) END AS language FROM documents GROUP BY source")
def agg14_agreed_language(documents: DataFrame) -> DataFrame:
    return sp.agreed_language(documents.withColumn("recording_id", F.col("source")), "lang")


_OF = "SELECT recording_id, win_start_us AS start_us, win_end_us AS end_us FROM {{v_chunks}} c WHERE outcome IN ({})"
_COVERED = MERGED.format(f"({_OF.format(chr(39) + 'transcribed' + chr(39) + ', ' + chr(39) + 'silent' + chr(39))})")


@query("v_chunks", sql=f"SELECT recording_id, 'transcribed' AS kind, start_us, end_us FROM {_COVERED} m")
def agg3_transcript_coverage(chunks: DataFrame) -> DataFrame:
    none = chunks.where("false").select("recording_id", F.col("win_start_us").alias("start_us"), F.col("win_end_us").alias("end_us"))
    return sp.transcript_coverage(chunks, none).where("kind = 'transcribed'").select("recording_id", "kind", "start_us", "end_us")


@query("v_chunks", sql="""SELECT recording_id, CAST(sum(us) AS BIGINT) AS total_us FROM (SELECT recording_id, end_us - start_us AS us FROM """ + MERGED.format("(SELECT recording_id, win_start_us AS start_us, win_end_us AS end_us FROM {v_chunks} c)") + """ m) x GROUP BY recording_id""")
def eva10_coverage_adds_up(chunks: DataFrame) -> DataFrame:
    """Transcribed, untranscribed and pending stretches together are the searched windows."""
    none = chunks.where("false").select("recording_id", F.col("win_start_us").alias("start_us"), F.col("win_end_us").alias("end_us"))
    parts = sp.transcript_coverage(chunks, none).where("kind <> 'no_speech'")
    return parts.groupBy("recording_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


@query("v_segments", sql=f"SELECT recording_id, ordinal, CAST(n AS INTEGER) AS n, w[n + 1] AS word, start_us + ((end_us - start_us) * (2 * n + 1)) // (2 * len(w)) AS at_us FROM (SELECT *, {SEAM_WORDS} AS w, unnest(range(0, len({SEAM_WORDS}))) AS n FROM {{v_segments}} s) x")
def eva1_word_timeline(segments: DataFrame) -> DataFrame:
    return sp.word_timeline(segments)


@query("v_segments", sql=f"SELECT recording_id, ordinal, coalesce(lag({SEAM_WORDS}) OVER (PARTITION BY recording_id ORDER BY ordinal) = {SEAM_WORDS}, false) AS repeats FROM {{v_segments}} s")
def seam10_repeats(segments: DataFrame) -> DataFrame:
    return sp.repeats_before(segments).select("recording_id", "ordinal", "repeats")


@query("v_segments")
def win25_loops(segments: DataFrame) -> DataFrame:
    return sp.loops(segments).select("recording_id", "ordinal", "loops")


_CHAINS = MERGED.replace("start_us > before", "start_us >= before").format("{v_segments}")


@query("v_segments", sql=f"SELECT * FROM {_CHAINS} c")
def win14_segment_chains(segments: DataFrame) -> DataFrame:
    return sp.segment_chains(segments)


@query("v_segments", sql=f"SELECT recording_id, least(min(start_us), 8000000) AS start_us, greatest(max(end_us), 12000000) AS end_us FROM {_CHAINS} c WHERE start_us < 12000000 AND end_us > 8000000 GROUP BY recording_id")
def win15_snap_range(segments: DataFrame) -> DataFrame:
    return sp.snap_range(segments, 8_000_000, 12_000_000)


@query("v_segments", sql="SELECT recording_id, ordinal, start_us - 3000000 AS start_us, end_us - 3000000 AS end_us, CASE WHEN end_us <= 3000000 OR start_us >= 23000000 THEN 'outside' WHEN start_us < 3000000 OR end_us > 23000000 THEN 'across_edge' ELSE 'kept' END AS outcome FROM {v_segments} s")
def flt3_align_cues(segments: DataFrame) -> DataFrame:
    return sp.align_cues(segments, -3_000_000, 20_000_000).select("recording_id", "ordinal", "start_us", "end_us", "outcome")



@query("v_turns", sql="SELECT event_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, end_us, event_id) AS ordinal FROM {v_turns} t")
def win13_ordinals(turns: DataFrame) -> DataFrame:
    return sp.ordinals(turns.withColumn("ordinal", F.col("event_id"))).select("event_id", "ordinal")


# jobs
@query("v_job_events", sql="""SELECT job_id, event_id, from_state, to_state FROM (SELECT *, lag(to_state) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_state FROM {v_job_events} e) x
    WHERE from_state IS NOT NULL AND NOT coalesce(list_contains(map(['queued', 'running', 'committing', 'interrupted', 'cancelling'], [['running', 'cancelling', 'cancelled'], ['committing', 'interrupted', 'cancelling', 'failed'], ['succeeded', 'failed', 'interrupted'], ['running', 'cancelled', 'queued'], ['cancelled', 'failed']])[from_state], to_state), false)""")
def strm7_illegal_steps(events: DataFrame) -> DataFrame:
    return jobs.illegal_steps(events)


@query("v_job_events", sql="""SELECT job_id, state, CASE WHEN state IN ('running', 'committing') THEN 'live_owner' WHEN state = 'succeeded' THEN state WHEN state = 'queued' THEN 'not_started' ELSE 'interrupted' END AS resumability
    FROM (SELECT job_id, arg_max(to_state, {'ts': ts, 'e': event_id}) AS state FROM {v_job_events} e GROUP BY job_id) x""")
def strm8_resumability(events: DataFrame) -> DataFrame:
    return jobs.latest_states(events)


@query("events", sql="SELECT user_id AS job_id, event_id % 10 AS chunk, event_type AS code, count(*) AS times FROM events GROUP BY ALL HAVING count(*) >= 3")
def agg18_poisoned_chunks(events: DataFrame) -> DataFrame:
    return jobs.poisoned_chunks(events.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 10).alias("chunk"), F.col("event_type").alias("code")))


@query("orders", sql="""SELECT o_custkey AS batch_id, count(*) FILTER (WHERE s = 'complete') AS complete, count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s = 'failed') AS failed, 0::BIGINT AS cancelled, 0::BIGINT AS rejected
    FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' ELSE 'failed' END AS s FROM orders) x GROUP BY o_custkey""")
def agg17_batch_counts(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    return jobs.batch_counts(orders.select(F.col("o_custkey").alias("batch_id"), status.alias("status")))


@query("v_turns", sql="""SELECT "user", min(at_us) AS start_us, max(at_us) + 500000 AS end_us, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY "user" ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS nth FROM (
    SELECT recording_id AS "user", start_us AS at_us, CASE WHEN start_us - lag(start_us) OVER (PARTITION BY recording_id ORDER BY start_us) > 500000 IS NOT FALSE THEN 1 ELSE 0 END AS n FROM {v_turns} t) x) y GROUP BY "user", nth""")
def strm9_idle_sessions(turns: DataFrame) -> DataFrame:
    return jobs.idle_sessions(turns.select(F.col("recording_id").alias("user"), F.col("start_us").alias("at_us")), 500_000)


@query("v_turns", sql="""WITH a AS (SELECT recording_id AS session_id, start_us AS at_us, min(start_us) OVER (PARTITION BY recording_id) AS opened, lag(start_us) OVER (PARTITION BY recording_id ORDER BY start_us) AS p FROM {v_turns} t),
    d AS (SELECT session_id, min(at_us) FILTER (WHERE at_us - p >= 2000000 OR at_us >= opened + 20000000) AS dead FROM a GROUP BY session_id)
    SELECT a.session_id, least(max(at_us) + 2000000, min(opened) + 20000000) AS expires_us FROM a JOIN d USING (session_id) WHERE dead IS NULL OR at_us < dead GROUP BY a.session_id""")
def tim11_session_expiry(turns: DataFrame) -> DataFrame:
    return jobs.session_expiry(turns.select(F.col("recording_id").alias("session_id"), F.col("start_us").alias("at_us")), 2_000_000, 20_000_000)


@query("events", sql="SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def src11_latest_by_key(events: DataFrame) -> DataFrame:
    return jobs.latest_by_key(events, ("user_id", "event_type"), ("ts", "event_id")).select("event_id", "user_id", "event_type", "ts")


# evaluation
@query("conversations")
def agg19_word_error_rate(conversations: DataFrame) -> DataFrame:
    """Each turn against the one before it in its conversation, pooled by role."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = conversations.withColumn("before", before).where("before IS NOT NULL").repartition("conv_id", "turn")
    edits = pairs.select("role", ev.word_edits(seam_words(F.col("before")), seam_words(F.col("text"))).alias("e")).select("role", "e.*")
    return ev.pooled_word_error_rate(edits, "role")


@query("v_turns", "v_segments", sql="""WITH h AS (SELECT s.recording_id, s.ordinal, s.speaker AS kind, s.start_us, min(t.start_us) AS hit_us FROM {v_segments} s LEFT JOIN {v_turns} t ON t.recording_id = s.recording_id AND t.start_us >= s.start_us AND t.start_us < s.end_us GROUP BY ALL)
    SELECT kind, count(*) AS events, count(hit_us) AS hits, count(hit_us) * 10000 // count(*) AS recall_bp FROM h GROUP BY ROLLUP (kind)""")
def agg21_candidate_recall(turns: DataFrame, segments: DataFrame) -> DataFrame:
    truth = segments.select("recording_id", F.col("ordinal").alias("event_id"), F.col("speaker").alias("kind"), "start_us", "end_us")
    return ev.recall_by_kind(ev.candidate_recall(truth, turns.select("recording_id", F.col("start_us").alias("representative_us"))))


@query("lineitem", sql="""WITH r AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, count(*) AS readings, avg(q) FILTER (WHERE i IN ((n - 1) // 2, n // 2)) AS median, max(q) FILTER (WHERE i = (18 * (n - 1) + 10) // 20) AS p90, CAST(sum(q) AS BIGINT) AS total FROM r GROUP BY l_returnflag""")
def agg27_latency_summary(lineitem: DataFrame) -> DataFrame:
    return ev.latency_summary(lineitem.withColumn("q", F.col("l_quantity").cast("long")), ("l_returnflag",), "q")


CELLS = "(SELECT task_id, arm, count(*) AS runs, count(score) AS graded, CAST(sum(wrong) AS BIGINT) AS wrong, CASE WHEN count(score) = count(*) THEN sum(score) / count(*) END AS score FROM {v_grades} g GROUP BY task_id, arm)"


@query("v_grades", sql=f"SELECT * FROM {CELLS} c")
def agg28_trial_cells(grades: DataFrame) -> DataFrame:
    return ev.trial_cells(grades)


@query("v_grades", sql=f"""SELECT a.task_id, CASE WHEN a.score >= b.score - 0.10 AND a.wrong / a.runs <= b.wrong / b.runs THEN 'equal_or_better' WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 'loss' END AS verdict
    FROM {CELLS} a JOIN {CELLS} b ON a.task_id = b.task_id AND a.arm = 'fr' AND b.arm = 'en'""")
def agg29_compare_arms(grades: DataFrame) -> DataFrame:
    return ev.compare_arms(ev.trial_cells(grades), "fr", "en")


@query("v_grades", sql="SELECT arm, CAST(sum(score) AS BIGINT) * 10000 // count(score) AS rate_bp, CASE WHEN CAST(sum(score) AS BIGINT) * 10000 // count(score) >= 5000 THEN 'met' ELSE 'not_met' END AS gate FROM {v_grades} g GROUP BY arm")
def agg30_gate_lines(grades: DataFrame) -> DataFrame:
    return ev.gate_lines(grades, 5_000)


@query("events", sql="""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    p AS (SELECT *, CASE WHEN i >= n // 4 THEN (i - n // 4) * 4 // (n - n // 4) END AS part FROM r),
    m AS (SELECT user_id, max(value) AS peak, max(value) FILTER (WHERE part = 0) AS a, max(value) FILTER (WHERE part = 1) AS b, max(value) FILTER (WHERE part = 2) AS c, max(value) FILTER (WHERE part = 3) AS d FROM p GROUP BY user_id)
    SELECT user_id, peak, coalesce(b > a * 1.02 AND c > b * 1.02 AND d > c * 1.02 AND d > a * 1.2, false) AS grows FROM m""")
def eva14_monotonic_growth(events: DataFrame) -> DataFrame:
    return ev.monotonic_growth(events, ("user_id",), ("ts", "event_id"), "value")
