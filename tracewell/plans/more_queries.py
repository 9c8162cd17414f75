"""Queries of the smaller operators and of text rules on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import jobs
from tracewell.operators import more as m
from tracewell.plans.registry import query
from tracewell.plans.span_queries import MERGED


@query("events", sql="SELECT event_id, epoch_us(ts) - event_id * 3600000000 * 24 BETWEEN 788918400000000 AND 1704067200000000 + 86400000000 AS plausible FROM events")
def flt9_plausible_time(events: DataFrame) -> DataFrame:
    at = F.expr("(unix_date(cast(ts AS date)) * 86400L + hour(ts) * 3600L + minute(ts) * 60L) * 1000000L + cast(extract(SECOND FROM ts) * 1000000 AS bigint)")
    reading = F.struct((at - F.col("event_id") * 86_400_000_000).alias("utc_us"), F.lit(None).cast("long").alias("local_us"))
    return events.select("event_id", reading.alias("r")).select("event_id", m.plausible_time("r", 1_704_067_200_000_000).alias("plausible"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'r' WHEN 'A' THEN 'A' END AS flag, l_returnflag = 'R' AS noted FROM lineitem")
def flt11_closed_vocabulary(lineitem: DataFrame) -> DataFrame:
    return m.closed_vocabulary(lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag")), "flag", ["r", "A"])


@query("v_segments", sql="SELECT recording_id, ordinal, start_us FROM {v_segments} s")
def flt6_brief_view(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id", "ordinal", "start_us")


@query("v_turns", sql="SELECT recording_id, cluster AS kind, count(*) AS count, min(event_id) AS first_ordinal FROM {v_turns} t GROUP BY ALL")
def agg10_warning_summary(turns: DataFrame) -> DataFrame:
    return m.warning_summary(turns.select("recording_id", F.col("cluster").alias("kind"), F.col("event_id").alias("ordinal")))


_PLAN = """(SELECT recording_id, time_us, bool_or(candidate) AS candidate FROM (SELECT recording_id, start_us AS time_us, true AS candidate FROM {v_turns} t WHERE cluster = 'click'
    UNION ALL SELECT recording_id, k * 1000000, false FROM (SELECT *, unnest(range((start_us + 999999) // 1000000, (end_us + 999999) // 1000000)) AS k FROM """ + MERGED.format("{v_turns}") + """ m) x) y GROUP BY recording_id, time_us)"""


def _plan(turns: DataFrame) -> DataFrame:
    from tracewell.operators.spans import merge_spans

    return m.read_plan(turns.where("cluster = 'click'").select("recording_id", F.col("start_us").alias("time_us")), merge_spans(turns, ["recording_id"]), 1_000_000)


@query("v_turns", sql=f"SELECT * FROM {_PLAN} p")
def set14_read_plan(turns: DataFrame) -> DataFrame:
    return _plan(turns)


@query("v_turns", sql=f"SELECT recording_id, time_us FROM {_PLAN} p WHERE time_us % 3000000 <> 0")
def set15_pending_targets(turns: DataFrame) -> DataFrame:
    done = _plan(turns).where("time_us % 3000000 = 0").select("recording_id", "time_us", F.lit("a").alias("engine"))
    return m.pending_targets(_plan(turns), done, "a").select("recording_id", "time_us")


@query("v_turns", sql=f"""SELECT *, pending = 0 AND failed = 0 AS complete FROM (SELECT recording_id, count(*) AS planned, count(*) FILTER (WHERE time_us % 3000000 = 0) AS read,
    count(*) FILTER (WHERE time_us % 3000000 = 1000000) AS failed, count(*) FILTER (WHERE time_us % 3000000 NOT IN (0, 1000000)) AS pending FROM {_PLAN} p GROUP BY recording_id) x""")
def agg9_screen_text_coverage(turns: DataFrame) -> DataFrame:
    plan = _plan(turns)
    done = plan.where("time_us % 3000000 IN (0, 1000000)").withColumn("outcome", F.when(F.col("time_us") % 3_000_000 == 0, "read").otherwise("failed"))
    return m.screen_text_coverage(plan, done)


@query("lineitem", sql="""SELECT l_orderkey AS recording_id, l_partkey AS pts, CASE WHEN bool_or(l_linenumber <= 3) THEN 'old' ELSE 'new' END AS outcome, list_sort(list(DISTINCT CAST(l_linenumber AS BIGINT))) AS targets FROM lineitem GROUP BY ALL""")
def set16_merge_screen_text(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select(F.col("l_orderkey").alias("recording_id"), F.col("l_partkey").alias("pts"), F.col("l_linenumber").cast("long").alias("n"))
    frames = lambda where, name: rows.where(where).groupBy("recording_id", "pts").agg(F.collect_set("n").alias("targets")).withColumn("outcome", F.lit(name))
    return m.merge_screen_text(frames("n <= 3", "old"), frames("n > 3", "new"))


@query("documents", sql="""SELECT count(*) AS found, count(*) FILTER (WHERE n = 1 AND lang <> 'es') AS searched, count(*) FILTER (WHERE n = 1 AND lang = 'es') AS unavailable, count(*) FILTER (WHERE n > 1) AS duplicates
    FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) x""")
def agg15_bundle_counts(documents: DataFrame) -> DataFrame:
    return m.bundle_counts(documents.select(F.sha2("text", 256).alias("manifest_sha256"), F.col("doc_id").alias("bundle_rank"), (F.col("lang") != "es").alias("readable")))


@query("lineitem", sql="""WITH s AS (SELECT l_orderkey AS task_id, l_suppkey AS step, sum(CAST(l_quantity AS BIGINT)) AS tokens, count(*) AS images FROM lineitem GROUP BY ALL), t AS (SELECT task_id, sum(tokens) AS tokens, max(images) AS images FROM s GROUP BY task_id)
    SELECT task_id, 'tokens' AS measure, CAST(tokens AS BIGINT) AS used, 150::BIGINT AS allowed FROM t WHERE tokens > 150 UNION ALL SELECT task_id, 'images', images, 1 FROM t WHERE images > 1""")
def agg31_budget_overruns(lineitem: DataFrame) -> DataFrame:
    calls = lineitem.select(F.col("l_orderkey").alias("task_id"), F.lit("p").alias("profile"), F.col("l_suppkey").alias("step"), F.col("l_quantity").cast("long").alias("tokens"), F.lit(1).cast("long").alias("images"))
    limits = lineitem.sparkSession.createDataFrame([("p", 150, 1)], "profile string, max_tokens long, max_images long")
    return m.budget_overruns(calls, limits)


@query("events", sql="SELECT user_id AS job_id, event_type AS stream, arg_max(props, {'t': ts, 'e': event_id}) AS state, max(event_id) AS done, count(*) AS total FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, event_type) AS x FROM events) e GROUP BY ALL")
def strm10_stream_statuses(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("user_id", "event_type")
    rows = events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stream"), F.col("props").alias("state"), F.max("event_id").over(by).alias("done"), F.count(F.lit(1)).over(by).alias("total"), "ts", "event_id")
    return m.stream_statuses(rows)


@query("v_turns", "v_segments", sql="""SELECT s.recording_id, s.ordinal AS label_id, EXISTS (SELECT 1 FROM {v_turns} t WHERE t.recording_id = s.recording_id AND t.cluster = 'error' AND s.start_us >= t.start_us - 500000 AND s.start_us < t.end_us + 500000) AS bracketed FROM {v_segments} s""")
def eva11_labelled_changes(turns: DataFrame, segments: DataFrame) -> DataFrame:
    return m.labelled_changes(segments.select("recording_id", F.col("ordinal").alias("label_id"), F.col("start_us").alias("at_us")), turns.where("cluster = 'error'"))


@query("v_clock_lines", sql="""SELECT recording_id, from_us, time_us AS to_us, CASE WHEN time_us - from_us > 500000 THEN (from_us + time_us) // 2 END AS read_next_us FROM (
    SELECT recording_id, time_us, v, lag(time_us) OVER w AS from_us, lag(v) OVER w AS was FROM (SELECT recording_id, time_us, CAST(text[1:2] AS BIGINT) * 3600000000 AS v FROM {v_clock_lines} c) x WINDOW w AS (PARTITION BY recording_id ORDER BY time_us)) y WHERE v - was = 3600000000""")
def win22_rollover_brackets(lines: DataFrame) -> DataFrame:
    reads = lines.select("recording_id", "time_us", (F.substring("text", 1, 2).cast("long") * 3_600_000_000).alias("value_us"))
    return m.rollover_brackets(reads, 3_600_000_000)


#: When each speaker speaks, however many of its turns overlap.
_SPEAKING = MERGED.replace("recording_id", "recording_id, cluster")


@query("v_turns", sql=f"""WITH r AS (SELECT recording_id, cluster AS ref, start_us, end_us FROM {_SPEAKING.format("(SELECT * FROM {v_turns} t WHERE event_id % 2 = 0)")} m), h AS (SELECT recording_id, cluster AS hyp, start_us, end_us FROM {_SPEAKING.format("(SELECT * FROM {v_turns} t WHERE event_id % 3 = 0)")} m),
    c AS (SELECT r.recording_id, greatest(r.start_us, h.start_us) AS start_us, least(r.end_us, h.end_us) AS end_us FROM r JOIN h ON r.recording_id = h.recording_id AND ref = hyp AND r.start_us < h.end_us AND h.start_us < r.end_us),
    b AS (SELECT recording_id, unnest([start_us, end_us]) AS t FROM {{v_turns}} t WHERE event_id % 2 = 0),
    e AS (SELECT recording_id, start_us AS t, 1 AS r, 0 AS h, 0 AS c, 0 AS m FROM r UNION ALL SELECT recording_id, end_us, -1, 0, 0, 0 FROM r UNION ALL SELECT recording_id, start_us, 0, 1, 0, 0 FROM h UNION ALL SELECT recording_id, end_us, 0, -1, 0, 0 FROM h
          UNION ALL SELECT recording_id, start_us, 0, 0, 1, 0 FROM c UNION ALL SELECT recording_id, end_us, 0, 0, -1, 0 FROM c UNION ALL SELECT recording_id, t - 250000, 0, 0, 0, 1 FROM b UNION ALL SELECT recording_id, t + 250000, 0, 0, 0, -1 FROM b),
    g AS (SELECT recording_id, t, sum(r) AS r, sum(h) AS h, sum(c) AS c, sum(m) AS m FROM e GROUP BY recording_id, t),
    s AS (SELECT * FROM (SELECT recording_id, lead(t) OVER w - t AS us, sum(r) OVER w AS r, sum(h) OVER w AS h, sum(c) OVER w AS c, sum(m) OVER w AS m FROM g WINDOW w AS (PARTITION BY recording_id ORDER BY t)) x WHERE us IS NOT NULL AND m = 0)
    SELECT recording_id, CAST(sum(r * us) AS BIGINT) AS speech_us, CAST(sum(greatest(0, r - h) * us) AS BIGINT) AS missed_us, CAST(sum(greatest(0, h - r) * us) AS BIGINT) AS false_us, CAST(sum((least(r, h) - c) * us) AS BIGINT) AS confused_us FROM s GROUP BY recording_id""")
def agg22_diarization_error(turns: DataFrame) -> DataFrame:
    side = lambda where, name: turns.where(where).select("recording_id", F.col("cluster").alias(name), "start_us", "end_us")
    pairs = turns.select("recording_id", F.col("cluster").alias("ref"), F.col("cluster").alias("hyp")).distinct()
    return m.diarization_error(side("event_id % 2 = 0", "ref"), side("event_id % 3 = 0", "hyp"), pairs)


@query("orders", "customer", sql="""WITH r AS (SELECT c_custkey AS key, concat('d', c_custkey % 5) AS digest, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 2500 THEN 'running' WHEN c_acctbal < 5000 THEN 'cancelled' ELSE 'succeeded' END AS state FROM customer WHERE c_custkey % 3 <> 0),
    q AS (SELECT o_orderkey AS request_id, o_custkey AS key, concat('d', (o_custkey + o_orderkey % 2) % 5) AS digest FROM orders)
    SELECT request_id, CASE WHEN r.key IS NULL THEN 'start' WHEN r.digest <> q.digest THEN 'conflict' WHEN state = 'running' THEN 'continue' ELSE 'replay' END AS verdict FROM q LEFT JOIN r ON r.key = q.key""")
def strm13_idempotent_requests(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as requests against what the customers' records say."""
    requests = orders.selectExpr("o_orderkey AS request_id", "o_custkey AS key", "concat('d', (o_custkey + o_orderkey % 2) % 5) AS digest")
    state = "CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 2500 THEN 'running' WHEN c_acctbal < 5000 THEN 'cancelled' ELSE 'succeeded' END AS state"
    return jobs.idempotent_requests(requests, customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS key", "concat('d', c_custkey % 5) AS digest", state))


_STORED = "SELECT concat('k:', recording_id % 9) AS recognition_key, recording_id, idx, win_start_us, win_end_us + CASE WHEN value < 20 THEN 1000000 ELSE 0 END AS win_end_us, outcome FROM {v_chunks} c"


@query("v_chunks", sql=f"""WITH c AS ({_STORED}), s AS (SELECT DISTINCT recognition_key, idx, win_start_us, win_end_us FROM c WHERE outcome = 'transcribed' AND recording_id % 3 = 0)
    SELECT recording_id, idx FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.recognition_key = c.recognition_key AND s.idx = c.idx AND s.win_start_us = c.win_start_us AND s.win_end_us = c.win_end_us)""")
def strm12_checkpoint_reuse(chunks: DataFrame) -> DataFrame:
    """What is still to be worked out: chunks whose key, number or window no stored answer has; windows differ by recording."""
    keyed = chunks.sparkSession.sql(_STORED, v_chunks=chunks)
    return jobs.checkpoint_reuse(keyed, keyed.where("outcome = 'transcribed' AND recording_id % 3 = 0"))[1].select("recording_id", "idx")


_PROGRESS = """SELECT recording_id, idx, idx * 1000000 AS from_us, idx * 1000000 + elapsed AS done_until_us, (idx % 7) * 9000000 + idx * 1000000 AS to_us, elapsed AS fresh_media_us, CASE WHEN idx % 11 = 0 THEN 0 ELSE elapsed * (1 + recording_id % 5) END AS fresh_elapsed_us, idx % 4 AS fresh_chunks
    FROM (SELECT *, CAST(floor(value * 100000) AS bigint) AS elapsed FROM {v_chunks} c) e"""


@query("v_chunks", sql=f"""SELECT recording_id, idx, CAST(least(100, floor(done * 100 / total)) AS BIGINT) AS percent, CAST(trunc(media * 1000 / spent) AS BIGINT) AS speed_milli, CASE WHEN fresh_chunks >= 2 AND fresh_elapsed_us >= 20000000 THEN CAST(trunc((to_us - done_until_us)::DECIMAL(38, 0) * fresh_elapsed_us // media) AS BIGINT) END AS remaining_us
    FROM (SELECT *, done_until_us - from_us AS done, CASE WHEN to_us > from_us THEN to_us - from_us END AS total, CASE WHEN fresh_media_us > 0 THEN fresh_media_us END AS media, CASE WHEN fresh_elapsed_us > 0 THEN fresh_elapsed_us END AS spent FROM ({_PROGRESS}) p) x""")
def num9_progress_figures(chunks: DataFrame) -> DataFrame:
    return jobs.progress_figures(chunks.sparkSession.sql(_PROGRESS, v_chunks=chunks)).select("recording_id", "idx", "percent", "speed_milli", "remaining_us")


@query("v_reports", sql="SELECT report_id, replace(text, chr(8203), '<U+200B>') AS shown FROM {v_reports} r")
def str8_render_hidden(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", text.render_hidden(F.col("text")).alias("shown"))


@query("pages", sql="SELECT page_id, sha256(regexp_replace(regexp_replace(html, '</?[A-Za-z][^<>]{0,254}>', '', 'g'), '\\{\\\\[^{}]{0,253}\\}', '', 'g')) AS text_sha256 FROM pages")
def str11_strip_markup(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.sha2(text.strip_markup(F.col("html")), 256).alias("text_sha256"))


@query("documents", sql="SELECT doc_id, 'src_sha256_' || sha256(text) AS source_id FROM documents")
def str21_source_id(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.concat(F.lit("src_sha256_"), F.sha2("text", 256)).alias("source_id"))
