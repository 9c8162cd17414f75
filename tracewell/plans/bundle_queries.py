"""Queries of search over many recordings, and of handoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import handoff as h
from tracewell.operators import search as s
from tracewell.operators import search_all as a
from tracewell.plans.registry import query
from tracewell.plans.text_queries import FULL_WORDS, HITS, TIER

ASKED = "that with"
#: Segments as lines of a screen, three places in turn.
_SHOWN = "(SELECT recording_id, start_us AS time_us, ordinal % 3 AS line_no, text FROM {{v_segments}} g)"


def _runs(lines: str) -> str:
    return f"""(WITH l AS (SELECT recording_id, time_us, line_no, array_to_string({FULL_WORDS.format('text')}, ' ') AS words, dense_rank() OVER (PARTITION BY recording_id ORDER BY time_us) AS frame FROM {lines} x),
        d AS (SELECT DISTINCT * FROM l WHERE words <> ''),
        r AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, line_no, words ORDER BY frame) AS run FROM d)
        SELECT recording_id, line_no, words AS text, min(time_us) AS first_us, max(time_us) AS last_us, count(*) AS frames FROM r GROUP BY recording_id, line_no, r.words, run)"""


def _shown_hits(lines: str) -> str:
    return f"(SELECT * FROM (SELECT *, {TIER} AS tier FROM {_runs(lines)} runs) t WHERE tier IS NOT NULL)"


_SHOWN = _SHOWN.replace("{{", "{").replace("}}", "}")
_UNION = f"""(SELECT recording_id, 'transcript' AS kind, tier, start_us, end_us, ordinal FROM {HITS} h
    UNION ALL SELECT recording_id, 'screen_text', tier, first_us, last_us, line_no FROM {_shown_hits(_SHOWN)} s)"""
_BUNDLES = "(SELECT conv_id AS bundle_id, conv_id // 3 AS digest, conv_id AS recording_id, conv_id % 7 <> 0 AS readable, conv_id % 5 <> 0 AS has_transcript, conv_id % 2 = 0 AS has_screen_text FROM (SELECT DISTINCT conv_id FROM conversations) c)"
_KNOWN = f"(SELECT *, CASE WHEN NOT readable THEN 'unreadable' WHEN bundle_id > min(bundle_id) OVER (PARTITION BY digest) THEN 'duplicate' ELSE 'searched' END AS status FROM {_BUNDLES} b)"
_PLACED = f"""(SELECT k.bundle_id, u.*, row_number() OVER (PARTITION BY k.bundle_id, tier ORDER BY start_us, kind = 'screen_text', ordinal) AS sequence FROM {_UNION} u JOIN {_KNOWN} k USING (recording_id)
    WHERE status = 'searched' AND CASE WHEN kind = 'transcript' THEN has_transcript ELSE has_screen_text END)"""


def _shown(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id", F.col("start_us").alias("time_us"), (F.col("ordinal") % 3).alias("line_no"), "text")


def _bundles(conversations: DataFrame) -> DataFrame:
    c = F.col("conv_id")
    rows = conversations.select("conv_id").distinct()
    return rows.select(c.alias("bundle_id"), F.expr("conv_id div 3").alias("digest"), c.alias("recording_id"), (c % 7 != 0).alias("readable"), (c % 5 != 0).alias("has_transcript"), (c % 2 == 0).alias("has_screen_text"))


@query("v_lines", sql=f"SELECT recording_id, line_no, md5(text) AS words, first_us, last_us, frames, tier FROM {_shown_hits('{v_lines}')} h")
def str6_search_screen_text(lines: DataFrame) -> DataFrame:
    return a.search_screen_text(lines.withColumn("line_no", F.col("line_no").cast("long")), ASKED).withColumn("words", F.md5("words"))


@query("v_segments", sql=f"SELECT recording_id, ordinal, tier, row_number() OVER (PARTITION BY recording_id ORDER BY tier, ordinal)::INTEGER AS rank FROM {HITS} h")
def sort4_rank_hits(segments: DataFrame) -> DataFrame:
    return a.rank_hits(s.search(segments, ASKED)).select("recording_id", "ordinal", "tier", "rank")


@query("v_segments", sql=f"SELECT * FROM {_UNION} u")
def set10_union_hits(segments: DataFrame) -> DataFrame:
    return a.union_hits(s.search(segments, ASKED), a.search_screen_text(_shown(segments), ASKED))


@query("conversations", sql=f"SELECT bundle_id, min(bundle_id) OVER (PARTITION BY digest) AS first_id, bundle_id = min(bundle_id) OVER (PARTITION BY digest) AS kept FROM {_BUNDLES} b")
def set11_distinct_bundles(conversations: DataFrame) -> DataFrame:
    return a.distinct_bundles(_bundles(conversations)).select("bundle_id", "first_id", "kept")


@query("conversations", "v_segments", sql=f"SELECT bundle_id, kind, tier, start_us, ordinal, sequence::INTEGER AS sequence, row_number() OVER (ORDER BY tier, sequence, bundle_id)::INTEGER AS rank FROM {_PLACED} p QUALIFY rank <= 100")
def str7_search_bundles(conversations: DataFrame, segments: DataFrame) -> DataFrame:
    return a.search_bundles(_bundles(conversations), segments, _shown(segments), ASKED, 100)[0].select("bundle_id", "kind", "tier", "start_us", "ordinal", "sequence", "rank")


@query("conversations", "v_segments", sql=f"""SELECT k.bundle_id, status, CASE WHEN status = 'searched' THEN concat_ws('+', CASE WHEN has_transcript THEN 'transcript' END, CASE WHEN has_screen_text THEN 'screen_text' END) END AS covered, count(p.bundle_id) AS hits
    FROM {_KNOWN} k LEFT JOIN {_PLACED} p ON p.bundle_id = k.bundle_id GROUP BY k.bundle_id, status, has_transcript, has_screen_text""")
def str7_bundle_coverage(conversations: DataFrame, segments: DataFrame) -> DataFrame:
    return a.search_bundles(_bundles(conversations), segments, _shown(segments), ASKED, 100)[1]


@query("v_citations", "v_segments", sql="SELECT report_id, pos FROM {v_citations} c WHERE NOT EXISTS (SELECT 1 FROM {v_segments} g WHERE g.recording_id = c.evidence_id AND g.ordinal = c.pos)")
def join8_segments_not_in_store(citations: DataFrame, segments: DataFrame) -> DataFrame:
    cited = citations.select("report_id", "pos", F.col("evidence_id").alias("recording_id"), F.col("pos").alias("ordinal"))
    return h.not_in_store(cited, segments, ["recording_id", "ordinal"]).select("report_id", "pos")


#: An order as a handoff: a claim for each line that cites the part (every fifth line cites a part of its own, every third supplier's none).
_HANDOFF = """(SELECT o.o_orderkey AS report_id, l.*, o_orderdate AS a, o_totalprice, o_custkey, o_orderstatus FROM orders o JOIN (
    SELECT l_orderkey, list({'n': l_linenumber, 'id': l_partkey % 50, 'cites': CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_partkey END, 'part': l_partkey, 'kind': CASE WHEN l_suppkey % 2 = 0 THEN 'image' ELSE 'text' END, 'seen': l_linenumber % 3 = 0, 'held': l_partkey % 5 <> 0}) AS ls FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""
_RULES = {
    "duplicate_claim_id": "len(list_distinct(list_transform(ls, lambda x: x.id))) < len(ls)",
    "duplicate_citation_id": "len(list_distinct(list_transform(list_filter(ls, lambda x: x.held), lambda x: x.part))) < len(list_filter(ls, lambda x: x.held))",
    "missing_citation": "len(list_filter(ls, lambda x: x.cites IS NOT NULL AND NOT x.held)) > 0",
    "unused_citation": "len(list_filter(ls, lambda x: x.held AND NOT list_contains(list_transform(ls, lambda y: y.cites), x.part))) > 0",
    "claim_without_citation": "len(list_filter(ls, lambda x: x.cites IS NULL)) > 0",
    "image_without_access": "o_custkey % 4 = 0 AND len(list_filter(ls, lambda x: x.held AND x.kind = 'image')) > 0",
    "only_uninspected_images": "len(list_filter(ls, lambda x: x.held)) > 0 AND len(list_filter(ls, lambda x: x.held AND (x.kind <> 'image' OR x.seen))) = 0",
    "reversed_window": "o_custkey % 100 >= report_id % 97",
    "resume_card_missing": "o_orderstatus = 'P' AND o_custkey % 3 = 0",
    "resume_card_too_long": "o_custkey % 3 <> 0 AND 8 * (o_custkey % 400) > 2048",
    "budget_differs": "report_id % 10 = 0",
}


@query("orders", "lineitem", sql=" UNION ALL ".join(f"SELECT report_id, '{name}' AS finding FROM {_HANDOFF} h WHERE {rule}" for name, rule in _RULES.items()))
def jsn3_handoff_rules(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    claim = F.struct((F.col("l_partkey") % 50).cast("string").alias("id"), F.when(F.col("l_suppkey") % 3 != 0, F.array(part)).otherwise(F.array().cast("array<string>")).alias("citations"))
    held = F.when(F.col("l_partkey") % 5 != 0, F.struct(part.alias("id"), F.when(F.col("l_suppkey") % 2 == 0, "image").otherwise("text").alias("kind"), (F.col("l_linenumber") % 3 == 0).alias("inspected")))
    lines = lineitem.groupBy(F.col("l_orderkey").alias("report_id")).agg(F.collect_list(claim).alias("claims"), F.collect_list(held).alias("citations"))
    # the cards are written after the join, and no side of it is broadcast: both are far larger than the files they are estimated from
    rows = orders.withColumnRenamed("o_orderkey", "report_id").join(lines.hint("merge"), "report_id")
    own = rows.select(
        "report_id", "claims", "citations", (F.col("o_custkey") % 100).alias("from_us"), (F.col("report_id") % 97).alias("to_us"), (F.col("o_custkey") % 4 != 0).alias("image_access"), (F.col("o_orderstatus") == "P").alias("cut_short"),
        F.when(F.col("o_custkey") % 3 != 0, F.repeat(F.lit("resumed "), (F.col("o_custkey") % 400).cast("int"))).alias("resume_card"), F.lit(7).alias("budget_limit"), F.when(F.col("report_id") % 10 != 0, 7).alias("budget_stated"),
    )
    return h.handoff_rules(own.withColumn("resume_card", F.when(F.col("resume_card") == "", "-").otherwise(F.col("resume_card"))))


@query("lineitem", "part", "events", sql="""WITH i AS (SELECT p_partkey AS item_id, p_partkey % 150 AS recording_id, p_size * 1000000 AS at_us, CASE WHEN p_partkey % 9 <> 0 THEN (p_size % 4)::VARCHAR END AS derived, CASE WHEN p_partkey % 2 = 0 THEN 'utc' END AS zone FROM part),
    g AS (SELECT user_id AS recording_id, event_id % 60 * 1000000 AS at_us FROM events WHERE event_type = 'error')
    SELECT l_orderkey AS report_id, l_linenumber AS pos, CASE WHEN i.item_id IS NULL THEN 'no_item' WHEN derived IS NULL THEN 'no_clock' WHEN l_suppkey % 2 = 0 AND zone IS NULL THEN 'not_an_instant' WHEN derived = (l_linenumber % 4)::VARCHAR THEN 'agrees'
      WHEN EXISTS (SELECT 1 FROM g WHERE g.recording_id = i.recording_id AND abs(g.at_us - i.at_us) <= 5000000) THEN 'may_be_stale' ELSE 'differs' END AS finding
    FROM lineitem LEFT JOIN i ON i.item_id = l_partkey AND l_partkey % 10 <> 0""")
def tim12_clock_time_findings(lineitem: DataFrame, part: DataFrame, events: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    items = part.where("p_partkey % 10 <> 0").select(key.alias("item_id"), (key % 150).alias("recording_id"), (F.col("p_size") * 1_000_000).cast("long").alias("at_us"), F.when(key % 9 != 0, (F.col("p_size") % 4).cast("string")).alias("derived"), F.when(key % 2 == 0, "utc").alias("zone"))
    gaps = events.select(F.col("user_id").alias("recording_id"), (F.col("event_id") % 60 * 1_000_000).alias("at_us"), (F.col("event_type") == "error").alias("by_person"))
    citations = lineitem.select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("item_id"), (F.col("l_linenumber") % 4).cast("string").alias("stated"), F.when(F.col("l_suppkey") % 2 == 0, "utc").alias("stated_zone"))
    return h.clock_time_findings(citations, items, gaps)


@query("lineitem", "part", "orders", sql="""WITH s AS (SELECT l_orderkey AS report_id, l_partkey AS fact_id, CASE WHEN l_suppkey % 6 <> 0 THEN l_suppkey % 3 END AS value, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS at_us FROM lineitem),
    f AS (SELECT p_partkey AS fact_id, p_size % 3 AS value FROM part WHERE p_partkey % 8 <> 0), w AS (SELECT o_orderkey AS fact_id, o_custkey % 50 AS from_us, o_custkey % 50 + 30 AS to_us FROM orders),
    v AS (SELECT s.*, CASE WHEN f.fact_id IS NULL THEN 'unverifiable' WHEN s.value IS NULL THEN 'needs_reading' WHEN s.value <> f.value THEN 'wrong'
        WHEN s.at_us IS NOT NULL AND EXISTS (SELECT 1 FROM w WHERE w.fact_id = s.fact_id) AND NOT EXISTS (SELECT 1 FROM w WHERE w.fact_id = s.fact_id AND s.at_us >= from_us AND s.at_us < to_us) THEN 'wrong' ELSE 'matched' END AS verdict FROM s LEFT JOIN f USING (fact_id))
    SELECT report_id, (SELECT count(*) FROM f) AS facts, count(DISTINCT CASE WHEN verdict = 'matched' THEN fact_id END) AS matched, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, count(*) FILTER (verdict = 'needs_reading') AS needs_reading FROM v GROUP BY report_id""")
def jsn5_grade_report(lineitem: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    statements = lineitem.select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("fact_id"), F.when(F.col("l_suppkey") % 6 != 0, F.col("l_suppkey") % 3).alias("value"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("at_us"))
    facts = part.where("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("fact_id"), (F.col("p_size") % 3).alias("value"))
    windows = orders.select(F.col("o_orderkey").alias("fact_id"), (F.col("o_custkey") % 50).alias("from_us"), (F.col("o_custkey") % 50 + 30).alias("to_us"))
    return h.grade_reports(statements, facts, windows)


_TRACE = "(SELECT user_id AS run_id, CASE WHEN event_type IN ('click', 'view') THEN 'tool_use' ELSE 'tool_result' END AS kind, event_id % 400 AS call_id, event_type AS tool, event_id AS at_us, event_type = 'error' AS is_error, CASE WHEN event_id % 4 <> 0 THEN event_id % 30 END AS message_id, event_id % 77 AS i, event_id % 55 AS o FROM events)"


def _trace(events: DataFrame) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"), F.when(kind.isin("click", "view"), "tool_use").otherwise("tool_result").alias("kind"), (e % 400).alias("call_id"), kind.alias("tool"), e.alias("at_us"), (kind == "error").alias("is_error"),
        F.when(e % 4 != 0, e % 30).alias("message_id"), (e % 77).alias("input_tokens"), (e % 55).alias("output_tokens"),
    )


@query("events", sql=f"""WITH c AS (SELECT run_id, call_id, arg_min(tool, at_us) FILTER (kind = 'tool_use') AS tool, min(at_us) FILTER (kind = 'tool_use') AS started_us, min(at_us) FILTER (kind = 'tool_result') AS ended_us, arg_min(is_error, at_us) FILTER (kind = 'tool_result') AS failed FROM {_TRACE} t GROUP BY run_id, call_id)
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_us, call_id)::INTEGER AS step FROM c WHERE started_us IS NOT NULL""")
def jsn6_trace_calls(events: DataFrame) -> DataFrame:
    return h.trace_calls(_trace(events))


@query("events", sql=f"""SELECT run_id, count(*) AS messages, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM (SELECT run_id, message_id, max(i) AS i, max(o) AS o FROM {_TRACE} t WHERE message_id IS NOT NULL GROUP BY run_id, message_id) m GROUP BY run_id""")
def jsn6_trace_usage(events: DataFrame) -> DataFrame:
    return h.trace_usage(_trace(events))
