"""Queries of clients' logs, records and handoffs: JSON is built out of the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import handoff, traces
from tracewell.plans.registry import query
from tracewell.sources.guard import guard_records

#: A log of messages: tool uses and their results, messages in parts, some broken lines, and a result of every third run.
_MESSAGES = """
    SELECT conv_id AS run_id, turn + 1 AS line, CASE
        WHEN (conv_id * 7 + turn) % 11 = 0 THEN '{broken' WHEN (conv_id * 7 + turn) % 11 = 1 THEN '["no", "type"]'
        WHEN role = 'assistant' THEN concat('{"type":"assistant","message":{"id":"m', CAST(turn - turn % 4 AS string), '","content":[{"type":"text","text":"', hex(text), '"},{"type":"tool_use","id":"c', CAST(turn AS string),
            '","name":"', CASE turn % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'mcp__a__b' WHEN 3 THEN 'Skill' ELSE 'Odd' END, '","input":{"command":"run ', CAST(conv_id AS string), '","file_path":"/f/', CAST(turn AS string), '","extra":[1,{}]}}],',
            '"usage":{"input_tokens":', CAST(turn * 3 AS string), ',"output_tokens":', CAST(conv_id % 50 AS string), '}}}')
        WHEN role = 'user' THEN concat('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"c', CAST(turn - 1 AS string), '","content":"', CASE WHEN conv_id % 4 = 0 THEN 'Permission needed' ELSE 'fine' END, '","is_error":', CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END, '}]}}')
        ELSE concat('{"type":"system","subtype":"init","model":"m', CAST(conv_id % 3 AS string), '"}') END AS text
    FROM {conversations}
    UNION ALL SELECT conv_id, max(turn) + 2, concat('{"type":"result","subtype":"success","num_turns":', CAST(count(*) AS string), ',"usage":{"input_tokens":', CAST(sum(turn) AS string), '},"permission_denials":[{"tool_use_id":"c1"}]}')
    FROM {conversations} WHERE conv_id % 3 = 0 GROUP BY conv_id"""

#: A log of items: each turn is an item, started and completed, and each run has completed turns.
_ITEMS = """
    SELECT conv_id AS run_id, turn * 3 + n AS line, CASE
        WHEN (conv_id + turn + n) % 13 = 0 THEN 'oops' WHEN n = 3 THEN concat('{"type":"turn.completed","usage":{"input_tokens":', CAST(turn AS string), ',"output_tokens":2}}')
        ELSE concat('{"type":"item.', CASE WHEN n = 1 THEN 'started' ELSE 'completed' END, '","item":{"id":"i', CAST(turn AS string), '","type":"',
            CASE turn % 4 WHEN 0 THEN 'command_execution' WHEN 1 THEN 'agent_message' WHEN 2 THEN 'web_search' ELSE 'view_image' END, '","command":"do ', CAST(n AS string), '","path":"p', CAST(n AS string),
            '","text":"', hex(text), '","status":"', CASE WHEN conv_id % 6 = 0 THEN 'declined' ELSE 'completed' END, '"', CASE WHEN n = 2 THEN concat(',"exit_code":', CAST(conv_id % 3 AS string)) ELSE '' END, '}}') END AS text
    FROM {conversations}, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k"""


def _log(conversations: DataFrame, sql: str) -> DataFrame:
    # every brace but the table's is JSON's own
    quoted = sql.replace("{", "{{").replace("}", "}}").replace("{{conversations}}", "{conversations}")
    return conversations.sparkSession.sql(quoted, conversations=conversations)


def _duck(sql: str) -> str:
    """The log's events for DuckDB, as ``t``: run_id, line, j, type."""
    log = sql.replace("{conversations}", "conversations")
    return f"l AS ({log}), e AS (SELECT run_id, line, TRY_CAST(text AS JSON) AS j FROM l), t AS (SELECT run_id, line, j, CASE WHEN json_type(j, '$.type') = 'VARCHAR' THEN j->>'$.type' END AS type FROM e)"


_M, _I = _duck(_MESSAGES), _duck(_ITEMS)


@query("conversations", sql=f"""WITH {_M},
    a AS (SELECT run_id, line, j->'$.message.content[1]' AS b, row_number() OVER (PARTITION BY run_id ORDER BY line) AS step FROM t WHERE type = 'assistant'),
    c AS (SELECT run_id, line, step, step - 1 AS call, b->>'$.id' AS call_id, b->>'$.name' AS name, b FROM a),
    r AS (SELECT run_id, line, j->>'$.message.content[0].tool_use_id' AS call_id, true AS completed, CAST(j->'$.message.content[0].is_error' AS BOOLEAN) AS err, contains(lower(j->>'$.message.content[0].content'), 'permission') AS refused FROM t WHERE type = 'user'
          UNION ALL SELECT run_id, line, j->>'$.permission_denials[0].tool_use_id', false, NULL, true FROM t WHERE type = 'result'),
    m AS (SELECT c.run_id, c.call, bool_or(completed) AS completed, coalesce(arg_max(err, r.line) FILTER (completed), false) AS is_error, bool_or(refused AND coalesce(err, true)) AS denied FROM c JOIN r ON r.run_id = c.run_id AND r.call_id = c.call_id AND r.line > c.line GROUP BY c.run_id, c.call)
    SELECT c.run_id, c.call, c.step, c.call_id, CASE name WHEN 'Bash' THEN 'shell' WHEN 'Read' THEN 'read_file' WHEN 'Skill' THEN 'skill' WHEN 'mcp__a__b' THEN 'other' ELSE 'unrecognised' END AS kind,
        CASE WHEN name IN ('Bash', 'Skill') THEN b->>'$.input.command' WHEN name = 'Read' THEN b->>'$.input.file_path' ELSE name END AS target,
        coalesce(completed, false) AS completed, coalesce(is_error, false) AS is_error, coalesce(denied, false) AS denied FROM c LEFT JOIN m USING (run_id, call)""")
def jsn6_message_calls(conversations: DataFrame) -> DataFrame:
    return traces.message_calls(_log(conversations, _MESSAGES)).drop("output")


@query("conversations", sql=f"""WITH {_M},
    b AS (SELECT run_id, count(*) FILTER (type IS NULL) AS unparsed_lines FROM t GROUP BY run_id),
    s AS (SELECT run_id, arg_max(j->>'$.model', line) AS model FROM t WHERE type = 'system' GROUP BY run_id),
    f AS (SELECT run_id, arg_max(j->>'$.message.content[0].text', line) AS final_message FROM t WHERE type = 'assistant' GROUP BY run_id),
    r AS (SELECT run_id, CAST(j->'$.num_turns' AS BIGINT) AS turns, j->>'$.subtype' AS outcome, CAST(j->'$.usage.input_tokens' AS BIGINT) AS i FROM t WHERE type = 'result'),
    m AS (SELECT run_id, arg_max(CAST(j->'$.message.usage.input_tokens' AS BIGINT), line) AS i, arg_max(CAST(j->'$.message.usage.output_tokens' AS BIGINT), line) AS o FROM t WHERE type = 'assistant' GROUP BY run_id, j->>'$.message.id'),
    u AS (SELECT run_id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM m GROUP BY run_id)
    SELECT b.run_id, model, turns, outcome, final_message, coalesce(r.i, u.i, 0) AS input_tokens, CASE WHEN r.i IS NULL THEN coalesce(u.o, 0) ELSE 0 END AS output_tokens,
        CASE WHEN r.i IS NOT NULL THEN 'result' WHEN u.i IS NOT NULL THEN 'messages' ELSE 'none' END AS usage_from, unparsed_lines
    FROM b LEFT JOIN s USING (run_id) LEFT JOIN f USING (run_id) LEFT JOIN r USING (run_id) LEFT JOIN u USING (run_id)""")
def jsn6_message_runs(conversations: DataFrame) -> DataFrame:
    return traces.message_runs(_log(conversations, _MESSAGES)).drop("duration_ms", "cached_input_tokens", "cache_creation_input_tokens")


@query("conversations", sql=f"WITH {_M} SELECT run_id, line, CASE WHEN j IS NULL THEN 'not_json' ELSE 'no_type' END AS problem FROM t WHERE type IS NULL")
def jsn6_broken_lines(conversations: DataFrame) -> DataFrame:
    return traces.broken_lines(_log(conversations, _MESSAGES))


@query("conversations", sql=f"""WITH {_I},
    i AS (SELECT run_id, line, type = 'item.completed' AS done, j->'$.item' AS b FROM t WHERE type LIKE 'item.%' AND j->>'$.item.type' <> 'agent_message'),
    c AS (SELECT run_id, b->>'$.id' AS call_id, min(line) AS first, arg_max(b, line) AS b, arg_max(done, line) AS completed FROM i GROUP BY run_id, b->>'$.id')
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first) - 1 AS call, call_id, CASE b->>'$.type' WHEN 'command_execution' THEN 'shell' WHEN 'view_image' THEN 'view_image' ELSE 'other' END AS kind,
        CASE b->>'$.type' WHEN 'command_execution' THEN b->>'$.command' WHEN 'view_image' THEN b->>'$.path' ELSE b->>'$.type' END AS target, completed,
        b->>'$.status' = 'declined' OR coalesce(CAST(b->'$.exit_code' AS BIGINT) <> 0, false) AS is_error, b->>'$.status' = 'declined' AS denied, CAST(b->'$.exit_code' AS BIGINT) AS exit_code FROM c""")
def jsn6_item_calls(conversations: DataFrame) -> DataFrame:
    return traces.item_calls(_log(conversations, _ITEMS)).drop("output")


@query("conversations", sql=f"""WITH {_I}
    SELECT run_id, nullif(count(*) FILTER (type = 'turn.completed'), 0) AS turns, arg_max(type, line) FILTER (type = 'turn.completed') AS outcome, arg_max(j->>'$.item.text', line) FILTER (type = 'item.completed' AND j->>'$.item.type' = 'agent_message') AS final_message,
        coalesce(sum(CAST(j->'$.usage.input_tokens' AS BIGINT)) FILTER (type = 'turn.completed'), 0)::BIGINT AS input_tokens, coalesce(sum(CAST(j->'$.usage.output_tokens' AS BIGINT)) FILTER (type = 'turn.completed'), 0)::BIGINT AS output_tokens, count(*) FILTER (type IS NULL) AS unparsed_lines
    FROM t GROUP BY run_id""")
def jsn6_item_runs(conversations: DataFrame) -> DataFrame:
    return traces.item_runs(_log(conversations, _ITEMS)).drop("cached_input_tokens", "reasoning_output_tokens")


_CITED = """(SELECT l_orderkey AS report_id, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem)"""
_KIND = "CASE {0} % 4 WHEN 0 THEN 'frame' WHEN 1 THEN 'crop' WHEN 2 THEN 'audio' ELSE 'novel' END"


def _handoffs(lineitem: DataFrame) -> DataFrame:
    """A handoff of each order: its lines are citations of suppliers (segments) and parts (evidence)."""
    cited = lineitem.sparkSession.sql("SELECT * FROM " + _CITED.replace("lineitem", "{lineitem}") + " c", lineitem=lineitem)
    lines = cited.selectExpr("report_id", "s", "pos", f"""CASE WHEN pos % 2 = 0 THEN concat('{{"segment_id":"tsg_', s, '"}}') ELSE concat('{{"evidence_id":"evd_', p, '","type":"', {_KIND.format('p')}, '"', CASE WHEN s % 5 = 0 THEN concat(',"parent_evidence_id":"evd_', p + 1, '"') ELSE '' END, '}}') END AS line""")
    whole = lines.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.max("s").alias("s"))
    body = F.concat(
        F.lit('{"citations":['), F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit('],"session":{"session_id":"s'), (F.col("report_id") % 6).cast("string"), F.lit('"},"resume":{"session_id":"s'), (F.col("report_id") % 7 % 6).cast("string"),
        F.lit('","to_verify":[{"id":"tsg_'), F.col("s").cast("string"), F.lit('"}]}}'),
    )
    return whole.select("report_id", F.concat(F.lit("s"), (F.col("report_id") % 6).cast("string")).alias("session_id"), body.alias("body"))


def _stores(part: DataFrame, supplier: DataFrame) -> tuple[DataFrame, DataFrame]:
    return supplier.selectExpr("concat('s', s_suppkey % 3) AS session_id", "concat('tsg_', s_suppkey) AS segment_id"), part.selectExpr("concat('s', p_partkey % 6) AS session_id", "concat('evd_', p_partkey) AS evidence_id", f"{_KIND.format('p_size')} AS kind")


_IDENTITIES = f"""c AS {_CITED}, i AS (SELECT report_id, concat('/citations/', pos, '/segment_id') AS pointer, s AS id, 'segment' AS store, NULL AS kind FROM c WHERE pos % 2 = 0
    UNION ALL SELECT report_id, concat('/citations/', pos, '/evidence_id'), p, 'evidence', CASE WHEN p % 4 < 3 THEN {_KIND.format('p')} END FROM c WHERE pos % 2 = 1
    UNION ALL SELECT report_id, concat('/citations/', pos, '/parent_evidence_id'), p + 1, 'evidence', NULL FROM c WHERE pos % 2 = 1 AND s % 5 = 0
    UNION ALL SELECT report_id, '/resume/to_verify/0/id', max(s), 'segment', NULL FROM c GROUP BY report_id)"""


@query("lineitem", "part", "supplier", sql=f"""WITH {_IDENTITIES},
    f AS (SELECT i.*, s_suppkey IS NOT NULL AS seg, p_partkey IS NOT NULL AS evi, {_KIND.format('p_size')} AS held FROM i LEFT JOIN supplier ON store = 'segment' AND s_suppkey = id AND s_suppkey % 3 = report_id % 6 LEFT JOIN part ON store = 'evidence' AND p_partkey = id AND p_partkey % 6 = report_id % 6)
    SELECT report_id, pointer, CASE WHEN store = 'segment' THEN 'segment_not_in_session' WHEN NOT evi THEN 'evidence_not_in_session' ELSE 'evidence_kind_mismatch' END AS finding FROM f WHERE NOT (seg OR evi) OR (evi AND kind <> held)
    UNION ALL SELECT DISTINCT report_id, '/resume/session_id', 'session_mismatch' FROM c WHERE report_id % 6 <> report_id % 7 % 6""")
def jsn4_handoff_findings(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    return handoff.resolve_handoff(_handoffs(lineitem), *_stores(part, supplier))[0]


@query("lineitem", "part", "supplier", sql=f"WITH {_IDENTITIES} SELECT report_id, count(*) AS identities_checked FROM i GROUP BY report_id")
def jsn4_identities_checked(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    return handoff.resolve_handoff(_handoffs(lineitem), *_stores(part, supplier))[1]


#: Records of events; of each ten, six break something.
_RECORD = """CASE event_id % 10 WHEN 3 THEN '{"broken' ELSE concat('{"schema_version":', CASE event_id % 10 WHEN 4 THEN 9 ELSE 2 END, ',"event_id":', event_id, ',"who":{"user_id":', CASE event_id % 10 WHEN 1 THEN concat('"', user_id, '"') ELSE CAST(user_id AS string) END,
    CASE event_id % 10 WHEN 2 THEN '' ELSE concat(',"kind":"', event_type, '"') END, CASE event_id % 10 WHEN 0 THEN ',"extra":{}' ELSE '' END, '},"values":[', CASE event_id % 10 WHEN 5 THEN '-1' ELSE CAST(event_id % 7 AS string) END, ',2]}') END"""
_SCHEMA = "schema_version int NOT NULL, event_id bigint NOT NULL, who struct<user_id: bigint NOT NULL, kind: string NOT NULL> NOT NULL, values array<bigint> NOT NULL"


def _guarded(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = events.selectExpr("event_id AS line", f"{_RECORD} AS text")
    return guard_records(lines, _SCHEMA, {"values_from_0": "forall(`values`, v -> v >= 0)"}, version="schema_version", newest=2)


@query("events", sql="SELECT event_id AS line, user_id, event_type AS kind, event_id % 7 + 2 AS total FROM events WHERE event_id % 10 > 5")
def src9_guarded_records(events: DataFrame) -> DataFrame:
    return _guarded(events)[0].select("line", "record.who.*", F.aggregate("record.values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("events", sql="""SELECT event_id AS line, ['/who/extra', '/who/user_id', '/who/kind', '', '', ''][event_id % 10 + 1] AS pointer, ['unknown_member', 'wrong_type', 'missing_member', 'not_json', 'newer_version', 'values_from_0'][event_id % 10 + 1] AS reason FROM events WHERE event_id % 10 < 6""")
def src9_quarantine(events: DataFrame) -> DataFrame:
    return _guarded(events)[1]
