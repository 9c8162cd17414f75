"""Logs of agent clients: lines of JSON to calls, usage and outcomes of runs.

Two kinds of log are read. In a ``messages`` log an event holds a whole message
with content blocks: tool uses, later their results, and a last event with the
run's result. In an ``items`` log events start, update and complete items. Lines
are parsed as VARIANT, so members that nobody asks for are tolerated and values
of another type than asked for count as missing. Everything is joins and windows
by run and call.

Input: run_id, line (its number, from 1), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools by what they do, and item types that are no tool use.
READ_TOOLS, LIST_TOOLS = ("Read",), ("Glob", "Grep", "LS")
INTERNAL_TOOLS = ("TodoWrite", "TaskList")
OTHER_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit", "WebFetch", "WebSearch", "Task", "Agent", "BashOutput", "KillShell", "PowerShell")
MESSAGE_ITEMS = ("agent_message", "reasoning", "error")
IMAGE_ITEMS, OTHER_ITEMS = ("view_image", "image_view"), ("file_change", "mcp_tool_call", "web_search", "collab_tool_call")
REFUSED = ("declined", "rejected", "denied")
TOKENS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cached_input_tokens": "cache_read_input_tokens", "cache_creation_input_tokens": "cache_creation_input_tokens"}


def _text(value: str, path: str) -> str:
    """SQL of the string at a path; null if it is none."""
    return f"IF(schema_of_variant(try_variant_get({value}, '{path}')) = 'STRING', try_variant_get({value}, '{path}', 'string'), NULL)"


def _whole(value: str, path: str) -> str:
    """SQL of the whole number from 0 on at a path; null if it is none."""
    return f"IF(schema_of_variant(try_variant_get({value}, '{path}')) = 'BIGINT' AND try_variant_get({value}, '{path}', 'bigint') >= 0, try_variant_get({value}, '{path}', 'bigint'), NULL)"


def _true(value: str, path: str) -> str:
    return f"coalesce(schema_of_variant(try_variant_get({value}, '{path}')) = 'BOOLEAN' AND try_variant_get({value}, '{path}', 'boolean'), false)"


def trace_events(lines: DataFrame) -> DataFrame:
    """run_id, line, type, event (VARIANT) of every line that isn't blank; ``type`` is null where the line is no event."""
    found = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("run_id", "line", F.expr("try_parse_json(text)").alias("event"))
    return found.select("run_id", "line", F.expr(_text("event", "$.type")).alias("type"), "event")


def broken_lines(lines: DataFrame) -> DataFrame:
    """run_id, line, problem of lines that are no event: ``not_json``, or ``no_type`` for JSON without a type."""
    return trace_events(lines).where("type IS NULL").select("run_id", "line", F.when(F.col("event").isNull(), "not_json").otherwise("no_type").alias("problem"))


def _blocks(events: DataFrame, types: tuple[str, ...], path: str = "$.message.content") -> DataFrame:
    """``events`` of some types with ``pos`` and ``block`` of each member of the array at ``path``."""
    some = events.where(F.col("type").isin(*types))
    return some.sparkSession.sql(f"SELECT e.*, x.pos, x.value AS block FROM {{events}} e, LATERAL variant_explode(try_variant_get(e.event, '{path}')) x WHERE x.key IS NULL", events=some)


def _kind(tool: Column, block: str) -> tuple[Column, Column]:
    """What a tool use does, and on what."""
    at = lambda key: F.coalesce(F.expr(_text(block, f"$.input.{key}")), F.lit(""))
    name = F.coalesce(tool, F.lit(""))
    kind = (
        F.when(name == "Bash", "shell").when(name.isin(*READ_TOOLS), "read_file").when(name.isin(*LIST_TOOLS), "list_files").when(name == "Skill", "skill")
        .when(name.isin(*INTERNAL_TOOLS), "internal").when(name.isin(*OTHER_TOOLS) | name.startswith("mcp__"), "other").otherwise("unrecognised")
    )
    skill = F.coalesce(*[F.expr(_text(block, f"$.input.{key}")) for key in ("skill", "command", "name")], F.lit(""))
    target = F.when(kind == "shell", at("command")).when(kind == "read_file", at("file_path")).when(kind == "list_files", at("path")).when(kind == "skill", skill).otherwise(name)
    return kind, target


def message_calls(lines: DataFrame) -> DataFrame:
    """run_id, call (from 0), step, call_id, kind, target, completed, is_error, denied, output of a ``messages`` log's tool uses.

    ``step`` counts the run's assistant events. A result belongs to the last use of
    its id before it; of several the last counts, but what was denied once stays
    denied: by an error that speaks of permission, or in the list of the run's end.
    A use without an id has the empty one.
    """
    events = trace_events(lines)
    uses = _blocks(events, ("assistant",)).where(f"{_text('block', '$.type')} = 'tool_use'")
    kind, target = _kind(F.expr(_text("block", "$.name")), "block")
    calls = uses.select("run_id", "line", "pos", F.expr(f"coalesce({_text('block', '$.id')}, '')").alias("call_id"), kind.alias("kind"), target.alias("target"))
    steps = events.where("type = 'assistant'").selectExpr("run_id", "line", "row_number() OVER (PARTITION BY run_id ORDER BY line) AS step")
    calls = calls.join(steps, ["run_id", "line"]).withColumn("call", F.expr("row_number() OVER (PARTITION BY run_id ORDER BY line, pos) - 1"))

    said = F.lower(F.to_json(F.expr("named_struct('c', try_variant_get(block, '$.content'))")))
    results = _blocks(events, ("user",)).where(f"{_text('block', '$.type')} = 'tool_result'").select(
        "run_id", "line", "pos", F.expr(f"coalesce({_text('block', '$.tool_use_id')}, '')").alias("call_id"), F.lit(True).alias("completed"), F.expr(_true("block", "$.is_error")).alias("is_error"),
        (F.expr(_true("block", "$.is_error")) & (said.contains("permission") | said.contains("denied"))).alias("denied"), F.expr(_text("block", "$.content")).alias("output"),
    )
    listed = _blocks(events, ("result",), "$.permission_denials").select(
        "run_id", "line", "pos", F.expr(f"coalesce({_text('block', '$.tool_use_id')}, '')").alias("call_id"), F.lit(False).alias("completed"), F.lit(None).cast("boolean").alias("is_error"), F.lit(True).alias("denied"), F.lit(None).cast("string").alias("output"),
    )
    every = calls.select("run_id", "line", "pos", "call_id", "call").unionByName(results.unionByName(listed), allowMissingColumns=True)
    met = every.withColumn("of", F.expr("last(call, true) OVER (PARTITION BY run_id, call_id ORDER BY line, pos)")).where("call IS NULL AND of IS NOT NULL")
    place = F.when(F.col("completed"), F.struct("line", "pos"))
    ends = met.groupBy("run_id", F.col("of").alias("call")).agg(
        F.bool_or("completed").alias("completed"), F.max_by("is_error", place).alias("is_error"), F.bool_or("denied").alias("denied"), F.max_by("output", place).alias("output")
    )
    out = calls.select("run_id", "call", "step", "call_id", "kind", "target").join(ends, ["run_id", "call"], "left")
    return out.select("run_id", F.col("call").cast("long").alias("call"), F.col("step").cast("long").alias("step"), "call_id", "kind", "target", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("completed", "is_error", "denied")], "output")


def message_runs(lines: DataFrame) -> DataFrame:
    """run_id, model, turns, duration_ms, outcome, final_message, the four token counts, usage_from, unparsed_lines of ``messages`` logs.

    Usage is the last result's (``result``), else the sum over messages: a message is
    logged again as it grows, so of events with its id the last counts, and events
    without an id count each (``messages``; ``none`` if there is no message). The
    final message is the result's, else the last text before it.
    """
    events = trace_events(lines)
    usage = lambda path: [F.coalesce(F.expr(_whole("event", f"{path}.{member}")), F.lit(0).cast("long")).alias(name) for name, member in TOKENS.items()]
    base = events.groupBy("run_id").agg(F.count_if(F.col("type").isNull()).alias("unparsed_lines"))
    begun = events.where("type = 'system'").where(f"{_text('event', '$.subtype')} = 'init'").groupBy("run_id").agg(F.max_by(F.expr(_text("event", "$.model")), "line").alias("model"))
    texts = _blocks(events, ("assistant",)).where(f"{_text('block', '$.type')} = 'text'").select("run_id", "line", "pos", F.struct(F.expr(_text("block", "$.text")).alias("t")).alias("text"))
    # the last text before each result, and in the whole run
    ends = events.where("type = 'result'").select("run_id", "line", F.lit(-1).alias("pos"), F.struct(
        F.expr(_text("event", "$.result")).alias("said"), F.expr(_whole("event", "$.num_turns")).alias("turns"), F.expr(_whole("event", "$.duration_ms")).alias("duration_ms"), F.expr(_text("event", "$.subtype")).alias("outcome"),
        F.expr("coalesce(startswith(schema_of_variant(try_variant_get(event, '$.usage')), 'OBJECT'), false)").alias("counted"), *usage("$.usage"),
    ).alias("end"))
    both = texts.unionByName(ends, allowMissingColumns=True).withColumn("before", F.expr("last(text, true) OVER (PARTITION BY run_id ORDER BY line, pos)"))
    last = both.groupBy("run_id").agg(
        F.max_by(F.struct("end", F.coalesce("end.said", "before.t").alias("said")), F.when(F.col("end").isNotNull(), F.col("line"))).alias("r"),
        F.max_by("end", F.when(F.col("end.counted"), F.col("line"))).alias("u"), F.max_by("text", F.when(F.col("text").isNotNull(), F.struct("line", "pos"))).alias("t"),
    )
    messages = events.where("type = 'assistant'").select("run_id", "line", F.expr(_text("event", "$.message.id")).alias("id"), F.struct(*usage("$.message.usage")).alias("u"))
    each = messages.groupBy("run_id", F.coalesce(F.concat(F.lit("m"), "id"), F.concat(F.lit("l"), "line")).alias("k")).agg(F.max_by("u", "line").alias("u"))
    sums = each.groupBy("run_id").agg(*[F.sum(f"u.{name}").alias(f"m_{name}") for name in TOKENS])
    rows = base.join(begun, "run_id", "left").join(last, "run_id", "left").join(sums, "run_id", "left")
    tokens = [F.coalesce(F.col(f"u.{name}"), F.col(f"m_{name}"), F.lit(0)).cast("long").alias(name) for name in TOKENS]
    source = F.when(F.col("u").isNotNull(), "result").when(F.col("m_input_tokens").isNotNull(), "messages").otherwise("none")
    return rows.select("run_id", "model", "r.end.turns", "r.end.duration_ms", "r.end.outcome", F.coalesce("r.said", "t.t").alias("final_message"), *tokens, source.alias("usage_from"), "unparsed_lines")


def item_calls(lines: DataFrame) -> DataFrame:
    """run_id, call (from 0, in the order in which items first appear), call_id, kind, target, completed, is_error, denied, exit_code, output of an ``items`` log.

    An item's last event says what it is and how it stands, its last completed one
    the output. Failed is what was refused, has failed, or ended with another code than 0.
    """
    types = ("item.started", "item.updated", "item.completed")
    item = "try_variant_get(event, '$.item')"
    rows = trace_events(lines).where(F.col("type").isin(*types)).select(
        "run_id", "line", (F.col("type") == "item.completed").alias("done"), F.expr(f"coalesce({_text('event', '$.item.id')}, '')").alias("call_id"), F.expr(f"coalesce({_text('event', '$.item.type')}, '')").alias("kind"),
        *[F.expr(f"coalesce({_text('event', f'$.item.{k}')}, '')").alias(k) for k in ("command", "path", "status")],
        F.expr(f"IF(schema_of_variant(try_variant_get({item}, '$.exit_code')) = 'BIGINT', try_variant_get({item}, '$.exit_code', 'bigint'), NULL)").alias("exit_code"), F.expr(_text("event", "$.item.aggregated_output")).alias("output"),
    ).where(~F.col("kind").isin(*MESSAGE_ITEMS))
    calls = rows.groupBy("run_id", "call_id").agg(F.min("line").alias("first"), F.max_by(F.struct("kind", "command", "path", "status", "exit_code", "done"), "line").alias("s"), F.max_by("output", F.when(F.col("done"), F.col("line"))).alias("output"))
    s = lambda name: F.col(f"s.{name}")
    kind = F.when(s("kind") == "command_execution", "shell").when(s("kind").isin(*IMAGE_ITEMS), "view_image").when(s("kind") == "todo_list", "internal").when(s("kind").isin(*OTHER_ITEMS), "other").otherwise("unrecognised")
    target = F.when(kind == "shell", s("command")).when(kind == "view_image", s("path")).otherwise(s("kind"))
    denied = s("status").isin(*REFUSED)
    failed = denied | (s("status") == "failed") | F.coalesce(s("exit_code") != 0, F.lit(False))
    return calls.select(
        "run_id", F.expr("row_number() OVER (PARTITION BY run_id ORDER BY first, call_id) - 1").cast("long").alias("call"), "call_id", kind.alias("kind"), target.alias("target"),
        s("done").alias("completed"), failed.alias("is_error"), denied.alias("denied"), s("exit_code").alias("exit_code"), "output",
    )


def item_runs(lines: DataFrame) -> DataFrame:
    """run_id, turns (null for none), outcome, final_message, input_tokens, output_tokens, cached_input_tokens, reasoning_output_tokens, unparsed_lines of ``items`` logs: usage adds up over completed turns."""
    events = trace_events(lines)
    turn, message = F.col("type") == "turn.completed", (F.col("type") == "item.completed") & (F.expr(_text("event", "$.item.type")) == "agent_message")
    tokens = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")
    return events.groupBy("run_id").agg(
        F.nullif(F.count_if(turn), F.lit(0)).alias("turns"), F.max_by("type", F.when(F.col("type").isin("turn.completed", "turn.failed", "error"), F.col("line"))).alias("outcome"),
        F.max_by(F.expr(_text("event", "$.item.text")), F.when(message, F.col("line"))).alias("final_message"),
        *[F.coalesce(F.sum(F.when(turn, F.expr(_whole("event", f"$.usage.{t}")))), F.lit(0)).cast("long").alias(t) for t in tokens], F.count_if(F.col("type").isNull()).alias("unparsed_lines"),
    )
