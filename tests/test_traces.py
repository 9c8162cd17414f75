"""Logs of clients: messages, items, broken lines."""

import json

from tracewell.operators import traces


def logs(spark, runs):
    rows = [(run, n + 1, x if isinstance(x, str) else json.dumps(x)) for run, lines in runs.items() for n, x in enumerate(lines)]
    return spark.createDataFrame(rows, "run_id string, line long, text string")


def use(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given, "unknown": [1]}


def answer(i, content, error=None):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content} | ({} if error is None else {"is_error": error})]}}


def says(*blocks, message=None, tokens=None):
    return {"type": "assistant", "message": {"content": list(blocks)} | ({"id": message} if message else {}) | ({"usage": tokens} if tokens else {})}


def test_messages(spark):
    run = [
        {"type": "system", "subtype": "init", "model": "m-1", "tools": []}, "", "not json", '{"no": "type"}', "[1, 2]", '{"type": 3}',
        says({"type": "text", "text": "first"}, use("a", "Bash", command="ls -l"), message="1", tokens={"input_tokens": 5, "output_tokens": 1}),
        says(use("b", "Read", file_path="/x"), message="1", tokens={"input_tokens": 5, "output_tokens": 9, "cache_read_input_tokens": 2}),
        answer("a", "fine"), answer("b", "Permission refused", True), answer("b", [{"type": "text", "text": "later"}], False), answer("zz", "nobody's"),
        says(use("a", "Grep", path="src", glob="*.py"), use("c", "Skill", command="s"), use("d", "mcp__x__y"), use("e", "Odd"), {"type": "thinking"}, tokens={"input_tokens": 7, "output_tokens": -1}),
        answer("a", "again", True), "{\"type\": \"user\", \"message\": {\"content\": \"plain\"}}",
    ]
    ended = [*run, {"type": "result", "subtype": "success", "num_turns": 4, "duration_ms": 1200, "usage": {"input_tokens": 100, "output_tokens": 20}, "permission_denials": [{"tool_use_id": "c"}]}]
    lines = logs(spark, {"open": run, "ended": ended, "empty": ["?"]})
    got = {(r["run_id"], r["call"]): (r["step"], r["call_id"], r["kind"], r["target"], r["completed"], r["is_error"], r["denied"], r["output"]) for r in traces.message_calls(lines).collect()}
    want = {
        0: (1, "a", "shell", "ls -l", True, False, False, "fine"), 1: (2, "b", "read_file", "/x", True, False, True, None), 2: (3, "a", "list_files", "src", True, True, False, "again"),
        3: (3, "c", "skill", "s", False, False, False, None), 4: (3, "d", "other", "mcp__x__y", False, False, False, None), 5: (3, "e", "unrecognised", "Odd", False, False, False, None),
    }
    assert got == {("open", k): v for k, v in want.items()} | {("ended", k): v if k != 3 else (*v[:6], True, None) for k, v in want.items()}
    runs = {r["run_id"]: tuple(r)[1:] for r in traces.message_runs(lines).collect()}
    assert runs == {
        "open": ("m-1", None, None, None, "first", 12, 9, 2, 0, "messages", 4), "ended": ("m-1", 4, 1200, "success", "first", 100, 20, 0, 0, "result", 4),
        "empty": (None, None, None, None, None, 0, 0, 0, 0, "none", 1),
    }
    assert sorted((r["run_id"], r["line"], r["problem"]) for r in traces.broken_lines(lines).where("run_id <> 'open'").collect()) == [("empty", 1, "not_json"), ("ended", 3, "not_json"), ("ended", 4, "no_type"), ("ended", 5, "no_type"), ("ended", 6, "no_type")]


def test_items(spark):
    item = lambda event, i, kind, **more: {"type": f"item.{event}", "item": {"id": i, "type": kind} | more}
    run = [
        item("started", "1", "command_execution", command="make"), item("started", "2", "view_image", path="p.png"), item("completed", "0", "reasoning", text="hm"),
        item("completed", "1", "command_execution", command="make all", exit_code=2, aggregated_output="boom", status="completed"), item("updated", "2", "view_image", path="q.png", status="declined"),
        item("completed", "3", "agent_message", text="done"), item("completed", "4", "novel_thing"), {"type": "turn.completed", "usage": {"input_tokens": 3, "output_tokens": 4, "reasoning_output_tokens": 1}},
        {"type": "turn.completed", "usage": {"input_tokens": 5, "cached_input_tokens": 2}}, {"type": "thread.started"}, "{broken", {"type": "turn.failed"},
    ]
    lines = logs(spark, {"r": run})
    assert sorted(tuple(r)[1:] for r in traces.item_calls(lines).collect()) == [
        (0, "1", "shell", "make all", True, True, False, 2, "boom"), (1, "2", "view_image", "q.png", False, True, True, None, None), (2, "4", "unrecognised", "novel_thing", True, False, False, None, None),
    ]
    assert [tuple(r)[1:] for r in traces.item_runs(lines).collect()] == [(2, "turn.failed", "done", 8, 4, 2, 1, 1)]
    none = lines.where("false")
    assert [f(none).count() for f in (traces.message_calls, traces.message_runs, traces.item_calls, traces.item_runs, traces.broken_lines)] == [0] * 5
