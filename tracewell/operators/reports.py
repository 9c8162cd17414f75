"""Reports: statements and times in them, fenced blocks, claims against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.facts import contains_sequence, fact_words, time_alternative
from tracewell.operators.spans import overlap_join

#: Largest report, and the name of the block.
MAX_REPORT_BYTES, BLOCK = 128 * 1024, "handoff"


def report_lines(reports: DataFrame) -> DataFrame:
    """report_id, line (from 1), text, in_code: lines and whether they are inside a fence; a fence's own lines are."""
    lines = reports.select("report_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("line", (F.col("n") + 1).cast("long"))
    fence = F.trim("text").startswith("```").cast("int")
    upto = Window.partitionBy("report_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(fence).over(upto)
    return lines.withColumn("in_code", (opened % 2 == 1) | (fence == 1)).drop("n")


def statements(reports: DataFrame) -> DataFrame:
    """report_id, line, n, statement: sentences of each line outside code; a table's row is one statement, its rules are none."""
    lines = report_lines(reports).where(~F.col("in_code") & (F.trim("text") != "") & ~F.trim("text").rlike(r"^[|:\s-]+$"))
    row = F.trim("text").startswith("|")
    parts = F.when(row, F.array(F.trim("text"))).otherwise(F.split(F.trim("text"), r"(?<=[.!?])\s+"))
    return lines.select("report_id", "line", F.posexplode(F.filter(parts, lambda s: s != "")).alias("n", "statement"))


def times_in(statement: str = "statement"):
    """``array<bigint>``: the seconds that MM:SS and H:MM:SS times of a text name."""
    found = F.regexp_extract_all(F.col(statement), F.lit(r"(?<![0-9:.])((?:[0-9]{1,2}:)?[0-5]?[0-9]:[0-5][0-9])(?![0-9:])"), 1)
    return F.transform(found, lambda t: F.aggregate(F.split(t, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long")))


def extract_block(reports: DataFrame, name: str = BLOCK) -> DataFrame:
    """report_id, line, body, finding: the one fenced block of the name, or why there is none.

    A block opens with three backticks or more and the name alone, and closes with
    as many or more and nothing else. Findings: too_large, no_block, several_blocks,
    not_closed, not_json.
    """
    lines = reports.select("report_id", F.octet_length("text").alias("bytes"), F.split("text", "\n").alias("lines"))
    # state: the length of the open fence (0: none), whether it is ours, its line, and what has been found
    fold = f"""
        aggregate(sequence(0, size(lines) - 1), struct(0 AS fence, false AS ours, 0 AS at, cast(array() AS array<struct<line: int, body: string, closed: boolean>>) AS found, cast(array() AS array<string>) AS body), (a, i) ->
            transform(array(struct(length(regexp_extract(lines[i], '^(`{{3,}})', 1)) AS n, regexp_extract(lines[i], '^`{{3,}}(.*)$', 1) AS rest)), f ->
                CASE WHEN a.fence = 0 AND f.n >= 3 THEN struct(f.n AS fence, trim(f.rest) = '{name}' AS ours, i + 1 AS at, a.found AS found, cast(array() AS array<string>) AS body)
                     WHEN a.fence > 0 AND f.n >= a.fence AND trim(f.rest) = '' THEN struct(0 AS fence, false AS ours, 0 AS at, IF(a.ours, concat(a.found, array(struct(a.at AS line, array_join(a.body, '\\n') AS body, true AS closed))), a.found) AS found, a.body AS body)
                     WHEN a.ours THEN struct(a.fence AS fence, a.ours AS ours, a.at AS at, a.found AS found, concat(a.body, array(lines[i])) AS body)
                     ELSE a END)[0],
            a -> IF(a.ours, concat(a.found, array(struct(a.at AS line, array_join(a.body, '\\n') AS body, false AS closed))), a.found))
    """
    rows = lines.withColumn("found", F.when(F.col("bytes") <= MAX_REPORT_BYTES, F.expr(fold)))
    one = F.get("found", F.lit(0))
    finding = (
        F.when(F.col("found").isNull(), "too_large").when(F.size("found") == 0, "no_block").when(F.size("found") > 1, "several_blocks")
        .when(~one["closed"], "not_closed").when(F.get_json_object(one["body"], "$").isNull(), "not_json")
    )
    return rows.select("report_id", one["line"].alias("line"), F.when(finding.isNull(), one["body"]).alias("body"), finding.alias("finding"))


def facts_stated(stated: DataFrame, facts: DataFrame) -> DataFrame:
    """task_id, fact_id, statement_no: the first timed statement that states a fact and overlaps its window.

    ``stated``: task_id, statement_no, text, start_us, end_us; ``facts``: task_id,
    fact_id, words, start_us, end_us. A statement states a fact if the fact's words
    stand in it in one run, numbers in words being numbers and a clock time in
    either spelling (see ``functions.facts``). The words of a side are worked out
    once for each of its rows, before they meet.
    """
    said = stated.select("task_id", "statement_no", fact_words(F.col("text")).alias("said"), "start_us", "end_us")
    ways = F.array_compact(F.array(fact_words(F.col("words")), fact_words(time_alternative(F.col("words")))))
    near = overlap_join(facts.select("task_id", "fact_id", ways.alias("ways"), "start_us", "end_us"), said, ["task_id"])
    return near.where(F.exists("ways", lambda way: contains_sequence(F.col("said"), way))).groupBy("task_id", "fact_id").agg(F.min("statement_no").alias("statement_no"))


def schema_findings(reports: DataFrame, rules: dict[str, dict], column: str = "body") -> DataFrame:
    """report_id, pointer, rule: what a JSON text breaks of rules by pointer.

    A rule may say required, type (string, number, boolean, array, object), enum,
    pattern, max_length, max_items. Each becomes a column check.
    """
    checks = []
    for pointer, rule in rules.items():
        value = F.get_json_object(column, "$" + "".join(f".{p}" for p in pointer.strip("/").split("/") if p))
        kind = F.when(value.rlike(r"^\{"), "object").when(value.rlike(r"^\["), "array").when(value.rlike(r"^(true|false)$"), "boolean").when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").otherwise("string")
        broken = {
            "required": value.isNull() if rule.get("required") else None,
            "type": value.isNotNull() & (kind != rule["type"]) if rule.get("type") not in (None, "string") else None,
            "enum": ~value.isin(*rule["enum"]) if "enum" in rule else None,
            "pattern": ~value.rlike(rule["pattern"]) if "pattern" in rule else None,
            "length": F.length(value) > rule["max_length"] if "max_length" in rule else None,
            "items": F.json_array_length(value) > rule["max_items"] if "max_items" in rule else None,
        }
        checks += [F.when(test, F.struct(F.lit(pointer).alias("pointer"), F.lit(name).alias("rule"))) for name, test in broken.items() if test is not None]
    found = F.explode(F.array_compact(F.array(*checks)))
    return reports.select("report_id", found.alias("f")).select("report_id", "f.pointer", "f.rule")
