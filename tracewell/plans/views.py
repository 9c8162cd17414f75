"""Views over the corpus tables, defined once for Spark and once for DuckDB.

They give the shapes that the operators work on (segments, turns, samples, ...)
by integer arithmetic, so that both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MICROS = {
    "spark": "((unix_date(cast(ts AS date)) * 86400L + hour(ts) * 3600L + minute(ts) * 60L) * 1000000L + cast(extract(SECOND FROM ts) * 1000000 AS bigint))",
    "duck": "epoch_us(ts)",
}
_BYTES = {"spark": "octet_length(text)", "duck": "strlen(text)"}
_DIV = {"spark": "div", "duck": "//"}
_SECONDS = {"spark": "cast(hour(ts) * 3600 + minute(ts) * 60 + floor(extract(SECOND FROM ts)) AS bigint)", "duck": "(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + floor(extract('second' FROM ts))::BIGINT)"}
_TWO = {"spark": "lpad(cast({} AS string), 2, '0')", "duck": "lpad(({})::VARCHAR, 2, '0')"}


def _clock(engine: str) -> str:
    two = lambda x: _TWO[engine].format(x)
    d = _DIV[engine]
    return f"concat({two(f's {d} 3600')}, ':', {two(f'(s {d} 60) % 60')}, ':', {two('s % 60')})"


def _definitions(engine: str) -> dict[str, str]:
    spark, d = engine == "spark", _DIV[engine]
    step = "explode(sequence(0, cast((vec_id * vec_id) % 7 AS int))) AS rep" if spark else "unnest(range(0, (vec_id * vec_id) % 7 + 1)) AS rep"
    blocks = "transform(embedding, x -> cast(floor((cast(x AS double) + 1) * 20) AS int))" if spark else "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 20) AS INTEGER))"
    lines = "posexplode(split(text, '\\n')) AS (line_no, text)" if spark else "unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS text"
    newline, zero_width = ("'\\n'", "'\\u200B'") if spark else ("chr(10)", "chr(8203)")
    return {
        "v_segments": f"SELECT conv_id AS recording_id, cast(turn + 1 AS bigint) AS ordinal, turn * 5000000 AS start_us, turn * 5000000 + 1000000 + ({_BYTES[engine]} * 37) % 6000000 AS end_us, role AS speaker, text FROM {{conversations}}",
        "v_turns": f"SELECT event_id, user_id AS recording_id, {_MICROS[engine]} % 60000000 AS start_us, {_MICROS[engine]} % 60000000 + 200000 + (event_id * 7919) % 3000000 AS end_us, event_type AS cluster FROM {{events}}",
        "v_samples": f"SELECT recording_id, cast(row_number() OVER (PARTITION BY recording_id ORDER BY vec_id, rep) - 1 AS bigint) * 500000 AS time_us, {blocks} AS blocks FROM (SELECT label AS recording_id, vec_id, embedding, {step} FROM {{embeddings}}) x",
        "v_lines": f"SELECT source AS recording_id, doc_id * 500000 AS time_us, {lines} FROM {{documents}}" if spark else f"SELECT source AS recording_id, doc_id * 500000 AS time_us, {lines} FROM {{documents}}",
        "v_reports": f"""SELECT doc_id AS report_id, concat(text, {newline}, CASE doc_id % 7 WHEN 0 THEN 'see https://example.com/a' WHEN 1 THEN 'in /home/user/notes' WHEN 2 THEN 'in C:\\{chr(92) if spark else ''}temp' WHEN 3 THEN concat('a', {zero_width}, 'b') WHEN 4 THEN 'at 12:34' ELSE '' END) AS text FROM {{documents}}""",
        "v_clock_lines": f"SELECT recording_id, time_us, CASE WHEN event_id % 11 = 0 THEN concat({_clock(engine)}, ' ', {_clock(engine)}) ELSE {_clock(engine)} END AS text FROM (SELECT user_id AS recording_id, event_id, event_id * 1000000 AS time_us, {_SECONDS[engine]} AS s FROM {{events}}) x",
        "v_citations": "SELECT l_orderkey AS report_id, cast(l_linenumber AS bigint) AS pos, l_partkey AS evidence_id FROM {lineitem}",
        "v_evidence": "SELECT p_partkey AS evidence_id, p_type AS kind FROM {part} WHERE p_partkey % 10 <> 0",
        "v_chunks": f"SELECT recording_id, idx, idx * 25000000 AS win_start_us, idx * 25000000 + 30000000 AS win_end_us, outcome, value FROM (SELECT user_id AS recording_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bigint) AS idx, CASE event_type WHEN 'click' THEN 'transcribed' WHEN 'view' THEN 'transcribed' WHEN 'purchase' THEN 'silent' WHEN 'signup' THEN 'pending' ELSE 'unusable' END AS outcome, value FROM {{events}}) x",
        "v_job_events": "SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'committing' WHEN 'purchase' THEN 'succeeded' ELSE 'interrupted' END AS to_state FROM {events}",
        "v_grades": "SELECT d.source AS task_id, d.lang AS arm, d.doc_id AS run_index, l.quality AS score, l.toxic AS wrong FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id",
        "v_links": "SELECT page_id, url FROM {pages}",
    }


TABLES = ("conversations", "events", "embeddings", "documents", "lineitem", "part", "labels", "pages", "benchmark", "orders", "customer", "supplier", "nation", "region")
_SPARK, _DUCK = _definitions("spark"), _definitions("duck")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the corpus, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _SPARK[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql})


def duck(sql: str) -> str:
    """``sql`` with each ``{v_name}`` replaced by the view as a subquery."""
    for name, text in _DUCK.items():
        if f"{{{name}}}" in sql:
            for t in TABLES:
                text = text.replace(f"{{{t}}}", t)
            sql = sql.replace(f"{{{name}}}", f"({text})")
    return sql
