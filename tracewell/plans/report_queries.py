"""Queries of reports and of comparisons between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.facts import fact_words, states
from tracewell.functions.text import NUMBER_NAMES
from tracewell.operators import compare as c
from tracewell.operators import reports as r
from tracewell.operators.seams import seam_spans
from tracewell.operators.speech import plan_chunks
from tracewell.plans.registry import query
from tracewell.plans.speech_queries import PLAN, RANGES, SEAM_WORDS
from tracewell.sources.shared import parts


@query("v_reports", sql="""WITH l AS (SELECT report_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, trim(unnest(string_split(text, chr(10)))) AS t FROM {v_reports} x),
    k AS (SELECT report_id, line, CASE WHEN starts_with(t, '|') THEN [t] ELSE list_filter(string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01'), lambda s: s <> '') END AS parts FROM l WHERE t <> '' AND NOT regexp_full_match(t, '[|:\\s-]+'))
    SELECT report_id, line, CAST(n AS INTEGER) AS n, md5(parts[n + 1]) AS statement FROM (SELECT *, unnest(range(0, len(parts))) AS n FROM k) x""")
def str17_statements(reports: DataFrame) -> DataFrame:
    return r.statements(reports).withColumn("statement", F.md5("statement"))



@query("v_reports", sql="""SELECT report_id, CAST(CASE WHEN report_id % 4 IN (0, 1) THEN 2 + len(string_split(text, chr(10))) END AS INTEGER) AS line, CASE WHEN report_id % 4 = 0 THEN '{"id": 1}' END AS body,
    CASE report_id % 4 WHEN 1 THEN 'not_closed' WHEN 0 THEN NULL ELSE 'no_block' END AS finding FROM {v_reports} x""")
def jsn1_extract_block(reports: DataFrame) -> DataFrame:
    tail = F.when(F.col("report_id") % 4 == 0, '\nx\n```handoff\n{"id": 1}\n```').when(F.col("report_id") % 4 == 1, '\nx\n```handoff\n{"id": 1}').when(F.col("report_id") % 4 == 2, "\n```json\n```handoff\n```").otherwise("")
    return r.extract_block(reports.withColumn("text", F.concat("text", tail)))


@query("events", sql="""SELECT event_id AS report_id, '/kind' AS pointer, 'enum' AS rule FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, '/value', 'required' FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, '/kind', 'length' FROM events WHERE length(event_type) > 6""")
def jsn2_schema_findings(events: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("value")))
    return r.schema_findings(events.select(F.col("event_id").alias("report_id"), body.alias("body")), {"/kind": {"enum": ["click", "view"], "max_length": 6, "type": "string"}, "/value": {"required": True, "type": "number"}})


@query("v_segments", sql="""WITH s AS (SELECT *, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS words FROM {v_segments} x)
    SELECT recording_id AS task_id, k AS fact_id, min(ordinal) AS statement_no FROM s, (SELECT unnest(['of the', 'with', 'that']) AS k) f WHERE contains(words, ' ' || k || ' ') AND start_us < 20000000 AND end_us > 5000000 GROUP BY recording_id, k""")
def join14_facts_stated(segments: DataFrame) -> DataFrame:
    stated = segments.select(F.col("recording_id").alias("task_id"), F.col("ordinal").alias("statement_no"), "text", "start_us", "end_us")
    facts = segments.select(F.col("recording_id").alias("task_id")).distinct().select("task_id", F.explode(F.array(*[F.lit(x) for x in ("of the", "with", "that")])).alias("words"))
    return r.facts_stated(stated, facts.select("task_id", F.col("words").alias("fact_id"), "words", F.lit(5_000_000).cast("long").alias("start_us"), F.lit(20_000_000).cast("long").alias("end_us")))


def _spelt() -> str:
    """SQL of the number ``n`` (from 1, below a million) in words, in one of the ways to write it."""
    pick = lambda a, i: f"element_at(array({a}), CAST({i} AS int))"
    whole = lambda a, b: f"({a} div {b})"
    names, tens = (", ".join(f"'{x}'" for x in some) for some in ([*NUMBER_NAMES[:20]], [*NUMBER_NAMES[20:]]))
    below = lambda x: f"CASE WHEN {x} = 0 THEN '' WHEN {x} < 20 THEN {pick(names, f'{x} + 1')} WHEN {x} % 10 = 0 THEN {pick(tens, whole(x, 10) + ' - 1')} ELSE concat({pick(tens, whole(x, 10) + ' - 1')}, CASE WHEN n % 2 = 0 THEN '-' ELSE ' ' END, {pick(names, f'{x} % 10 + 1')}) END"
    joint = "CASE WHEN n % 3 = 0 THEN ' and ' ELSE ' ' END"
    hundreds = lambda x: f"CASE WHEN {x} >= 100 THEN concat({pick(names, whole(x, 100) + ' + 1')}, ' hundred', CASE WHEN {x} % 100 = 0 THEN '' ELSE concat({joint}, {below(f'({x} % 100)')}) END) ELSE {below(f'({x} % 100)')} END"
    return f"CASE WHEN n >= 1000 THEN concat({hundreds(whole('n', 1000))}, ' thousand', CASE WHEN n % 1000 = 0 THEN '' ELSE concat({joint}, {hundreds('(n % 1000)')}) END) ELSE {hundreds('(n % 1000)')} END"


#: Events whose texts are read by one task.
DEALT = 100_000


def _numbered(events: DataFrame) -> DataFrame:
    """event_id, n: dealt to more tasks as events grow, for their texts are far larger than the files that Spark plans tasks by."""
    return events.selectExpr("event_id", "1 + event_id * 7919 % 999999 AS n").repartition(parts(events.sparkSession, events.count(), DEALT))


@query("events", sql="SELECT event_id, ['value', n::VARCHAR, 'ms', 'and', '7', 'hundred'] AS words FROM (SELECT event_id, 1 + event_id * 7919 % 999999 AS n FROM events) e")
def str16_fact_words(events: DataFrame) -> DataFrame:
    """Numbers that are written out in words, and read back."""
    rows = _numbered(events).selectExpr("event_id", f"concat('Value: ', {_spelt()}, ' milliseconds, and 7 hundred') AS text")
    return rows.select("event_id", fact_words(F.col("text")).alias("words"))


@query("events", sql=f"""SELECT event_id, n % 4 <> 3 AS stated FROM (SELECT event_id, 1 + event_id * 7919 % 999999 AS n FROM events) e""")
def str16_terms_stated(events: DataFrame) -> DataFrame:
    """Terms with a number or a clock time, in a text that says it in another way; a fourth says another number."""
    rows = _numbered(events)
    clock = "concat(CAST(n % 24 AS string), {0}, lpad(CAST(n % 60 AS string), 2, '0'))"
    rows = rows.selectExpr(
        "event_id", f"CASE n % 4 WHEN 0 THEN concat('at ', {clock.format(chr(39) + ':' + chr(39))}) WHEN 3 THEN concat('1', CAST(n AS string), ' ms') ELSE concat(CAST(n AS string), ' milliseconds') END AS term",
        f"CASE n % 4 WHEN 0 THEN concat('it was at ', {clock.format(chr(39) + '.' + chr(39))}, ' that') ELSE concat('it took ', {_spelt()}, ' ms in all') END AS text",
    )
    return rows.select("event_id", states(F.col("text"), F.col("term")).alias("stated"))


def _again(segments: DataFrame) -> DataFrame:
    """The same segments a quarter of a second later, every fifth one gone."""
    return segments.where("ordinal % 5 <> 0").withColumn("start_us", F.col("start_us") + 250_000).withColumn("end_us", F.col("end_us") + 250_000)


_AGAIN = "(SELECT * REPLACE (start_us + 250000 AS start_us, end_us + 250000 AS end_us) FROM {v_segments} g WHERE ordinal % 5 <> 0)"
_WORDS = f"(SELECT recording_id, ordinal, n, w[n + 1] AS word, start_us + ((end_us - start_us) * (2 * n + 1)) // (2 * len(w)) AS at_us FROM (SELECT recording_id, ordinal, start_us, end_us, w, unnest(range(0, len(w))) AS n FROM (SELECT *, {SEAM_WORDS} AS w FROM {{0}} g0) g1) g2)"
_TRIPLES = f"(SELECT *, row_number() OVER w AS place, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS triple, lead(at_us, 2) OVER w AS until_us FROM {_WORDS} g3 WINDOW w AS (PARTITION BY recording_id ORDER BY at_us, ordinal, n))"
_RECALL = f"""r AS (SELECT * FROM {_TRIPLES.replace('{0}', '{v_segments}')} g4), s AS (SELECT * FROM {_TRIPLES.replace('{0}', _AGAIN)} g4),
    h AS (SELECT DISTINCT recording_id, place FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.recording_id = r.recording_id AND s.triple = r.triple AND s.at_us BETWEEN r.at_us - 6000000 AND r.at_us + 6000000)),
    f AS (SELECT r.recording_id, r.place, r.word, r.at_us, EXISTS (SELECT 1 FROM h WHERE h.recording_id = r.recording_id AND r.place IN (h.place, h.place + 1, h.place + 2)) AS found FROM r)"""


@query("v_segments", sql=f"WITH {_RECALL} SELECT * FROM f")
def eva3_trigram_recall(segments: DataFrame) -> DataFrame:
    return c.trigram_recall(segments, _again(segments))


_SCRIPT = "CASE WHEN {0} = 0 THEN NULL WHEN {1} >= {2} AND {1} >= {0} - {1} - {2} THEN 'latin' WHEN {2} >= {0} - {1} - {2} THEN 'cyrillic' ELSE 'other' END"
_LETTERS = "*, length(regexp_replace(word, '[^\\p{L}]+', '', 'g')) AS l, length(regexp_replace(word, '[^\\p{Latin}]+', '', 'g')) AS a, length(regexp_replace(word, '[^\\p{Cyrillic}]+', '', 'g')) AS y"


@query("v_segments", sql=f"""WITH {_RECALL}, o AS (SELECT *, place - row_number() OVER (PARTITION BY recording_id ORDER BY place) AS run FROM f WHERE NOT found),
    t AS (SELECT {_LETTERS}, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS triple FROM o WINDOW w AS (PARTITION BY recording_id, run ORDER BY place)),
    g AS (SELECT recording_id, run, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS words, count(DISTINCT triple) AS d, {_SCRIPT.format('sum(l)', 'sum(a)', 'sum(y)')} AS mine FROM t GROUP BY recording_id, run),
    b AS (SELECT g.recording_id, g.run, {_SCRIPT.format('sum(l)', 'sum(a)', 'sum(y)')} AS theirs FROM g JOIN (SELECT {_LETTERS} FROM s) s ON s.recording_id = g.recording_id AND s.at_us BETWEEN g.first_us - 1000000 AND g.last_us + 1000000 GROUP BY g.recording_id, g.run)
    SELECT recording_id, first_us, last_us, words, CASE WHEN words >= 6 AND d * 2 < words - 2 THEN 'repetition' WHEN mine <> theirs THEN 'script' ELSE 'loss' END AS kind FROM g LEFT JOIN b USING (recording_id, run)""")
def eva4_lost_runs(segments: DataFrame) -> DataFrame:
    again = _again(segments)
    return c.lost_runs(c.trigram_recall(segments, again), again)


_SEAMS = f"""r AS (SELECT * FROM {_TRIPLES.replace('{0}', '{v_segments}')} g4), s AS (SELECT * FROM {_TRIPLES.replace('{0}', _AGAIN)} g4), b AS (SELECT * FROM {RANGES} b0),
    m AS (SELECT x.* FROM (SELECT recording_id, lead(win_start_us) OVER (PARTITION BY recording_id ORDER BY idx) AS start_us, win_end_us AS end_us FROM PLANNED p) x JOIN b USING (recording_id) WHERE x.start_us < x.end_us AND x.start_us >= b.start_us AND x.end_us <= b.end_us),
    w AS (SELECT b.recording_id, b.start_us, b.end_us, coalesce(list(m ORDER BY m.start_us) FILTER (m.start_us IS NOT NULL), []) AS seams FROM b LEFT JOIN m USING (recording_id) GROUP BY b.recording_id, b.start_us, b.end_us),
    k AS (SELECT recording_id, start_us AS p, end_us AS until, seams, CASE WHEN len(seams) > 0 THEN seams[1].end_us - seams[1].start_us + 6000000 ELSE 11000000 END AS width FROM w
        UNION ALL SELECT recording_id, CASE WHEN len(list_filter(seams, lambda z: p < z.end_us + 3000000 AND p + width > z.start_us - 3000000)) > 0 THEN p + 1000000 ELSE p + width END, until, seams, width FROM k WHERE p + width <= until),
    z AS (SELECT recording_id, 'seam' AS kind, start_us - 3000000 AS start_us, end_us + 3000000 AS end_us FROM m
        UNION ALL SELECT recording_id, 'control', p, p + width FROM k WHERE p + width <= until AND len(list_filter(seams, lambda z: p < z.end_us + 3000000 AND p + width > z.start_us - 3000000)) = 0),
    i AS (SELECT z.recording_id, z.kind, z.start_us, z.end_us, r.place, r.word, r.at_us FROM z JOIN r ON r.recording_id = z.recording_id AND r.at_us >= z.start_us AND r.at_us < z.end_us),
    h AS (SELECT DISTINCT z.recording_id, z.start_us, z.end_us, s.triple FROM z JOIN s ON s.recording_id = z.recording_id AND s.at_us >= z.start_us - 6000000 AND s.until_us <= z.end_us + 6000000 WHERE s.triple IS NOT NULL),
    q AS (SELECT recording_id, kind, start_us, end_us, i.place, i.word, i.at_us, bool_or(h.triple IS NOT NULL) AS hit FROM i LEFT JOIN (SELECT recording_id, place + j AS place, triple FROM r, range(0, 3) v(j) WHERE triple IS NOT NULL) e USING (recording_id, place) LEFT JOIN h USING (recording_id, start_us, end_us, triple) GROUP BY ALL),
    o AS (SELECT *, place - row_number() OVER (PARTITION BY recording_id, start_us ORDER BY place) AS run FROM q WHERE kind = 'seam' AND NOT hit),
    t AS (SELECT {_LETTERS}, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS triple FROM o WINDOW w AS (PARTITION BY recording_id, start_us, run ORDER BY place)),
    g AS (SELECT recording_id, start_us, end_us, run, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS words, count(DISTINCT triple) AS d, {_SCRIPT.format('sum(l)', 'sum(a)', 'sum(y)')} AS mine FROM t GROUP BY recording_id, start_us, end_us, run HAVING count(*) >= 3),
    b2 AS (SELECT g.recording_id, g.start_us, g.run, {_SCRIPT.format('sum(l)', 'sum(a)', 'sum(y)')} AS theirs FROM g JOIN (SELECT {_LETTERS} FROM s) s ON s.recording_id = g.recording_id AND s.at_us BETWEEN g.first_us - 1000000 AND g.last_us + 1000000 GROUP BY g.recording_id, g.start_us, g.run),
    losses AS (SELECT recording_id, start_us + 3000000 AS start_us, end_us - 3000000 AS end_us, first_us, last_us, words, CASE WHEN words >= 6 AND d * 2 < words - 2 THEN 'repetition' WHEN mine <> theirs THEN 'script' ELSE 'loss' END AS kind FROM g LEFT JOIN b2 USING (recording_id, start_us, run))"""


_WIDE = PLAN.replace("10000000", "30000000").replace("8000000", "28000000").replace("7999999", "27999999")


@query("v_segments", sql=f"""WITH RECURSIVE {_SEAMS.replace("PLANNED", _WIDE)},
    n AS (SELECT z.recording_id, z.kind, count(DISTINCT (z.start_us)) AS stretches FROM z GROUP BY ALL), u AS (SELECT recording_id, kind, count(*) AS words FROM i GROUP BY ALL), y AS (SELECT recording_id, kind, count(*) FILTER (hit) AS found FROM q GROUP BY ALL),
    j AS (SELECT n.recording_id, coalesce(max(stretches) FILTER (kind = 'seam'), 0) AS seams, coalesce(max(words) FILTER (kind = 'seam'), 0) AS seam_words, coalesce(max(found) FILTER (kind = 'seam'), 0) AS seam_found,
        coalesce(max(stretches) FILTER (kind = 'control'), 0) AS controls, coalesce(max(words) FILTER (kind = 'control'), 0) AS control_words, coalesce(max(found) FILTER (kind = 'control'), 0) AS control_found FROM n LEFT JOIN u USING (recording_id, kind) LEFT JOIN y USING (recording_id, kind) GROUP BY n.recording_id),
    e2 AS (SELECT recording_id, CAST(coalesce(sum(words) FILTER (kind <> 'loss'), 0) AS BIGINT) AS explained, coalesce(max(words) FILTER (kind = 'loss'), 0) AS longest_loss FROM losses GROUP BY recording_id),
    f AS (SELECT j.*, coalesce(explained, 0) AS explained, coalesce(longest_loss, 0) AS longest_loss FROM j LEFT JOIN e2 USING (recording_id))
    SELECT *, (seam_words > 0 AND control_words > 0 AND (control_found * seam_words - (seam_found + explained) * control_words) * 10 > seam_words * control_words) OR longest_loss >= 8 AS finding FROM f""")
def eva5_seam_comparison(segments: DataFrame) -> DataFrame:
    return c.seam_comparison(_again(segments), segments, *_seams_and_ranges(segments, 30_000_000))


def _seams_and_ranges(segments: DataFrame, window_us: int) -> tuple[DataFrame, DataFrame]:
    ranges = segments.groupBy("recording_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return seam_spans(plan_chunks(ranges, window_us, 2_000_000), 0), ranges


@query("v_segments", sql=f"WITH RECURSIVE {_SEAMS.replace('PLANNED', PLAN)} SELECT * FROM losses")
def eva5_seam_losses(segments: DataFrame) -> DataFrame:
    """Runs that are lost at seams of chunks of ten seconds, each with its seam and what explains it."""
    subject = _again(segments)
    return c.seam_losses(c.stretch_words(segments, subject, c.seams_inside(*_seams_and_ranges(segments, 10_000_000))), subject)


_TEXT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("v_segments", sql=f"""WITH a AS (SELECT *, {_TEXT} AS t FROM {{v_segments}} s), b AS (SELECT recording_id, t, min(start_us) + 250000 AS s, min(end_us) + 250000 AS e FROM a WHERE ordinal % 5 <> 0 GROUP BY recording_id, t HAVING count(*) = 1)
    SELECT a.recording_id, a.ordinal, abs(a.start_us - b.s) AS start_diff_us, abs(a.end_us - b.e) AS end_diff_us FROM a JOIN b USING (recording_id, t) WHERE len(string_split(t, ' ')) >= 3 AND abs(a.start_us - b.s) <= 6000000""")
def eva7_timing_differences(segments: DataFrame) -> DataFrame:
    return c.timing_differences(segments, _again(segments))


@query("v_segments", sql="""SELECT recording_id, CAST(CASE WHEN gap <= 0 THEN 0 WHEN gap <= 20000 THEN 1 WHEN gap <= 100000 THEN 2 WHEN gap <= 500000 THEN 3 WHEN gap <= 1000000 THEN 4 WHEN gap <= 5000000 THEN 5 ELSE 6 END AS INTEGER) AS bin, count(*) AS gaps
    FROM (SELECT recording_id, start_us - lag(end_us) OVER (PARTITION BY recording_id ORDER BY ordinal) AS gap FROM {v_segments} s) x WHERE gap IS NOT NULL GROUP BY ALL""")
def eva8_gap_histogram(segments: DataFrame) -> DataFrame:
    return c.gap_histogram(segments)


@query("v_segments", sql="""SELECT recording_id, start_us, md5(text) AS text, 'a' AS side FROM {v_segments} s WHERE ordinal % 5 = 0 OR ordinal % 7 = 0
    UNION ALL SELECT recording_id, start_us + 1, md5(text), 'b' FROM {v_segments} s WHERE ordinal % 5 <> 0 AND ordinal % 7 = 0""")
def eva12_compare_revisions(segments: DataFrame) -> DataFrame:
    other = segments.where("ordinal % 5 <> 0").withColumn("start_us", F.when(F.col("ordinal") % 7 == 0, F.col("start_us") + 1).otherwise(F.col("start_us")))
    return c.compare_revisions(segments, other).select("recording_id", "start_us", F.md5("text").alias("text"), "side")
