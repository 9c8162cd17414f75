"""Queries of file formats and text rules: files are built out of the tables, read back, and held against the rows they were built of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import clock, text
from tracewell.operators import more, reports, speakers, visual
from tracewell.operators.listing import window_violations
from tracewell.operators.speech import cue_quality
from tracewell.plans.registry import query
from tracewell.plans.text_queries import JOINED, WORDS
from tracewell.plans.visual_queries import DELTAS
from tracewell.sources import records, sidecar

_SAID = "(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, ordinal) AS n FROM {v_segments} g WHERE trim(text) <> '')"
_LINE = "trim(replace(text, chr(10), ' '))"


@query("v_segments", sql=f"SELECT recording_id, n AS ordinal, start_us // 1000 * 1000 AS start_us, end_us // 1000 * 1000 AS end_us, md5({_LINE}) AS text FROM {_SAID} x")
def src1_read_subrip(segments: DataFrame) -> DataFrame:
    """SubRip files of all recordings, written and read again."""
    cues, _ = sidecar.read_cues(sidecar.subrip(segments).select(F.col("recording_id").alias("path"), "text"))
    return cues.select(F.col("path").alias("recording_id"), "ordinal", "start_us", "end_us", F.md5("text").alias("text"))


def _webvtt(segments: DataFrame) -> DataFrame:
    """A WebVTT file of each turn, which is one cue; some have two voices, some a broken time."""
    stamp = lambda c: text.milliseconds(F.col(c), ".")
    voice = F.when(F.col("ordinal") % 4 == 0, F.concat(F.lit("<v a>x</v> <v b>"), F.lit("y"))).otherwise(F.concat(F.lit("<v "), "speaker", F.lit(">"), F.lit("said")))
    times = F.when(F.col("ordinal") % 7 == 3, F.concat(stamp("end_us"), F.lit(" --> "), stamp("start_us"))).otherwise(F.concat(stamp("start_us"), F.lit(" --> "), stamp("end_us")))
    return segments.select(F.concat_ws("-", "recording_id", "ordinal").alias("path"), F.concat(F.lit("WEBVTT\n\nNOTE built\n\n1\n"), times, F.lit(" align:start\n"), voice, F.lit("\n")).alias("text"))


@query("v_segments", sql="""SELECT concat(recording_id, '-', ordinal) AS path, start_us // 1000 * 1000 AS start_us, end_us // 1000 * 1000 AS end_us, CASE WHEN ordinal % 4 = 0 THEN 'x y' ELSE 'said' END AS text, CASE WHEN ordinal % 4 <> 0 THEN speaker END AS speaker FROM {v_segments} g WHERE ordinal % 7 <> 3""")
def src2_read_webvtt(segments: DataFrame) -> DataFrame:
    return sidecar.read_cues(_webvtt(segments), webvtt=True)[0].select("path", "start_us", "end_us", "text", "speaker")


@query("v_segments", sql="SELECT concat(recording_id, '-', ordinal) AS path, 'reversed_timing' AS problem FROM {v_segments} g WHERE ordinal % 7 = 3")
def src2_rejected_files(segments: DataFrame) -> DataFrame:
    return sidecar.read_cues(_webvtt(segments), webvtt=True)[1].select("path", "problem")


@query("pages", sql="SELECT page_id AS path, CASE page_id % 5 WHEN 0 THEN 'webvtt' WHEN 1 THEN 'webvtt' WHEN 4 THEN NULL ELSE 'subrip' END AS format, CASE page_id % 5 WHEN 4 THEN 'not_utf8' END AS problem FROM pages")
def src3_detect_sidecar_format(pages: DataFrame) -> DataFrame:
    """Pages with one head or another: a mark of byte order, a name that only begins alike, bytes of another encoding."""
    k = F.col("page_id") % 5
    head = F.when(k == 0, F.lit("WEBVTT\n")).when(k == 1, F.lit("﻿WEBVTT ")).when(k == 2, F.lit("WEBVTTX ")).otherwise(F.lit("1\n"))
    content = F.when(k == 4, F.unhex(F.lit("FFFE4100"))).otherwise(F.concat(head, F.coalesce("html", F.lit(""))).cast("binary"))
    return sidecar.detect_sidecar_format(pages.select(F.col("page_id").alias("path"), content.alias("content"))).select("path", "format", "problem")


@query("events", sql="SELECT user_id AS recording_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events WHERE event_type <> 'error'")
def src17_clock_tags(events: DataFrame) -> DataFrame:
    tags = F.when(F.col("event_type") != "error", F.concat(F.lit('{"creation_time": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))).otherwise(F.lit('{"title": "x"}'))
    return records.clock_tags(events.select(F.col("user_id").alias("recording_id"), F.concat(F.lit('{"format": {"tags": '), tags, F.lit("}}")).alias("metadata_json")))


@query("lineitem", sql="""SELECT l_orderkey, CAST(round(sum(l_partkey % 128 / 128.0::DOUBLE) / count(*) * 10000) AS INTEGER) AS confidence_bp FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey, NULL FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber % 3 <> 0) = 0""")
def agg11_chunk_confidence(lineitem: DataFrame) -> DataFrame:
    token = F.struct(F.when(F.col("l_linenumber") % 3 == 0, F.lit("[_BEG_]")).otherwise(F.lit("word")).alias("text"), (F.col("l_partkey") % 128 / 128).alias("p"))
    return records.chunk_confidence(lineitem.select("l_orderkey", F.array(token).alias("tokens")), ("l_orderkey",))


@query("v_segments", sql=f"SELECT recording_id, ordinal, regexp_matches({JOINED}, '(^|\\x01)t\\x01?h\\x01?a\\x01?t\\x01?w\\x01?i\\x01?t\\x01?h(\\x01|$)') AS hit FROM {{v_segments}} g")
def str3_phrase_match(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id", "ordinal", text.phrase_match(text.normalise_words(F.col("text")), text.normalise_words(F.lit("that with"))).alias("hit"))


@query("v_segments", sql=f"SELECT recording_id, ordinal, list_has_all({WORDS.format('text')}, ['that', 'with']) AS hit FROM {{v_segments}} g")
def str4_all_terms_match(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id", "ordinal", text.all_terms_match(text.normalise_words(F.col("text")), text.normalise_words(F.lit("with that"))).alias("hit"))


@query("documents", sql="""SELECT doc_id, md5(CASE WHEN strlen(t) <= 200 THEN t ELSE substr(t, 1, list_max(list_filter(range(0, 201), lambda i: strlen(substr(t, 1, i)) <= 200))) END) AS clean
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f-\\x{9f}]', chr(65533), 'g') AS t FROM documents) x""")
def str9_sanitize(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(text.sanitize(F.coalesce("text", F.lit("")), 200)).alias("clean"))


@query("v_segments", sql="SELECT recording_id, ordinal, CASE ordinal % 4 WHEN 0 THEN NULL WHEN 1 THEN speaker WHEN 2 THEN speaker ELSE NULL END AS speaker FROM {v_segments} g")
def str12_voice_label(segments: DataFrame) -> DataFrame:
    """One voice, one voice twice, two voices, none."""
    k = F.col("ordinal") % 4
    one = F.concat(F.lit("<v.loud  "), "speaker", F.lit(">a</v>"))
    payload = F.when(k == 0, F.concat(one, F.lit("<v nobody>b"))).when(k == 1, one).when(k == 2, F.concat(one, F.lit(" "), one)).otherwise(F.lit("<i>no voice</i>"))
    return segments.select("recording_id", "ordinal", text.voice_label(payload).alias("speaker"))


@query("v_reports", sql="""WITH t AS (SELECT report_id, regexp_extract_all(concat(text, ' from ', report_id % 70, ':', lpad((report_id % 60)::VARCHAR, 2, '0'), ' to 1:0', report_id % 10, ':30, not 1:2:3:4 or 7:5'), '(?:^|[^0-9:.])((?:[0-9]{1,2}:)?[0-5]?[0-9]:[0-5][0-9])(?:$|[^0-9:])', 1) AS f FROM {v_reports} x)
    SELECT report_id, list_transform(f, lambda t: list_reduce(list_transform(string_split(t, ':'), lambda p: p::BIGINT), lambda a, b: a * 60 + b)) AS seconds FROM t""")
def str18_times_in(v_reports: DataFrame) -> DataFrame:
    r = F.col("report_id")
    told = F.concat("text", F.lit(" from "), (r % 70).cast("string"), F.lit(":"), F.lpad((r % 60).cast("string"), 2, "0"), F.lit(" to 1:0"), (r % 10).cast("string"), F.lit(":30, not 1:2:3:4 or 7:5"))
    return v_reports.select("report_id", told.alias("t")).select("report_id", reports.times_in("t").alias("seconds"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(CAST((l_suppkey * 1000003 - 500) AS DECIMAL(30, 0)) * 90000 / 1000000) AS BIGINT) AS pts FROM lineitem")
def num2_first_pts_at_or_after(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", clock.first_pts_at_or_after(F.col("l_suppkey") * 1_000_003, 1, 90_000, 500).alias("pts"))


@query("v_samples", sql=f"SELECT recording_id, time_us FROM {DELTAS} d WHERE is_change")
def win5_is_change(samples: DataFrame) -> DataFrame:
    deltas = visual.sample_deltas(samples)
    return deltas.where(visual.is_change(F.col("changed_blocks"), F.col("max_block_delta"))).select("recording_id", "time_us")


@query("v_turns", "v_segments", sql="""WITH o AS (SELECT s.recording_id, s.ordinal, s.start_us, s.end_us, t.cluster AS tag, sum(least(s.end_us, t.end_us) - greatest(s.start_us, t.start_us)) AS us FROM {v_segments} s JOIN {v_turns} t ON s.recording_id = t.recording_id AND s.start_us < t.end_us AND t.start_us < s.end_us GROUP BY s.recording_id, s.ordinal, s.start_us, s.end_us, t.cluster),
    p AS (SELECT *, sum(us) OVER (PARTITION BY recording_id, ordinal) AS speech, row_number() OVER (PARTITION BY recording_id, ordinal ORDER BY us DESC, tag) AS n FROM o)
    SELECT recording_id, ordinal, tag FROM p WHERE n = 1 AND least(speech, end_us - start_us) * 10000 // (end_us - start_us) >= 5000 AND us * 10000 // speech >= 7000""")
def agg6_dominant_speaker(turns: DataFrame, segments: DataFrame) -> DataFrame:
    labelled = turns.select("recording_id", F.col("cluster").alias("tag"), "start_us", "end_us")
    return speakers.attribute_speakers(segments, labelled).where("outcome = 'labelled'").select("recording_id", "ordinal", "tag")


@query("v_turns", sql="""WITH b AS (SELECT DISTINCT recording_id, unnest(range(start_us // 1000000, (end_us - 1) // 1000000 + 1)) AS cell, event_id % 3 AS k FROM {v_turns} t),
    c AS (SELECT recording_id, cell, bool_or(k = 0) AS u, bool_or(k = 1) AS r, bool_or(k = 2) AS i FROM b GROUP BY recording_id, cell), g AS (SELECT recording_id, cell, cell - row_number() OVER (PARTITION BY recording_id ORDER BY cell) AS run FROM c WHERE u AND NOT r AND i)
    SELECT recording_id, min(cell) * 1000000 AS start_us, (max(cell) + 1) * 1000000 AS end_us FROM g GROUP BY recording_id, run""")
def set13_carried_untranscribed(turns: DataFrame) -> DataFrame:
    """Spans of whole seconds, so that SQL can go cell by cell."""
    whole = lambda k: turns.where(f"event_id % 3 = {k}").selectExpr("recording_id", "start_us div 1000000 * 1000000 AS start_us", "((end_us - 1) div 1000000 + 1) * 1000000 AS end_us")
    return more.carried_untranscribed(whole(0), whole(1), whole(2))


@query("v_segments", sql="""SELECT recording_id, 'overlapping' AS kind, count(*) AS cues, min(ordinal) AS first_ordinal FROM (
    SELECT *, max(start_us + 1000000 + (ordinal % 3) * 3000000) OVER (PARTITION BY recording_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM {v_segments} s) x WHERE start_us < latest GROUP BY recording_id""")
def flt10_cue_quality(segments: DataFrame) -> DataFrame:
    """Cues of one, four and seven seconds in turn, five seconds apart: every third is overlapped."""
    return cue_quality(segments.withColumn("end_us", F.col("start_us") + 1_000_000 + F.col("ordinal") % 3 * 3_000_000))


_PLANTED = "(SELECT recording_id, start_us // 20000000 AS ordinal, start_us AS representative_us, CASE event_id % 5 WHEN 0 THEN start_us WHEN 1 THEN end_us ELSE coalesce(lead(start_us) OVER (PARTITION BY recording_id, start_us // 20000000 ORDER BY start_us, event_id), end_us) END AS span_end_us, event_id % 130 AS sample_count FROM {v_turns} t)"


@query("v_turns", sql=f"""WITH r AS (SELECT *, lead(representative_us) OVER w AS following, row_number() OVER w AS n FROM {_PLANTED} p WINDOW w AS (PARTITION BY recording_id, ordinal ORDER BY representative_us))
    SELECT recording_id, ordinal, 'empty' AS violation FROM r WHERE span_end_us <= representative_us UNION ALL SELECT recording_id, ordinal, 'not_contiguous' FROM r WHERE following <> span_end_us
    UNION ALL SELECT recording_id, ordinal, 'too_many' FROM r WHERE n > 32 UNION ALL SELECT recording_id, ordinal, 'samples' FROM r WHERE sample_count > 122 OR sample_count < 1""")
def int3_window_violations(turns: DataFrame) -> DataFrame:
    """Turns as candidates, some of them empty, apart, or of too many samples."""
    by = "OVER (PARTITION BY recording_id, start_us div 20000000 ORDER BY start_us, event_id)"
    planted = turns.selectExpr("recording_id", "start_us div 20000000 AS ordinal", "start_us AS representative_us", f"CASE event_id % 5 WHEN 0 THEN start_us WHEN 1 THEN end_us ELSE coalesce(lead(start_us) {by}, end_us) END AS span_end_us", "event_id % 130 AS sample_count")
    return window_violations(planted)


@query("v_samples")
def int3_own_candidates(samples: DataFrame) -> DataFrame:
    """Our own candidates break none of the rules: no row comes back."""
    return window_violations(visual.candidates(samples))
