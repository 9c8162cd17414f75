"""Queries of clocks, evidence and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import clock
from tracewell.functions.text import derive_id
from tracewell.operators import more
from tracewell.operators import evidence as e
from tracewell.plans.registry import query
from tracewell.plans.span_queries import MERGED


@query("v_clock_lines", sql="""SELECT recording_id, time_us, CASE WHEN contains(text, ' ') THEN 'several_times' END AS refusal,
    CASE WHEN NOT contains(text, ' ') THEN (CAST(text[1:2] AS BIGINT) * 3600 + CAST(text[4:5] AS BIGINT) * 60 + CAST(text[7:8] AS BIGINT)) * 1000000 END AS value_us FROM {v_clock_lines} c""")
def tim3_read_clock_face(lines: DataFrame) -> DataFrame:
    return lines.select("recording_id", "time_us", clock.read_clock_face(F.col("text")).alias("f")).select("recording_id", "time_us", "f.*")


_TEXT = {0: "Z", 1: "+02:00", 2: "-0530", 3: "", 4: "-00:00"}


@query("events", sql="""SELECT event_id, CASE WHEN k IN (0, 4) THEN u WHEN k = 1 THEN u - 7200000000 WHEN k = 2 THEN u + 19800000000 END AS utc_us, CASE WHEN k IN (1, 2, 3) THEN u END AS local_us,
    CAST(CASE k WHEN 1 THEN 7200 WHEN 2 THEN -19800 END AS INTEGER) AS offset_s FROM (SELECT event_id, event_id % 5 AS k, epoch_us(date_trunc('second', ts)) AS u FROM events) x""")
def tim2_parse_clock_reading(events: DataFrame) -> DataFrame:
    zone = F.create_map(*[F.lit(x) for pair in _TEXT.items() for x in pair])[(F.col("event_id") % 5).cast("int")]
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return events.select("event_id", clock.parse_clock_reading(text).alias("r")).select("event_id", "r.*")


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey * 1001 * 1000000 // 30000 + 500 AS time_us, CAST(ceil(CAST(l_suppkey * 1000003 AS DECIMAL(30, 0)) * 30000 / 1001000000) AS BIGINT) AS pts FROM lineitem")
def num1_pts_to_micros(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", clock.pts_to_micros(F.col("l_partkey"), 1001, 30_000, 500).alias("time_us"), clock.first_pts_at_or_after(F.col("l_suppkey") * 1_000_003, 1001, 30_000, 0).alias("pts"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10000 // nullif(l_partkey, 0) AS share_bp FROM lineitem")
def num3_basis_points(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", clock.basis_points(F.col("l_quantity").cast("long"), F.col("l_partkey")).alias("share_bp"))


@query("part", sql="""SELECT p_partkey, greatest(0, least(10, p_size % 7 + 8) - greatest(0, p_size % 7)) * greatest(0, least(10, p_partkey % 11 + 6) - greatest(0, p_partkey % 11)) * 2 >= 48 AS same FROM part""")
def num11_same_place(part: DataFrame) -> DataFrame:
    box = lambda *v: F.struct(*[(x if not isinstance(x, int) else F.lit(x)).cast("long").alias(n) for n, x in zip("xywh", v, strict=True)])
    return part.select("p_partkey", clock.same_place(box(0, 0, 10, 10), box(F.col("p_size") % 7, F.col("p_partkey") % 11, 8, 6)).alias("same"))


_RECORDS = "(SELECT o_orderkey AS record_id, o_custkey AS request_key, o_orderkey AS number, CASE WHEN o_orderstatus = 'O' THEN 'cut' END AS partial_reason, 'tool' AS tool FROM orders)"


def _records(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("request_key"), F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "O", "cut").alias("partial_reason"), F.lit("tool").alias("tool"))


@query("customer", "orders", sql=f"SELECT c_custkey AS request_key, max(record_id) AS record_id FROM customer JOIN {_RECORDS} r ON r.request_key = c_custkey WHERE partial_reason IS NULL GROUP BY c_custkey")
def join17_reusable_records(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return e.reusable_records(customer.select(F.col("c_custkey").alias("request_key")), _records(orders))


@query("lineitem", sql="SELECT l_partkey AS evidence_id, max(l_orderkey) AS record_id, max(l_orderkey) AS number FROM lineitem GROUP BY l_partkey")
def join18_item_by_id(lineitem: DataFrame) -> DataFrame:
    return e.item_by_id(lineitem.select(F.col("l_partkey").alias("evidence_id"), F.col("l_orderkey").alias("record_id"), F.col("l_orderkey").alias("number")))


@query("lineitem", sql="SELECT l_partkey AS evidence_id, count(DISTINCT {'a': l_returnflag, 'b': l_linestatus}) AS versions FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT {'a': l_returnflag, 'b': l_linestatus}) > 1")
def int5_item_conflicts(lineitem: DataFrame) -> DataFrame:
    return e.item_conflicts(lineitem.withColumn("evidence_id", F.col("l_partkey")), ("l_returnflag", "l_linestatus"))


@query("v_segments", sql="""SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, end_us, carried DESC, ordinal) AS ordinal, start_us, carried FROM (
    SELECT recording_id, ordinal, start_us, end_us, true AS carried FROM {v_segments} s WHERE end_us <= 8000000 OR start_us >= 16000000
    UNION ALL SELECT recording_id, ordinal, start_us + 1, end_us + 1, false FROM {v_segments} s WHERE start_us >= 8000000 AND end_us <= 16000000) x""")
def set12_splice_revision(segments: DataFrame) -> DataFrame:
    run = segments.where("start_us >= 8000000 AND end_us <= 16000000").withColumn("start_us", F.col("start_us") + 1).withColumn("end_us", F.col("end_us") + 1)
    return e.splice_revision(segments, run, 8_000_000, 16_000_000).select("recording_id", "ordinal", "start_us", "carried")


@query("v_segments", sql="""WITH c AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN ordinal - 1 END AS from_segment FROM {v_segments} s)
    SELECT c.recording_id, c.ordinal, md5(o.text) AS origin FROM c LEFT JOIN c o ON o.recording_id = c.recording_id AND o.ordinal = c.from_segment""")
def join12_lineage(segments: DataFrame) -> DataFrame:
    rows = segments.select("recording_id", "ordinal", "text", F.col("recording_id").alias("revision_id"), F.col("ordinal").alias("segment_id"), F.col("recording_id").alias("from_revision"), F.when(F.col("ordinal") % 3 == 0, F.col("ordinal") - 1).alias("from_segment"))
    return e.lineage(rows).select("recording_id", "ordinal", F.md5("origin_text").alias("origin"))


@query("v_segments", sql="SELECT recording_id, ordinal, 'outside' AS violation FROM {v_segments} s WHERE end_us > 20000000")
def int2_verify_revision(segments: DataFrame) -> DataFrame:
    return e.verify_revision(segments, segments.select("recording_id").distinct().withColumn("duration_us", F.lit(20_000_000)))


@query("v_segments", sql="SELECT recording_id, ordinal FROM {v_segments} s WHERE ordinal % 4 = 0")
def int1_verify_identities(segments: DataFrame) -> DataFrame:
    own = derive_id("seg", "segment", F.col("recording_id"), F.col("ordinal"))
    rows = segments.withColumn("id", F.when(F.col("ordinal") % 4 == 0, F.concat(own, F.lit("x"))).otherwise(own))
    return e.verify_identities(rows, "seg", "segment", ("recording_id", "ordinal")).select("recording_id", "ordinal")


@query("v_segments", sql="SELECT recording_id, count(*) AS artifacts, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sha256(string_agg('s' || ordinal || ' ' || sha256(text), chr(10) ORDER BY 's' || ordinal || ' ' || sha256(text))) AS manifest_sha256 FROM {v_segments} s GROUP BY recording_id")
def int6_retained_manifest(segments: DataFrame) -> DataFrame:
    return e.retained_manifest(segments.select("recording_id", F.concat(F.lit("s"), "ordinal").alias("name"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes")))


_ANCHORS = "(SELECT recording_id, event_id AS rank, CASE cluster WHEN 'click' THEN 'screen_clock' WHEN 'view' THEN 'container_time' WHEN 'purchase' THEN 'operator' WHEN 'error' THEN 'unknown' ELSE 'screen_timestamp' END AS source, start_us AS media_us, end_us * 3 AS utc_us, 700000 AS precision_us FROM {v_turns} t)"


def _anchors(turns: DataFrame) -> DataFrame:
    source = F.when(F.col("cluster") == "click", "screen_clock").when(F.col("cluster") == "view", "container_time").when(F.col("cluster") == "purchase", "operator").when(F.col("cluster") == "error", "unknown").otherwise("screen_timestamp")
    return turns.select("recording_id", F.col("event_id").alias("rank"), source.alias("source"), F.col("start_us").alias("media_us"), (F.col("end_us") * 3).alias("utc_us"), F.lit(700_000).alias("precision_us"))


@query("v_turns", sql=f"SELECT recording_id, source, rank FROM {_ANCHORS} a WHERE source <> 'unknown' QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY list_position(['operator', 'creation_date_tag', 'confirmed_screen_clock', 'container_time', 'screen_timestamp', 'screen_clock'], source), rank) = 1")
def tim4_select_anchor(turns: DataFrame) -> DataFrame:
    return e.select_anchor(_anchors(turns)).select("recording_id", "source", "rank")


@query("v_turns", sql=f"""SELECT recording_id, CASE WHEN count(*) < 2 THEN 'single' WHEN max(utc_us - media_us) - min(utc_us - media_us) > 2000000 + 1400000 THEN 'conflicting' ELSE 'consistent' END AS verdict
    FROM {_ANCHORS} a WHERE utc_us IS NOT NULL GROUP BY recording_id""")
def tim5_anchor_consistency(turns: DataFrame) -> DataFrame:
    return e.anchor_consistency(_anchors(turns))


@query("v_turns", "v_segments", sql="""WITH a AS (SELECT recording_id, min(start_us) AS m FROM {v_turns} t GROUP BY recording_id), g AS (SELECT recording_id, start_us AS at_us, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS jump FROM {v_turns} t WHERE cluster = 'error'),
    before AS (SELECT a.recording_id, coalesce(sum(g.jump), 0) AS moved FROM a LEFT JOIN g ON g.recording_id = a.recording_id AND g.at_us <= a.m GROUP BY a.recording_id)
    SELECT s.recording_id, s.ordinal AS item_id, CAST(min(CASE WHEN a.m IS NULL THEN NULL ELSE 1000000000 + s.start_us - a.m END) + coalesce(sum(g.jump), 0) - min(b.moved) AS BIGINT) AS utc_us, count(g.at_us) AS part
    FROM {v_segments} s LEFT JOIN a USING (recording_id) LEFT JOIN before b USING (recording_id) LEFT JOIN g ON g.recording_id = s.recording_id AND g.at_us <= s.start_us GROUP BY s.recording_id, s.ordinal""")
def tim6_clock_time_at(turns: DataFrame, segments: DataFrame) -> DataFrame:
    anchors = turns.groupBy("recording_id").agg(F.min("start_us").alias("media_us")).withColumn("utc_us", F.lit(1_000_000_000).cast("long"))
    gaps = turns.where("cluster = 'error'").select("recording_id", F.col("start_us").alias("at_us"), F.col("event_id").alias("jump_us"), F.when(F.col("event_id") % 2 == 0, "accepted").otherwise("detected").alias("state"))
    return e.clock_time_at(segments.select("recording_id", F.col("ordinal").alias("item_id"), F.col("start_us").alias("media_us")), anchors, gaps)


@query("v_turns", sql="""SELECT g.recording_id, g.event_id AS gap_id, j.event_id AS jump_id FROM {v_turns} g JOIN {v_turns} j ON g.recording_id = j.recording_id AND g.cluster = 'error' AND j.cluster = 'signup' AND abs(g.start_us - j.start_us) <= 60000000
    AND g.event_id % 100 <= j.event_id % 100 + 10 AND j.event_id % 100 <= g.event_id % 100 + 5""")
def join16_same_gap(turns: DataFrame) -> DataFrame:
    at = turns.select("recording_id", "event_id", "cluster", F.col("start_us").alias("at_us"), (F.col("event_id") % 100).alias("low"))
    gaps = at.where("cluster = 'error'").select("recording_id", F.col("event_id").alias("gap_id"), "at_us", "low", (F.col("low") + 5).alias("high"))
    jumps = at.where("cluster = 'signup'").select("recording_id", F.col("event_id").alias("jump_id"), "at_us", "low", (F.col("low") + 10).alias("high"))
    return e.same_gap(gaps, jumps)


_GRID = "(SELECT recording_id, idx AS ordinal, idx * 25000000 AS start_us, idx * 25000000 + 25000000 AS end_us, CASE outcome WHEN 'unusable' THEN 'undecodable' ELSE 'analysed' END AS outcome, CASE WHEN outcome = 'silent' THEN 1 ELSE 0 END AS dropped, outcome <> 'pending' AS recorded FROM {v_chunks} c)"
_GAPS = f"(SELECT recording_id, start_us, end_us, CASE WHEN NOT recorded THEN 'not_analyzed' WHEN outcome = 'undecodable' THEN 'undecodable' ELSE 'budget_exhausted' END AS reason FROM {_GRID} g WHERE NOT recorded OR outcome = 'undecodable' OR dropped > 0)"


def _grid(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    grid = chunks.select("recording_id", F.col("idx").alias("ordinal"), F.col("win_start_us").alias("start_us"), (F.col("win_start_us") + 25_000_000).alias("end_us"), F.when(F.col("outcome") == "unusable", "undecodable").otherwise("analysed").alias("outcome"), (F.col("outcome") == "silent").cast("int").alias("dropped"), (F.col("outcome") != "pending").alias("recorded"))
    return grid, grid.where("recorded")


@query("v_chunks", sql=f"SELECT * FROM {_GAPS} g")
def set8_coverage_gaps(chunks: DataFrame) -> DataFrame:
    return e.coverage_gaps(*_grid(chunks))


@query("v_chunks", sql=f"SELECT * FROM " + MERGED.format(f"(SELECT * FROM {_GRID} g WHERE recorded AND outcome <> 'undecodable')") + " m")
def set7_analysed_ranges(chunks: DataFrame) -> DataFrame:
    return e.analysed_ranges(_grid(chunks)[1])


@query("v_chunks", sql=f"SELECT recording_id, ordinal FROM {_GRID} g WHERE NOT recorded")
def set6_missing_windows(chunks: DataFrame) -> DataFrame:
    return e.missing_windows(*_grid(chunks)).select("recording_id", "ordinal")


@query("v_chunks", sql=f"""SELECT m.recording_id, count(*) AS ranges, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, (SELECT list(r ORDER BY list_position(['not_analyzed', 'undecodable', 'budget_exhausted'], r)) FROM (SELECT DISTINCT reason AS r FROM {_GAPS} g WHERE g.recording_id = m.recording_id) d) AS reasons
    FROM {MERGED.format(_GAPS)} m GROUP BY m.recording_id""")
def agg4_envelope_coverage(chunks: DataFrame) -> DataFrame:
    return e.envelope_coverage(e.coverage_gaps(*_grid(chunks)))


@query("v_chunks", sql=f"SELECT recording_id, ordinal, outcome FROM {_GRID} g")
def set9_merge_extension(chunks: DataFrame) -> DataFrame:
    grid, recorded = _grid(chunks)
    return e.merge_extension(recorded, grid.withColumn("outcome", F.when(F.col("recorded"), "again").otherwise(F.col("outcome")))).select("recording_id", "ordinal", "outcome")


@query("lineitem", sql="""SELECT change_id, l_linenumber, rank, left_out FROM (SELECT l_orderkey AS change_id, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_partkey, l_suppkey, l_linenumber) AS INTEGER) AS rank, greatest(0, count(*) OVER (PARTITION BY l_orderkey) - 3) AS left_out FROM lineitem) x WHERE rank <= 3""")
def sort5_top_regions(lineitem: DataFrame) -> DataFrame:
    regions = lineitem.select(F.col("l_orderkey").alias("change_id"), "l_linenumber", F.col("l_quantity").cast("long").alias("changed_pixels"), F.col("l_partkey").alias("y"), (F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("x"))
    return e.top_regions(regions, 3).select("change_id", "l_linenumber", "rank", "left_out")


@query("embeddings", sql="""SELECT vec_id AS change_id, CAST(i % 8 // 4 AS BIGINT) AS tile_x, CAST(i // 32 AS BIGINT) AS tile_y, count(*) AS changed_pixels FROM (
    SELECT vec_id, i, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 128) AS a, floor((CAST(embedding[len(embedding) - i] AS DOUBLE) + 1) * 128) AS b FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings) x) y
    WHERE abs(a - b) >= 32 GROUP BY ALL HAVING count(*) >= 4""")
def num7_changed_tiles(embeddings: DataFrame) -> DataFrame:
    """Components as pixels four apart, eight to a line, against the same in reverse."""
    def pixels(vector: str) -> DataFrame:
        each = embeddings.select(F.col("vec_id").alias("change_id"), F.expr(f"posexplode({vector}) AS (i, v)"))
        return each.select("change_id", F.expr("i % 8 * 4").alias("x"), F.expr("i div 8 * 4").alias("y"), F.floor((F.col("v").cast("double") + 1) * 128).alias("value"))

    return more.changed_tiles(pixels("embedding"), pixels("reverse(embedding)"))


@query("lineitem", sql="""WITH RECURSIVE t AS (SELECT l_orderkey AS change_id, l_partkey % 20 AS x, l_suppkey % 12 AS y, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT change_id, x, y, x * 100 + y AS mark FROM t UNION SELECT t.change_id, t.x, t.y, r.mark FROM r JOIN t ON t.change_id = r.change_id AND abs(t.x - r.x) <= 2 AND abs(t.y - r.y) <= 2),
    m AS (SELECT change_id, x, y, min(mark) AS mark FROM r GROUP BY ALL)
    SELECT change_id, CAST(min(x) * 16 AS INTEGER) AS x, CAST(min(y) * 16 AS INTEGER) AS y, CAST(least(310, max(x) * 16 + 16) - min(x) * 16 AS INTEGER) AS width, CAST(least(185, max(y) * 16 + 16) - min(y) * 16 AS INTEGER) AS height, CAST(sum(n) AS BIGINT) AS changed_pixels FROM m JOIN t USING (change_id, x, y) GROUP BY change_id, mark""")
def num7_change_regions(lineitem: DataFrame) -> DataFrame:
    tiles = lineitem.groupBy(F.col("l_orderkey").alias("change_id"), F.expr("l_partkey % 20").alias("tile_x"), F.expr("l_suppkey % 12").alias("tile_y")).agg(F.sum(F.col("l_quantity").cast("long")).alias("changed_pixels"))
    return more.change_regions(tiles, 310, 185)
