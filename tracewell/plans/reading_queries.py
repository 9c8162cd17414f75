"""Queries of several clocks, and of the evaluation of what was read and heard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import clock_sets as c
from tracewell.operators import readings as r
from tracewell.operators.more import COLLAR_US, diarization_error
from tracewell.plans.registry import query
from tracewell.plans.text_queries import WORDS

DAY, QUARTER, START = 86_400_000_000, 900_000_000, 1_600_000_000_000_000


@query("v_turns", sql="""WITH c AS (SELECT recording_id, cluster AS no, min(start_us) AS start_us, min(start_us) + (max(end_us) - min(start_us)) // 2 AS end_us FROM {v_turns} t GROUP BY recording_id, cluster),
    j AS (SELECT DISTINCT recording_id, cluster AS no, start_us // 1000000 AS at_s FROM {v_turns} t WHERE event_id % 3 = 0),
    p AS (SELECT x.recording_id, x.no AS a, y.no AS b, x.start_us AS s1, x.end_us AS e1, y.start_us AS s2, y.end_us AS e2 FROM c x JOIN c y ON x.recording_id = y.recording_id AND x.no < y.no AND x.start_us < y.end_us AND y.start_us < x.end_us),
    ab AS (SELECT p.recording_id, a, b, count(*) AS n FROM p JOIN j ON j.recording_id = p.recording_id AND j.no = a AND at_s * 1000000 > s2 AND at_s * 1000000 < e2 ANTI JOIN j k ON k.recording_id = p.recording_id AND k.no = b AND k.at_s = j.at_s GROUP BY p.recording_id, a, b),
    ba AS (SELECT p.recording_id, a, b, count(*) AS n FROM p JOIN j ON j.recording_id = p.recording_id AND j.no = b AND at_s * 1000000 > s1 AND at_s * 1000000 < e1 ANTI JOIN j k ON k.recording_id = p.recording_id AND k.no = a AND k.at_s = j.at_s GROUP BY p.recording_id, a, b)
    SELECT p.recording_id, p.a, p.b, least(e1, e2) - greatest(s1, s2) AS overlap_us, coalesce(ab.n, 0) AS a_jumps_in_b, coalesce(ba.n, 0) AS b_jumps_in_a FROM p LEFT JOIN ab USING (recording_id, a, b) LEFT JOIN ba USING (recording_id, a, b)""")
def join15_clock_pairs(turns: DataFrame) -> DataFrame:
    clocks = turns.groupBy("recording_id", F.col("cluster").alias("no")).agg(F.min("start_us").alias("start_us"), F.expr("min(start_us) + (max(end_us) - min(start_us)) div 2").alias("end_us"))
    jumps = turns.where("event_id % 3 = 0").select("recording_id", F.col("cluster").alias("no"), F.expr("start_us div 1000000 * 1000000").alias("at_us"))
    return c.clock_pairs(clocks, jumps)


_STRETCHES = "(SELECT recording_id, cluster AS no, start_us AS first_us, start_us AS first_value_us, end_us AS last_us, end_us + (event_id % 5 - 2) * 700000 AS last_value_us, CASE WHEN event_id % 2 = 0 THEN 1000000 ELSE 1000 END AS unit_us FROM {v_turns} t)"


@query("v_turns", sql=f"""SELECT recording_id, no, last_value_us - first_value_us - (last_us - first_us) AS drift_us, abs(last_value_us - first_value_us - (last_us - first_us)) > unit_us + 250000 AS differs
    FROM {_STRETCHES} s QUALIFY row_number() OVER (PARTITION BY recording_id, no ORDER BY last_us - first_us DESC, first_us, last_value_us DESC) = 1""")
def win21_clock_rate(turns: DataFrame) -> DataFrame:
    e = F.col("event_id")
    stretches = turns.select(
        "recording_id", F.col("cluster").alias("no"), F.col("start_us").alias("first_us"), F.col("start_us").alias("first_value_us"), F.col("end_us").alias("last_us"), (F.col("end_us") + (e % 5 - 2) * 700_000).alias("last_value_us"),
        F.when(e % 2 == 0, 1_000_000).otherwise(1_000).alias("unit_us"),
    )
    return c.clock_rate(stretches)


#: Runs of a clock that is left for stretches of one to five runs, of up to three other clocks.
_RUNS = """SELECT recording_id, run, event_id % 6 AS reads, event_id % 4 <> 0 AS advances,
    CASE WHEN run % 12 BETWEEN 3 AND 3 + ((run - run % 12) / 12 + recording_id) % 5 THEN 50000000 + event_id * 7919 % 3 * 20000000 ELSE event_id % 3 * 100000 END AS low_us
    FROM (SELECT recording_id, event_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, event_id) AS run FROM {v_turns}) t"""


def _level(n: int) -> str:
    """The fold of the runs ``l{n}`` (a list by recording): each run's head and place, and the runs of the turns as ``l{n + 1}``."""
    return f"""
    c{n} AS (SELECT recording_id, rs, 1::BIGINT AS pos, 1::BIGINT AS head, 0::BIGINT AS prev, rs[1].low_us AS lo, rs[1].low_us + 1500000 AS hi, rs[1].reads AS seen FROM l{n}
        UNION ALL SELECT recording_id, rs, coalesce(nx, pos + 1), CASE WHEN nx IS NULL THEN pos + 1 ELSE head END, CASE WHEN nx IS NULL THEN 0 ELSE pos END,
            CASE WHEN nx IS NULL THEN rs[pos + 1].low_us ELSE greatest(lo, rs[nx].low_us) END, CASE WHEN nx IS NULL THEN rs[pos + 1].low_us ELSE least(hi - 1500000, rs[nx].low_us) END + 1500000,
            CASE WHEN nx IS NULL THEN rs[pos + 1].reads ELSE seen + rs[nx].reads END
        FROM (SELECT *, list_min(list_filter(range(pos + 1, len(rs) + 1), lambda i: greatest(lo, rs[i].low_us) < least(hi, rs[i].low_us + 1500000) AND greatest(seen, rs[i].reads) >= 3)) AS nx FROM c{n} WHERE pos < len(rs)) s),
    s{n} AS (SELECT recording_id, rs[head].run AS head, rs[prev + 1 : pos - 1] AS gone FROM c{n} WHERE prev > 0 AND pos > prev + 1),
    k{n} AS (SELECT recording_id, rs[pos].run AS run, rs[head].run AS head FROM c{n}),
    x{n} AS (SELECT recording_id, unnest(gone).run AS run, head FROM s{n} WHERE len(list_filter(gone, lambda r: r.reads >= 3 AND r.advances)) = 0),
    l{n + 1} AS (SELECT recording_id, list(g ORDER BY g.run) AS rs FROM (SELECT recording_id, unnest(gone) AS g FROM s{n} WHERE len(list_filter(gone, lambda r: r.reads >= 3 AND r.advances)) > 0) t GROUP BY recording_id)"""


_LEVELS = 6
_FOLD = f"""WITH RECURSIVE r AS ({_RUNS.replace("/ 12", "// 12")}), l0 AS (SELECT recording_id, list({{'run': run, 'reads': reads, 'advances': advances, 'low_us': low_us}} ORDER BY run) AS rs FROM r GROUP BY recording_id),
    {", ".join(_level(n) for n in range(_LEVELS))}
    """ + " UNION ALL ".join(f"SELECT recording_id, run, '{'other_clock' if n else 'main'}' AS part, {n}::BIGINT AS depth, head FROM k{n} UNION ALL SELECT recording_id, run, 'excursion', {n}, head FROM x{n}" for n in range(_LEVELS))


@query("v_turns", sql=_FOLD)
def win19_fold_excursions(turns: DataFrame) -> DataFrame:
    runs = turns.sparkSession.sql(_RUNS.replace("/ 12", "div 12"), v_turns=turns).withColumn("run", F.col("run").cast("long")).withColumn("high_us", F.col("low_us") + 1_500_000)
    return c.fold_excursions(runs).select("recording_id", "run", "part", "depth", "head")


@query("v_turns", sql=f"""WITH s AS (SELECT recording_id, 0 AS f, 'operator' AS source, min({START} + event_id) AS utc_us FROM {{v_turns}} t WHERE cluster = 'purchase' GROUP BY recording_id),
    g AS (SELECT recording_id, concat(cluster, event_id % 9) AS source, CASE event_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 3 * {START} ELSE {START} + event_id END AS utc_us, event_id AS pos FROM {{v_turns}} t WHERE cluster <> 'purchase'),
    b AS (SELECT * FROM s UNION ALL SELECT recording_id, 1, source, arg_min(utc_us, pos) FROM g WHERE utc_us >= 788918400000000 AND utc_us <= 1700000000000000 + {DAY} GROUP BY recording_id, source)
    SELECT recording_id, source, utc_us, row_number() OVER (PARTITION BY recording_id ORDER BY f, source)::INTEGER AS place FROM b QUALIFY place <= 16""")
def tim7_anchors_from_ingest(turns: DataFrame) -> DataFrame:
    e = F.col("event_id")
    stated = turns.where("cluster = 'purchase'").select("recording_id", (e + START).alias("utc_us"))
    utc = F.when(e % 7 == 0, F.lit(5).cast("long")).when(e % 7 == 1, F.lit(3 * START)).otherwise(e + START)
    tags = turns.where("cluster <> 'purchase'").select("recording_id", F.concat("cluster", (e % 9).cast("string")).alias("source"), e.alias("pos"), utc.alias("utc_us"))
    return c.anchors_from_ingest(stated, tags, 1_700_000_000_000_000, DAY)


@query("v_turns", sql="""WITH a AS (SELECT recording_id, event_id AS anchor_id, cluster IN ('click', 'view') AS from_screen, event_id * 37 % 1000 AS precision_us FROM {v_turns} t WHERE event_id % 4 <> 0),
    p AS (SELECT *, 16 - count(*) FILTER (NOT from_screen) OVER (PARTITION BY recording_id) AS room, row_number() OVER (PARTITION BY recording_id, from_screen ORDER BY precision_us, anchor_id) AS place FROM a)
    SELECT recording_id, anchor_id FROM p WHERE NOT from_screen OR place <= room""")
def sort10_screen_anchor_top(turns: DataFrame) -> DataFrame:
    anchors = turns.where("event_id % 4 <> 0").selectExpr("recording_id", "event_id AS anchor_id", "cluster IN ('click', 'view') AS from_screen", "event_id * 37 % 1000 AS precision_us")
    return c.screen_anchor_top(anchors).select("recording_id", "anchor_id")


_UTC = f"{START} + recording_id * 18000000000 + 123456789"
_CLOCKS = f"SELECT recording_id, event_id AS no, event_id % 2 = 0 AS wraps, event_id % 3 * 5000000 AS uncertainty_us, {_UTC} AS utc_us, {_UTC} + (event_id % 113 - 56) * {QUARTER} + (event_id * 31 % 80 - 40) * 1000000 AS at_us"


@query("v_turns", sql=f"""WITH k AS ({_CLOCKS} FROM {{v_turns}} t), s AS (SELECT *, CASE WHEN wraps THEN at_us % {DAY} ELSE at_us END AS start_us FROM k),
    d AS (SELECT *, start_us + day_us - CASE WHEN wraps THEN utc_us % {DAY} ELSE utc_us END AS apart_us FROM (SELECT *, unnest(CASE WHEN wraps THEN [-{DAY}, 0, {DAY}] ELSE [0] END) AS day_us FROM s) x),
    o AS (SELECT *, CAST(floor((apart_us + {QUARTER // 2}) / {QUARTER}) AS BIGINT) * {QUARTER} AS offset_us FROM d)
    SELECT DISTINCT recording_id, no, offset_us FROM o WHERE abs(apart_us - offset_us) <= uncertainty_us + 30000000 AND abs(offset_us) <= 14 * 3600000000""")
def tim8_offset_observations(turns: DataFrame) -> DataFrame:
    clocks = turns.selectExpr(*[x.strip() for x in ("recording_id", "event_id AS no", "event_id % 2 = 0 AS wraps", "event_id % 3 * 5000000 AS uncertainty_us", f"{_UTC} + (event_id % 113 - 56) * {QUARTER} + (event_id * 31 % 80 - 40) * 1000000 AS at_us")])
    clocks = clocks.withColumn("start_us", F.when(F.col("wraps"), F.col("at_us") % DAY).otherwise(F.col("at_us")))
    return c.offset_observations(clocks, turns.select("recording_id").distinct().selectExpr("recording_id", f"{_UTC} AS utc_us"))


@query("v_turns", sql=f"""WITH k AS (SELECT recording_id, event_id AS no, {_UTC} AS anchor_us, event_id * 7919 * 1000000 % {DAY} AS start_us, (event_id % 25 - 12) * 3600000000 AS zone_us FROM {{v_turns}} t),
    d AS (SELECT *, anchor_us - anchor_us % {DAY} + start_us - zone_us + day * {DAY} AS utc_us FROM (SELECT *, unnest([-1, 0, 1]) AS day FROM k) x)
    SELECT recording_id, no, utc_us FROM d QUALIFY row_number() OVER (PARTITION BY recording_id, no ORDER BY abs(utc_us - anchor_us), utc_us) = 1""")
def tim9_confirm_zone(turns: DataFrame) -> DataFrame:
    clocks = turns.selectExpr("recording_id", "event_id AS no", f"event_id * 7919 * 1000000 % {DAY} AS start_us", "(event_id % 25 - 12) * 3600000000 AS zone_us")
    return c.confirm_zone(clocks, turns.select("recording_id").distinct().selectExpr("recording_id", f"{_UTC} AS utc_us"))


_PHRASE = "(contains(array_to_string({w}, ''), array_to_string({t}, '')) AND regexp_matches(array_to_string({w}, chr(1)), '(^|\\x01)' || array_to_string(string_split(array_to_string({t}, ''), ''), '\\x01?') || '(\\x01|$)'))"
_TERM_WORDS = WORDS.format("term")
#: What was heard: the whole text, one letter for another.
_HEARD = "replace(text, 'a', 'o')"


@query("benchmark", sql=f"""WITH w AS (SELECT item_id, text, {WORDS.format('text')} AS words FROM benchmark), t AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(words) + 1, 2)) AS i FROM w) x),
    k AS (SELECT * FROM t WHERE length(term) % 5 <> 0), h AS (SELECT item_id, {WORDS.format(_HEARD)} AS words FROM benchmark WHERE item_id % 3 <> 0)
    SELECT item_id, count(*) AS terms, count(*) FILTER (coalesce({_PHRASE.format(w='words', t=_TERM_WORDS)}, false)) AS found FROM k LEFT JOIN h USING (item_id) GROUP BY item_id""")
def agg20_critical_terms(benchmark: DataFrame) -> DataFrame:
    words = benchmark.select("item_id", text.normalise_words(F.col("text")).alias("w")).where("size(w) > 0")
    terms = words.select("item_id", "w", F.explode(F.expr("sequence(1, size(w), 2)")).alias("i")).select("item_id", F.array_join(F.slice("w", F.col("i"), F.lit(2)), " ").alias("term"))
    return r.critical_terms(terms, benchmark.where("item_id % 3 <> 0").select("item_id", F.expr(_HEARD).alias("text")), terms.where("length(term) % 5 = 0"))


@query("conversations")
def agg24_line_error(conversations: DataFrame) -> DataFrame:
    """Turns as true lines, four to a frame; what was read is a frame's turns with some letters and digits lost. Held against brute force in the tests."""
    truth = conversations.select((F.col("conv_id") * 10_000 + F.expr("turn div 4")).alias("frame_id"), F.col("turn").alias("line_no"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), (F.col("conv_id") * 101 + F.col("turn")).cast("string")).alias("text"))
    read = truth.groupBy("frame_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "text")))["text"], " ").alias("text"))
    return r.line_error(truth, read.withColumn("text", F.regexp_replace(F.regexp_replace("text", "th", "t"), "7", "1")))


@query("lineitem", sql="""SELECT size, theme, count(*) AS lines, count(*) FILTER (errors = 0) AS exact, median(share) AS median_error, CAST(sum(least(share, 10000)) // count(*) AS BIGINT) AS mean_error, CAST(sum(numbers) AS BIGINT) AS numbers, CAST(sum(found) AS BIGINT) AS numbers_found
    FROM (SELECT l_linenumber % 3 AS size, l_returnflag AS theme, l_partkey % 7 AS errors, l_partkey % 7 * 10000 // greatest(1, l_suppkey % 20) AS share, l_suppkey % 4 AS numbers, l_suppkey % 2 AS found FROM lineitem) x GROUP BY GROUPING SETS ((size), (theme), ())""")
def agg25_line_error_summary(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.selectExpr("l_linenumber % 3 AS size", "l_returnflag AS theme", "l_partkey % 7 AS errors", "l_suppkey % 20 AS length", "l_suppkey % 4 AS numbers", "l_suppkey % 2 AS numbers_found")
    return r.line_error_summary(rows)


@query("conversations", sql=f"""WITH w AS (SELECT DISTINCT conv_id AS frame_id, role AS family, unnest({WORDS.format('text')}) AS word FROM conversations)
    SELECT frame_id, word, count(DISTINCT family) AS families FROM w WHERE regexp_full_match(word, '\\p{{L}}{{4,}}') GROUP BY frame_id, word HAVING count(DISTINCT family) > 1""")
def agg26_corroborated_words(conversations: DataFrame) -> DataFrame:
    return r.corroborated_words(conversations.select(F.col("conv_id").alias("frame_id"), F.col("role").alias("family"), "text"))


_ATTRIBUTED = "(SELECT o_custkey % 500 AS recording_id, o_orderkey AS ordinal, o_orderkey % 3 AS ref, CASE WHEN o_custkey % 4 = 0 THEN 'mixed' ELSE 'labelled' END AS outcome, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey // 7 + o_custkey) % 3 END AS hyp FROM orders)"


@query("orders", sql=f"""SELECT recording_id, count(*) AS segments, count(hyp) AS labelled, count(*) FILTER (hyp = (ref + recording_id) % 3) AS "right", count(*) FILTER (hyp <> (ref + recording_id) % 3) AS wrong FROM {_ATTRIBUTED} a WHERE outcome = 'labelled' GROUP BY recording_id""")
def agg23_segment_attribution(orders: DataFrame) -> DataFrame:
    rows = orders.selectExpr("o_custkey % 500 AS recording_id", "o_orderkey AS ordinal", "o_orderkey % 3 AS ref", "IF(o_custkey % 4 = 0, 'mixed', 'labelled') AS outcome", "IF(o_orderkey % 5 <> 0, (o_orderkey div 7 + o_custkey) % 3, NULL) AS hyp")
    pairs = rows.select("recording_id").distinct().withColumn("ref", F.explode(F.expr("sequence(0L, 2L)"))).withColumn("hyp", (F.col("ref") + F.col("recording_id")) % 3)
    return r.segment_attribution(rows.withColumnRenamed("ref", "tag"), rows.select("recording_id", "ordinal", F.col("hyp").alias("tag")), pairs)


@query("v_turns")
def agg22_best_map(turns: DataFrame) -> DataFrame:
    """The map of speakers that shares the most time. Held against all permutations in the tests."""
    side = lambda where, name: turns.where(where).select("recording_id", F.col("cluster").alias(name), "start_us", "end_us")
    return r.best_map(side("event_id % 2 = 0", "ref"), side("event_id % 3 <> 0", "hyp"))


@query("v_turns")
def agg22_scored_error(turns: DataFrame) -> DataFrame:
    """The error under the best map, both on scored time alone. Held against a grid in the tests."""
    side = lambda where, name: turns.where(where).select("recording_id", F.col("cluster").alias(name), "start_us", "end_us")
    reference, hypothesis = side("event_id % 2 = 0", "ref"), side("event_id % 3 <> 0", "hyp")
    unscored = turns.where("event_id % 10 = 0").selectExpr("recording_id", "start_us - 1000000 AS start_us", "end_us + 1000000 AS end_us")
    pairs = r.best_map(reference, hypothesis, COLLAR_US, unscored)
    return diarization_error(reference, hypothesis, pairs, COLLAR_US, unscored)


@query("v_segments", sql=f"""WITH w AS (SELECT recording_id, chunk, start_us + (i - 1) * 200000 AS at_us, words[i] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM (SELECT recording_id, ordinal AS chunk, start_us, {WORDS.format('text')} AS words FROM {{v_segments}} g) x) y),
    t AS (SELECT *, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS triple FROM w WINDOW o AS (PARTITION BY recording_id, chunk ORDER BY at_us, word))
    SELECT a.recording_id, a.chunk, b.chunk AS other, min(a.at_us) AS at_us FROM t a JOIN t b ON a.recording_id = b.recording_id AND a.triple = b.triple AND a.chunk < b.chunk AND abs(a.at_us - b.at_us) <= 4000000 GROUP BY a.recording_id, a.chunk, b.chunk""")
def eva6_seam_repeats(segments: DataFrame) -> DataFrame:
    words = segments.select("recording_id", F.col("ordinal").alias("chunk"), "start_us", F.posexplode(text.normalise_words(F.col("text"))).alias("i", "word"))
    return r.seam_repeats(words.select("recording_id", "chunk", (F.col("start_us") + F.col("i") * 200_000).alias("at_us"), "word"))


@query("v_segments", sql="""WITH c AS (SELECT DISTINCT recording_id, (ordinal - 1) // 5 * 25000000 AS win_start_us FROM {v_segments} g), o AS (SELECT recording_id, start_us + (ordinal % 3 - 1) * 1000000 AS start_us, end_us FROM {v_segments} g),
    a AS (SELECT DISTINCT g.recording_id, g.start_us, g.end_us FROM {v_segments} g JOIN c ON c.recording_id = g.recording_id AND abs(g.start_us - win_start_us) <= 20000),
    l AS (SELECT a.*, (SELECT min(o.start_us) FROM o WHERE o.recording_id = a.recording_id AND o.start_us < a.end_us AND a.start_us < o.end_us AND o.start_us < o.end_us) - a.start_us AS lead FROM a)
    SELECT recording_id, count(*) AS starts, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, count(*) FILTER (end_us - start_us > 10000000) AS long, count(*) FILTER (lead > 0) AS leads, CAST(coalesce(sum(lead) FILTER (lead > 0), 0) AS BIGINT) AS lead_us FROM l GROUP BY recording_id""")
def eva9_chunk_start_segments(segments: DataFrame) -> DataFrame:
    chunks = segments.selectExpr("recording_id", "(ordinal - 1) div 5 * 25000000 AS win_start_us").distinct()
    other = segments.selectExpr("recording_id", "start_us + (ordinal % 3 - 1) * 1000000 AS start_us", "end_us")
    return r.chunk_start_segments(segments, chunks, other)


@query("embeddings", sql="""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 150 * (vec_id % 5)) AS INTEGER)) AS samples FROM embeddings WHERE vec_id % 11 <> 0 UNION ALL SELECT vec_id, [1, 2, 3] FROM embeddings WHERE vec_id % 11 = 0),
    f AS (SELECT vec_id, len(samples) AS n, list_transform(range(0, (len(samples) - 1) // 16 + 1), lambda i: samples[i * 16 + 1:i * 16 + 16]) AS frames FROM s)
    SELECT vec_id, CASE WHEN n < 48 THEN 'too_short' WHEN len(list_filter(frames, lambda f: list_sum(list_transform(f, lambda x: x::BIGINT * x)) * 100000 >= len(f)::BIGINT * 32768 * 32768)) = 0 THEN 'silent' ELSE 'sound' END AS sound FROM f""")
def seam3_classify_audio(embeddings: DataFrame) -> DataFrame:
    """Vectors as short recordings: frames of 16 samples, 48 at least."""
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 150 * (F.col("vec_id") % 5)).cast("int"))
    rows = embeddings.select("vec_id", F.when(F.col("vec_id") % 11 != 0, samples).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("samples"))
    return r.classify_audio(rows, 16, 48).select("vec_id", "sound")


@query("v_turns", sql="""SELECT recording_id, time_us, kind, target_id, row_number() OVER (PARTITION BY recording_id ORDER BY time_us, kind = 'periodic', target_id)::INTEGER AS place
    FROM (SELECT DISTINCT recording_id, start_us // 5000000 * 5000000 AS time_us, CASE WHEN event_id % 2 = 0 THEN 'candidate' ELSE 'periodic' END AS kind, event_id % 5 AS target_id FROM {v_turns} t) x""")
def sort8_order_read_targets(turns: DataFrame) -> DataFrame:
    return r.order_read_targets(turns.selectExpr("recording_id", "start_us div 5000000 * 5000000 AS time_us", "IF(event_id % 2 = 0, 'candidate', 'periodic') AS kind", "event_id % 5 AS target_id"))


@query("v_turns", sql="""SELECT recording_id, min(start_us) FILTER (cluster = 'error') AS from_us, CAST(coalesce(sum(event_id % 4) FILTER (cluster = 'view'), 0) AS BIGINT) AS dropped FROM {v_turns} t WHERE cluster IN ('error', 'view', 'click') GROUP BY recording_id HAVING count(*) FILTER (cluster IN ('error', 'view')) > 0""")
def sort9_first_unanalysed(turns: DataFrame) -> DataFrame:
    gaps = turns.where("cluster IN ('error', 'click')").select("recording_id", "start_us", (F.col("cluster") == "error").alias("retryable"))
    return r.first_unanalysed(gaps, turns.where("cluster = 'view'").select("recording_id", (F.col("event_id") % 4).alias("dropped")))


@query("v_chunks", sql="""SELECT recording_id, idx, CASE WHEN coalesce(bool_or(idx % 17 = 16) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'stopped' WHEN idx % 17 = 16 THEN 'late' ELSE 'published' END AS status FROM {v_chunks} c""")
def strm4_late_audio(chunks: DataFrame) -> DataFrame:
    early = F.when(F.col("idx") % 17 == 16, 5_000_001).otherwise(5_000_000)
    return r.late_audio(chunks.select("recording_id", "idx", "win_start_us", (F.col("win_start_us") - early).alias("audio_start_us"))).select("recording_id", "idx", "status")


@query("conversations", "v_segments", sql="""WITH s AS (SELECT recording_id, max(ordinal) AS fin FROM {v_segments} g GROUP BY recording_id), d AS (SELECT DISTINCT conv_id FROM conversations),
    t AS (SELECT conv_id AS recording_id, CASE WHEN conv_id % 5 = 0 THEN 9 ELSE conv_id % 3 END AS revision, conv_id % 4 AS ordinal FROM d UNION ALL SELECT conv_id + 10000000, 1, 1 FROM d WHERE conv_id % 9 = 0),
    p AS (SELECT t.recording_id, count(*) AS n, max(g.ordinal) AS o FROM t JOIN {v_segments} g ON g.recording_id = t.recording_id AND t.revision = g.recording_id % 3 AND g.ordinal > t.ordinal AND g.ordinal <= t.ordinal + 2 GROUP BY t.recording_id)
    SELECT t.recording_id, CASE WHEN s.fin IS NULL THEN 'unknown' WHEN t.revision <> t.recording_id % 3 THEN 'stale' WHEN coalesce(p.o, t.ordinal) < s.fin THEN 'more' WHEN t.recording_id % 2 = 0 THEN 'sealed' ELSE 'waiting' END AS status,
        coalesce(p.n, 0) AS segments, CASE WHEN s.fin IS NOT NULL AND t.revision = t.recording_id % 3 THEN coalesce(p.o, t.ordinal) END AS next_ordinal FROM t LEFT JOIN s USING (recording_id) LEFT JOIN p USING (recording_id)""")
def strm6_since_read(conversations: DataFrame, segments: DataFrame) -> DataFrame:
    rows = segments.select("recording_id", (F.col("recording_id") % 3).alias("revision"), (F.col("recording_id") % 2 == 0).alias("sealed"), "ordinal")
    ids = conversations.select("conv_id").distinct()
    tokens = ids.selectExpr("conv_id AS recording_id", "IF(conv_id % 5 = 0, 9L, conv_id % 3) AS revision", "conv_id % 4 AS ordinal").unionByName(ids.where("conv_id % 9 = 0").selectExpr("conv_id + 10000000 AS recording_id", "1L AS revision", "1L AS ordinal"))
    return r.since_read(rows, tokens, 2)


_INFO = """concat('{"live_status": "', CASE page_id % 11 WHEN 0 THEN 'is_live' ELSE 'was_live' END, '", "availability": "', CASE page_id % 13 WHEN 0 THEN 'private' ELSE 'public' END, '", "duration": ', page_id % 90 * 60, CASE page_id % 17 WHEN 0 THEN ', "entries": ["a"]' ELSE '' END,
    ', "formats": [{"format_id": "', page_id % 7, '", "protocol": "https", "ext": "mp4", "filesize": ', page_id % 50 * 1000, '.5}, {"format_id": "x ', page_id, '", "protocol": "https", "ext": "webm", "filesize": 1}, {"format_id": "m3u", "protocol": "', CASE page_id % 2 WHEN 0 THEN 'm3u8' ELSE 'https' END, '", "ext": "m4a", "filesize": 20000}]}')"""


@query("pages", sql=f"""WITH j AS (SELECT page_id, from_json({_INFO}, '{{"live_status":"VARCHAR","availability":"VARCHAR","duration":"DOUBLE","entries":["VARCHAR"],"formats":[{{"format_id":"VARCHAR","protocol":"VARCHAR","ext":"VARCHAR","filesize":"DOUBLE"}}]}}') AS i FROM pages),
    g AS (SELECT page_id, i, list_transform(list_filter(i.formats, lambda f: f.protocol = 'https' AND f.ext IN ('mp4', 'm4a', 'webm') AND regexp_full_match(f.format_id, '[A-Za-z0-9_-]{{1,32}}') AND ceil(f.filesize) <= 30000), lambda f: f.format_id) AS good FROM j),
    s AS (SELECT page_id, good, CASE WHEN i.entries IS NOT NULL THEN 'not_one_video' WHEN i.live_status IN ('is_live', 'is_upcoming') THEN 'not_finished' WHEN i.availability <> 'public' THEN 'not_public' WHEN i.duration > 3600 THEN 'too_long' WHEN len(good) = 0 THEN 'no_format' ELSE 'selected' END AS status FROM g)
    SELECT page_id, status, CASE WHEN status = 'selected' THEN array_to_string(good, ',') END AS formats FROM s""")
def src16_page_formats(pages: DataFrame) -> DataFrame:
    return r.page_formats(pages.select("page_id", F.expr(_INFO).alias("info")), 30_000, 3_600)
