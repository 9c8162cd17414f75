"""Queries of screen changes and of speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import speakers as sp
from tracewell.operators import visual as v
from tracewell.plans.registry import query

DURATION = "(SELECT recording_id, max(time_us) + 500000 AS duration_us FROM {v_samples} s GROUP BY recording_id)"
WINDOWS = f"(SELECT recording_id, k AS ordinal, k * 60000000 AS start_us, least((k + 1) * 60000000, duration_us) AS end_us FROM (SELECT *, unnest(range(0, (duration_us - 1) // 60000000 + 1)) AS k FROM {DURATION} d) w)"
DELTAS = """(SELECT recording_id, time_us, changed_blocks, max_block_delta, coalesce(changed_blocks >= 2 OR max_block_delta >= 6, false) AS is_change FROM (
    SELECT recording_id, time_us, len(list_filter(d, lambda x: x >= 4)) AS changed_blocks, list_max(d) AS max_block_delta FROM (
        SELECT recording_id, time_us, list_transform(list_zip(lag(blocks) OVER (PARTITION BY recording_id ORDER BY time_us), blocks), lambda z: abs(z[1] - z[2])) AS d FROM {v_samples} s) x) y)"""
DELTAS = DELTAS.replace("list_transform(list_zip(lag(blocks) OVER (PARTITION BY recording_id ORDER BY time_us), blocks), lambda z: abs(z[1] - z[2])) AS d FROM {v_samples} s", "CASE WHEN p IS NOT NULL THEN list_transform(list_zip(p, blocks), lambda z: abs(z[1] - z[2])) END AS d FROM (SELECT *, lag(blocks) OVER (PARTITION BY recording_id ORDER BY time_us) AS p FROM {v_samples} s0) s")


def _recordings(samples: DataFrame) -> DataFrame:
    return samples.groupBy("recording_id").agg((F.max("time_us") + 500_000).alias("duration_us"))


@query("v_samples", sql=f"SELECT * FROM {WINDOWS} w")
def win1_tumbling_windows(samples: DataFrame) -> DataFrame:
    return v.tumbling_windows(_recordings(samples))


@query("v_samples", sql=f"SELECT recording_id, ordinal, c AS cell, start_us + c * 10000000 AS start_us, least(start_us + (c + 1) * 10000000, end_us) AS end_us FROM (SELECT *, unnest(range(0, (end_us - start_us - 1) // 10000000 + 1)) AS c FROM {WINDOWS} w) x")
def win2_coverage_cells(samples: DataFrame) -> DataFrame:
    return v.coverage_cells(v.tumbling_windows(_recordings(samples)))


@query("v_samples", sql="""SELECT recording_id, time_us, time_us // 60000000 AS ordinal, false AS lead_in FROM {v_samples} s
    UNION ALL SELECT recording_id, time_us, time_us // 60000000 + 1, true FROM (SELECT *, lead(time_us) OVER (PARTITION BY recording_id ORDER BY time_us) AS n FROM {v_samples} s) x
    WHERE n // 60000000 = time_us // 60000000 + 1 AND (time_us // 60000000 + 1) * 60000000 - time_us <= 500000""")
def win3_lead_in(samples: DataFrame) -> DataFrame:
    return v.with_lead_in(samples).select("recording_id", "time_us", "ordinal", "lead_in")


@query("v_samples", sql=f"SELECT * FROM {DELTAS} d")
def win4_sample_deltas(samples: DataFrame) -> DataFrame:
    return v.sample_deltas(samples).drop("blocks")


@query("v_samples", sql=f"""SELECT recording_id, ordinal, min(time_us) AS start_us, max(time_us) AS end_us, count(*) AS samples FROM (
    SELECT *, row_number() OVER (PARTITION BY recording_id, ordinal ORDER BY time_us) - row_number() OVER (PARTITION BY recording_id, ordinal, is_change ORDER BY time_us) AS run FROM (SELECT *, time_us // 60000000 AS ordinal FROM {DELTAS} d) x) y
    WHERE is_change GROUP BY recording_id, ordinal, run HAVING count(*) >= 3""")
def win7_motion_runs(samples: DataFrame) -> DataFrame:
    return v.motion_runs(samples)


@query("v_samples")
def win6_candidates(samples: DataFrame) -> DataFrame:
    return v.candidates(samples)


@query("v_samples")
def flt5_omit_periodic(samples: DataFrame) -> DataFrame:
    return v.omit_periodic(v.candidates(samples))


@query("v_samples")
def win26_plan_screen_changes(samples: DataFrame) -> DataFrame:
    return v.plan_screen_changes(v.candidates(samples))


@query("v_samples")
def flt8_settled_screens(samples: DataFrame) -> DataFrame:
    return v.settled_screens(v.candidates(samples))


@query("v_samples")
def agg34_index_stats(samples: DataFrame) -> DataFrame:
    return v.index_stats(v.candidates(samples))


_BITS = "list_transform(range(1, 65), lambda i: CASE WHEN i % 8 <> 0 AND blocks[i] > blocks[i + 1] THEN 1 ELSE 0 END)"
HASH = f"(SELECT recording_id, time_us, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(bits[i] AS HUGEINT) * (CAST(1 AS HUGEINT) << (64 - i)))) - CASE WHEN bits[1] = 1 THEN CAST(1 AS HUGEINT) << 64 ELSE 0 END AS BIGINT) AS hash FROM (SELECT recording_id, time_us, {_BITS} AS bits FROM {{v_samples}} s) b)"


@query("v_samples", sql=f"SELECT * FROM {HASH} h")
def num5_difference_hash(samples: DataFrame) -> DataFrame:
    return samples.select("recording_id", "time_us", v.difference_hash(F.col("blocks")).alias("hash"))


@query("v_samples", sql=f"SELECT recording_id, time_us, CAST(bit_count(xor(hash, before)) AS INTEGER) AS distance FROM (SELECT *, lag(hash) OVER (PARTITION BY recording_id ORDER BY time_us) AS before FROM {HASH} h) x WHERE before IS NOT NULL")
def num6_hash_distance(samples: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    hashed = samples.select("recording_id", "time_us", v.difference_hash(F.col("blocks")).alias("hash"))
    before = hashed.withColumn("before", F.lag("hash").over(Window.partitionBy("recording_id").orderBy("time_us"))).where("before IS NOT NULL")
    return before.select("recording_id", "time_us", v.hash_distance(F.col("hash"), F.col("before")).alias("distance"))


# speakers: events as turns, conversations as segments
LABELLED = """(WITH f AS (SELECT recording_id, cluster, min({'s': start_us, 'e': end_us, 'c': cluster}) AS first FROM {v_turns} t GROUP BY recording_id, cluster),
    n AS (SELECT recording_id, cluster, dense_rank() OVER (PARTITION BY recording_id ORDER BY first) AS tag FROM f)
    SELECT t.*, CAST(n.tag AS INTEGER) AS tag FROM {v_turns} t JOIN n USING (recording_id, cluster))"""
ATTRIBUTED = f"""(WITH o AS (SELECT s.recording_id, s.ordinal, t.tag, sum(least(s.end_us, t.end_us) - greatest(s.start_us, t.start_us)) AS us FROM {{v_segments}} s JOIN {LABELLED} t
        ON s.recording_id = t.recording_id AND s.start_us < t.end_us AND t.start_us < s.end_us GROUP BY s.recording_id, s.ordinal, t.tag),
    b AS (SELECT recording_id, ordinal, sum(us) AS speech, min({{'less': -us, 'tag': tag}}) AS top FROM o GROUP BY recording_id, ordinal),
    r AS (SELECT s.recording_id, s.ordinal, b.top.tag AS tag, CASE WHEN speech IS NULL OR least(speech, s.end_us - s.start_us) * 10000 // (s.end_us - s.start_us) < 5000 THEN 'little_speech'
        WHEN -b.top.less * 10000 // speech < 7000 THEN 'mixed' ELSE 'labelled' END AS outcome FROM {{v_segments}} s LEFT JOIN b USING (recording_id, ordinal))
    SELECT recording_id, ordinal, CASE WHEN outcome = 'labelled' THEN tag END AS tag, outcome FROM r)"""


@query("v_turns", sql=f"SELECT recording_id, event_id, tag FROM {LABELLED} t")
def win23_label_turns(turns: DataFrame) -> DataFrame:
    return sp.label_turns(turns).select("recording_id", "event_id", "tag")


@query("v_segments", "v_turns", sql=f"SELECT * FROM {ATTRIBUTED} a")
def join2_attribute_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    return sp.attribute_speakers(segments, sp.label_turns(turns)).select("recording_id", "ordinal", "tag", "outcome")


@query("v_segments", "v_turns", sql=f"""SELECT t.recording_id, t.tag, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, min(start_us) AS first_us,
    coalesce((SELECT count(*) FROM {ATTRIBUTED} a WHERE a.recording_id = t.recording_id AND a.tag = t.tag), 0) AS segments FROM {LABELLED} t GROUP BY t.recording_id, t.tag""")
def agg5_speaker_totals(segments: DataFrame, turns: DataFrame) -> DataFrame:
    labelled = sp.label_turns(turns)
    return sp.speaker_totals(labelled, sp.attribute_speakers(segments, labelled))


@query("v_segments", "v_turns", sql=f"SELECT recording_id, outcome, count(*) AS segments FROM {ATTRIBUTED} a GROUP BY recording_id, outcome")
def agg7_speaker_coverage(segments: DataFrame, turns: DataFrame) -> DataFrame:
    return sp.speaker_coverage(sp.attribute_speakers(segments, sp.label_turns(turns)))


@query("v_segments", "v_turns", sql=f"SELECT recording_id, 6 - (SELECT count(DISTINCT tag) FROM {LABELLED} t WHERE t.recording_id = s.recording_id) AS missing FROM (SELECT DISTINCT recording_id FROM {{v_segments}} s0) s")
def agg8_count_shortfall(segments: DataFrame, turns: DataFrame) -> DataFrame:
    return sp.count_shortfall(segments.select("recording_id").distinct().withColumn("voices", F.lit(6)), sp.label_turns(turns))
