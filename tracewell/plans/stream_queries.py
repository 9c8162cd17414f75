"""Queries that stream over samples, and queries in SQL over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import visual
from tracewell.plans.registry import query
from tracewell.plans.span_queries import TURNS
from tracewell.plans.text_queries import WORDS
from tracewell.plans.visual_queries import HASH
from tracewell.sources.shared import scratch
from tracewell.streaming import hooks, jobs

#: Samples three times as close as the view's, so that two of three go.
_DENSE = "(SELECT recording_id, time_us // 3 AS time_us FROM {v_samples} s)"


@query("v_samples", sql=f"SELECT recording_id, min(time_us) AS time_us FROM {_DENSE} d GROUP BY recording_id, time_us // 500000")
def strm2_sample_rate_limit(samples: DataFrame) -> DataFrame:
    """The batch form of the stream's rate limit."""
    return visual.rate_limited(samples.withColumn("time_us", F.expr("time_us div 3"))).select("recording_id", "time_us")


@query("v_samples", sql=f"""SELECT recording_id, time_us // 60000000 AS ordinal, count(*) AS samples, min(time_us) AS first_us, max(time_us) AS last_us
    FROM (SELECT recording_id, min(time_us) AS time_us FROM {_DENSE} d GROUP BY recording_id, time_us // 500000) f GROUP BY recording_id, time_us // 60000000""")
def strm1_tumbling_index(samples: DataFrame) -> DataFrame:
    """The windows of a stream over all samples, once each; a last sample of no recording, hours later, closes them."""
    spark, place = samples.sparkSession, scratch(samples.sparkSession, "samples")
    rows = samples.withColumn("time_us", F.expr("time_us div 3"))
    last = rows.agg((F.coalesce(F.max("time_us"), F.lit(0)) + 3_600_000_000).alias("time_us")).select(F.lit(None).cast(dict(rows.dtypes)["recording_id"]).alias("recording_id"), "time_us", F.array().cast("array<int>").alias("blocks"))
    rows.select("recording_id", "time_us", "blocks").unionByName(last).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{place}/in").schema).parquet(f"{place}/in")
    windows = jobs.tumbling_index(stream).select("recording_id", "ordinal", "samples", "first_us", "last_us")
    windows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{place}/out").where("recording_id IS NOT NULL")


@query("events", sql="SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def src11_upserts(events: DataFrame) -> DataFrame:
    """The table that a stream of all events keeps, four files to a batch, read after the last one."""
    spark, place = events.sparkSession, scratch(events.sparkSession, "events")
    events.select("user_id", "event_type", "event_id", "value").repartition(8, "event_id").write.parquet(f"{place}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{place}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    keys, order = ("user_id", "event_type"), ("event_id",)
    jobs.upsert_by_key(stream, f"{place}/out", f"{place}/cp", keys, order, availableNow=True).awaitTermination()
    return jobs.upserted(spark, f"{place}/out", stream.schema, keys, order)


def _sql(df: DataFrame, sql: str) -> DataFrame:
    hooks.register_functions(df.sparkSession)
    return df.sparkSession.sql(sql, df=df)


@query("v_turns", sql=f"SELECT * FROM {TURNS} m")
def udf2_merge_spans(turns: DataFrame) -> DataFrame:
    """The table function over a table argument."""
    return _sql(turns.select("recording_id", "start_us", "end_us"), "SELECT * FROM merge_spans(TABLE({df}) PARTITION BY recording_id ORDER BY (start_us, end_us))")


@query("v_segments", sql=f"SELECT recording_id, ordinal, {WORDS.format('text')} AS words FROM {{v_segments}} g")
def udf2_normalise_words(segments: DataFrame) -> DataFrame:
    return _sql(segments, "SELECT recording_id, ordinal, normalise_words(text) AS words FROM {df}")


@query("v_samples", sql=f"SELECT recording_id, count(DISTINCT hash) AS hashes, CAST(max(bit_count(xor(hash, 255))) AS INTEGER) AS farthest FROM {HASH} h GROUP BY recording_id")
def udf2_difference_hash(samples: DataFrame) -> DataFrame:
    return _sql(samples, "SELECT recording_id, count(DISTINCT difference_hash(blocks)) AS hashes, max(hash_distance(difference_hash(blocks), 255L)) AS farthest FROM {df} GROUP BY recording_id")
