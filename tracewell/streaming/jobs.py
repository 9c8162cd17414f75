"""Structured Streaming forms: windows of samples, a rate limit, growing transcripts and job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from tracewell.operators.jobs import LEGAL_STEPS, latest_by_key
from tracewell.operators.visual import LEAD_US, WINDOW_US, window_candidates

#: Fixed value: audio may begin this much before its window; later than that, publication stops.
LATE, LATE_US = "5 seconds", 5_000_000


def event_time(df: DataFrame, time: str = "time_us") -> DataFrame:
    """``df`` with ``at``: media time as a timestamp from the epoch on."""
    return df.withColumn("at", F.timestamp_micros(time))


def sample_rate_limit(samples: DataFrame, late: str = LATE) -> DataFrame:
    """The first sample of each half second, once no earlier one can come (of several at one time the least)."""
    return _half_seconds(event_time(samples).withWatermark("at", late), samples.columns).select("s.*")


def _half_seconds(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    rest = [c for c in columns if c not in ("recording_id", "time_us")]
    first = rows.groupBy("recording_id", F.window("at", f"{LEAD_US // 1000} milliseconds"), *more).agg(F.min(F.struct("time_us", *rest)).alias("s"))
    return first.withColumn("s", F.struct("recording_id", "s.*"))


def tumbling_index(samples: DataFrame, late: str = LATE) -> DataFrame:
    """recording_id, ordinal, samples, first_us, last_us, held: each window once, when all its samples can have come.

    Samples are limited to one each half second; ``held`` (array of ``lead_in`` and
    the sample, at most 121) has the window's own and, as lead-in, the last one up
    to half a second before it. State is Spark's: half seconds, and windows of them,
    each dropped when the watermark has passed its end. A sample may come ``late``
    at most and in any order; a later one is left out.
    """
    own = F.struct(F.lit(False).alias("lead_in"), F.col("time_us").alias("until_us"))
    ahead = F.struct(F.lit(True).alias("lead_in"), F.expr(f"(time_us div {WINDOW_US} + 1) * {WINDOW_US}").alias("until_us"))
    # a sample at the end of a window also comes at the beginning of the next
    both = F.explode(F.when(F.expr(f"time_us % {WINDOW_US} >= {WINDOW_US - LEAD_US}"), F.array(own, ahead)).otherwise(F.array(own)))
    rows = samples.withColumn("__as", both).withColumn("at", F.timestamp_micros("__as.until_us")).withColumn("lead_in", F.col("__as.lead_in")).withWatermark("at", late)
    slots = _half_seconds(rows, samples.columns, "lead_in")
    whole = slots.groupBy("recording_id", F.window("window", f"{WINDOW_US // 1_000_000} seconds").alias("minute")).agg(
        F.count_if(~F.col("lead_in")).alias("samples"), F.min(F.when(~F.col("lead_in"), F.col("s.time_us"))).alias("first_us"), F.max(F.when(~F.col("lead_in"), F.col("s.time_us"))).alias("last_us"),
        F.collect_list(F.struct("lead_in", "s")).alias("held"),
    )
    return whole.where("samples > 0").select("recording_id", F.expr(f"unix_micros(minute.start) div {WINDOW_US}").alias("ordinal"), "samples", "first_us", "last_us", "held")


def index_candidates(windows: DataFrame) -> DataFrame:
    """The candidates of windows of :func:`tumbling_index`, as ``visual.candidates`` has them.

    A column ``duration_us`` of the samples says where a recording ends; without it
    the last span of a window reaches to the window's end.
    """
    samples = windows.select("ordinal", F.explode("held").alias("h")).select("ordinal", "h.lead_in", "h.s.*")
    length = F.col("duration_us") if "duration_us" in samples.columns else F.lit(None).cast("long")
    ends = samples.groupBy("recording_id").agg(F.max(length).alias("duration_us"))
    return window_candidates(samples.select("recording_id", "time_us", "blocks", "ordinal", "lead_in"), ends)


def write_candidates(samples: DataFrame, path: str, checkpoint: str, late: str = LATE, **trigger):
    """Starts a query that writes the candidates of a stream of samples (recording_id, time_us, blocks), each window's once, to ``path/batch=n``.

    A batch that runs again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        index_candidates(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = tumbling_index(samples, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(**trigger) if trigger else out).start()


#: Buckets of keys of an upserted table, and parts of a bucket that are merged into one.
BUCKETS, PARTS = 64, 8
MANIFEST = "bucket int, folder string"


def upsert_by_key(events: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], order: tuple[str, ...], *, buckets: int = BUCKETS, parts: int = PARTS, **trigger):
    """Starts a query that keeps the last event of each key in a table that :func:`upserted` reads.

    A batch writes its own last events by bucket of the key, ``path/data/batch=n/bucket=b``,
    and ``path/manifest/version=n``: which folders make up each bucket. A bucket that
    has come to ``parts`` folders is merged into one; the others aren't touched, so
    a batch's work grows with the batch. A batch that runs again writes the same
    folders again. Folders that neither this version nor the one before names are
    removed, so a reader has one batch's time. Nulls are keys like others.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        folder = f"data/batch={number}"
        latest_by_key(batch, keys, order).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{folder}")
        before = manifest(spark, path, number - 1)
        # at most a row for each bucket
        touched = [r["bucket"] for r in _read(spark, batch.schema, [f"{path}/{folder}"], True).select("bucket").distinct().collect()]
        now = {b: [*folders] for b, folders in before.items()}
        for b in touched:
            now.setdefault(b, []).append(f"{folder}/bucket={b}")
        full = [b for b in touched if len(now[b]) > parts]
        if full:
            rows = _read(spark, batch.schema, [f"{path}/{f}" for b in full for f in now[b]], False)
            merged = f"data/merged={number}"
            latest_by_key(rows, keys, order).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{merged}")
            now |= {b: [f"{merged}/bucket={b}"] for b in full}
        rows = [(b, f) for b, folders in now.items() for f in folders]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={number}")
        old = manifest(spark, path, number - 2)
        kept = {f for version in (before, now) for folders in version.values() for f in folders}
        never_named = [f"{folder}/bucket={b}" for b in full]
        for gone in never_named + [f for folders in old.values() for f in folders if f not in kept] + ([f"manifest/version={number - 2}"] if number >= 2 else []):
            _remove(spark, f"{path}/{gone}")

    out = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (out.trigger(**trigger) if trigger else out).start()


def _fs(spark: SparkSession, path: str):
    """The path and its file system, by Hadoop's API, so that any store will do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    place, fs = _fs(spark, path)
    fs.delete(place, True)


def _read(spark: SparkSession, schema: StructType, paths: list[str], with_bucket: bool) -> DataFrame:
    wide = StructType([*schema.fields, StructField("bucket", IntegerType())]) if with_bucket else schema
    return spark.read.schema(wide).parquet(*paths)


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, list[str]]:
    """The folders of each bucket in a version (none: no folders); at most ``buckets * parts`` rows."""
    place, fs = _fs(spark, f"{path}/manifest/version={version}")
    if not fs.exists(place):
        return {}
    out: dict[int, list[str]] = {}
    for r in sorted(spark.read.schema(MANIFEST).json(f"{path}/manifest/version={version}").collect()):
        out.setdefault(r["bucket"], []).append(r["folder"])
    return out


def upserted(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The table that :func:`upsert_by_key` keeps at ``path``: the last event of each key, as of its newest version.

    Parts are read together and merged by key, a shuffle of what was written since
    the buckets were last merged and of their merged parts.
    """
    place, fs = _fs(spark, f"{path}/manifest")
    versions = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(place)] if fs.exists(place) else []
    folders = [f"{path}/{f}" for parts in manifest(spark, path, max(versions, default=0)).values() for f in parts]
    rows = _read(spark, schema, folders, False) if folders else spark.createDataFrame([], schema)
    return latest_by_key(rows, keys, order)


class SettledPrefix(StatefulProcessor):
    """Publishes the segments of a growing recording as far as its finished chunks reach without a gap.

    What is published never changes: a segment comes out once, in order of its
    start, as soon as every chunk that can still hold an earlier one has come: the
    chunks from 0 on without a gap, and the next may begin ``LATE_US`` before the
    end of the last. Segments may overlap. One that begins before what was settled
    when its chunk came is late: it isn't published and comes out as ``late``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "idx long", "segments array<struct<start_us: bigint, end_us: bigint, text: string>>, win_end_us long")
        self.waiting = handle.getMapState("waiting", "start_us long, end_us long, text string", "n long")
        self.next = handle.getValueState("next", "idx long, settled_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for chunk in frame.itertuples():
                self.held.updateValue((int(chunk.idx),), ([tuple(s) if not isinstance(s, dict) else (s["start_us"], s["end_us"], s["text"]) for s in chunk.segments], int(chunk.win_end_us)))
        at, settled = self.next.get() if self.next.exists() else (0, None)
        out = []
        while self.held.containsKey((at,)):
            segments, end = self.held.getValue((at,))
            for s in sorted(tuple(s) for s in segments):
                if settled is not None and s[0] < settled:
                    out.append((key[0], *s, True))
                else:
                    self.waiting.updateValue(s, (1 + (self.waiting.getValue(s)[0] if self.waiting.containsKey(s) else 0),))
            self.held.removeKey((at,))
            at, settled = at + 1, max(end - LATE_US, settled if settled is not None else end - LATE_US)
        if settled is not None:
            for s in sorted(tuple(s) for s in self.waiting.keys()):
                if s[0] < settled:
                    out += [(key[0], *s, False)] * self.waiting.getValue(s)[0]
                    self.waiting.removeKey(s)
            self.next.update((at, settled))
        yield pd.DataFrame(out, columns=["recording_id", "start_us", "end_us", "text", "late"])

    def close(self) -> None:
        pass


def growing_transcript(chunks: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us, text, late appended as chunks (recording_id, idx, win_end_us, segments) of recordings finish, in any order.

    The last ``LATE_US`` of a recording come out when a closing chunk without
    segments says that it goes no further.
    """
    schema = StructType.fromDDL("recording_id long, start_us long, end_us long, text string, late boolean")
    return chunks.groupBy("recording_id").transformWithStateInPandas(SettledPrefix(), schema, "Append", "None")


class JobSteps(StatefulProcessor):
    """Reports the steps that a job may not take."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for event in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            before = self.state.get()[0] if self.state.exists() else None
            if before is not None and event.to_state not in LEGAL_STEPS.get(before, ()):
                out.append((key[0], event.event_id, before, event.to_state))
            self.state.update((event.to_state,))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "from_state", "to_state"])

    def close(self) -> None:
        pass


def job_steps(events: DataFrame) -> DataFrame:
    """job_id, event_id, from_state, to_state of a stream's illegal steps; the stream is in order of time for each job."""
    return events.groupBy("job_id").transformWithStateInPandas(JobSteps(), StructType.fromDDL("job_id long, event_id long, from_state string, to_state string"), "Append", "None")
