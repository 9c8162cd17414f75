"""Record files: turns, recogniser output, on-screen text, requests, and tables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TURN = r"^(\d+)\.(\d{3}) -- (\d+)\.(\d{3}) speaker_(\d+)(?: .*)?$"
#: How far past the range an end is trimmed rather than refused, most turns of a file, most lines of a request file.
TRIM_US, MAX_TURNS, MAX_REQUESTS = 10_000, 20_000, 1_000
RECOGNISER = "result struct<language: string>, transcription array<struct<offsets: struct<`from`: bigint, `to`: bigint>, text: string, tokens: array<struct<text: string, p: double>>>>"


def whole_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, value of text files, each a row; a table of such rows stands for files that are kept together."""
    if isinstance(path, DataFrame):
        return path.select("path", "value")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def numbered_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, line (from 1), text of every line of text files."""
    files = whole_files(spark, path).withColumn("value", F.regexp_replace(F.col("value"), "\n$", ""))
    return files.select("path", F.posexplode(F.split("value", "\r\n?|\n")).alias("n", "text")).select("path", (F.col("n") + 1).cast("long").alias("line"), "text")


def read_turns(spark: SparkSession, path: str, offset_us: int = 0, end_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns (path, start_us, end_us, cluster) and rejected files (path, line) of a diariser's lines.

    Lines that don't begin with a digit are skipped, empty turns too; another line that isn't a turn rejects the file.
    """
    lines = numbered_lines(spark, path).where(F.col("text").rlike(r"^\d"))
    part = lambda i: F.regexp_extract("text", TURN, i).try_cast("long")
    rows = lines.withColumn("start_us", part(1) * 1_000_000 + part(2) * 1000 + offset_us).withColumn("end_us", part(3) * 1_000_000 + part(4) * 1000 + offset_us).withColumn("cluster", part(5).cast("int"))
    bad = rows.where("start_us IS NULL OR end_us < start_us").groupBy("path").agg(F.min("line").alias("line"))
    good = rows.join(bad, "path", "left_anti").where("start_us < end_us").select("path", "start_us", "end_us", "cluster")
    return (trim_turns(good, end_us) if end_us is not None else good), bad


def trim_turns(turns: DataFrame, end_us: int) -> DataFrame:
    """Turns whose end is at most ten milliseconds past the range end with it."""
    near = (F.col("end_us") > end_us) & (F.col("end_us") <= end_us + TRIM_US)
    return turns.withColumn("end_us", F.when(near, F.lit(end_us).cast("long")).otherwise(F.col("end_us")))


def read_rttm(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, start_us, end_us, speaker of RTTM speaker lines."""
    fields = F.split(F.trim("text"), r"\s+")
    rows = numbered_lines(spark, path).where(F.col("text").startswith("SPEAKER ")).select("path", fields.alias("f"))
    micros = lambda i: F.round(F.get("f", F.lit(i)).try_cast("decimal(20,6)") * 1_000_000).cast("long")
    return rows.select("path", micros(3).alias("start_us"), (micros(3) + micros(4)).alias("end_us"), F.get("f", F.lit(7)).alias("speaker")).where("start_us < end_us")


def read_recogniser_json(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, language, pos, start_us, end_us, text, tokens of a recogniser's files, one for each chunk; a broken file has one row of nulls."""
    files = whole_files(spark, path).select("path", F.from_json("value", RECOGNISER).alias("j"))
    rows = files.select("path", F.col("j.result.language").alias("language"), F.posexplode_outer("j.transcription").alias("pos", "s"))
    return rows.select("path", "language", "pos", (F.col("s.offsets.from") * 1000).alias("start_us"), (F.col("s.offsets.to") * 1000).alias("end_us"), "s.text", "s.tokens")


def chunk_confidence(segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, confidence_bp: the mean probability of text tokens (not marks like [_BEG_]) in basis points, null without any."""
    text = F.filter("tokens", lambda t: ~t["text"].rlike(r"^\[_.*\]$|^<\|.*\|>$") & t["p"].isNotNull())
    sums = segments.select(*keys, F.size(text).alias("n"), F.aggregate(text, F.lit(0.0), lambda a, t: a + t["p"]).alias("p")).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return sums.select(*keys, F.when(F.col("n") > 0, F.round(F.col("p") / F.col("n") * 10_000).cast("int")).alias("confidence_bp"))


SCREEN_TEXT = "runner string, line struct<image: bigint, x: bigint, y: bigint, width: bigint, height: bigint, text: string, text_cut: boolean, confidence: double>, image struct<image: bigint, lines: bigint>"


def read_screen_text_jsonl(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (path, image, x, y, w, h, text, confidence_bp) of images that are closed by their record, and the images (path, image) that aren't."""
    rows = numbered_lines(spark, path).where("text <> ''").select("path", "line", F.from_json("text", SCREEN_TEXT).alias("j"))
    lines = rows.where("j.line IS NOT NULL").select("path", F.col("j.line.image").alias("image"), "j.line.x", "j.line.y", F.col("j.line.width").alias("w"), F.col("j.line.height").alias("h"), "j.line.text", F.round(F.col("j.line.confidence") * 10_000).cast("int").alias("confidence_bp"))
    closed = rows.where("j.image IS NOT NULL").select("path", F.col("j.image.image").alias("image")).distinct()
    return lines.join(closed, ["path", "image"], "left_semi"), lines.select("path", "image").distinct().join(closed, ["path", "image"], "left_anti")


def read_request_lines(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (path, line, operation_id, steps) and rejections (path, line, reason) of JSON-line files; a bad line rejects itself alone."""
    rows = numbered_lines(spark, path).where(F.trim("text") != "").withColumn("j", F.from_json("text", "operation_id string, steps array<string>"))
    reason = F.when(F.col("line") > MAX_REQUESTS, "too_many_lines").when(F.col("j").isNull() | F.get_json_object("text", "$").isNull(), "not_json").when(F.coalesce(F.col("j.operation_id"), F.lit("")) == "", "no_operation")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("path", "line", "j.operation_id", "j.steps"), rows.where("reason IS NOT NULL").select("path", "line", "reason")


def write_record_table(df: DataFrame, path: str, buckets: int = 64, key: str = "recording_id") -> None:
    """A table in folders by a hash of the recording, sorted in files so that scans skip by recording and time."""
    order = [key, *[c for c in ("start_us", "time_us") if c in df.columns]]
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket", *order[:1]).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_record_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def clock_tags(probes: DataFrame, tag: str = "creation_time") -> DataFrame:
    """recording_id, text: the creation time that a container's probe output (JSON) gives, where there is one."""
    text = F.get_json_object("metadata_json", f"$.format.tags.{tag}")
    return probes.select("recording_id", text.alias("text")).where("text IS NOT NULL")


def read_frames(spark: SparkSession, path: str, every_us: int = 500_000, size: int = 128 * 72) -> DataFrame:
    """recording_id, time_us, pixels of files of raw grey frames, one after another, named by the recording's number.

    A last frame that isn't whole keeps the bytes it has, which ``frames_to_samples``
    refuses. A file is a row while it is cut up, so it is at most 2 GB, some 29 hours
    of frames; other files are left out if their name begins with no number.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"/([0-9]{1,18})[^/]*$", 1).alias("number"), "content", F.col("length").cast("long").alias("bytes"))
    frames = files.where("number <> '' AND bytes > 0").select(F.col("number").cast("long").alias("recording_id"), "content", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {size})")).alias("n"))
    return frames.select("recording_id", (F.col("n") * every_us).alias("time_us"), F.expr(f"substring(content, cast(n * {size} + 1 AS int), {size})").alias("pixels"))
