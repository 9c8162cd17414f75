"""Transcript files: SubRip and WebVTT to cues, and cues to SubRip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import milliseconds, strip_markup, subrip_text, voice_label

#: The largest file, the longest line and the most cues that are read.
MAX_FILE_BYTES, MAX_LINE_BYTES, MAX_CUES = 8 * 1024 * 1024, 4096, 20_000
SUBRIP_TIME = r"^(\d{1,3}):([0-5]\d):([0-5]\d),(\d{3})[ \t]+-->[ \t]+(\d{1,3}):([0-5]\d):([0-5]\d),(\d{3})[ \t]*$"
WEBVTT_TIME = r"^(?:(\d{2,}):)?([0-5]\d):([0-5]\d)\.(\d{3})[ \t]+-->[ \t]+(?:(\d{2,}):)?([0-5]\d):([0-5]\d)\.(\d{3})(?:[ \t].*)?$"


def detect_sidecar_format(files: DataFrame) -> DataFrame:
    """``path, content`` with ``format`` (``webvtt``, ``subrip`` or null) and ``problem``: by content, not by name."""
    head = F.hex(F.substring("content", 1, 4))
    problem = (
        F.when(F.octet_length("content") > MAX_FILE_BYTES, "too_large").when(head.rlike("^(FFFE|FEFF|0000FEFF)"), "not_utf8")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    )
    body = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    return files.withColumn("problem", problem).withColumn("format", F.when(problem.isNull(), F.when(body.rlike(r"^WEBVTT([ \t\r\n]|$)"), "webvtt").otherwise("subrip")))


def _time(line: Column, pattern: str, first: int) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, pattern, first + i), F.lit("")).cast("long"), F.lit(0))
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1_000_000 + part(3) * 1000


def _cues(files: DataFrame, webvtt: bool) -> DataFrame:
    pattern = WEBVTT_TIME if webvtt else SUBRIP_TIME
    text = F.regexp_replace(F.regexp_replace(F.col("text"), "^\ufeff", ""), "\r\n?", "\n")
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    order = Window.partitionBy("path").orderBy("n")
    # blocks between blank lines
    lines = lines.withColumn("block", F.sum((F.trim("line") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.trim("line") != "")
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("n"))
    timed = F.min(F.when(F.col("line").contains("-->"), F.col("place"))).over(Window.partitionBy("path", "block"))
    lines = lines.withColumn("place", place).withColumn("at", timed)
    head = F.min_by("line", "n")
    blocks = lines.groupBy("path", "block").agg(
        head.alias("head"), F.min("n").alias("first_line"), F.max("at").alias("at"),
        F.max(F.when(F.col("place") == F.col("at"), F.col("line"))).alias("timing"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") > F.col("at"), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("payload"),
    )
    if webvtt:
        blocks = blocks.where(~F.col("head").rlike(r"^(WEBVTT|NOTE|STYLE|REGION)([ \t]|$)"))
    good = F.coalesce(F.col("timing").rlike(pattern), F.lit(False)) & (F.col("at") <= 2)
    if not webvtt:
        good = good & ((F.col("at") == 1) | F.trim("head").rlike(r"^\d+$"))
    start, end = _time(F.col("timing"), pattern, 1), _time(F.col("timing"), pattern, 5)
    blocks = blocks.withColumn("start_us", start).withColumn("end_us", end)
    problem = F.when(F.col("at").isNull(), "untimed_text").when(~good, "invalid_timing").when(F.col("end_us") <= F.col("start_us"), "reversed_timing")
    early = F.col("start_us") < F.lag("start_us").over(Window.partitionBy("path").orderBy("first_line"))
    return blocks.withColumn("problem", F.coalesce(problem, F.when(early, "out_of_order")))


def read_cues(files: DataFrame, webvtt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cues (path, ordinal, line, start_us, end_us, text, original, speaker) and rejected files (path, line, problem).

    ``files``: path, text. One bad block rejects its file, at the first bad line;
    cues are never put in another order. Empty cues are left out.
    """
    blocks = _cues(files, webvtt)
    bad = blocks.where("problem IS NOT NULL").groupBy("path").agg(F.min(F.struct((F.col("first_line") + 1).alias("line"), "problem")).alias("p")).select("path", "p.line", "p.problem")
    clean = F.trim(strip_markup(F.col("payload"), webvtt))
    cues = blocks.join(bad, "path", "left_anti").withColumn("text", clean).where("text <> ''")
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("first_line")).cast("long")
    speaker = voice_label(F.col("payload")) if webvtt else F.lit(None).cast("string")
    return cues.select("path", ordinal.alias("ordinal"), (F.col("first_line") + 1).cast("long").alias("line"), "start_us", "end_us", "text", F.when(F.col("text") != F.col("payload"), F.col("payload")).alias("original"), speaker.alias("speaker")), bad


def read_subrip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_cues(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_webvtt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_cues(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), webvtt=True)


def subrip(segments: DataFrame) -> DataFrame:
    """recording_id, text: each recording's segments as a SubRip file, numbered from 1, empty ones left out."""
    rows = segments.where(F.trim("text") != "").withColumn("n", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_us", "ordinal")))
    cue = F.concat(F.col("n"), F.lit("\n"), milliseconds(F.col("start_us")), F.lit(" --> "), milliseconds(F.col("end_us")), F.lit("\n"), subrip_text(F.col("text")), F.lit("\n"))
    cues = rows.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("n", cue.alias("cue")))).alias("cues"))
    return cues.select("recording_id", F.array_join(F.transform("cues", lambda c: c["cue"]), "\n").alias("text"))


def write_subrip(segments: DataFrame, path: str) -> None:
    """A text file for each recording, in folders by recording_id."""
    subrip(segments).write.partitionBy("recording_id").mode("overwrite").text(path)
