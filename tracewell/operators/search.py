"""Literal search over segments and on-screen lines, in two tiers, with paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import MAX_QUERY_WORDS, SEP, WORD, match_tier, normalise_words, phrase_pattern
from tracewell.operators.spans import in_range
from tracewell.sources.shared import parts, scratch

#: Letters after a word by which a phrase is looked for, and segments whose pairs are dealt to one task.
AHEAD, DEALT = 4, 10_000


def tier_of(text: Column, query: str) -> Column:
    """1 where the query's words stand in the text run together, 2 where all are in it, else null."""
    return match_tier(normalise_words(text), normalise_words(F.lit(query)))


def search(segments: DataFrame, query: str, *, from_us: int | None = None, to_us: int | None = None, speaker: str | None = None, after: tuple[int, int] | None = None, limit: int | None = None, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Segments that match, with ``tier``, by recording; hits are ranked by (tier, ordinal).

    A range keeps segments that intersect it, ``speaker`` those of that speaker.
    ``after`` and ``limit`` page through each recording's ranking.
    """
    rows = segments if from_us is None else in_range(segments, from_us, to_us)
    if speaker is not None:
        rows = rows.where(F.col("speaker") == speaker)
    hits = rows.withColumn("tier", tier_of(F.col("text"), query)).where("tier IS NOT NULL")
    if after is not None:
        hits = hits.where((F.col("tier") > after[0]) | ((F.col("tier") == after[0]) & (F.col("ordinal") > after[1])))
    if limit is not None:
        hits = page(hits, keys, ("tier", "ordinal"), limit)
    return hits


def page(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key, and ``has_more``: whether there are others."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit + 1)
    return rows.withColumn("has_more", F.max("__n").over(Window.partitionBy(*keys)) > limit).where(F.col("__n") <= limit).drop("__n")


def queries_by_segments(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """query_id, the segments' columns and tier for every query (query_id, query; at most 16 words) that a segment matches.

    The words of segments are worked out once, with a number for each segment, into a
    table of the job's own. Numbers of segments and queries meet first, texts join
    after. All terms: segments that have the term of the query that fewest segments have
    are tried for the others. Phrase: at a word that the phrase's joined letters
    begin with, where the next ``AHEAD`` letters are the phrase's too. A phrase that
    ends within these is found by that; longer ones are few, and they alone are tried
    as patterns.
    """
    spark = segments.sparkSession
    asked = queries.withColumn("terms", normalise_words(F.col("query"))).where(f"size(terms) BETWEEN 1 AND {MAX_QUERY_WORDS}").withColumn("joined", F.array_join("terms", "")).withColumn("pattern", phrase_pattern(F.col("terms")))
    words, place, asks = F.col("words"), scratch(spark, "words"), scratch(spark, "queries")
    asked.select("query_id", F.array_distinct("terms").alias("terms"), "joined", "pattern").write.parquet(asks)
    asked = spark.read.parquet(asks)
    segments.select(F.struct(*segments.columns).alias("__row"), F.monotonically_increasing_id().alias("__id"), normalise_words(F.col("text")).alias("words")).write.parquet(place)
    rows = spark.read.parquet(place)

    terms = asked.select("query_id", F.explode("terms").alias("word"))
    own = rows.select("__id", F.explode(F.array_distinct("words")).alias("word"))
    common = own.join(terms.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a term that no segment has leaves its query without hits
    rarest = terms.join(common, "word", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).select("query_id", "r.word")
    met = own.join(rarest, "word").select("query_id", "__id", F.lit(False).alias("phrase"), F.lit(False).alias("begun"), F.lit(True).alias("met"))

    begins = F.transform(F.sequence(F.lit(1), F.length("joined")), lambda n: F.struct(F.substring("joined", F.lit(1), n).alias("word"), F.substring("joined", n + 1, F.lit(AHEAD)).alias("next"), (F.length("joined") > n + AHEAD).alias("more")))
    heads = asked.select("query_id", F.explode(begins).alias("h")).select("query_id", "h.*")
    # words that no phrase begins with go first; the others meet with each number of the letters after them, as a phrase may end within these
    places = F.explode(F.transform(words, lambda w, i: F.struct(w.alias("word"), F.slice("words", i + 2, F.lit(AHEAD)).alias("after"))))
    some = rows.select("__id", places.alias("o")).select("__id", "o.*").join(heads.select("word").distinct(), "word", "left_semi")
    letters = F.substring(F.array_join("after", ""), 1, AHEAD)
    ends = F.transform(F.sequence(F.lit(0), F.lit(AHEAD)), lambda k: F.length(F.array_join(F.slice("after", F.lit(1), k), "")))
    some = some.select("__id", "word", letters.alias("letters"), ends.alias("ends"))
    ahead = some.select("__id", "word", F.explode(F.transform(F.sequence(F.lit(0), F.length("letters")), lambda n: F.struct(F.substring("letters", F.lit(1), n).alias("next"), F.array_contains("ends", n).alias("whole")))).alias("a"))
    begun = ahead.select("__id", "word", "a.*").join(heads, ["word", "next"]).where("more OR whole").select("query_id", "__id", (~F.col("more")).alias("phrase"), F.col("more").alias("begun"), F.lit(False).alias("met"))
    # a task's pairs are so many whatever the input, and aren't summed up before they are dealt, as few repeat
    pairs = met.unionByName(begun).repartition(parts(spark, rows.count(), DEALT), "query_id", "__id").groupBy("query_id", "__id").agg(*[F.bool_or(c).alias(c) for c in ("phrase", "begun", "met")])

    hits = pairs.join(rows, "__id").join(asked, "query_id")
    run_on = F.col("phrase") | (F.col("begun") & F.contains(F.array_join(words, ""), F.col("joined")) & F.call_function("rlike", F.array_join(words, SEP), F.col("pattern")))
    every = F.col("met") & F.forall("terms", lambda t: F.array_contains(words, t))
    # exploded, as a filter on the tier would work it out a second time
    tier = F.explode(F.array_compact(F.array(F.when(run_on, 1).when(every, 2))))
    return hits.select("query_id", "__row", tier.alias("tier")).select("query_id", "__row.*", "tier")


def text_runs(lines: DataFrame, place: str = "line_no") -> DataFrame:
    """Occurrences of on-screen text: the same words at the same place in frames that follow one another.

    recording_id, place, words, first_us, last_us, frames. Frames are those that
    have lines; a frame that wasn't read doesn't break a run. Frames are numbered
    without their text.
    """
    number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("time_us"))
    frames = lines.select("recording_id", "time_us").distinct().withColumn("__frame", number)
    # a text has words if it has a letter or digit: a filter on the words themselves would work them out twice
    read = lines.where(F.col("text").rlike(WORD)).select("recording_id", "time_us", place, F.array_join(normalise_words(F.col("text")), " ").alias("words"))
    rows = read.join(frames, ["recording_id", "time_us"])
    # lines that repeat in a frame have one rank
    run = F.col("__frame") - F.dense_rank().over(Window.partitionBy("recording_id", place, "words").orderBy("__frame"))
    runs = rows.withColumn("__run", run).groupBy("recording_id", place, "words", "__run")
    return runs.agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), (F.max("__frame") - F.min("__frame") + 1).cast("long").alias("frames")).drop("__run")


def bundle_rank(hits: DataFrame) -> DataFrame:
    """``sequence``: a hit's place in its bundle and tier, by time, transcript before screen text, then ordinal."""
    order = Window.partitionBy("recording_id", "tier").orderBy("start_us", F.when(F.col("kind") == "transcript", 0).otherwise(1), "ordinal")
    return hits.withColumn("sequence", F.row_number().over(order))


def since_page(segments: DataFrame, watermark: int, query: str, limit: int) -> DataFrame:
    """Of each recording's next ``limit`` segments after the watermark those that match, and the new ``watermark`` past all looked at."""
    looked = page(segments.where(F.col("ordinal") > watermark), ("recording_id",), ("ordinal",), limit).drop("has_more")
    looked = looked.withColumn("watermark", F.max("ordinal").over(Window.partitionBy("recording_id")))
    return looked.where(tier_of(F.col("text"), query).isNotNull())


def spread_evenly(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """n of each key's m rows at places step * (m - 1) div (n - 1): the first, the last, and evenly between."""
    by = Window.partitionBy(*keys)
    placed = df.withColumn("__i", F.row_number().over(by.orderBy(order)) - 1).withColumn("__m", F.count(F.lit(1)).over(by))
    wanted = F.expr(f"__m <= {n} OR exists(sequence(0, {n - 1}), s -> (s * (__m - 1)) div {max(1, n - 1)} = __i)")
    return placed.where(wanted).drop("__i", "__m")
