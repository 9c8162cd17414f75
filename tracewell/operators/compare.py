"""Comparing two runs of recognised speech: words found again, losses, repeats, timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.folds import ordered_fold
from tracewell.operators.speech import word_timeline
from tracewell.operators.spans import overlap_join
from tracewell.sources.shared import parts

#: How near a triple counts, how near the same text, words of the shortest text compared, and what is late.
NEAR_US, SAME_US, MIN_WORDS, LATE_US = 6_000_000, 6_000_000, 3, 500_000
#: Margin of a seam, step past one, width of a stretch where there is none; how near a run the subject is read; words of the shortest repetition.
MARGIN_US, SHIFT_US, PLAIN_US, BESIDE_US, REPEATED = 3_000_000, 1_000_000, 11_000_000, 1_000_000, 6
#: Words of the shortest lost run that is listed, and of a loss that is a finding by itself.
LOST_WORDS, FINDING_WORDS = 3, 8
#: Upper bounds of the gap bins in microseconds.
GAP_BINS = (0, 20_000, 100_000, 500_000, 1_000_000, 5_000_000)
#: Segments whose words are dealt to one task.
DEALT = 10_000


def triples(words: DataFrame) -> DataFrame:
    """Words with ``place`` in the recording (from 1), ``triple``, the word and the two after it (null if there are none), and ``until_us``, when that ends."""
    order = Window.partitionBy("recording_id").orderBy("at_us", "ordinal", "n")
    triple = F.concat("word", F.lit(" "), F.lead("word", 1).over(order), F.lit(" "), F.lead("word", 2).over(order))
    return words.withColumn("triple", triple).withColumn("until_us", F.lead("at_us", 2).over(order)).withColumn("place", F.row_number().over(order))


def trigram_recall(reference: DataFrame, subject: DataFrame) -> DataFrame:
    """Reference words (recording_id, place, word, at_us) with ``found``: any triple that holds the word occurs in the subject within six seconds.

    Both sides' triples are put in one order of time by (recording, triple), and a
    sliding count says whether the subject's is near, so that repeated triples make
    no pairs. A triple belongs to the two words after its first, too.
    """
    mine = triples(word_timeline(reference)).select("recording_id", "place", "word", "at_us", "triple", F.lit(0).alias("theirs"))
    theirs = triples(word_timeline(subject)).where("triple IS NOT NULL").select("recording_id", "at_us", "triple", F.lit(1).alias("theirs"))
    near = Window.partitionBy("recording_id", "triple").orderBy("at_us").rangeBetween(-NEAR_US, NEAR_US)
    every = mine.where("triple IS NOT NULL").unionByName(theirs, allowMissingColumns=True)
    met = every.withColumn("hit", (F.sum("theirs").over(near) > 0).cast("int")).where("theirs = 0").unionByName(mine.where("triple IS NULL"), allowMissingColumns=True)
    held = F.max("hit").over(Window.partitionBy("recording_id").orderBy("place").rowsBetween(-2, 0))
    return met.select("recording_id", "place", "word", "at_us", (F.coalesce(held, F.lit(0)) > 0).alias("found"))


def _script(latin: str, cyrillic: str, letters: str) -> Column:
    """The writing system of most letters, null without letters; of equal ones the first named."""
    other = F.col(letters) - F.col(latin) - F.col(cyrillic)
    most = F.greatest(F.col(latin), F.col(cyrillic), other)
    return F.when(F.col(letters) > 0, F.when(F.col(latin) == most, "latin").when(F.col(cyrillic) == most, "cyrillic").otherwise("other"))


def _letters(words: DataFrame) -> DataFrame:
    """Words with ``letters`` and how many of them are ``latin`` and ``cyrillic``."""
    of = lambda kind: F.length(F.regexp_replace("word", rf"[^\p{{{kind}}}]+", "")).cast("long")
    return words.withColumn("letters", of("L")).withColumn("latin", of("IsLatin")).withColumn("cyrillic", of("IsCyrillic"))


def lost_runs(words: DataFrame, subject: DataFrame, keys: tuple[str, ...] = ("recording_id",), least: int = 1) -> DataFrame:
    """keys, first_us, last_us, words, kind of the longest runs of words (keys, place, word, at_us, found) that weren't found, of ``least`` words or more.

    The keys begin with recording_id; runs end where another key does. ``repetition``: six words or more, and fewer than half of its triples differ;
    ``script``: most letters of what the subject's segments say within a second of the
    run are of another writing system; else ``loss``.
    """
    key = [*keys, "run"]
    lost = words.where(~F.col("found")).withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*keys).orderBy("place")))
    order = Window.partitionBy(*key).orderBy("place")
    lost = lost.withColumn("triple", F.concat("word", F.lit(" "), F.lead("word", 1).over(order), F.lit(" "), F.lead("word", 2).over(order)))
    sums = [F.sum(c).alias(c) for c in ("letters", "latin", "cyrillic")]
    runs = _letters(lost).groupBy(*key).agg(F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.count(F.lit(1)).alias("words"), F.count_distinct("triple").alias("distinct"), *sums)
    runs = runs.where(F.col("words") >= least)
    # what is said beside a run is what is said until its end less what is said before it, in one order of time
    n = parts(subject.sparkSession, subject.count(), DEALT)
    edge = lambda at, kind, sign: F.struct(at.alias("t"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    edges = F.explode(F.array(edge(F.col("first_us") - BESIDE_US, 0, -1), edge(F.col("last_us") + BESIDE_US, 2, 1)))
    edges = runs.withColumn("e", edges).select(*runs.columns, "e.*").repartition(n, "recording_id")
    said = _letters(word_timeline(subject.where("recording_id IS NOT NULL").repartition(n, "recording_id"))).where("at_us IS NOT NULL")
    said = said.select("recording_id", F.col("at_us").alias("t"), F.lit(1).alias("kind"), *[F.col(c).alias(f"said_{c}") for c in ("letters", "latin", "cyrillic")])
    upto = Window.partitionBy("recording_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    so_far = edges.unionByName(said, allowMissingColumns=True)
    so_far = so_far.select(*runs.columns, "kind", "sign", *[F.coalesce(F.sum(f"said_{c}").over(upto), F.lit(0)).alias(f"said_{c}") for c in ("letters", "latin", "cyrillic")]).where("kind <> 1")
    beside = so_far.groupBy(*runs.columns).agg(*[F.sum(F.col("sign") * F.col(f"said_{c}")).alias(f"said_{c}") for c in ("letters", "latin", "cyrillic")])
    repeats = (F.col("words") >= REPEATED) & (F.col("distinct") * 2 < F.col("words") - 2)
    theirs = _script("said_latin", "said_cyrillic", "said_letters")
    kind = F.when(repeats, "repetition").when(_script("latin", "cyrillic", "letters") != theirs, "script").otherwise("loss")
    return beside.select(*keys, "first_us", "last_us", "words", kind.alias("kind"))


def control_stretches(seams: DataFrame, ranges: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us: stretches as wide as the recording's first seam with its margins, clear of all seams with theirs.

    ``seams``: recording_id, start_us, end_us; ``ranges``: one row a recording, its
    compared range. They follow one another from the range's start; where one would
    touch a seam the next begins whole seconds later. A range without seams is laid
    out in stretches of eleven seconds.
    """
    bounds = ranges.select("recording_id", F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us"))
    rows = bounds.join(seams.select("recording_id", "start_us", "end_us"), "recording_id", "left").where("start_us IS NULL OR (start_us >= from_us AND end_us <= to_us)")
    rows = rows.unionByName(bounds.withColumn("start_us", F.lit(None).cast("long")).withColumn("end_us", F.lit(None).cast("long"))).withColumn("start_us", F.coalesce("start_us", "to_us")).distinct()

    def laid(recording: int, at: int, width: int, until: int) -> tuple[int, list[tuple]]:
        count = max(0, (until - at) // width)
        return at + count * width, [(recording, at + i * width, at + (i + 1) * width) for i in range(count)]

    def step(now: tuple | None, row) -> tuple[tuple | None, list[tuple]]:
        if row is None:
            recording, at, width, until = now
            return None, laid(recording, at, width, until)[1]
        seam = row.end_us == row.end_us and row.end_us is not None
        if now is None:
            now = (row.recording_id, row.from_us, int(row.end_us - row.start_us) + 2 * MARGIN_US if seam else PLAIN_US, row.to_us)
        if not seam:
            return now, []
        recording, at, width, until = now
        at, out = laid(recording, at, width, int(row.start_us) - MARGIN_US)
        late = int(row.end_us) + MARGIN_US - at
        return (recording, at + max(0, -(-late // SHIFT_US)) * SHIFT_US, width, until), out

    return ordered_fold(rows, ["recording_id"], ["start_us"], step, "recording_id long, start_us long, end_us long")


def stretch_words(reference: DataFrame, subject: DataFrame, stretches: DataFrame) -> DataFrame:
    """recording_id, from_us, to_us, place, word, at_us, found: the reference's words in each different stretch (recording_id, start_us, end_us), and whether the subject has a triple with the word within six seconds of the stretch.

    Segments are dealt by recording once, as texts; words, triples and stretches then
    meet in windows within recordings, so that no word is sent anywhere. What stretches
    are open is carried along the words, and a stretch has a triple if of the subject's,
    from six seconds before it on, the first to end does so in time.
    """
    n = parts(reference.sparkSession, reference.count() + subject.count(), DEALT)
    at = stretches.where("recording_id IS NOT NULL AND start_us < end_us").select("recording_id", "start_us", "end_us").distinct()
    begins = at.select("recording_id", "start_us", (F.col("start_us") + 1).alias("end_us")).distinct()
    open_ = overlap_join(begins, at.withColumn("from_us", F.col("start_us")).withColumn("to_us", F.col("end_us")), ["recording_id"]).select("recording_id", F.col("start_us").alias("at_us"), F.struct("from_us", "to_us").alias("open"))
    opened = open_.repartition(n, "recording_id").groupBy("recording_id", "at_us").agg(F.collect_list("open").alias("open")).withColumn("place", F.lit(0))
    mine = triples(word_timeline(reference.repartition(n, "recording_id"))).select("recording_id", "place", "word", "at_us", "triple")
    order = Window.partitionBy("recording_id").orderBy("at_us", "place")
    carried = F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = mine.unionByName(opened, allowMissingColumns=True).withColumn("open", carried).where("place > 0").withColumn("open", F.filter("open", lambda x: x["to_us"] > F.col("at_us")))
    # a triple also belongs to the two words after its first
    asked = F.array_distinct(F.flatten(F.array_compact(F.array("open", F.lead("open", 1).over(order), F.lead("open", 2).over(order)))))
    inside = placed.withColumn("asked", asked).withColumn("open", F.explode("asked")).select("recording_id", "open.from_us", "open.to_us", "place", "word", "at_us", "triple", (F.col("open.from_us") - NEAR_US).alias("since_us"))
    theirs = triples(word_timeline(subject.repartition(n, "recording_id"))).where("triple IS NOT NULL AND at_us IS NOT NULL").select("recording_id", "triple", F.col("at_us").alias("since_us"), "until_us")
    back = Window.partitionBy("recording_id", "triple").orderBy(F.desc("since_us"), F.col("until_us").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = inside.unionByName(theirs, allowMissingColumns=True).withColumn("hit", F.min("until_us").over(back) <= F.col("to_us") + NEAR_US).where("place IS NOT NULL")
    held = F.max("hit").over(Window.partitionBy("recording_id", "from_us", "to_us").orderBy("place").rowsBetween(-2, 0))
    return met.withColumn("found", F.coalesce(held, F.lit(False))).where("at_us >= from_us AND at_us < to_us").select("recording_id", "from_us", "to_us", "place", "word", "at_us", "found")


def seam_losses(words: DataFrame, subject: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us (the seam), first_us, last_us, words, kind of runs of ``LOST_WORDS`` or more words that are lost at seams; ``words`` are :func:`stretch_words` of the seams with their margins."""
    runs = lost_runs(words, subject, ("recording_id", "from_us", "to_us"), LOST_WORDS)
    return runs.select("recording_id", (F.col("from_us") + MARGIN_US).alias("start_us"), (F.col("to_us") - MARGIN_US).alias("end_us"), "first_us", "last_us", "words", "kind")


def seams_inside(seams: DataFrame, ranges: DataFrame) -> DataFrame:
    """The seams (recording_id, start_us, end_us) inside their recording's compared range, with their margins."""
    inside = seams.join(ranges.select("recording_id", F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us")), "recording_id").where("start_us >= from_us AND end_us <= to_us")
    return inside.select("recording_id", (F.col("start_us") - MARGIN_US).alias("start_us"), (F.col("end_us") + MARGIN_US).alias("end_us"))


def seam_comparison(subject: DataFrame, reference: DataFrame, seams: DataFrame, ranges: DataFrame) -> DataFrame:
    """recording_id, seams, seam_words, seam_found, controls, control_words, control_found, explained, longest_loss, finding: what the reference says at the subject's seams and far from them, found in the subject.

    Lost runs of three words or more that the recogniser explains (a repetition,
    another script) say how two cuts differ, so their words, ``explained``, count as
    found at the seams. ``finding``: the share found at seams is more than a tenth
    below that of the control stretches (where both have words), or a run of
    ``FINDING_WORDS`` words or more is plainly lost at a seam.
    """
    key = ["recording_id", "from_us", "to_us"]
    at = seams_inside(seams, ranges).withColumn("kind", F.lit("seam"))
    every = at.unionByName(control_stretches(seams, ranges).withColumn("kind", F.lit("control"))).withColumnsRenamed({"start_us": "from_us", "end_us": "to_us"})
    words = stretch_words(reference, subject, every.withColumnsRenamed({"from_us": "start_us", "to_us": "end_us"}))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sums = words.groupBy(*key).agg(F.count(F.lit(1)).alias("words"), F.count_if("found").alias("found"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), none)
    counted = every.join(sums, key, "left").groupBy("recording_id").agg(
        of("seam", one).alias("seams"), of("seam", F.col("words")).alias("seam_words"), of("seam", F.col("found")).alias("seam_found"),
        of("control", one).alias("controls"), of("control", F.col("words")).alias("control_words"), of("control", F.col("found")).alias("control_found"),
    )
    plain = F.col("kind") == "loss"
    # controls have lost runs, too; runs are fewer than words to tell apart
    own = at.select("recording_id", (F.col("start_us") + MARGIN_US).alias("start_us"), (F.col("end_us") - MARGIN_US).alias("end_us")).distinct()
    losses = seam_losses(words, subject).join(own, ["recording_id", "start_us", "end_us"], "left_semi")
    losses = losses.groupBy("recording_id").agg(F.sum(F.when(~plain, F.col("words"))).alias("explained"), F.max(F.when(plain, F.col("words"))).alias("longest_loss"))
    rows = counted.join(losses, "recording_id", "left").withColumn("explained", F.coalesce("explained", none)).withColumn("longest_loss", F.coalesce("longest_loss", none))
    # in whole numbers: c / C - s / S > 1 / 10
    gap = (F.col("control_found") * F.col("seam_words") - (F.col("seam_found") + F.col("explained")) * F.col("control_words")) * 10 > F.col("seam_words") * F.col("control_words")
    return rows.withColumn("finding", ((F.col("seam_words") > 0) & (F.col("control_words") > 0) & gap) | (F.col("longest_loss") >= FINDING_WORDS))


def timing_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """recording_id, ordinal, start_diff_us, end_diff_us of segments of three words or more whose text the other side has once, starting within six seconds."""
    text = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    mine = a.withColumn("__t", text).where(F.size(F.split("__t", " ")) >= MIN_WORDS)
    once = b.withColumn("__t", text).groupBy("recording_id", "__t").agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("b_start"), F.min("end_us").alias("b_end")).where("n = 1")
    met = mine.join(once, ["recording_id", "__t"]).where(F.abs(F.col("start_us") - F.col("b_start")) <= SAME_US)
    return met.select("recording_id", "ordinal", F.abs(F.col("start_us") - F.col("b_start")).alias("start_diff_us"), F.abs(F.col("end_us") - F.col("b_end")).alias("end_diff_us"))


def gap_histogram(segments: DataFrame) -> DataFrame:
    """recording_id, bin, gaps: gaps between successive segments in seven bins."""
    gap = F.col("start_us") - F.lag("end_us").over(Window.partitionBy("recording_id").orderBy("ordinal"))
    bins = F.lit(len(GAP_BINS))
    for i in reversed(range(len(GAP_BINS))):
        bins = F.when(F.col("gap") <= GAP_BINS[i], i).otherwise(bins)
    return segments.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("recording_id", bins.alias("bin")).agg(F.count(F.lit(1)).alias("gaps"))


def compare_revisions(a: DataFrame, b: DataFrame) -> DataFrame:
    """recording_id, start_us, end_us, text, side: segments that one side has more often than the other."""
    columns = ["recording_id", "start_us", "end_us", "text"]
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))
