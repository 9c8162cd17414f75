"""Evaluation of what was read and heard: terms, lines, words, speakers, seams; and what is looked at next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import normalise_words, phrase_match
from tracewell.operators.speakers import speaking, unscored_time
from tracewell.operators.spans import overlap_join

#: Least letters of a word that counts, and the times by which seams are judged.
LEAST_LETTERS, REPEAT_US, AT_START_US, LONG_US = 4, 4_000_000, 20_000, 10_000_000
#: Letters of a line's piece that is looked for as it is.
PIECE = 16
#: Samples of a frame, the least number of samples, and a frame's mean square in parts of full scale squared (-50 dBFS).
FRAME_SAMPLES, LEAST_SAMPLES, SILENT_PART = 320, 1_600, 100_000


def critical_terms(terms: DataFrame, heard: DataFrame, known_misses: DataFrame) -> DataFrame:
    """item_id, terms, found: how many of an item's terms (item_id, term) are in what was heard (item_id, text), by the phrase rule.

    Known misses (item_id, term) don't count; an item that wasn't heard has none found.
    """
    asked = terms.distinct().join(known_misses.select("item_id", "term").distinct(), ["item_id", "term"], "left_anti")
    words = heard.groupBy("item_id").agg(F.min("text").alias("text")).select("item_id", normalise_words(F.col("text")).alias("words"))
    hit = F.coalesce(phrase_match(F.col("words"), normalise_words(F.col("term"))), F.lit(False))
    return asked.join(words, "item_id", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(hit).alias("found"))


def _best_inside(line: str, text: str) -> int:
    """The least edit distance of ``line`` to any part of ``text``.

    Of pieces of ``PIECE`` letters, one more than there are errors stands in the text
    unchanged, so up to so many errors only the text around such pieces is compared;
    beyond that, or where pieces are everywhere, all of it.
    """
    if line in text:
        return 0
    most = len(line) // PIECE - 1
    if most > 0:
        near = _near_pieces(line, text, most)
        if near is not None:
            best = min((_least_inside(line, text[a:b]) for a, b in near), default=len(line))
            if best <= most:
                return best
    return _least_inside(line, text)


def _near_pieces(line: str, text: str, most: int) -> list[tuple[int, int]] | None:
    """Where in the text a part within ``most`` errors of the line can be; None if that is hardly less than all."""
    places = []
    for start in range(0, (most + 1) * PIECE, PIECE):
        piece, at = line[start : start + PIECE], -1
        while (at := text.find(piece, at + 1)) >= 0:
            places.append(at - start)
            if len(places) > 4 * most + 4:
                return None
    spans: list[tuple[int, int]] = []
    for at in sorted(places):
        a, b = max(0, at - most), min(len(text), at + len(line) + most)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans if sum(b - a for a, b in spans) * 4 < len(text) * 3 else None


def _least_inside(line: str, text: str) -> int:
    """The least edit distance of ``line`` to any part of ``text``, by the whole edit table.

    A row of the edit table is two whole numbers, a bit a letter of the text: where it
    goes up and where it goes down by one. A letter of the line, which has fewer, moves all at once.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full, up, down = (1 << len(text)) - 1, 0, 0
    for c in line:
        same = at.get(c, 0)
        across = ((((same & up) + up) ^ up) | same | down) & full
        rise = ((down | (full ^ (across | up))) << 1 | 1) & full
        fall = (across & up) << 1 & full
        up, down = fall | (full ^ (across | rise)), rise & across
    steps = [np.unpackbits(np.frombuffer(x.to_bytes(len(text) // 8 + 1, "little"), dtype=np.uint8), bitorder="little").astype(np.int64) for x in (up, down)]
    return len(line) + int(np.cumsum(steps[0] - steps[1]).min(initial=0))


def line_error(truth: DataFrame, read: DataFrame) -> DataFrame:
    """frame_id, line_no, errors, length, numbers, numbers_found, numbers_near: each true line against what was read on its frame.

    ``truth``: frame_id, line_no, text; ``read``: frame_id, text (one row a frame,
    the lines run together). ``errors`` is the least edit distance to any part of
    it. Numbers are words with a digit; found as they are, or near: within two edits
    of a number that was read.
    """
    @F.pandas_udf("long")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lines, texts in batches:
            yield pd.Series([_best_inside(a, b) for a, b in zip(lines, texts, strict=True)], dtype="int64")

    numbers = lambda c: F.array_distinct(F.filter(normalise_words(F.col(c)), lambda w: w.rlike("[0-9]")))
    # the numbers of a frame are looked for once, not once a line
    seen = read.select("frame_id", F.coalesce("text", F.lit("")).alias("__read")).withColumn("__seen", numbers("__read"))
    rows = truth.join(seen, "frame_id", "left").withColumn("__read", F.coalesce("__read", F.lit(""))).withColumn("__seen", F.coalesce("__seen", F.array().cast("array<string>")))
    rows = rows.withColumn("__true", numbers("text"))
    missed = F.array_except("__true", "__seen")
    near = F.filter(missed, lambda n: F.exists("__seen", lambda m: F.levenshtein(n, m) <= 2))
    length = F.length("text")
    return rows.select("frame_id", "line_no", distance("text", "__read").alias("errors"), length.cast("long").alias("length"), F.size("__true").alias("numbers"), (F.size("__true") - F.size(missed)).alias("numbers_found"), F.size(near).alias("numbers_near"))


def line_error_summary(scores: DataFrame) -> DataFrame:
    """size, theme, lines, exact, median_error, mean_error, numbers, numbers_found: by size, by theme and over all (nulls).

    An error is the share of the line's characters, in whole basis points, 10,000 at most in the mean.
    """
    share = F.expr("errors * 10000 div greatest(1, length)")
    grouped = scores.select("size", "theme", "errors", "numbers", "numbers_found", share.alias("share")).groupingSets([["size"], ["theme"], []], "size", "theme")
    return grouped.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("errors") == 0).alias("exact"), F.median("share").alias("median_error"),
        F.expr("sum(least(share, 10000)) div count(1)").alias("mean_error"), F.sum("numbers").alias("numbers"), F.sum("numbers_found").alias("numbers_found"),
    )


def corroborated_words(readings: DataFrame) -> DataFrame:
    """frame_id, word, families: words of ``LEAST_LETTERS`` letters or more that two or more families of engines read on a frame (frame_id, family, text)."""
    words = readings.select("frame_id", "family", F.explode(F.array_distinct(normalise_words(F.col("text")))).alias("word")).where(F.col("word").rlike(f"^\\p{{IsAlphabetic}}{{{LEAST_LETTERS},}}$"))
    return words.groupBy("frame_id", "word").agg(F.countDistinct("family").alias("families")).where("families > 1")


def segment_attribution(truth: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """recording_id, segments, labelled, right, wrong: attributions (recording_id, ordinal, tag, outcome) against the true ones.

    Segments whose true speaker is ambiguous (not ``labelled``) don't count.
    ``pairs`` (recording_id, ref, hyp) says which found label is which true one.
    """
    sure = truth.where("outcome = 'labelled'").select("recording_id", "ordinal", F.col("tag").alias("ref"))
    named = found.select("recording_id", "ordinal", F.col("tag").alias("hyp")).join(pairs.withColumnRenamed("ref", "__named"), ["recording_id", "hyp"], "left")
    rows = sure.join(named, ["recording_id", "ordinal"], "left")
    right = F.col("hyp").isNotNull() & F.col("__named").eqNullSafe(F.col("ref"))
    return rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("segments"), F.count("hyp").alias("labelled"), F.count_if(right).alias("right"), F.count_if(F.col("hyp").isNotNull() & ~right).alias("wrong"))


def _assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one choice of cells with the largest sum: shortest augmenting paths, row by row."""
    n = max(gain.shape)
    cost = np.zeros((n, n))
    cost[: gain.shape[0], : gain.shape[1]] = gain.max() - gain
    cost[gain.shape[0] :, :] = cost[:, gain.shape[1] :] = gain.max()
    u, v, row_of = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        row_of[n], at = row, n
        least, came, used = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, dtype=bool)
        while row_of[at] >= 0:
            used[at] = True
            r, free = row_of[at], ~used[:n]
            better = free & (cost[r] - u[r] - v[:n] < least)
            least[better], came[better] = (cost[r] - u[r] - v[:n])[better], at
            following = int(np.where(free, least, np.inf).argmin())
            step = least[following]
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            at = following
        while at != n:
            row_of[at] = row_of[came[at]]
            at = came[at]
    return [(int(row_of[c]), c) for c in range(gain.shape[1]) if row_of[c] < gain.shape[0] and gain[row_of[c], c] > 0]


def best_map(reference: DataFrame, hypothesis: DataFrame, collar_us: int = 0, unscored: DataFrame | None = None) -> DataFrame:
    """recording_id, ref, hyp: the one-to-one map of speakers that shares the most time that counts.

    Time within ``collar_us`` of the end of a turn of the reference, and in the
    ranges ``unscored``, doesn't count. The time that two speakers share is summed by
    Spark; a recording's table of speakers, which are few, is one group.
    """
    key, pair = ["recording_id"], ["recording_id", "ref", "hyp"]
    met = overlap_join(speaking(reference, "ref"), speaking(hypothesis, "hyp"), key)
    shared = met.groupBy(*pair).agg(F.sum("overlap_us").alias("us"))
    if collar_us or unscored is not None:
        both = met.select(*pair, F.greatest("start_us", "r_start_us").alias("start_us"), F.least("end_us", "r_end_us").alias("end_us"))
        hidden = overlap_join(both, unscored_time(reference, collar_us, unscored), key).groupBy(*pair).agg(F.sum("overlap_us").alias("hidden"))
        shared = shared.join(hidden, pair, "left").select(*pair, (F.col("us") - F.coalesce("hidden", F.lit(0))).alias("us")).where("us > 0")

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="ref", columns="hyp", values="us").fillna(0).sort_index().sort_index(axis=1)
        return pd.DataFrame([(key[0], table.index[i], table.columns[j]) for i, j in _assignment(table.to_numpy(dtype=float))], columns=["recording_id", "ref", "hyp"])

    kinds = dict(shared.dtypes)
    return shared.groupBy("recording_id").applyInPandas(choose, f"recording_id {kinds['recording_id']}, ref {kinds['ref']}, hyp {kinds['hyp']}")


def seam_repeats(words: DataFrame) -> DataFrame:
    """recording_id, chunk, other, at_us: three words in a row that another chunk has too within ``REPEAT_US``, once for each pair of chunks (the first).

    ``words``: recording_id, chunk, at_us, word. Triples meet by time cells, so a
    common one doesn't meet itself all over a recording.
    """
    order = Window.partitionBy("recording_id", "chunk").orderBy("at_us", "word")
    triple = F.concat_ws(" ", "word", F.lead("word", 1).over(order), F.lead("word", 2).over(order))
    rows = words.withColumn("triple", F.when(F.lead("word", 2).over(order).isNotNull(), triple)).where("triple IS NOT NULL").select("recording_id", "chunk", "at_us", "triple")
    cells = rows.withColumn("cell", F.expr(f"at_us div {REPEAT_US}"))
    near = rows.select("recording_id", F.col("chunk").alias("other"), F.col("at_us").alias("other_us"), "triple", F.explode(F.expr(f"array(at_us div {REPEAT_US} - 1, at_us div {REPEAT_US}, at_us div {REPEAT_US} + 1)")).alias("cell"))
    # words are many more bytes than the texts that they are estimated from, so neither side is sent to the driver
    met = cells.join(near.hint("merge"), ["recording_id", "triple", "cell"]).where((F.col("chunk") < F.col("other")) & (F.abs(F.col("at_us") - F.col("other_us")) <= REPEAT_US))
    return met.groupBy("recording_id", "chunk", "other").agg(F.min("at_us").alias("at_us"))


def chunk_start_segments(segments: DataFrame, chunks: DataFrame, other: DataFrame) -> DataFrame:
    """recording_id, starts, total_us, long, leads, lead_us: segments that start within ``AT_START_US`` of a chunk's start.

    ``segments``: recording_id, start_us, end_us; ``chunks``: recording_id,
    win_start_us; ``other``: the segments of another plan. A segment leads by how
    long before the first of the other plan's segments that overlap it it starts.
    """
    starts = chunks.select("recording_id", F.explode(F.expr(f"sequence(-{AT_START_US}, {AT_START_US}, {AT_START_US})")).alias("d"), "win_start_us")
    cells = starts.select("recording_id", F.expr(f"(win_start_us + d) div {AT_START_US}").alias("cell"), "win_start_us").distinct()
    at = segments.withColumn("cell", F.expr(f"start_us div {AT_START_US}")).join(cells, ["recording_id", "cell"]).where(F.abs(F.col("start_us") - F.col("win_start_us")) <= AT_START_US)
    own = at.select("recording_id", "start_us", "end_us").distinct()
    met = overlap_join(own, other.select("recording_id", "start_us", "end_us"), ["recording_id"]).groupBy("recording_id", "start_us", "end_us").agg(F.min("r_start_us").alias("first_us"))
    rows = own.join(met, ["recording_id", "start_us", "end_us"], "left")
    length, lead = F.col("end_us") - F.col("start_us"), F.col("first_us") - F.col("start_us")
    return rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("starts"), F.sum(length).alias("total_us"), F.count_if(length > LONG_US).alias("long"), F.count_if(lead > 0).alias("leads"), F.coalesce(F.sum(F.when(lead > 0, lead)), F.lit(0)).alias("lead_us"))


def classify_audio(pcm: DataFrame, frame: int = FRAME_SAMPLES, least: int = LEAST_SAMPLES, part: int = SILENT_PART) -> DataFrame:
    """``pcm`` (samples: array of 16-bit whole numbers) with ``sound``: ``too_short``, ``silent`` (every frame is below -50 dBFS) or ``sound``."""
    power = F.transform(
        F.expr(f"sequence(0, greatest(0, (size(samples) - 1) div {frame}))"),
        lambda i: F.struct(F.aggregate(F.slice("samples", i * frame + 1, frame), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x).alias("sum"), F.least(F.lit(frame), F.size("samples") - i * frame).alias("n")),
    )
    quiet = F.forall(power, lambda p: p["sum"] * part < p["n"].cast("long") * 32_768 * 32_768)
    return pcm.withColumn("sound", F.when(F.coalesce(F.size("samples"), F.lit(0)) < least, "too_short").when(quiet, "silent").otherwise("sound"))


def order_read_targets(targets: DataFrame) -> DataFrame:
    """``targets`` (recording_id, time_us, kind, target_id) once each, with ``place``: by time, candidates before periodic ones, then by id."""
    order = Window.partitionBy("recording_id").orderBy("time_us", F.when(F.col("kind") == "candidate", 0).otherwise(1), "target_id")
    return targets.dropDuplicates(["recording_id", "time_us", "kind", "target_id"]).withColumn("place", F.row_number().over(order))


def first_unanalysed(gaps: DataFrame, windows: DataFrame) -> DataFrame:
    """recording_id, from_us, dropped: the start of the first gap that may be tried again, and how many changes the windows have dropped."""
    first = gaps.where("retryable").groupBy("recording_id").agg(F.min("start_us").alias("from_us"))
    dropped = windows.groupBy("recording_id").agg(F.sum("dropped").alias("dropped"))
    return dropped.join(first, "recording_id", "full").select("recording_id", "from_us", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def late_audio(chunks: DataFrame, late_us: int = 5_000_000) -> DataFrame:
    """``chunks`` (recording_id, idx, audio_start_us, win_start_us) with ``status``: ``published``, ``late`` (audio begins more than ``late_us``
    before its window), or ``stopped``: a recording publishes nothing after its first late chunk and never rewrites what it has."""
    early = F.col("audio_start_us") < F.col("win_start_us") - late_us
    before = Window.partitionBy("recording_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("status", F.when(F.coalesce(F.bool_or(early).over(before), F.lit(False)), "stopped").when(early, "late").otherwise("published"))


def since_read(segments: DataFrame, tokens: DataFrame, limit: int) -> DataFrame:
    """recording_id, status, segments, next_ordinal of reads that go on from a token (recording_id, revision, ordinal).

    ``segments``: recording_id, revision, sealed, ordinal. ``stale`` tokens are of
    another revision; ``more`` segments are there, ``waiting`` for more to come, or
    the revision is ``sealed`` and read to its end; ``unknown`` recordings have no segments.
    """
    state = segments.groupBy("recording_id").agg(F.max("revision").alias("now"), F.max("ordinal").alias("end"), F.max_by("sealed", "revision").alias("sealed"))
    met = tokens.join(state, "recording_id", "left")
    ahead = met.where(F.col("revision") == F.col("now")).join(segments.select("recording_id", F.col("revision"), F.col("ordinal").alias("o")), ["recording_id", "revision"]).where(F.col("o") > F.col("ordinal"))
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("o"))
    page = ahead.withColumn("n", place).where(F.col("n") <= limit).groupBy("recording_id").agg(F.count(F.lit(1)).alias("segments"), F.max("o").alias("next_ordinal"))
    rows = met.join(page, "recording_id", "left")
    status = (
        F.when(F.col("now").isNull(), "unknown").when(F.col("revision") != F.col("now"), "stale").when(F.coalesce("next_ordinal", "ordinal") < F.col("end"), "more")
        .when(F.col("sealed"), "sealed").otherwise("waiting")
    )
    return rows.select("recording_id", status.alias("status"), F.coalesce("segments", F.lit(0)).cast("long").alias("segments"), F.when(F.col("revision") == F.col("now"), F.coalesce("next_ordinal", "ordinal")).alias("next_ordinal"))


def page_formats(pages: DataFrame, most_bytes: int, most_seconds: int) -> DataFrame:
    """page_id, status, formats: the formats of a page's video (``info``, JSON) that may be fetched.

    One finished, public video within ``most_seconds``; formats come by https, are
    mp4, m4a or webm, have a plain id and a declared size, rounded up, within ``most_bytes``.
    """
    kind = "live_status string, availability string, duration double, entries array<string>, formats array<struct<format_id: string, protocol: string, ext: string, filesize: double>>"
    i = lambda name: F.col(f"i.{name}")
    fits = lambda f: (f["protocol"] == "https") & f["ext"].isin("mp4", "m4a", "webm") & f["format_id"].rlike("^[A-Za-z0-9_-]{1,32}$") & (F.ceil(f["filesize"]) <= most_bytes)
    good = F.filter(i("formats"), lambda f: F.coalesce(fits(f), F.lit(False)))
    status = (
        F.when(F.col("i").isNull() | i("formats").isNull(), "unreadable").when(i("entries").isNotNull(), "not_one_video").when(F.coalesce(i("live_status"), F.lit("not_live")).isin("is_live", "is_upcoming"), "not_finished")
        .when(F.coalesce(i("availability"), F.lit("public")) != "public", "not_public").when(F.coalesce(i("duration") > most_seconds, F.lit(True)), "too_long").when(F.size(good) == 0, "no_format").otherwise("selected")
    )
    rows = pages.withColumn("i", F.from_json("info", kind)).withColumn("status", status)
    return rows.select("page_id", "status", F.when(F.col("status") == "selected", F.array_join(F.transform(good, lambda f: f["format_id"]), ",")).alias("formats"))
