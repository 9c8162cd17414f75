"""Language identification by rank-order n-gram profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (1 to 3, words
set apart by a blank), in order. A document's own most frequent n-grams are
compared with every profile by the out-of-place distance: the sum of how far each
n-gram's rank is from its rank in the profile, ``PROFILE`` if it isn't in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import written

PROFILE = 400
#: Documents of a language that its profile is learnt from, about: languages with more give an even sample by a hash of id and text.
TRAIN_DOCUMENTS = 4_000
BLANK, BITS = 32, 21
#: Characters whose n-grams are worked out at once, and n-grams that are counted at once.
PART, HELD = 100_000, 1_000_000
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """The code point itself where it is a letter, else a blank."""
    out = np.full(0x110000, BLANK, dtype=np.uint32)
    for at in range(0, len(out), PART):
        some = np.fromiter((chr(c).isalpha() for c in range(at, min(at + PART, len(out)))), dtype=bool)
        out[at : at + PART][some] = at + np.flatnonzero(some)
    return out


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a whole text, a number each, part by part; none if it has no letter."""
    text = text.lower()
    last = np.array([BLANK], dtype=np.int64)
    for at in range(0, len(text) + 1, PART):
        part = text[at : at + PART] if at + PART <= len(text) else text[at:] + " "
        points = letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        blank = points == BLANK
        fresh = points[~(blank & np.concatenate((last[-1:] == BLANK, blank[:-1])))]
        seq = np.concatenate((last, fresh))
        two = (seq[:-1] << BITS) | seq[1:]
        three = (two[:-1] << BITS) | seq[2:]
        yield np.concatenate((fresh[fresh != BLANK], two[len(last) - 1 :], three[seq[1:-1] != BLANK]))
        last = seq[-2:]


def counted(parts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and how often they occur, for about ``HELD`` numbers at a time."""
    held: list[np.ndarray] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= HELD:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties by the n-gram."""
    found = np.empty(0, dtype=np.int64)
    counts = np.empty(0, dtype=np.int64)
    for each, n in counted(grams(text)):
        if not len(found):
            found, counts = each, n
            continue
        found, place = np.unique(np.concatenate((found, each)), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((counts, n)), minlength=len(found)).astype(np.int64)
    return found[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """The profiles' n-grams in order, and for each of them the languages that have it: those of ``grams[i]`` are ``lang[begins[i]:begins[i + 1]]``, its ranks ``rank`` at the same places.

    14 bytes for each n-gram of a profile, whatever the number of languages.
    """

    langs: list[str]
    grams: np.ndarray
    begins: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least distance (ties: the first by name) and 1 - distance / the largest possible one."""
        top = ranked(text, self.size) if text else []
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == top)
        first, count = self.begins[at[own]], self.begins[at[own] + 1] - self.begins[at[own]]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)
        # an n-gram that a profile lacks is ``size`` out of place
        gain = self.size - np.abs(self.rank[place].astype(np.int64) - np.repeat(own, count))
        distance = self.size * len(top) - np.bincount(self.lang[place], weights=gain, minlength=len(self.langs)).astype(np.int64)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(top)))


def profiles_of(langs: list[str], lang: np.ndarray, gram: np.ndarray, rank: np.ndarray, size: int) -> Profiles:
    """Profiles of (place of the language in ``langs``, n-gram, rank from 0), an entry each."""
    order = np.lexsort((lang, gram))
    grams, first = np.unique(gram[order], return_index=True)
    return Profiles(langs, grams, np.append(first, len(gram)).astype(np.int64), lang[order].astype(np.int32), rank[order].astype(np.int16 if size < 1 << 15 else np.int32), size)


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = PROFILE, documents: int = TRAIN_DOCUMENTS) -> Profiles:
    """Profiles of all languages in ``lang``; rows with a null text or language teach nothing.

    A language with more than ``documents`` rows (see ``TRAIN_DOCUMENTS``) gives an
    even sample of about so many, drawn by a hash of id and text, and one row in
    any case; so it doesn't matter whether rows share an id or have none. The
    n-grams are counted in the tasks, a bounded number at a time, and summed by
    Spark; the driver gets ``size`` rows of each language, as Arrow columns.
    """
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit("sample")).alias("h")).dropna(subset=["text", "lang"])
    # a row for each language, as a table of known size, so that the texts aren't shuffled where Spark can broadcast it
    share = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(documents)) / F.count(F.lit(1))).alias("share"), F.min("h").alias("least")), "shares")
    drawn = rows.join(share, "lang")
    even = drawn.where((F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000) & (F.col("h") != F.col("least")))
    always = drawn.where(F.col("h") == F.col("least")).groupBy("lang").agg(F.first("text").alias("text"))
    sample = even.select("lang", "text").unionByName(always)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[int]] = {}
            for i, name in enumerate(batch.column(0).to_pylist()):
                own.setdefault(name, []).append(i)
            for name in sorted(own):
                texts = (batch.column(1)[i].as_py() for i in own[name])
                for each, n in counted(part for t in texts for part in grams(t)):
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(each), "gram": each, "n": n.astype(np.int64)})

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", order).where(F.col("rank") <= size).select("lang", "gram", "rank").toArrow()
    named = top.column("lang").combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    langs = sorted(names)
    place = np.argsort(np.argsort(np.array(names, dtype=object), kind="stable"), kind="stable") if names else np.empty(0, np.int64)
    lang_at = place[named.indices.to_numpy()] if names else place
    return profiles_of(langs, lang_at, top.column("gram").to_numpy(), top.column("rank").to_numpy().astype(np.int64) - 1, size)


def identify(text: Column, profiles: Profiles) -> Column:
    """``struct<lang_pred string, score double>`` of a text column: ``und`` and 0 for null and for texts without a letter."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    return predict(text)


def held_out(key: str = "doc_id") -> Column:
    """True for a third of the rows, by crc32 of the id: these are never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
