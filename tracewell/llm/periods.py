"""Periodic runs of words, found by recompression.

The words of a batch of documents become numbers, one sequence with a number of
its own between documents. Block compression (equal neighbours become one symbol)
and pair compression (a left symbol and a right one become one) in turn shrink it
to a run-length grammar. Two positions' longest common extension climbs that
grammar while their symbols are equal and goes down again where they differ, one
symbol a level at most. A run of period p holds a multiple of p and the same
place one period on, so the pairs (i, i + p) of that grid are the candidates:
their extensions both ways are the run.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.texts import portions

#: A run's least length in words, and in periods.
LEAST, REPEATS = 12, 2
#: Rows whose texts are sorted by length, so that those worked on together have like lengths.
ROWS = 1_000
#: Candidates whose extensions are worked out at once.
AT_ONCE = 500_000
RUN = "struct<start: long, length: long, period: long>"


@dataclass
class Level:
    """Symbols of one level, where each begins in the level below, which one holds each symbol below, and whether blocks (or pairs) were made."""

    symbols: np.ndarray
    first: np.ndarray
    blocks: bool
    parent: np.ndarray


def level_of(symbols: np.ndarray, first: np.ndarray, blocks: bool) -> Level:
    starts = np.zeros(first[-1], dtype=np.int64)
    starts[first[1:-1]] = 1
    return Level(symbols, first, blocks, np.cumsum(starts))


def side(symbols: np.ndarray, seed: int) -> np.ndarray:
    """True for the symbols that are left in a pair, by a hash."""
    x = (symbols.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(bool)


def compress(symbols: np.ndarray, starts: np.ndarray, names: np.ndarray, fresh: int, blocks: bool) -> tuple[Level, int]:
    """The next level: one symbol from each start on; a group of several is named by ``names`` (one for each start, equal for equal groups)."""
    first = np.flatnonzero(starts)
    out = symbols[first]
    many = np.diff(np.append(first, len(symbols))) > 1
    each, which = np.unique(names[many], return_inverse=True)
    out[many] = fresh + which
    return level_of(out, np.append(first, len(symbols)), blocks), fresh + len(each)


def grammar(words: np.ndarray) -> list[Level]:
    """The levels of a sequence, from its own symbols up to one in which no symbol comes twice."""
    levels = [level_of(words.astype(np.int64), np.arange(len(words) + 1), True)]
    fresh = int(words.max()) + 1 if len(words) else 0
    seeds = itertools.count(1)
    while True:
        now = levels[-1].symbols
        if len(np.unique(now)) == len(now):
            return levels
        starts = np.ones(len(now), dtype=bool)
        starts[1:] = now[1:] != now[:-1]
        if not starts.all():
            first = np.flatnonzero(starts)
            size = np.diff(np.append(first, len(now)))
            # a block is named by its symbol and its length; lengths are numbered first, so both fit into 64 bits
            level, fresh = compress(now, starts, now[first] * np.int64(len(now) + 1) + size, fresh, True)
            levels.append(level)
            now = level.symbols
        best, gain = None, 0
        while not gain:
            for seed in itertools.islice(seeds, 4):
                left = side(now, seed)
                merged = left[:-1] & ~left[1:]
                if merged.sum() > gain:
                    best, gain = merged, int(merged.sum())
            if len(now) < 2:
                return levels
        starts = np.ones(len(now), dtype=bool)
        starts[1:] = ~best
        first = np.flatnonzero(starts)
        second = now[np.minimum(first + 1, len(now) - 1)]
        level, fresh = compress(now, starts, now[first] * np.int64(fresh) + second, fresh, False)
        levels.append(level)


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the sequence read backwards."""
    return [level_of(x.symbols[::-1], (x.first[-1] - x.first)[::-1], x.blocks) for x in levels]


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the sequence's suffixes at ``a`` and at ``b`` have in common, pair by pair.

    Every pair must differ before the sequence ends; one whose last symbol is its own does.
    """
    u, v = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    stop = np.full(len(u), len(levels) - 1)
    alive = np.arange(len(u))
    for h in range(len(levels) - 1):
        symbols, up = levels[h].symbols, levels[h + 1]
        x, y = u[alive], v[alive]
        same = symbols[x] == symbols[y]
        stop[alive[~same]] = h
        alive, x, y = alive[same], x[same], y[same]
        if not len(alive):
            break
        parent = up.parent
        start_x, start_y = up.first[parent[x]] == x, up.first[parent[y]] == y
        # inside a symbol of the level above: go on to where both begin one, or differ
        inside = np.flatnonzero(~(start_x & start_y))
        if len(inside):
            p, q = x[inside], y[inside]
            if up.blocks:
                step = np.minimum(up.first[parent[p] + 1] - p, up.first[parent[q] + 1] - q)
            else:
                step = 1
            x[inside], y[inside] = p + step, q + step
            u[alive], v[alive] = x, y
            same = symbols[x] == symbols[y]
            stop[alive[~same]] = h
            alive, x, y = alive[same], x[same], y[same]
        u[alive], v[alive] = parent[x], parent[y]
    for h in range(len(levels) - 1, 0, -1):
        at = np.flatnonzero(stop >= h)
        level, symbols = levels[h], levels[h - 1].symbols
        x, y = level.first[u[at]], level.first[v[at]]
        same = symbols[x] == symbols[y]
        if level.blocks:
            step = np.minimum(level.first[u[at] + 1] - x, level.first[v[at] + 1] - y)
        else:
            step = 1
        u[at], v[at] = x + same * step, y + same * step
    return u - a


class Covered:
    """Runs found so far, by the positions they cover: a candidate inside one whose period divides its own would find it again."""

    def __init__(self, n: int):
        self.run, self.ends, self.periods = np.full(n, -1), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, found: np.ndarray) -> None:
        # a shorter run has next to no candidates of a multiple of its period
        long = found[found[:, 1] - found[:, 0] >= 4 * found[:, 2]]
        long = long[np.argsort(long[:, 1] - long[:, 0], kind="stable")]
        for at, (s, e, p) in enumerate(long.tolist(), len(self.ends)):
            self.run[s:e] = at
        self.ends, self.periods = np.append(self.ends, long[:, 1]), np.append(self.periods, long[:, 2])

    def fresh(self, i: np.ndarray, p: int) -> np.ndarray:
        """The positions that no known run makes needless."""
        if not len(self.ends):
            return i
        run = self.run[i]
        return i[(run < 0) | (i + p >= self.ends[run]) | (p % self.periods[run] != 0)]


def candidates(words: np.ndarray, longest: int, known: Covered, least: int = LEAST, repeats: int = REPEATS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p): grid positions whose words and neighbours allow a run of period p, portion by portion.

    A run of length L repeats L - p words at the distance p, at least ``least - p``
    and at least ``(repeats - 1) * p``: so half as many words from the grid position
    on, or half as many before it, are equal. A portion ends before each power of
    two at the latest, so what is in ``known`` by then spares the multiples of a period.
    """
    held_i, held_p, n = [], [], 0
    for p in range(1, longest // repeats + 1):
        if n and (n >= AT_ONCE or p & (p - 1) == 0):
            yield np.concatenate(held_i), np.concatenate(held_p)
            held_i, held_p, n = [], [], 0
        i = known.fresh(np.flatnonzero(words[: len(words) - p : p] == words[p::p]) * p, p)
        if not len(i):
            continue
        half = min(4, -(-max(least - p, (repeats - 1) * p, 1) // 2))
        after, before = np.ones(len(i), dtype=bool), np.ones(len(i), dtype=bool)
        for k in range(1, half):
            after &= words[np.minimum(i + k, len(words) - 1)] == words[np.minimum(i + k + p, len(words) - 1)]
        for k in range(1, half + 1):
            before &= (i >= k) & (words[np.maximum(i - k, 0)] == words[np.maximum(i - k, 0) + p])
        i = i[after | before]
        if len(i):
            held_i.append(i)
            held_p.append(np.full(len(i), p))
            n += len(i)
    if n:
        yield np.concatenate(held_i), np.concatenate(held_p)


def runs(words: np.ndarray, longest: int, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """start, end, period (a row each, in this order) of every run of a sequence whose first and last symbols are its own; ``longest``: a run's greatest length."""
    levels = back = None
    n, known = len(words), Covered(len(words))
    every = [np.empty((0, 3), dtype=np.int64)]
    for i, p in candidates(words, longest, known, least, repeats):
        if levels is None:
            levels = grammar(words)
            back = mirrored(levels)
        end = i + p + extensions(levels, i, i + p)
        start = i - extensions(back, n - i, n - i - p)
        good = end - start >= np.maximum(least, repeats * p)
        found = one_each(np.stack((start, end, p), axis=1)[good])
        every.append(found)
        known.add(found)
    return one_each(np.concatenate(every))


def one_each(found: np.ndarray) -> np.ndarray:
    """Each stretch once, in order; one found at several multiples of its period has the least as its period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    head = np.ones(len(found), dtype=bool)
    head[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[head]


def of_texts(texts: list[str], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[list[dict], str, int]]:
    """Runs, what is left of the text, and the number of words of each text."""
    split = [t.encode().split() for t in texts]
    number: dict[bytes, int] = {}
    gaps = len(split) + 1
    parts, begins, at = [np.zeros(1, dtype=np.int64)], [], 1
    for j, words in enumerate(split):
        begins.append(at)
        at += len(words) + 1
        parts.append(np.fromiter((number.setdefault(w, gaps + len(number)) for w in words), dtype=np.int64, count=len(words)))
        parts.append(np.array([j + 1]))
    sequence = np.concatenate(parts)
    found = runs(sequence, max(map(len, split), default=0), least, repeats)
    dropped = np.zeros(len(sequence) + 1, dtype=np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 1], -1)
    dropped = np.cumsum(dropped) > 0
    bounds = np.searchsorted(found[:, 0], [*begins, len(sequence)])
    out = []
    for j, words in enumerate(split):
        own = found[bounds[j] : bounds[j + 1]]
        if len(own):
            own = own[np.lexsort((own[:, 2], own[:, 0]))]
            gone = dropped[begins[j] : begins[j] + len(words)]
            left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        else:
            left = b" ".join(words)
        out.append(([{"start": s - begins[j], "length": e - s, "period": p} for s, e, p in own.tolist()], left.decode(), len(words)))
    return out


def periodic_runs(df: DataFrame, text: str = "text", *, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``df`` with ``n_words long``, ``runs array<struct<start, length, period>>`` (by start, then period) and ``collapsed string``.

    Words are what stands between blanks, tabs and line ends (U+0009 to U+000D).
    A run is a stretch of words with least period q, no shorter than ``least``
    words and ``repeats`` (2 or more) periods, which no neighbour extends.
    ``collapsed`` leaves out every word that a run holds after its first period
    and joins the others by one blank. A null text has no words; equal rows give
    equal results; columns of those three names are replaced and others kept.
    Whole texts are worked on, about a million characters of shorter ones at once;
    nothing leaves its task.
    """
    if least < 1 or repeats < 2:
        raise ValueError("a run has at least a word and two periods")
    kept = df.drop("n_words", "runs", "collapsed")
    place = kept.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(place).to_pylist()]
                # texts of like lengths together: the grid goes up to half the longest one
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                found = (x for some in portions(texts[i] for i in order) for x in of_texts(some, least, repeats))
                out: list = [None] * len(texts)
                for i, x in zip(order, found, strict=True):
                    out[i] = x
                new = [pa.array([x[2] for x in out], pa.int64()), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(find, f"{schema}, n_words long, runs array<{RUN}>, collapsed string")


def planted(key: Column, text: Column) -> Column:
    """The text, in a tenth of the documents (by crc32 of the id) made periodic from some word on."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    # the words stand in an array of one, so that the lambda's variable, not their expression, is what each word looks up
    grown = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise("")), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), grown).otherwise(text)
