"""Packing whole documents into few sequences by linear grouping.

Documents longer than a sequence are cut into whole ones and a rest. The *large*
pieces (over some share of a sequence) stand in falling order of length and fall
into ``GROUPS`` groups of equal cardinality; each counts as its group's longest. For
those few sizes the configurations, ways to fill one sequence, are optimised by a
linear program whose columns are generated by a knapsack. A configuration used x
times gives floor(x) sequences, what is left over is packed at once. Real pieces
then take the places of their sizes: a piece's rank in its group says which
sequence it goes to, so nothing runs through the data in order. The small pieces
go, longest first, to the fullest sequence of their bin that they fit into.

The driver holds a histogram of lengths (no more rows than a sequence has ids) and
the configurations, both of which don't grow with the data. Where large begins is
the one of ``SHARES`` that packs the histogram's quantiles best: the fewer small
pieces there are to fill what rounding up has left, the more must be large.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import literal_rows, written
from tracewell.llm.packing import VOCABULARY, pieces

CAPACITY, END_ID, GROUPS = 2048, 0, 64
#: Pieces of up to such a share of a sequence are small; the quantiles of all lengths that the share is chosen by.
SHARES, QUANTILES = (1 / 3, 1 / 5, 1 / 8), 20_000
#: A bin of sequences that small pieces are fitted into: about so many sequences, and pieces, at most.
BIN_WINDOWS, BIN_PIECES = 1_024, 100_000
#: The linear program ends within this share of its optimum, or after so many steps; its configurations hold all pieces at any step.
NEAR, STEPS = 2e-4, 5_000


def groups_of(lengths: list[tuple[int, int]], count: int = GROUPS) -> list[dict[str, int]]:
    """size (the longest), lo, hi (ranks in falling order of length, from lo to hi - 1) of groups of equal cardinality, of (length, how many) of the large pieces."""
    lengths = sorted(lengths, reverse=True)
    n, ends = sum(m for _, m in lengths), np.cumsum([m for _, m in lengths])
    bounds = [(g, n * g // count, n * (g + 1) // count) for g in range(count)]
    return [{"group": g, "size": lengths[int(np.searchsorted(ends, lo, side="right"))][0], "lo": lo, "hi": hi} for g, lo, hi in bounds if lo < hi]


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill one sequence so that they are worth most (a knapsack in which any number of a size may be taken)."""
    most = capacity // int(sizes.min())
    value, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        better, pick = value.copy(), np.full(capacity + 1, -1)
        for i in np.flatnonzero(worth > 0):
            new = value[: capacity + 1 - sizes[i]] + worth[i]
            up = new > better[sizes[i] :] + 1e-12
            better[sizes[i] :][up], pick[sizes[i] :][up] = new[up], i
        picks.append(pick)
        value = better
    out, at = np.zeros(len(sizes), dtype=np.int64), capacity
    for pick in reversed(picks):
        i = pick[at]
        if i >= 0:
            out[i] += 1
            at -= sizes[i]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, float]]:
    """(counts, how many sequences) of the configurations of a least number of sequences that hold ``demand`` pieces of each size.

    The revised simplex method: ``inverse`` is that of the matrix whose columns are
    the configurations in use. Sizes are whole numbers from 1 to ``capacity``.
    """
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1 / (capacity // sizes))
    used = inverse @ demand
    for step in range(STEPS):
        worth = inverse.sum(axis=0)
        new = best_configuration(sizes, worth, capacity)
        if worth @ new <= 1 + NEAR:
            break
        change = inverse @ new
        up = change > 1e-9
        ratio = np.where(up, np.maximum(used, 0) / np.where(up, change, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = new
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / change[out]
            inverse = inverse - np.outer(change, row)
            inverse[out] = row
        used = inverse @ demand
    return [(columns[:, j], float(used[j])) for j in range(n) if used[j] > 1e-9]


def fitted(sizes: list[int], room: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The window of each size (in falling order), best fit first: ``room`` is what the windows have left; new ones follow them. And what is left then."""
    left = sorted((r, i) for i, r in enumerate(room))
    out, windows = [], len(room)
    for size in sizes:
        at = bisect_left(left, (size, -1))
        if at < len(left):
            r, i = left.pop(at)
        else:
            r, i, windows = capacity, windows, windows + 1
        insort(left, (r - size, i))
        out.append(i)
    rest = [0] * windows
    for r, i in left:
        rest[i] = r
    return out, rest


def places(groups: list[dict[str, int]], capacity: int = CAPACITY) -> tuple[list[dict[str, int]], int]:
    """Where the ranks of the large pieces go, and how many windows they take.

    A row is ``group, lo, hi, from_window, windows``: the group's ranks from lo to
    hi - 1 go, one after another, round the ``windows`` windows from that one on.
    """
    if not groups:
        return [], 0
    sizes = np.array(sorted({g["size"] for g in groups}), dtype=np.int64)
    waiting = {int(s): [[g["lo"], g["hi"], g["group"]] for g in groups if g["size"] == s] for s in sizes}
    demand = np.array([sum(hi - lo for lo, hi, _ in waiting[int(s)]) for s in sizes])
    left, plan = demand.copy(), []
    for counts, times in configurations(sizes, demand.astype(float), capacity):
        whole = int(times + 1e-6)
        whole = min([whole, *(left[counts > 0] // counts[counts > 0]).tolist()])
        if whole:
            plan.append((whole, counts))
            left -= whole * counts
    rest = [int(s) for s, n in zip(sizes[::-1], left[::-1], strict=True) for _ in range(n)]
    windows, _ = fitted(rest, [], capacity)
    for held in (Counter(s for s, w in zip(rest, windows, strict=True) if w == x) for x in sorted(set(windows))):
        plan.append((1, np.array([held[int(s)] for s in sizes])))
    out, first = [], 0
    for times, counts in plan:
        for size, count in zip(sizes, counts, strict=True):
            need = times * int(count)
            while need:
                lo, hi, group = waiting[int(size)][0]
                taken = min(need, hi - lo)
                # a part of a size's places starts where the one before it ended
                shift = (times * int(count) - need) % times
                for a, b, to in _round(lo, taken, shift, times):
                    out.append({"group": group, "lo": a, "hi": b, "from_window": first + to, "windows": times - to})
                need -= taken
                if lo + taken < hi:
                    waiting[int(size)][0][0] = lo + taken
                else:
                    waiting[int(size)].pop(0)
        first += times
    return out, first


def _round(lo: int, n: int, shift: int, times: int) -> list[tuple[int, int, int]]:
    """(from, to, window) of ``n`` ranks from ``lo`` on that start at the window ``shift`` of ``times``."""
    if not shift:
        return [(lo, lo + n, 0)]
    head = min(n, times - shift)
    return [(lo, lo + head, shift)] + ([(lo + head, lo + n, 0)] if n > head else [])


def quantiles(lengths: list[tuple[int, int]], count: int = QUANTILES) -> list[tuple[int, int]]:
    """A histogram (falling) of about ``count`` pieces with the same spread of lengths."""
    ends = np.cumsum([n for _, n in lengths])
    scaled = -(-ends * min(count, int(ends[-1])) // int(ends[-1])) if len(ends) else ends
    return [(length, int(n)) for (length, _), n in zip(lengths, np.diff(scaled, prepend=0), strict=True) if n]


def windows_taken(lengths: list[tuple[int, int]], least: float, groups: int, capacity: int) -> int:
    """How many windows a histogram (falling) takes if lengths above ``least`` are large."""
    large, small = [x for x in lengths if x[0] > least], [x for x in lengths if x[0] <= least]
    plan, windows = places(groups_of(large, groups), capacity)
    sizes = np.repeat([length for length, _ in large], [n for _, n in large]).astype(np.int64)
    room = np.full(windows, capacity)
    for step in plan:
        ranks = np.arange(step["lo"], step["hi"])
        np.subtract.at(room, step["from_window"] + (ranks - step["lo"]) % step["windows"], sizes[ranks])
    return len(fitted([length for length, n in small for _ in range(n)], room.tolist(), capacity)[1])


def least_large(lengths: list[tuple[int, int]], groups: int = GROUPS, capacity: int = CAPACITY) -> float:
    """The length above which pieces are large, of a histogram (falling) of lengths below the capacity."""
    some = quantiles(lengths)
    return min((windows_taken(some, capacity * share, groups, capacity), -share, capacity * share) for share in SHARES)[2]


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` as a table with ``__rank``: its place (from 0) in falling order of length, equal lengths in the order of the table's rows.

    Sorted in ranges that also part equal lengths, so that no length's pieces are one task.
    """
    row, mask = F.monotonically_increasing_id(), F.lit((1 << 33) - 1)
    by = [F.desc("length"), F.asc("__row")]
    parts = written(cut.withColumn("__row", row).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.shiftright(row, 33)).withColumn("__place", row.bitwiseAND(mask)), "ranked")
    shifts, total = [], 0
    for part, n in sorted(tuple(r) for r in parts.groupBy("__part").agg(F.count(F.lit(1))).collect()):
        shifts.append({"part": part, "shift": total})
        total += n
    offsets = F.broadcast(literal_rows(cut, shifts, "part long, shift long"))
    return parts.join(offsets, F.col("__part") == F.col("part")).withColumn("__rank", F.col("shift") + F.col("__place")).drop("part", "shift", "__part", "__place", "__row")


def pack_whole(cut: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces (key, start, length and any more) with ``sequence_id long`` and ``offset long``; no piece is cut.

    ``cut`` is a table, read twice. Pieces that fill a sequence stand alone; the
    others are packed as the module says. Bins of about ``BIN_WINDOWS`` sequences
    and at most ``BIN_PIECES`` pieces are dealt by rank, so every bin has its even
    share of every configuration and of every small length, whatever the keys are.
    Every piece comes back once; nothing for an empty table. Columns whose names
    begin with ``__`` are this function's own; ``sequence_id`` and ``offset`` are replaced.
    """
    cut = cut.drop("sequence_id", "offset")
    own = cut.columns
    lengths = sorted(((r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    if any(not 0 < length <= capacity for length, _ in lengths):
        raise ValueError("a piece has from one id to a sequence's")
    whole = sum(n for length, n in lengths if length == capacity)
    rest = [(length, n) for length, n in lengths if length < capacity]
    least = least_large(rest, groups, capacity)
    large = [(length, n) for length, n in rest if length > least]
    n_large = sum(n for _, n in large)
    plan, windows = places([{**g, "lo": g["lo"] + whole, "hi": g["hi"] + whole} for g in groups_of(large, groups)], capacity)
    ids, n = sum(length * m for length, m in rest), sum(m for _, m in rest)
    bins = max(1, -(-windows // BIN_WINDOWS), -(-ids // (capacity * BIN_WINDOWS)), -(-n // BIN_PIECES))

    rank = F.col("__rank")
    rows = ranked(cut)
    alone = rows.where(rank < whole).withColumn("sequence_id", rank).withColumn("offset", F.lit(0).cast("long"))
    steps = literal_rows(cut, plan, "group long, lo long, hi long, from_window long, windows long").select(F.struct("*").alias("__step"))
    in_group = F.expr(f"((__rank - {whole} + 1) * {groups} - 1) div {max(1, n_large)}") == F.col("__step.group")
    placed = rows.where((rank >= whole) & (rank < whole + n_large)).join(F.broadcast(steps), in_group & (F.col("__step.lo") <= rank) & (rank < F.col("__step.hi")))
    placed = placed.withColumn("__window", F.expr("__step.from_window + (__rank - __step.lo) % __step.windows")).drop("__step")
    small = rows.where(rank >= whole + n_large).withColumn("__window", F.lit(-1).cast("long"))
    dealt = placed.unionByName(small).withColumn("__bin", F.pmod(F.when(F.col("__window") >= 0, F.col("__window")).otherwise(rank), F.lit(bins)).cast("int"))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("__rank", "ascending")])
        size, window = rows.column("length").to_numpy(), rows.column("__window").to_numpy().copy()
        at, here = int(rows.column("__bin")[0].as_py()), window >= 0
        window[here] //= bins
        count = int(window[here].max()) + 1 if here.any() else 0
        room = capacity - np.bincount(window[here], weights=size[here], minlength=count).astype(np.int64)
        window[~here] = fitted(size[~here].tolist(), room.tolist(), capacity)[0]
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate(([True], np.diff(window[order]) != 0))
        before = np.empty(len(size), dtype=np.int64)
        before[order] = ends - size[order] - np.maximum.accumulate(np.where(first, ends - size[order], 0))
        return rows.select(own).append_column("sequence_id", pa.array(whole + window * bins + at)).append_column("offset", pa.array(before))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes)
    filled = dealt.groupBy("__bin").applyInArrow(fill, f"{schema}, sequence_id long, offset long")
    return alone.select(*[F.col(f"`{c}`") for c in own], "sequence_id", "offset").unionByName(filled)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset (with ``with_ids`` the ids) of every piece of ``df``.

    A document is its ids and the end id; only longer ones than ``capacity`` are
    cut, into whole sequences and a rest. A null text is empty: the end id alone.
    Rows that share an id, or have none, are documents of their own; other columns
    of ``df`` play no part.
    """
    cut = pieces(df, key, text, vocabulary=vocabulary or public_tokenizers.path(VOCABULARY), end_id=end_id, capacity=capacity, piece=capacity, with_ids=with_ids)
    packed = pack_whole(written(cut, "whole"), capacity=capacity, groups=groups)
    ids = ["ids"] if with_ids else []
    return packed.select(F.col("key").alias(key), F.expr(f"CAST(start div {capacity} AS int)").alias("piece"), "start", "length", "ids_crc32", "doc_tokens", *ids, "sequence_id", "offset")
