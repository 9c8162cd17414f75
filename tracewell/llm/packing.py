"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut: whole windows off the front, then pieces of at
most ``PIECE`` ids. Pieces are dealt to groups of about ``GROUP_WINDOWS`` windows by
a hash of their place in the table, whatever their ids are, or, where there is an order to keep, one after another. In a group, every piece starts as a partition of ``m`` windows of which one
is filled; the two partitions with the largest imbalances are merged, fullest
window with emptiest, until one is left. Its windows are nearly equal; if one is
above the capacity, ``m`` rises by one and the differencing is done again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import literal_rows, written
from tracewell.llm.words import words_of

CAPACITY, PIECE, GROUP_WINDOWS = 4096, 512, 256
#: Pieces of a group, about, where they are so small that its windows would hold more.
GROUP_PIECES = 100_000
VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Rows that are cut at once.
ROWS = 1_000


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole windows, then even pieces of at most ``piece``."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest, at = n - whole * capacity, whole * capacity
    parts = -(-rest // piece)
    for i in range(parts):
        length = rest * (i + 1) // parts - rest * i // parts
        out.append((at, length))
        at += length
    return out


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, with ``with_ids`` the ids of each piece, and the columns ``carry`` of its document.

    A null text is empty, so its document is the end id alone.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows, start, length, crc, tokens, ids = [], [], [], [], [], []
                for i, found in enumerate(words.encode([t or "" for t in batch.column(1).to_pylist()])):
                    data = memoryview(np.append(found, np.uint32(end_id)).astype("<u4", copy=False))
                    for s, n in cuts(len(data), capacity, piece):
                        part = data[s : s + n]
                        rows.append(i)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        tokens.append(len(data))
                        if with_ids:
                            ids.append(np.asarray(part).astype(np.int32))
                own = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(own)] + [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
                columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [batch.column(2 + i).take(own) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + list(carry))

    kinds = dict(df.dtypes)
    schema = f"key {kinds[key]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(cut, schema)


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window, 0 to m - 1, of each size: Karmarkar-Karp for m windows."""
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    # a partition: sums in falling order, and what fills each window: a leaf (a size) or a join of two, -1 for nothing
    heap, joins = [], []
    for i, size in enumerate(sizes):
        sums, held = np.zeros(m, dtype=np.int64), np.full(m, -1, dtype=np.int64)
        sums[0], held[0] = size, i
        heap.append((-int(size), i, sums, held))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, ha = heapq.heappop(heap)
        _, _, b, hb = heapq.heappop(heap)
        sums, held, other = a + b[::-1], ha.copy(), hb[::-1]
        both = (held >= 0) & (other >= 0)
        held = np.where(held < 0, other, held)
        for at in np.flatnonzero(both):
            joins.append((held[at], other[at]))
            held[at] = n + len(joins) - 1
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tie, sums, held))
        tie += 1
    where = np.full(n + len(joins), -1, dtype=np.int64)
    for window, node in enumerate(heap[0][3]):
        if node >= 0:
            where[node] = window
    for j in range(len(joins) - 1, -1, -1):
        where[list(joins[j])] = where[n + j]
    return where[:n]


def bundled(sizes: np.ndarray) -> np.ndarray:
    """The item each size belongs to: small sizes join into items of about ``PIECE`` ids, others are items of their own."""
    small = sizes < PIECE // 8
    item = np.empty(len(sizes), dtype=np.int64)
    item[small] = np.cumsum(sizes[small]) // PIECE
    item[~small] = np.arange((~small).sum()) + (item[small].max() + 1 if small.any() else 0)
    return np.unique(item, return_inverse=True)[1]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size: as few nearly equal windows as the differencing fits into the capacity.

    Sizes far below a piece go into it in bundles, so a group of very many of them
    takes no more partitions than one of pieces.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    whole = sizes == capacity
    out[whole] = np.arange(whole.sum())
    rest = sizes[~whole]
    item = bundled(rest) if capacity >= 2 * PIECE else np.arange(len(rest))
    items = np.bincount(item, weights=rest).astype(np.int64)
    m = max(1, -(-int(rest.sum()) // capacity))
    while True:
        where = differencing(items, m)
        if len(items) == 0 or np.bincount(where, weights=items).max() <= capacity:
            break
        m += 1
    out[~whole] = where[item] + whole.sum()
    return out


def in_turn(cut: DataFrame, order: tuple[str, ...], group: int) -> DataFrame:
    """``cut`` with ``__group``: pieces in the order of the columns, about ``group`` ids to each group, from 0 on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = before + np.cumsum(batch.column("length").to_numpy())
            starts = np.concatenate(([before], ends[:-1])) if len(ends) else ends
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part)), pa.array(starts, pa.int64())], names=[*batch.schema.names, "__part", "__before"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes)
    by = [*order, "key", "start"]
    # parts hold the order in ranges: ids before a piece are those of the parts before its own and those before it there
    rows = written(cut.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, f"{schema}, __part long, __before long"), "ordered")
    shift, total = [], 0
    for part, ids in sorted(tuple(r) for r in rows.groupBy("__part").agg(F.sum("length")).collect()):
        shift.append({"part": part, "shift": total})
        total += ids
    shifts = literal_rows(cut, shift, "part long, shift long")
    return rows.join(F.broadcast(shifts), F.col("__part") == F.col("part")).withColumn("__group", F.expr(f"(shift + __before) div {group}")).drop("__part", "__before", "part", "shift")


def pack(cut: DataFrame, *, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, order: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (key, start, length and any more) with ``sequence_id long`` and ``offset long``.

    ``cut`` is read twice, so it should be a table. Pieces are dealt by a hash of
    (key, start) and of the row's place in the table: a group has about
    ``group_windows`` windows' ids whatever the input, and neither a document of any
    length nor rows of one id (or none) in any number stay together. With ``order``,
    columns of ``cut``, groups are filled in that order instead, so ``sequence_id``
    follows it from group to group. Every piece comes back once; nothing for an
    empty table.
    """
    schema = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes)

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("key", "ascending"), ("start", "ascending")])
        sizes = rows.column("length").to_numpy()
        sequence = int(rows.column("__group")[0].as_py()) * (1 << 24) + windows(sizes, capacity)
        order = np.argsort(sequence, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate(([True], np.diff(sequence[order]) != 0))
        before = np.empty(len(sizes), dtype=np.int64)
        before[order] = ends - sizes[order] - np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        return rows.drop_columns("__group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(before))

    if order:
        dealt = in_turn(cut, order, capacity * group_windows)
    else:
        total, count = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
        groups = max(1, -(-total // (capacity * group_windows)), -(-count // GROUP_PIECES))
        dealt = cut.withColumn("__group", F.pmod(F.xxhash64("key", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, **options) -> DataFrame:
    """:func:`pack` of the :func:`pieces` of ``df``."""
    return pack(written(pieces(df, key, text, capacity=capacity, **options), "pieces"), capacity=capacity).withColumnRenamed("key", key)
