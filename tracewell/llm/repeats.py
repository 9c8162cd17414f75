"""Exact removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with
a smaller id. Windows of that length are gathered in *runs*: neighbouring windows
whose least 8-byte gram, by a hash, is the same one. Equal windows have equal
grams at equal places, so the grams, the anchors, say which shard a window goes
to, and only suffixes at anchors are sorted: about one in twenty.

A shard takes its runs in batches. A batch is sorted by the bytes from the anchor
on, then by those before it (its suffix array), scanned against itself and merged
with each level of the shard's index in turn. In merged order the longest match
of a suffix is with a neighbour, which bounds how far a run can agree with others
to the right, and in the order of the bytes before the anchor to the left; only
windows within both bounds are compared, byte for byte. The batch becomes a level,
and two levels of one rank are merged to one of the next. Runs that a smaller
document has in full leave the index, so it holds each content once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written
from tracewell.llm.shingles import mixed

LENGTH, GRAM = 50, 8
#: Starts of grams in a window; a run has at most as many windows.
PLACES = LENGTH - GRAM + 1
BEFORE = PLACES - 1
#: Bytes of text whose runs are found at once, and whose runs are sorted, freed of copies and packed as a lot.
CHUNK, LOT = 1_000_000, 24_000_000
#: Bytes of text for each shard, which has about a twentieth as many runs, and for each bucket of documents.
SHARD_BYTES, BUCKET_BYTES = 3_500_000, 4_000_000
BATCH_RUNS = 16_384
#: Repeated keys that are sent to every task (8 bytes each), and the parts that a key's rows are joined in otherwise.
FEW, PARTS = 100_000, 16
#: Of zstd.
LEVEL = 3
_A = np.uint64(0x9E3779B97F4A7C15)


def lex_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers, column after column where ties are left; which rows in that order differ from the one before."""
    order = np.argsort(rows[:, 0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    first = rows[order, 0]
    new[1:] = first[1:] != first[:-1]
    for j in range(1, rows.shape[1]):
        group = np.cumsum(new) - 1
        at = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(order) else group
        if not len(at):
            break
        g, o = group[at], order[at]
        o = o[np.lexsort((rows[o, j], g))]
        order[at] = o
        v = rows[o, j]
        new[at[1:]] |= (g[1:] == g[:-1]) & (v[1:] != v[:-1])
    return order, new


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows of big-endian words have in common."""
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    for j in range(a.shape[1]):
        x = a[left, j] ^ b[left, j]
        out[left] += sum(((x >> np.uint64(s)) == 0).astype(np.int64) for s in range(56, -1, -8))
        left = left[x == 0]
        if not len(left):
            break
    return out


def as_words(data: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, filled up with zeros."""
    n, width = data.shape
    full = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    full[:, :width] = data
    return full.view(">u8").astype(np.uint64)


class Runs:
    """Runs as columns: doc and text_hash say whose, start where in it; bytes has BEFORE columns up to the anchor, LENGTH from it on."""

    FIELDS = (("doc", np.int64), ("text_hash", np.uint64), ("start", np.int64), ("left", np.uint8), ("count", np.uint8))

    def __init__(self, data: np.ndarray, **columns: np.ndarray):
        self.bytes = data
        for name, kind in self.FIELDS:
            setattr(self, name, columns[name].astype(kind))

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at: np.ndarray) -> Runs:
        return Runs(self.bytes[at], **{name: getattr(self, name)[at] for name, _ in self.FIELDS})

    @staticmethod
    def inside(left: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which columns of ``bytes`` a run has."""
        columns, left = np.arange(-BEFORE, LENGTH), left.astype(np.int64)[:, None]
        return (columns >= -left) & (columns < count.astype(np.int64)[:, None] - 1 + LENGTH - left)

    def packed(self, whole: bool = True) -> bytes:
        """Compressed: fields byte by byte of all runs, then (``whole``) the bytes that runs have."""
        planes = [getattr(self, name).view(np.uint8).reshape(len(self), -1).T.tobytes() for name, _ in self.FIELDS]
        text = [self.bytes[self.inside(self.left, self.count)].tobytes()] if whole else []
        return zstandard.compress(b"".join([len(self).to_bytes(8, "little"), *planes, *text]), LEVEL)

    @classmethod
    def unpacked(cls, blobs: list[bytes], whole: bool = True) -> Runs:
        parts: dict[str, list[np.ndarray]] = {"bytes": [], **{name: [] for name, _ in cls.FIELDS}}
        for blob in blobs:
            data = zstandard.decompress(blob)
            n, at = int.from_bytes(data[:8], "little"), 8
            for name, kind in cls.FIELDS:
                size = np.dtype(kind).itemsize
                parts[name].append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
                at += n * size
            full = np.zeros((n, BEFORE + LENGTH if whole else 0), dtype=np.uint8)
            if whole:
                full[cls.inside(parts["left"][-1], parts["count"][-1])] = np.frombuffer(data, np.uint8, offset=at)
            parts["bytes"].append(full)
        return cls(np.concatenate(parts.pop("bytes")), **{k: np.concatenate(v) for k, v in parts.items()})


class Lot:
    """Runs gathered in one buffer that is used again for the next lot."""

    def __init__(self):
        self.bytes = np.empty((LOT // 16, BEFORE + LENGTH), dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.size, self.parts = 0, []

    def add(self, runs: Runs, anchors: np.ndarray) -> None:
        end = self.size + len(runs)
        if end > len(self.bytes):
            self.bytes = np.concatenate((self.bytes[: self.size], np.empty((max(len(runs), self.size // 2), BEFORE + LENGTH), dtype=np.uint8)))
        self.bytes[self.size : end] = runs.bytes
        self.size = end
        self.parts.append([getattr(runs, name) for name, _ in Runs.FIELDS] + [anchors])

    def runs(self) -> tuple[Runs, np.ndarray]:
        *columns, anchors = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        return Runs(self.bytes[: self.size], **dict(zip((name for name, _ in Runs.FIELDS), columns, strict=True))), anchors


def runs_of(texts: list[bytes], doc: np.ndarray, text_hash: np.ndarray, base: np.ndarray) -> tuple[Runs, np.ndarray]:
    """The runs of texts (or parts of them, from ``base`` on) and the hash of each run's anchor."""
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(texts) else np.empty(0, np.int64)
    total = int(sizes.sum())
    data = np.frombuffer(b"\0" * BEFORE + b"".join(texts) + b"\0" * 128, dtype=np.uint8)
    text = data[BEFORE:]
    word = np.empty(total + 16, dtype=np.uint64)
    for j in range(8):
        part = np.frombuffer(text[j : j + (total + 16 - j + 7) // 8 * 8].tobytes(), dtype="<u8")
        word[j::8] = part[: len(word[j::8])]
    grams = mixed(word[:total] * _A)
    # the hash above, the place below: the least of a window is its first least gram
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(total, dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    least = np.minimum(least[: max(0, len(least) - (PLACES - width))], least[PLACES - width :])
    windows = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner] if len(owner) else np.empty(0, np.int64)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    anchor, start, owner = anchor[first], at[first], owner[first]
    left = anchor - start
    rows = data[anchor[:, None] + np.arange(BEFORE + LENGTH)]
    rows[~Runs.inside(left, count)] = 0
    return Runs(rows, doc=doc[owner], text_hash=text_hash[owner], start=start - begins[owner] + base[owner], left=left, count=count), grams[anchor]


class Family:
    """A shard's index: levels of runs in suffix order, and which windows of each run are covered (a bit each)."""

    def __init__(self, runs: Runs):
        self.runs = runs
        self.right = as_words(runs.bytes[:, BEFORE:])
        self.left = as_words(runs.bytes[:, BEFORE - 1 :: -1])
        self.key = np.concatenate((self.right, self.left, ((runs.left.astype(np.uint64) << np.uint64(8)) | runs.count)[:, None]), axis=1)
        self.covered = np.zeros(len(runs), dtype=np.uint64)
        self.alive = np.ones(len(runs), dtype=bool)
        self.levels: list[tuple[int, np.ndarray]] = []

    def merged(self, at: np.ndarray) -> np.ndarray:
        """Runs in suffix order, without those that a smaller document has in full: these are covered."""
        if not len(at):
            return at
        order, new = lex_order(self.key[at])
        at = at[order]
        group = np.cumsum(new) - 1
        doc = self.runs.doc[at]
        gone = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[group]
        self.covered[at[gone]] = (np.uint64(1) << self.runs.count[at[gone]].astype(np.uint64)) - np.uint64(1)
        self.alive[at[gone]] = False
        return at[~gone]

    @staticmethod
    def reach(words: np.ndarray, side: np.ndarray | None) -> np.ndarray:
        """Of sorted rows, how many leading bytes each shares with any other one (of the other side, if there are sides)."""
        n = len(words)
        place = np.arange(n)
        if side is None:
            before, after = place - 1, np.where(place + 1 < n, place + 1, -1)
        else:
            last = [np.maximum.accumulate(np.where(side == s, place, -1)) for s in (False, True)]
            following = [np.minimum.accumulate(np.where(side == s, place, n)[::-1])[::-1] for s in (False, True)]
            before, after = np.where(side, last[0], last[1]), np.where(side, following[0], following[1])
            after = np.where(after < n, after, -1)
        out = np.zeros(n, dtype=np.int64)
        for other in (before, after):
            has = np.flatnonzero(other >= 0)
            out[has] = np.maximum(out[has], shared_bytes(words[has], words[other[has]]))
        return out

    def scan(self, at: np.ndarray, side: np.ndarray | None) -> None:
        """Mark the windows of runs (in suffix order) that a smaller document has; with sides, of the two sides against each other."""
        if len(at) < 2:
            return
        left = self.runs.left[at].astype(np.int64)
        right_reach = self.reach(self.right[at], side)
        keep = right_reach >= LENGTH - left
        at, left, right_reach = at[keep], left[keep], right_reach[keep]
        if len(at) < 2:
            return
        order, _ = lex_order(self.left[at])
        left_reach = np.empty(len(at), dtype=np.int64)
        left_reach[order] = self.reach(self.left[at[order]], None if side is None else side[keep][order])
        low = np.maximum(0, left - left_reach)
        high = np.minimum(self.runs.count[at].astype(np.int64) - 1, right_reach - LENGTH + left)
        size = np.maximum(0, high - low + 1)
        owner = np.repeat(np.arange(len(at)), size)
        if not len(owner):
            return
        window = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        words = np.empty((len(owner), -(-LENGTH // 8)), dtype=np.uint64)
        for s in range(0, len(owner), 32_768):  # the places take eight times as much as the bytes
            some = slice(s, s + 32_768)
            columns = (BEFORE - left[owner[some]] + window[some])[:, None] + np.arange(LENGTH)
            words[some] = as_words(self.runs.bytes[at[owner[some]][:, None], columns])
        order, new = lex_order(words)
        run, window = at[owner[order]], window[order]
        doc = self.runs.doc[run]
        found = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        np.bitwise_or.at(self.covered, run[found], np.uint64(1) << window[found].astype(np.uint64))

    def add(self, at: np.ndarray) -> None:
        """A new batch: its suffix array, the scans against itself and every level, and the merges of levels of one rank."""
        batch = self.merged(at)
        self.scan(batch, None)
        fresh = np.zeros(len(self.runs), dtype=bool)
        fresh[batch] = True
        for _, level in self.levels:
            both = self.merged(np.concatenate((level[self.alive[level]], batch[self.alive[batch]])))
            self.scan(both, fresh[both])
        self.levels.append((0, batch[self.alive[batch]]))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (_, b), (rank, a) = self.levels.pop(), self.levels.pop()
            both = np.concatenate((a[self.alive[a]], b[self.alive[b]]))
            self.levels.append((rank + 1, both[lex_order(self.key[both])[0]] if len(both) else both))


SPANS = "bucket int, doc long, text_hash long, start long, end long"


def bucket_of(doc: np.ndarray, text_hash: np.ndarray, buckets: int) -> np.ndarray:
    """Where a document is put together again: by its id and, where rows share it or have none, by its text."""
    doc, text_hash = (np.asarray(x).astype(np.int64).view(np.uint64) for x in (doc, text_hash))
    return (mixed(doc ^ (text_hash * _A)) % np.uint64(buckets)).astype(np.int32)


def spans_of(runs: Runs, covered: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Covered windows as spans of bytes, touching ones of a run as one."""
    some = np.flatnonzero(covered)
    bits = np.zeros((len(some), PLACES + 2), dtype=np.int8)
    bits[:, 1:-1] = (covered[some, None] >> np.arange(PLACES, dtype=np.uint64)) & np.uint64(1)
    step = np.diff(bits, axis=1)
    (row, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
    at = some[row]
    return pa.RecordBatch.from_pydict({"bucket": bucket_of(runs.doc[at], runs.text_hash[at].view(np.int64), buckets), "doc": runs.doc[at], "text_hash": runs.text_hash[at].view(np.int64), "start": runs.start[at] + a, "end": runs.start[at] + b - 1 + LENGTH})


def local_copies(runs: Runs) -> np.ndarray:
    """Which runs a smaller document of the same lot has in full."""
    key = np.empty(len(runs), dtype=np.uint64)
    for at in range(0, len(runs), 65_536):
        words = as_words(runs.bytes[at : at + 65_536])
        some = (runs.left[at : at + 65_536].astype(np.uint64) << np.uint64(8)) | runs.count[at : at + 65_536]
        for j in range(words.shape[1]):
            some = mixed(some * _A + words[:, j])
        key[at : at + 65_536] = some
    order = np.lexsort((runs.doc, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    at = np.flatnonzero(runs.doc[order] > runs.doc[head])
    o, h = order[at], head[at]
    out = np.zeros(len(runs), dtype=bool)
    for at in range(0, len(o), 65_536):
        x, y = o[at : at + 65_536], h[at : at + 65_536]
        out[x] = (runs.bytes[x] == runs.bytes[y]).all(axis=1) & (runs.left[x] == runs.left[y]) & (runs.count[x] == runs.count[y])
    return out


def dealt(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, known, runs): the runs of documents in lots for each shard, in suffix order; ``known`` ones are covered already, so they go without their bytes."""
    chunk: list[tuple[bytes, int, int, int]] = []
    found = Lot()
    held, lot = 0, 0

    def done() -> Iterator[pa.RecordBatch]:
        runs, anchors = found.runs()
        if not len(runs):
            found.clear()
            return
        gone = local_copies(runs)
        shard = (mixed(anchors) % np.uint64(shards)).astype(np.int64)
        out: dict[str, list] = {"shard": [], "known": [], "runs": []}
        suffix = runs.bytes[:, BEFORE : BEFORE + 8].copy().view(">u8").ravel()
        for known in (True, False):
            at = np.flatnonzero(gone == known)
            at = at[np.lexsort((suffix[at], shard[at]))]
            for part in np.split(at, np.flatnonzero(np.diff(shard[at])) + 1) if len(at) else []:
                out["shard"].append(int(shard[part[0]]))
                out["known"].append(known)
                out["runs"].append(runs.take(part).packed(whole=not known))
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["known"], pa.bool_()), pa.array(out["runs"], pa.binary())], names=list(out))
        found.clear()

    def more() -> None:
        found.add(*runs_of([x[0] for x in chunk], *(np.array([x[i] for x in chunk], dtype=np.int64) for i in (1, 2, 3))))
        chunk.clear()

    for batch in batches:
        for doc, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for base in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
                part = data[base : base + CHUNK + LENGTH - 1]
                chunk.append((part, doc, text_hash, base))
                held, lot = held + len(part), lot + len(part)
                if held >= CHUNK:
                    more()
                    held = 0
                if lot >= LOT:
                    if chunk:
                        more()
                    yield from done()
                    held = lot = 0
    if chunk:
        more()
    if found.parts:
        yield from done()


def indexed(lots: pa.Table, buckets: int) -> pa.Table:
    """Covered spans of a shard: its runs go through the index batch by batch."""
    blobs: dict[bool, list[bytes]] = {True: [], False: []}
    for blob, known in zip(lots.column("runs").to_pylist(), lots.column("known").to_pylist(), strict=True):
        blobs[known].append(blob)
    out = []
    for blob in blobs[True]:
        runs = Runs.unpacked([blob], whole=False)
        out.append(spans_of(runs, (np.uint64(1) << runs.count.astype(np.uint64)) - np.uint64(1), buckets))
    if blobs[False]:
        family = Family(Runs.unpacked(blobs[False]))
        for at in range(0, len(family.runs), BATCH_RUNS):
            family.add(np.arange(at, min(at + BATCH_RUNS, len(family.runs))))
        out.append(spans_of(family.runs, family.covered, buckets))
    return pa.Table.from_batches(out)


def repeated_spans(docs: DataFrame, total: int, buckets: int) -> DataFrame:
    """bucket, doc, text_hash, start, end: covered byte spans as they are found. ``docs``: doc, text_hash, text; ``total``: their bytes."""
    shards = max(1, -(-total // SHARD_BYTES))
    lots = docs.where("text IS NOT NULL").mapInArrow(lambda it: dealt(it, shards), "shard int, known boolean, runs binary")
    return lots.groupBy("shard").applyInArrow(lambda t: indexed(t, buckets), SPANS)


def packed_documents(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, rows): documents as compressed Arrow streams, so that a shuffle moves a third of the text."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        bucket = bucket_of(rows.column("doc").to_numpy(), rows.column("text_hash").to_numpy(), buckets)
        order = np.argsort(bucket, kind="stable")
        out: dict[str, list] = {"bucket": [], "rows": []}
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            sink = pa.BufferOutputStream()
            some = rows.take(pa.array(part)).combine_chunks()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as stream:
                stream.write_table(some)
            out["bucket"].append(int(bucket[part[0]]))
            out["rows"].append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["rows"], pa.binary())], names=list(out))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= LOT:
            yield done()
    if held:
        yield done()


LEFT = "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def without(packed: pa.Table, spans: pa.Table) -> pa.Table:
    """A bucket's documents without their spans: key, n_bytes, spans (merged), kept."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, text_hash, start, end in zip(*(spans.column(c).to_pylist() for c in ("doc", "text_hash", "start", "end")), strict=True):
        found.setdefault((doc, text_hash), []).append((start, end))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", kind), ("kept", pa.binary())])
    out = []
    for blob in packed.column("rows").to_pylist():
        rows = pa.ipc.open_stream(blob).read_all()
        n_bytes, merged, kept = [], [], []
        for doc, text_hash, text in zip(*(rows.column(c).to_pylist() for c in ("doc", "text_hash", "text")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            joined: list[list[int]] = []
            for a, b in sorted(found.get((doc, text_hash), ())):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            edges = [0, *(x for s in joined for x in s), len(data)]
            n_bytes.append(len(data))
            merged.append([{"start": a, "end": b} for a, b in joined])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
        out.append(pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], schema=schema))
    return pa.Table.from_batches(out, schema)


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` (key, doc, text) with ``text_hash``, 0 where no other row has the same ``doc``: it needs no room then."""
    again = written(docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("again")), "again")
    some = again.count()
    if some == 0:
        return docs.select("key", "doc", F.lit(0).cast("long").alias("text_hash"), "text")
    # few repeated keys go to every task; many are joined, a key's rows in parts
    met = docs.join(F.broadcast(again), "doc", "left") if some <= FEW else salted_left(docs, again)
    return met.select("key", "doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("text_hash"), "text")


def salted_left(docs: DataFrame, again: DataFrame) -> DataFrame:
    """A left join on ``doc``, each key's rows dealt to ``PARTS`` parts by their text."""
    parts = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return docs.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")).join(parts, ["doc", "part"], "left").drop("part")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans, kept: each document's UTF-8 length, the removed byte spans, and the bytes that are left.

    Passages are judged on the input, not on what is left; a null text is empty.
    Keys are whole numbers; a null key counts as the largest. Rows that share a key
    cover nothing of one another; their texts are told apart by a 64-bit hash.
    Texts of any length are worked on in parts that overlap by a window. Nothing for
    an empty table. Copies within a lot of text are found in the map tasks, so of a
    passage that a third of all documents hold a shard gets one run for each lot.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    docs = told_apart(docs.select("key", F.coalesce("key", F.lit((1 << 63) - 1)).alias("doc"), "text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    spans = repeated_spans(docs.select("doc", "text_hash", "text"), total, buckets)
    packed = docs.mapInArrow(lambda it: packed_documents(it, buckets), "bucket int, rows binary")
    return packed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(without, LEFT).withColumnRenamed("key", key)


#: DuckDB SQL for the digest columns: every window of every document, as hexadecimal text.
ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS p FROM d) x),
    f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
    g AS (SELECT w.doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) + {LENGTH} IS NOT FALSE THEN 1 ELSE 0 END AS new FROM w JOIN f USING (s) WHERE first_id < w.doc_id),
    r AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g) y GROUP BY doc_id, n),
    k AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last_b, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
          FROM (SELECT r.*, d.h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r JOIN d USING (doc_id)) z GROUP BY doc_id)
    SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_b, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
"""
