"""Near duplicates: a self join of word-shingle sets by Jaccard similarity.

1. Each text becomes its set of five-word shingles and a MinHash signature; texts
   with one set are one class and go on as one.
2. Classes that agree in a band of the signature are candidates. A bucket is cut
   into blocks and every two blocks of it are a unit of work of bounded size, so a
   bucket of any size is spread over tasks. A pair belongs to the first band in
   which it agrees.
3. In a unit, the signatures of each pair are compared a few values at a time; the
   pair is dropped as soon as, given the matches so far and a uniform prior, its
   probability of reaching the threshold is below the tolerance.
4. The pairs that are left, and no others, are verified on the shingle sets: a
   class goes to the units in which it has such pairs, with its partners packed in
   one value. Links are counted and classes joined to components.
Only stars (a class and the least that it is linked with in a unit) leave a task,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written
from tracewell.llm.components import components, salted_join
from tracewell.llm.shingles import mixed, shingle_sets
from tracewell.llm.texts import portions

#: A pair at the threshold is dropped in one of the 13 steps with probability 1.3e-7.
THRESHOLD, TOLERANCE = 0.8, 1e-8
#: With 26 bands of 4 values a pair at the threshold shares none with probability 1.1e-6.
BANDS, ROWS = 26, 4
#: Values compared at once.
STEP = 8
#: Classes and shingles of a block, about; and pairs compared at once.
BLOCK, BLOCK_SHINGLES, PAIRS = 256, 500_000, 200_000
_FUNCTIONS = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches in n values with which a pair is kept.

    With a uniform prior the posterior of reaching t after m matches of n is
    P(Binomial(n + 1, t) <= m).
    """
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit MinHash values for each set; none may be empty."""
    flat = np.concatenate(sets)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), len(_FUNCTIONS)), dtype=np.uint16)
    for j, f in enumerate(_FUNCTIONS):
        out[:, j] = (mixed(np.minimum.reduceat(flat * f, offsets)) >> np.uint64(48)).astype(np.uint16)
    return out


def set_hash(shingles: np.ndarray, salt: int = 0) -> int:
    """A hash of a whole set."""
    return int(mixed(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash, size, set_a, set_b, signature: a hash of the text, the set's size, two hashes of the whole set, and its signature (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, texts in portioned(whole.column(1)):
                batch = whole.slice(at, len(texts))
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                values = iter([row.tobytes() for row in signatures(full)] if full else [])
                a, b = [set_hash(s) for s in sets], [set_hash(s, 0x5DEECE66D) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([next(values) if len(s) else None for s in sets], pa.binary())],
                    names=["key", "hash", "size", "set_a", "set_b", "signature"],
                )

    kind = dict(df.dtypes)[key]
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`"))).mapInArrow(sign, f"key {kind}, hash long, size long, set_a long, set_b long, signature binary")


def portioned(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column (null: empty) in portions, each with the place of its first."""
    at = 0
    for texts in portions(x.as_py() or "" for x in column):
        yield at, texts
        at += len(texts)


def units(members: DataFrame) -> DataFrame:
    """``members`` of buckets with ``blocks`` blocks, once for each unit they belong to, dealt and sorted by unit.

    A unit is two blocks (lo <= hi), or one with itself. Adds lo, hi and mine, the member's block.
    """
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "blocks")
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def whole_units(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of some whole units each, rows with equal ``by``, with a column ``at``: rows of a unit that a batch cuts off wait for the next."""
    rest: pa.Table | None = None
    ids = lambda t: np.stack([t.column(c).to_numpy() for c in by])

    def done(t: pa.Table) -> pa.Table:
        x = ids(t)
        new = np.concatenate(([False], (x[:, 1:] != x[:, :-1]).any(axis=0)))
        return t.append_column("at", pa.array(np.cumsum(new)))

    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        if not now.num_rows:
            continue
        x = ids(now)
        differs = np.flatnonzero((x != x[:, -1:]).any(axis=0))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield done(now.slice(0, cut))
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield done(rest)


def pairs(unit: np.ndarray, mine: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs to compare: of both blocks, or within the one; some units at a time."""
    first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.append(first, len(unit)))
    left, right, waiting = [], [], 0
    for size in np.unique(sizes):
        if size < 2:
            continue
        a, b = np.triu_indices(size, 1)
        starts = first[sizes == size]
        some = max(1, PAIRS // len(a))
        for at in range(0, len(starts), some):
            s = starts[at : at + some, None]
            i, j = (s + a).ravel(), (s + b).ravel()
            keep = (lo[i] == hi[i]) | (mine[i] != mine[j])
            left.append(i[keep])
            right.append(j[keep])
            waiting += len(left[-1])
            if waiting > PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, waiting = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def first_met(sig: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that agree in none of the bands before the one they meet in."""
    bands = sig.view(np.uint64)
    for k in range(int(band.max(initial=0))):
        keep = (band[i] <= k) | (bands[i, k] != bands[j, k])
        if not keep.all():
            i, j = i[keep], j[keep]
    return i, j


def pruned(sig: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay candidates when signatures are compared step by step."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = small >= threshold * large
    i, j = i[keep], j[keep]
    matches = np.zeros(len(i), dtype=np.int32)
    for at in range(0, sig.shape[1], STEP):
        part = sig[:, at : at + STEP]
        matches += (part[i] == part[j]).sum(axis=1, dtype=np.int32)
        keep = matches >= least_matches(at + part.shape[1], threshold, tolerance)
        if not keep.all():
            i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def stars(n: int, i: np.ndarray, j: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each of n positions the one with the least ``by`` that the pairs connect it with, itself if none."""
    order = np.argsort(by, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    root = np.arange(n)
    a, b = place[i], place[j]
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        np.minimum.at(root, before, root.copy())
        if np.array_equal(root, before):
            break
    return order[root[place]]


def surviving(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """(unit, node, partners): each class that has surviving pairs in a unit, with the classes (8 bytes each) of those in which it comes first."""
    for t in whole_units(batches, ("bucket", "lo", "hi")):
        at, mine, lo, hi, node, sizes, band, unit = (t.column(c).to_numpy() for c in ("at", "mine", "lo", "hi", "node", "size", "band", "unit"))
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint16).reshape(len(at), -1)
        for i, j in pairs(at, mine, lo, hi):
            i, j = pruned(sig, sizes, *first_met(sig, band, i, j), threshold, tolerance)
            if len(i):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                rows = np.unique(np.concatenate((i, j)))
                ends = np.searchsorted(i, rows, side="right")
                offsets = np.concatenate(([0], 8 * ends)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(node[j], dtype="<i8"))])
                yield pa.RecordBatch.from_arrays([pa.array(unit[rows]), pa.array(node[rows]), packed], names=["unit", "node", "partners"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[ids] > 1
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[ids[shared]]
    out = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    columns = int((counts > 1).sum())
    width = max(1, min(columns, 4_000_000 // n))
    for at in range(0, columns, width):
        a, b = np.searchsorted(column, (at, at + width))
        dense = np.zeros((n, width), dtype=np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += dense @ dense.T
    return out


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, weight, shingles): the sets of classes, 8 bytes a shingle."""
    for whole in batches:
        for at, texts in portioned(whole.column("text")):
            batch = whole.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["node", "weight", "shingles"])


def verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, links): each class of a unit, the least of the unit that it is linked with, and the documents that its links in this unit lead to."""
    for t in whole_units(batches, ("unit",)):
        at, node, weight = (t.column(c).to_numpy() for c in ("at", "node", "weight"))
        shingles, partners = t.column("shingles"), t.column("partners")
        bounds = np.append(np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))), len(at))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own, links = node[a:b], np.zeros(b - a, dtype=np.int64)
            sets = [np.frombuffer(shingles[k].as_buffer(), dtype=np.uint64) for k in range(a, b)]
            to = [np.frombuffer(partners[k].as_buffer(), dtype="<i8") for k in range(a, b)]
            order = np.argsort(own, kind="stable")
            i = np.repeat(np.arange(b - a), [len(x) for x in to])
            j = order[np.searchsorted(own[order], np.concatenate(to))]
            sizes = np.array([len(s) for s in sets])
            shared = common(sets)[i, j]
            keep = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
            i, j = i[keep], j[keep]
            np.add.at(links, i, weight[a + j])
            np.add.at(links, j, weight[a + i])
            least = stars(b - a, i, j, own)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[least]), pa.array(links)], names=["a", "b", "links"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """key, class_id, n_links: for each document its class and how many others it is linked with.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles (words: lower case, between ASCII white space) is ``threshold`` or
    more; links are exact, and a link at the threshold is missed with a probability
    of about 1.3e-6 (1.1e-6 share no band, 1.3e-7 are pruned), a closer one with
    less. Classes are what links connect; ``class_id``
    is the least key of the class. A text with fewer than five words is one
    shingle. A null text or one without words has no links and is a class of its
    own. Keys are whole numbers; a row with a null key comes back with nulls.
    Repeated rows count as documents of their own; rows that repeat a key with
    another text share its class. Nothing for an empty table.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    sets = written(signed(docs, "key", "text"), "sets")
    same = ["size", "set_a", "set_b"]
    full = sets.where("size > 0 AND key IS NOT NULL")
    classes = written(full.groupBy(*same).agg(F.min(F.struct("key", "hash")).alias("least"), F.count(F.lit(1)).alias("weight"), F.any_value("signature").alias("signature")).select(*same, F.col("least.key").alias("node"), F.col("least.hash").alias("hash"), "weight", "signature"), "classes")

    bands = F.posexplode(F.array(*[F.substring("signature", 2 * ROWS * j + 1, 2 * ROWS) for j in range(BANDS)]))
    banded = classes.select("node", "size", bands.alias("band", "values")).select("node", "size", "band", F.xxhash64("band", "values").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    shared = shared.select("bucket", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    members = salted_join(banded.drop("size"), shared, "bucket", "node").join(classes.select("node", "size", "signature"), "node")
    dealt = units(members).withColumn("unit", F.xxhash64("bucket", "lo", "hi"))
    kept = written(dealt.mapInArrow(lambda it: surviving(it, threshold, tolerance), "unit long, node long, partners binary"), "survivors")

    # one row for each class with survivors: a text that is in the table many times is taken once
    texts = docs.select(F.col("key").alias("node"), F.xxhash64("text").alias("hash"), "text").groupBy("node", "hash").agg(F.any_value("text").alias("text"))
    some = kept.select("node").distinct().join(classes.select("node", "hash", "weight"), "node").join(texts, ["node", "hash"])
    shingles = written(some.select("node", "weight", "text").mapInArrow(shingled, "node long, weight long, shingles binary"), "shingles")
    rows = kept.join(shingles, "node").repartition("unit").sortWithinPartitions("unit")
    checked = written(rows.mapInArrow(lambda it: verified(it, threshold), "a long, b long, links long"), "links")
    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    final = components(checked.select("a", "b"))

    found = classes.select(*same, "node", "weight").join(links, "node", "left").join(final, "node", "left")
    out = sets.select("key", *same).join(found.where("links > 0 OR weight > 1").select(*same, F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), same, "left")
    return out.select(F.col("key").alias(key), F.when(F.col("key").isNotNull(), F.coalesce("class_id", "key")).alias("class_id"), F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.lit(0)).cast("long")).alias("n_links"))


#: DuckDB SQL for the same result: all shingles, their common pairs, and labels passed along links until nothing changes.
ORACLE_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x09-\\x0d ]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, sha FROM (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS sha FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0) x) y),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sha = b.sha AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
    SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links FROM documents d
"""
