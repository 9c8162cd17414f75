"""Hard negatives by inner product, with the pruning by length and coordinates known as LEMP.

Rows are dealt to shards of bounded size. In a shard they stand by falling length
of their vectors, in buckets of ``BUCKET`` rows; a bucket holds, for every coordinate, the
values of the rows' unit vectors in order. For an anchor, scores from a lower to
an upper bound bound the cosine in a bucket, and with it the value that a row's
unit vector may have at each coordinate. The anchor's ``FOCUS`` largest coordinates
give such ranges; the rows in all of them are the candidates, whose scores are
worked out exactly. The lower bound rises to the k-th best score as buckets go by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import written
from tracewell.llm.vectors import blocks, matrix, to_every

#: Rows of a shard and of a bucket, anchors that go through a shard at once, coordinates that candidates are chosen by.
SHARD, BUCKET, ANCHORS, FOCUS = 8_192, 512, 1_024, 4
#: Cosines are doubles: ranges are wider by this much.
SLACK = 1e-9


@dataclass
class Bucket:
    """Rows of like length: their numbers, labels, weights, greatest and least length, and by coordinate the rows in order of their unit vectors' values."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    longest: float
    shortest: float
    order: np.ndarray
    values: np.ndarray


def buckets(ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, size: int = 0) -> list[Bucket]:
    """The buckets of a shard, longest vectors first."""
    length = np.sqrt((weights.astype(np.float64) ** 2).sum(axis=1))
    turn = np.lexsort((ids, -length))
    out = []
    for at in range(0, len(turn), size or BUCKET):
        rows = turn[at : at + (size or BUCKET)]
        unit = weights[rows] / np.maximum(length[rows], 1e-300)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        out.append(Bucket(ids[rows], labels[rows], weights[rows], float(length[rows[0]]), float(length[rows[-1]]), order, np.take_along_axis(unit, order, axis=0)))
    return out


def cosines(low: float, high: float, length: float, bucket: Bucket) -> tuple[float, float] | None:
    """The cosines that scores from ``low`` to ``high`` leave possible in a bucket; None if there is none."""
    if length == 0 or bucket.longest == 0:
        return (-1.0, 1.0) if low <= 0 <= high else None
    # a positive score needs the least cosine in the longest row, a negative one in the shortest
    ends = [length * bucket.longest, length * bucket.shortest]
    least = low / ends[0] if low > 0 else low / ends[1] if ends[1] > 0 else -np.inf
    most = high / ends[0] if high < 0 else high / ends[1] if ends[1] > 0 else np.inf
    if least > 1 + SLACK or most < -1 - SLACK:
        return None
    return max(-1.0, least - SLACK), min(1.0, most + SLACK)


def feasible(bucket: Bucket, unit: np.ndarray, bounds: tuple[float, float], focus: int = FOCUS) -> np.ndarray:
    """The rows (positions in the bucket) whose values at the anchor's focus coordinates allow a cosine in ``bounds``."""
    near, far = np.arccos(bounds[1]), np.arccos(bounds[0])
    found = None
    for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
        own = np.arccos(np.clip(unit[f], -1, 1))
        low = np.cos(min(np.pi, own + far))
        high = 1.0 if near <= own <= far else np.cos(max(near - own, own - far))
        values = bucket.values[:, f]
        lo, hi = np.searchsorted(values, low - SLACK), np.searchsorted(values, high + SLACK, side="right")
        if lo == 0 and hi == len(values):
            continue
        inside = np.zeros(len(values), dtype=bool)
        inside[bucket.order[lo:hi, f]] = True
        found = inside if found is None else found & inside
    return np.arange(len(bucket.ids)) if found is None else np.flatnonzero(found)


def highest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def best_within(anchor: int, weights: np.ndarray, label: object, alike: bool, windows: list[tuple[int, int]], held: list[Bucket], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, greatest score) the ids and scores of the k best rows in it, of the anchor's label or of others (``alike``), without the anchor."""
    best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in windows]
    low = [lo for lo, _ in windows]
    length = float(np.sqrt((weights.astype(np.float64) ** 2).sum()))
    unit = weights / length if length else np.zeros(len(weights))
    for bucket in held:
        open_ = [i for i, (_, hi) in enumerate(windows) if low[i] <= hi]
        if not open_:
            break
        bounds = cosines(min(low[i] for i in open_), max(windows[i][1] for i in open_), length, bucket)
        if bounds is None:
            continue
        at = feasible(bucket, unit, bounds)
        at = at[((bucket.labels[at] == label) == alike) & (bucket.ids[at] != anchor)]
        dims = min(len(weights), bucket.weights.shape[1])
        scores, ids = bucket.weights[at, :dims] @ weights[:dims], bucket.ids[at]
        for i in open_:
            good = (scores >= low[i]) & (scores <= windows[i][1])
            if good.any():
                ids_, scores_ = np.concatenate((best[i][0], ids[good])), np.concatenate((best[i][1], scores[good]))
                top = highest(ids_, scores_, k)
                best[i] = ids_[top], scores_[top]
                if len(top) == k:
                    # a later row of the same score may have a smaller id
                    low[i] = int(scores_[top[-1]])
    return best


def _dealt(anchors: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors in blocks, once for each shard, and rows in shards, once for each block of anchors."""
    n, m = rows.count(), anchors.count()
    left = to_every(blocks(anchors, ANCHORS, "ab", m, "id"), max(1, -(-n // SHARD)), "shard")
    right = to_every(blocks(rows, SHARD, "shard", n, "id"), max(1, -(-m // ANCHORS)), "ab")
    return left, right


def _search(anchors: DataFrame, rows: DataFrame, alike: bool, k: int) -> DataFrame:
    """id, window, other, score: each shard's k best of every window (``windows array<struct<least, most>>``) of each anchor."""

    def find(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[np.ndarray]] = {c: [np.empty(0, np.int64)] for c in ("id", "window", "other", "score")}
        if len(anchors) and len(rows):
            held = buckets(rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["weights"], np.int64))
            for a in anchors.itertuples(index=False):
                windows = [(w["least"], w["most"]) for w in a.windows]
                for i, (ids, scores) in enumerate(best_within(a.id, np.asarray(a.weights, dtype=np.int64), a.label, alike, windows, held, k)):
                    for column, values in zip(out.values(), (np.full(len(ids), a.id), np.full(len(ids), i), ids, scores), strict=True):
                        column.append(values)
        return pd.DataFrame({c: np.concatenate(x) for c, x in out.items()})

    left, right = _dealt(anchors, rows)
    found = left.groupBy("ab", "shard").cogroup(right.groupBy("ab", "shard")).applyInPandas(find, "id long, window int, other long, score long")
    rank = F.row_number().over(Window.partitionBy("id", "window").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Both tables: ``id long, label long, weights array<long>``. An anchor's positives
    are its ``positives`` best other rows of its label by inner product; for each,
    the ``negatives`` best rows of other labels whose score is from
    ``least_percent`` to ``most_percent`` hundredths of the positive's (none if that
    is below 0). Equal scores: the smaller id first. Rows with a null id, label or
    weights take no part; of rows that share an id the one with the least label,
    then the least weights, counts; missing dimensions are zeros; other columns play no
    part. Scores are 64-bit: lengths whose product passes 2 ** 63 are outside. Empty tables give no rows.

    Every block of anchors meets every shard, a task of bounded size, and k rows of
    each are merged; labels deal nothing, so none of them is a hot key.
    """
    rows, anchors = (
        df.select("id", F.struct("label", "weights").alias("r")).where("id IS NOT NULL AND r.label IS NOT NULL AND r.weights IS NOT NULL").groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.label").cast("long").alias("label"), "r.weights")
        for df in (rows, anchors)
    )
    rows, anchors = written(rows, "rows"), written(anchors, "anchors")
    every = F.array(F.struct(F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("most")))
    same = _search(anchors.withColumn("windows", every), rows, True, positives).select("id", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    same = written(same, "positives")
    # at most ``positives`` windows an anchor, in the order of the positives; 100 * score >= least_percent * positive's, in whole numbers
    bounds = F.struct(
        "rank",
        F.expr(f"({least_percent} * positive_score) div 100 + IF(({least_percent} * positive_score) % 100 > 0, 1, 0)").cast("long").alias("least"),
        F.expr(f"({most_percent} * positive_score) div 100 - IF(({most_percent} * positive_score) % 100 < 0, 1, 0)").cast("long").alias("most"),
    )
    windows = same.groupBy("id").agg(F.array_sort(F.collect_list(bounds)).alias("windows"))
    other = _search(anchors.join(windows, "id"), rows, False, negatives).withColumnRenamed("rank", "place")
    pairs = other.join(same, (other["id"] == same["id"]) & (other["window"] + 1 == same["rank"]))
    return pairs.select(other["id"].alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
    WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
               FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
                 CAST(list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""
