"""Algebra of half-open spans ``[start_us, end_us)`` by key, and joins on time.

A span that is empty or has a null end is dropped. Everything is windows,
aggregates and equi-joins by key, so recordings are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """keys, start_us, end_us: the union of the spans of each key; touching spans join, unless ``strict``."""
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = before.isNull() | (F.col("start_us") >= before if strict else F.col("start_us") > before)
    islands = df.where("start_us < end_us").select(*keys, "start_us", "end_us", apart.cast("int").alias("__new"))
    islands = islands.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("__island")


def span_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, total_us, ranges: length and number of the merged spans."""
    return merge_spans(df, keys).groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"), F.count(F.lit(1)).alias("ranges"))


def sweep(a: DataFrame, b: DataFrame, keys: Sequence[str], wanted: str) -> DataFrame:
    """Spans where a condition on ``a`` and ``b`` (how many spans of each are open) holds, merged.

    One pass over the boundaries of both sides: each is a step up or down, running
    sums say what is open between one boundary and the next.
    """
    def steps(df: DataFrame, name: str) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("step")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("step"))))
        rows = df.where("start_us < end_us").select(*keys, ends.alias("e"))
        return rows.select(*keys, "e.t", *[(F.col("e.step") if name == n else F.lit(0)).alias(n) for n in ("a", "b")])

    edges = steps(a, "a").unionByName(steps(b, "b")).groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = edges.select(*keys, F.col("t").alias("start_us"), F.lead("t").over(order).alias("end_us"), F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    return merge_spans(pieces.where(wanted), keys)


def span_subtract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts of ``a`` that are not in ``b``."""
    return sweep(a, b, keys, "a > 0 AND b = 0")


def span_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts in both."""
    return sweep(a, b, keys, "a > 0 AND b > 0")


def span_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts in either."""
    return merge_spans(a.select(*keys, "start_us", "end_us").unionByName(b.select(*keys, "start_us", "end_us")), keys)


def gaps_within(covered: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``covered`` leaves of ``bounds``."""
    return span_subtract(bounds, covered, keys)


def join_nearest(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Merged spans of each key, the nearest pairs joined (ties: the leftmost first) until at most ``limit`` are left.

    The same as keeping the ``limit - 1`` largest gaps, of equal ones the later.
    """
    order = Window.partitionBy(*keys).orderBy("start_us")
    spans = merge_spans(df, keys).withColumn("__gap", F.col("start_us") - F.lag("end_us").over(order))
    wide = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("__gap"), F.desc("start_us")))
    spans = spans.withColumn("__cut", F.when(F.col("__gap").isNotNull() & (wide < limit), 1).otherwise(0))
    spans = spans.withColumn("__part", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*keys, "__part").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("__part")


def in_range(df: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """Rows whose span intersects ``[from_us, to_us)``."""
    return df.where((F.col("start_us") < to_us) & (F.col("end_us") > from_us))


def points_in_range(df: DataFrame, time: str, from_us: int, to_us: int) -> DataFrame:
    """Rows whose time is in ``[from_us, to_us)``."""
    return df.where((F.col(time) >= from_us) & (F.col(time) < to_us))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_us: int = 10_000_000, parts: int | None = None) -> DataFrame:
    """Pairs of a left and a right span of one key that share more than a point, and ``overlap_us``.

    ``left`` and ``right`` have the keys, start_us, end_us and columns with names of
    their own; the right times come back as r_start_us, r_end_us. Both are cut into
    buckets of time and meet by (key, bucket); a pair counts in the first bucket
    that both are in. ``parts``: so many tasks, for sides whose rows grow with the input.
    """
    dealt = lambda df: df if parts is None else df.repartition(parts, *keys, "__bucket")
    bucketed = lambda df: df.where("start_us < end_us").withColumn("__bucket", F.explode(F.expr(f"sequence(start_us div {bucket_us}, (end_us - 1) div {bucket_us})")))
    a = dealt(bucketed(left))
    b = dealt(bucketed(right)).withColumnsRenamed({"start_us": "r_start_us", "end_us": "r_end_us"})
    pairs = a.join(b, [*keys, "__bucket"]).where((F.col("start_us") < F.col("r_end_us")) & (F.col("r_start_us") < F.col("end_us")))
    pairs = pairs.where(F.col("__bucket") == F.expr(f"greatest(start_us, r_start_us) div {bucket_us}"))
    return pairs.withColumn("overlap_us", F.least("end_us", "r_end_us") - F.greatest("start_us", "r_start_us")).drop("__bucket")


def asof_join(requests: DataFrame, frames: DataFrame, keys: Sequence[str], at: str, time: str, tolerance_us: int | None = None, forward: bool = True) -> DataFrame:
    """Each request with the first frame at or after its time (``forward``), or the last at or before it, within the tolerance.

    ``frames``: the keys and ``time``. A request without such a frame has a null.
    Both sides are put in one order of time and the nearest frame is carried along,
    so no pair is compared.
    """
    own = [c for c in requests.columns if c not in keys]
    asked = requests.select(*keys, F.col(at).alias("__t"), F.struct(*own).alias("__request"), F.lit(None).cast("long").alias("__frame"))
    given = frames.select(*keys, F.col(time).alias("__t")).distinct().withColumn("__frame", F.col("__t"))
    both = asked.unionByName(given, allowMissingColumns=True)
    # the frame is the last one met, going back in time for those at or after; at one time frames come before requests
    by = Window.partitionBy(*keys).orderBy(F.desc("__t") if forward else F.col("__t"), F.col("__request").isNotNull())
    near = F.last("__frame", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__near", near).where("__request IS NOT NULL")
    far = F.abs(F.col("__near") - F.col("__t"))
    hit = F.col("__near") if tolerance_us is None else F.when(far <= tolerance_us, F.col("__near"))
    return found.select(*keys, "__request.*", hit.alias(time))
