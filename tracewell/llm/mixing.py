"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

A source with ``units`` of the ``total`` units is a task of that weight. Its k-th
block (from 0) is released at slot ``floor(k * total / units)`` and due by
``ceil((k + 1) * total / units)``; every slot goes to the released block with the
earliest deadline. In every prefix each source then has less than one block more
or less than its share; of equal deadlines the source that sorts first goes first.
The schedule repeats after ``total`` slots, so one period is worked out and each
block finds its slot by arithmetic: no step runs through the data in order.

Unlisted sources have equal weights, so those that sort between two listed ones
are served one after another: the schedule is worked out over such stretches, and
its length depends on the listed weights alone, not on the number of sources.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import literal_rows, written

#: Rows that share a bucket when a source is numbered; a source of any size is spread over its buckets.
BUCKET_ROWS = 1_000
#: A bucket with so many times as many rows holds very many of one key and is split by a hash of the rows.
HOT = 32


def source_units(df: DataFrame, source: str, weights: dict[str, int], default: int) -> DataFrame:
    """``src string, units int`` for every source of ``df`` (null: the empty string)."""
    seen = df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src")).agg(F.count(F.lit(1)).alias("src_rows"))
    units = F.lit(default)
    for name, unit in weights.items():
        units = F.when(F.col("src") == name, unit).otherwise(units)
    return seen.withColumn("units", units.cast("int"))


def in_order(units: DataFrame) -> DataFrame:
    """``units`` with ``at``, the source's place (from 0) in the order of ``src``; sorted in parts, so that no task gets all sources."""
    mask = (1 << 33) - 1
    row = F.monotonically_increasing_id()
    parts = written(units.repartitionByRange("src").sortWithinPartitions("src").withColumn("__p", F.shiftright(row, 33)).withColumn("__i", row.bitwiseAND(F.lit(mask))), "sources")
    sizes = sorted((r["__p"], r["n"]) for r in parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append({"p": p, "start": total})
        total += n
    offsets = literal_rows(units, starts, "p long, start long")
    return parts.join(F.broadcast(offsets), F.col("__p") == F.col("p")).select("src", "src_rows", "units", (F.col("start") + F.col("__i")).alias("at"))


def stretches(n: int, named: list[tuple[int, int]], default: int) -> list[tuple[int, int, int]]:
    """(lo, hi, units): the places lo to hi - 1 of ``n`` sources, of which ``named`` (place, units) stand alone."""
    out, lo = [], 0
    for at, units in [*sorted(named), (n, 0)]:
        if lo < at:
            out.append((lo, at, default))
        if at < n:
            out.append((at, at + 1, units))
        lo = at + 1
    return out


def period(parts: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    """One period as runs: the ``nth`` blocks of the places lo to hi - 1 are served in the slots from ``slot`` on."""
    total = sum((hi - lo) * units for lo, hi, units in parts)
    waiting = sorted((k * total // units, -(-(k + 1) * total // units), lo, hi, k) for lo, hi, units in parts for k in range(units))
    ready, runs, t, at = [], [], 0, 0
    while at < len(waiting) or ready:
        while at < len(waiting) and waiting[at][0] <= t:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        due, lo, hi, k = heapq.heappop(ready)
        # until the next block is released nothing can come before
        served = min(hi - lo, waiting[at][0] - t) if at < len(waiting) else hi - lo
        runs.append({"lo": lo, "hi": lo + served, "nth": k, "slot": t})
        if served < hi - lo:
            heapq.heappush(ready, (due, lo + served, hi, k))
        t += served
    return runs


def in_parts(df: DataFrame, units: DataFrame, source: str, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``src``, ``__md5`` (of the key, of a hash of the row where the key is null), ``__row_md5`` (of that hash) and ``__part``.

    A source's rows are split by leading digits of the md5. Rows of one key stay
    together in that, so a part of ``HOT`` times ``bucket_rows`` rows is split by
    its keys and leading digits of the rows' own md5. In a source, parts and
    rows have one order: by ``__md5``, then ``__row_md5``.
    """
    most = units.agg(F.max("src_rows")).first()[0] or 0
    digits = lambda n: next(d for d in range(64) if n <= bucket_rows * 16**d)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")
    rows = (
        df.withColumn("src", F.coalesce(F.col(source).cast("string"), F.lit("")))
        .withColumn("__row_md5", F.md5(spread))
        .withColumn("__md5", F.coalesce(F.md5(F.col(key).cast("string")), F.col("__row_md5")))
        .withColumn("__part", F.substring("__md5", 1, digits(most)))
    )
    hot = written(rows.groupBy("src", "__part").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT * bucket_rows), "hot")
    largest = hot.agg(F.max("__n")).first()[0]
    if not largest:
        return rows
    deeper = F.concat("__part", F.lit("/"), "__md5", F.lit("/"), F.substring("__row_md5", 1, digits(largest)))
    return rows.join(hot, ["src", "__part"], "left").withColumn("__part", F.when(F.col("__n").isNotNull(), deeper).otherwise(F.col("__part"))).drop("__n")


def numbered(df: DataFrame, units: DataFrame, source: str, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``src``, the columns of ``units`` and ``rank`` (from 0 within the source, in the order of :func:`in_parts`).

    Rows are numbered inside each part and shifted by the rows of the parts before,
    so that no task gets a source, or all rows of a key.
    """
    rows = in_parts(df, units, source, key, bucket_rows)
    # what is known of a source goes by way of its parts: a join on the source alone would give a source's rows to one task
    before = (
        rows.groupBy("src", "__part").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.partitionBy("src").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("src", "__part", F.coalesce("__before", F.lit(0)).alias("__before"))
        .join(units.drop("src_rows"), "src")
    )
    within = F.row_number().over(Window.partitionBy("src", "__part").orderBy("__md5", "__row_md5")) - 1
    return rows.join(before, ["src", "__part"]).withColumn("rank", within + F.col("__before")).drop("__md5", "__row_md5", "__part", "__before")


def mix(df: DataFrame, weights: dict[str, int], *, default: int = 1, source: str = "source", key: str = "doc_id", block_rows: int = 64) -> DataFrame:
    """``df`` with ``slot long`` and ``pos long``: the order of the mixture.

    Blocks are ``block_rows`` rows of one source; ``slot`` is the block's place in
    the schedule and ``pos`` the row's in its block. Reading by (slot, pos) gives
    the mixture. Weights are whole units: ``weights`` by name, ``default`` for
    other sources, of which there may be any number; a null source is the source ``''``. Columns of ``df`` named slot or pos
    are replaced. Every row of ``df`` is in
    the result once: where a source has run out, its later slots are left out and
    the others go on in their proportions. Rows with equal keys are
    numbered by a hash of the row (equal rows in an arbitrary order among
    themselves), rows with a null key by that hash alone. Nothing for an empty table.
    """
    if default < 1 or any(u < 1 for u in weights.values()) or block_rows < 1:
        raise ValueError("units and block_rows are whole numbers from 1")
    clean = df.drop("slot", "pos")
    own = clean.columns
    units = in_order(source_units(clean, source, weights, default))
    n = units.count()
    named = [(r["at"], r["units"]) for r in units.where(F.col("src").isin(*weights)).collect()] if weights else []
    parts = stretches(n, named, default)
    total = sum((hi - lo) * u for lo, hi, u in parts)
    plan = F.broadcast(literal_rows(clean, period(parts), "lo long, hi long, nth long, slot long").withColumnRenamed("slot", "__slot"))
    rows = numbered(clean.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{source}`").alias("__source"), F.col(f"`{key}`").alias("__key")), units, "__source", "__key")
    rows = rows.withColumn("__block", F.expr(f"rank div {block_rows}"))
    placed = rows.join(plan, (F.col("__block") % F.col("units") == F.col("nth")) & (F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
    return placed.select(
        "__row.*",
        F.expr(f"(__block div units) * {total}L + __slot + at - lo").cast("long").alias("slot"),
        (F.col("rank") % block_rows).cast("long").alias("pos"),
    )


def oracle_sql(table_name: str, weights: dict[str, int], *, default: int, block_rows: int, columns: str) -> str:
    """DuckDB SQL for :func:`mix`: the schedule is a recursive query."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"""
        WITH RECURSIVE d AS (SELECT *, coalesce(CAST(source AS VARCHAR), '') AS src FROM {table_name}),
        u AS (SELECT src, row_number() OVER (ORDER BY src) AS i, CASE src {cases} ELSE {default} END AS units FROM (SELECT DISTINCT src FROM d) x),
        tot AS (SELECT sum(units)::BIGINT AS total, count(*) AS n, list(units::BIGINT ORDER BY i) AS us FROM u),
        sched(t, pick, k) AS (
            SELECT 0::BIGINT, 0::BIGINT, list_transform(us, lambda x: 0::BIGINT) FROM tot
            UNION ALL
            SELECT t + 1, pick, list_transform(range(1, n + 1), lambda i: k[i] + CASE WHEN i = pick THEN 1 ELSE 0 END)
            FROM (SELECT t, k, n, list_min(list_transform(
                      list_filter(range(1, n + 1), lambda i: k[i] < us[i] AND (k[i] * total) // us[i] <= t),
                      lambda i: (((k[i] + 1) * total + us[i] - 1) // us[i]) * 100000 + i)) % 100000 AS pick
                  FROM sched, tot WHERE t < total) AS step
        ),
        plan AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sched WHERE t > 0),
        r AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rnk FROM d)
        SELECT {columns}, CAST((rnk // {block_rows}) // units * total + p.slot AS BIGINT) AS slot, CAST(rnk % {block_rows} AS BIGINT) AS pos
        FROM r JOIN u USING (src) JOIN plan p ON p.i = u.i AND p.nth = (rnk // {block_rows}) % units, tot
    """
