"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, made from two
hashes of its name. The shards take turns; at its turn a shard claims the first
slot of its permutation that nobody holds. The finished table has ``table_size``
rows whatever the data is, so it is broadcast, and a key is placed by one hash
and one lookup. A shard that goes or comes moves little more than its own keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; about a hundred slots or more for each shard keep the shares within a few per cent.
TABLE_SIZE = 2039


def hash52(value: Column, salt: str) -> Column:
    """52 bits of an md5, so that any SQL engine can recompute it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value)), 1, 13), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``slot int, shard string``: who holds each slot.

    ``shards`` are distinct names, at most ``table_size`` of them; their order doesn't matter.
    """
    if not is_prime(table_size):
        raise ValueError(f"table_size {table_size} is not prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    m, n = table_size, len(shards)
    names = spark.createDataFrame([(s,) for s in shards], "shard string")
    prefs = names.select(
        "shard",
        (hash52(F.col("shard"), "offset:") % m).alias("o"),
        (hash52(F.col("shard"), "skip:") % (m - 1) + 1).alias("k"),
    ).selectExpr("shard", f"transform(sequence(0L, {m - 1}L), j -> cast((o + j * k) % {m} as int)) AS prefs")
    ordered = prefs.agg(F.sort_array(F.collect_list(F.struct("shard", "prefs"))).alias("s"))
    turn = f"""
        aggregate(sequence(0, {m - 1}), array_repeat(-1, {m}), (owner, t) ->
            transform(array(filter(s[t % {n}].prefs, x -> owner[x] = -1)[0]), pick ->
                concat(slice(owner, 1, pick), array(t % {n}), slice(owner, pick + 2, {m}))
            )[0])
    """
    return (
        ordered.selectExpr("s", f"{turn} AS owner")
        .selectExpr("s", "posexplode(owner) AS (slot, i)")
        .selectExpr("slot", "s[i].shard AS shard")
    )


def place(df: DataFrame, key: str, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot int`` and ``shard string`` for the value of ``key``.

    A null key is placed as the empty string. Equal keys share a shard. An empty
    table gives an empty result. ``df`` may have columns of any names but these two.
    The scan isn't shuffled: the table of ``table_size`` rows is broadcast.
    """
    slots = F.broadcast(lookup_table(df.sparkSession, shards, table_size))
    kept = df.drop("slot", "shard")
    at = (hash52(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "key:") % table_size).cast("int")
    # the row in one column, so that none of its names meets ours
    keyed = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__row"), at.alias("__key"))
    return keyed.join(slots, F.col("__key") == F.col("slot"), "left").select("__row.*", "slot", "shard")


def oracle_sql(table_name: str, key: str, shards: Sequence[str], table_size: int = TABLE_SIZE) -> str:
    """DuckDB SQL for :func:`place`: the turns are a recursive query."""
    m, n = table_size, len(shards)
    h = lambda salt, x: f"CAST('0x' || substr(md5('{salt}' || {x}), 1, 13) AS BIGINT)"
    values = ", ".join(f"('{s}')" for s in shards)
    return f"""
        WITH RECURSIVE names(shard) AS (VALUES {values}),
        seeds AS (SELECT shard, {h('offset:', 'shard')} % {m} AS o, {h('skip:', 'shard')} % {m - 1} + 1 AS k FROM names),
        prefs AS (SELECT row_number() OVER (ORDER BY shard) - 1 AS i, shard,
                  list_transform(range(0, {m}), lambda j: (o + j * k) % {m}) AS p FROM seeds),
        turns(t, slot, owner) AS (
            SELECT 0, -1::BIGINT, list_transform(range(0, {m}), lambda x: -1::BIGINT)
            UNION ALL
            SELECT t + 1, pick, list_concat(list_slice(owner, 1, pick), [(t % {n})::BIGINT], list_slice(owner, pick + 2, {m}))
            FROM (SELECT t, owner, list_filter(p, lambda x: owner[x + 1] = -1)[1] AS pick
                  FROM turns JOIN prefs ON i = t % {n} WHERE t < {m}) AS claim
        ),
        slots AS (SELECT slot, shard FROM turns JOIN prefs ON i = (t - 1) % {n} WHERE t > 0)
        SELECT d.{key}, CAST(s.slot AS INTEGER) AS slot, s.shard
        FROM {table_name} d JOIN slots s ON s.slot = {h('key:', f"coalesce(CAST(d.{key} AS VARCHAR), '')")} % {m}
    """
