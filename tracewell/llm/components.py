"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written


#: Parts that the rows of one key are joined in.
SALT = 8


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``facts``, a row for each ``key``: the rows of a key are dealt by ``by`` to ``SALT`` parts, each of which gets the key's facts."""
    parts = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(parts, [key, "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges`` (a, b): the least node of its component.

    Large-star and small-star steps in turn, each a minimum by node joined back to
    the edges, until nothing changes; the edges are then stars. No step gathers a
    node's neighbours, and each round is written, so a lost executor costs one round.
    A node's edges are dealt by ``SALT`` parts of it, to each of which its minimum
    goes, so the least node of a large component is no task's alone.
    """
    now = written(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = state(now)
    if not before[0]:
        return now.selectExpr("u AS node", "v AS component")
    while True:
        both = now.union(now.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = salted_join(both.where("v > u"), least, "u", "v").selectExpr("v AS u", "m AS v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, below, "u", "v").selectExpr("explode(array(struct(u AS u, m AS v), struct(v AS u, m AS v))) AS e").selectExpr("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "edges")
        after = state(now)
        if after == before:
            return now.selectExpr("u AS node", "v AS component").union(now.selectExpr("v", "v").distinct())
        before = after
