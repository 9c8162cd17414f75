"""The registered queries of this subpackage, with their parameters, and the SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import grouping, language, mixing, near, negatives, neighbours, packing, periods, preference, repeats, secrets, sharding, topk
from tracewell.llm.common import table, written
from tracewell.llm.vectors import usable

SHARDS = [f"shard-{i:02d}" for i in range(16)]
WEIGHTS, DEFAULT_WEIGHT, BLOCK_ROWS = {"src0": 6, "src1": 4}, 2, 64


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("long"))
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding")).select(F.col("vec_id").alias("id"), weights.alias("weights"))
    return topk.search(rows, rows.where("id % 20 = 0"), 20)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    profiles = language.learn(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", language.identify(F.col("text"), profiles).alias("p")).select("doc_id", "held_out", "p.*")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS, default=DEFAULT_WEIGHT, block_rows=BLOCK_ROWS)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding", zero=False)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.search(written(neighbours.index(rows, 10), "index"), rows.where("id % 100 = 0"), 10)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[secrets.count("secrets", k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed("secrets", base), 256).alias("base_sha256"),
        secrets.listed("secrets").alias("spans"),
    )


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(preference.swapped_endings(table(spark, sf_dir, "conversations")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op11_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pack_documents(table(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periods.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)").cast("long")
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding") & F.col("label").isNotNull()).select(F.col("vec_id").alias("id"), label.alias("label"), weights.alias("weights"))
    return negatives.hard_negatives(rows, rows.where("id % 100 = 0"))


QUERIES = (op1_topk, op2_language, op3_repeats, op4_near, op5_pack, op6_mix, op7_neighbours, op8_secrets, op9_preference, op10_sharding, op11_whole, op12_periods, op13_negatives)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.ORACLE_SQL,
        "op3_repeats": repeats.ORACLE_SQL,
        "op4_near": near.ORACLE_SQL,
        "op6_mix": mixing.oracle_sql("documents", WEIGHTS, default=DEFAULT_WEIGHT, block_rows=BLOCK_ROWS, columns="doc_id, source"),
        "op9_preference": preference.ORACLE_SQL,
        "op10_sharding": sharding.oracle_sql("documents", "doc_id", SHARDS),
        "op13_negatives": negatives.ORACLE_SQL,
    }
