"""A corpus pipeline of five stages over ``documents``; each calls one operator and takes what the one before kept.

1. language_id drops documents without a letter and those unlike every learnt language.
2. near_duplicates keeps the document with the least id of each class.
3. secret_scan replaces every secret by a mark and keeps all documents.
4. mixing puts the documents in the order of the mixture; the files hold it in order.
5. packing cuts and packs them into sequences in the order of the mixture; its rows are pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language, mixing, near, packing, secrets
from tracewell.llm.common import written
from tracewell.llm.queries import BLOCK_ROWS, DEFAULT_WEIGHT, WEIGHTS

#: Texts in a learnt language score above 0.4; a text with a lower score than this is like none.
LEAST_SCORE = 0.25
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the rest of the table teaches; null texts go."""
    profiles = language.learn(docs.where(~language.held_out()))
    found = docs.select(*COLUMNS, language.identify(F.col("text"), profiles).alias("p"))
    return found.where((F.col("p.lang_pred") != language.UNKNOWN) & (F.col("p.score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; of rows that share an id and a text, one. Rows without an id are in no class and stay.

    Texts that share an id are documents of their own: all but one go under keys
    from 2 ** 62 on, worked out from a hash, so they give way to other ids.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("h"))
    texts = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    again = written(texts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("h").alias("least")).where("n > 1").select("doc_id", "least"), "again")
    once = rows.join(again, "doc_id").groupBy("doc_id", "h", "least").agg(F.min(F.struct(*COLUMNS[1:])).alias("d"))
    high = F.xxhash64("doc_id", "h").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    apart = once.withColumn("key", F.when(F.col("h") == F.col("least"), F.col("doc_id")).otherwise(high)).select("key", "doc_id", "d.*")
    keyed = rows.join(again, "doc_id", "left_anti").select(F.col("doc_id").alias("key"), *COLUMNS).unionByName(apart)
    gone = near.near_duplicates(keyed, key="key").where("key <> class_id").select("key").distinct()
    return keyed.join(gone, "key", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows where a text has changed."""
    clean = secrets.redacted(docs.select(*COLUMNS, F.col("text").alias("was")))
    return clean.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("was")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixture(docs: DataFrame) -> DataFrame:
    """id, hash, slot, pos: the place in the mixture of each id (null too) and hash of a text, one row for each."""
    mixed = mixing.mix(docs.select("doc_id", "source", F.xxhash64("text").alias("h")), WEIGHTS, default=DEFAULT_WEIGHT, block_rows=BLOCK_ROWS)
    return written(mixed.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash")).agg(F.min(F.struct("slot", "pos")).alias("p")).select("id", "hash", "p.slot", "p.pos"), "order")


def in_place(rows: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """``rows`` (with ``h``, the hash of their text) with the slot and pos of the mixture of ``docs``; a null id is an id of its own."""
    order = mixture(docs)
    return rows.join(order, F.col(key).eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))).drop("id", "hash")


def mixing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: sorted by slot over the files, and in each."""
    placed = in_place(docs.select(*COLUMNS, F.xxhash64("text").alias("h")), "doc_id", docs)
    return placed.repartitionByRange("slot", "pos").sortWithinPartitions("slot", "pos").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences, which follow the mixture from group to group.

    Readers don't keep the order of files, and stages hand on documents' columns
    alone, so the slots are worked out again by the mixing operator.
    """
    cut = written(packing.pieces(docs.withColumn("h", F.xxhash64("text")), carry=("h",)), "pieces")
    packed = packing.pack(in_place(cut, "key", docs), order=("slot", "pos"), group_windows=packing.GROUP_WINDOWS)
    return packed.withColumnRenamed("key", "doc_id").drop("h", "slot", "pos")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing_order),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result a table that the next reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: n-gram profiles, MinHash pruning, tokenizers and differencing aren't SQL: tests hold every stage against brute force.
ORACLE_SQL = None
