"""Rows that share an id or have none, very many languages, clashing names."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, language, mixing, packing, repeats, secrets, sharding


@pytest.mark.parametrize("key", ["11L", "CAST(NULL AS long)"])
def test_every_language_of_one_id_is_learnt(spark, key):
    rows = spark.range(120_000).selectExpr(
        f"{key} AS doc_id",
        "CASE id % 10 WHEN 0 THEN concat('der hund und die katze ', id) WHEN 1 THEN concat('le chat et le chien ', id) WHEN 2 THEN 'el perro y el gato' ELSE concat('the dog and the cat ', id) END AS text",
        "CASE id % 10 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' ELSE 'en' END AS lang",
    )
    profiles = language.learn(rows, documents=500)
    assert profiles.langs == ["de", "en", "es", "fr"]
    assert [profiles.predict(t)[0] for t in ("die katze und der hund", "the cat and the dog", "el gato y el perro", "le chien et le chat")] == ["de", "en", "es", "fr"]


def test_twenty_thousand_languages_are_small():
    n, size = 20_000, 400
    r = np.random.default_rng(1)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    gram = r.integers(97, 122, (n, size)) * (1 << 42) + np.arange(size) * (1 << 21) + r.integers(97, 122, (n, size))
    profiles = language.profiles_of([f"l{i:05d}" for i in range(n)], np.repeat(np.arange(n), size), gram.ravel(), np.tile(np.arange(size), n), size)
    assert sum(x.nbytes for x in (profiles.grams, profiles.begins, profiles.lang, profiles.rank)) < 15 * n * size + (1 << 20)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
    assert profiles.predict("what is it")[0] in profiles.langs


def test_packing_of_very_many_rows_of_one_id(spark):
    # 200,000 equal rows of 500 ids: 24,415 windows' worth
    cut = spark.range(200_000).selectExpr("7L AS key", "0L AS start", "500L AS length", "1L AS ids_crc32", "500L AS doc_tokens", "id AS n")
    packed = common.written(packing.pack(common.written(cut, "cut")), "packed")
    groups = packed.groupBy(F.shiftright("sequence_id", 24).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    least, most, count, total = groups.agg(F.min("n"), F.max("n"), F.count(F.lit(1)), F.sum("n")).first()
    assert (count, total) == (96, 200_000) and most < 1.2 * 200_000 / 96 and least > 0.8 * 200_000 / 96
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("ids"))
    assert full.agg(F.max("ids")).first()[0] <= 4096 and full.count() < 1.03 * 200_000 / 8


def test_packing_of_very_many_tiny_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 10_000)
    cut = spark.range(50_000).selectExpr("CAST(NULL AS long) AS key", "0L AS start", "1L AS length", "1L AS ids_crc32", "1L AS doc_tokens")
    packed = packing.pack(common.written(cut, "cut"))
    most = packed.groupBy(F.shiftright("sequence_id", 24)).count().agg(F.max("count"), F.sum("count")).first()
    assert most[1] == 50_000 and most[0] < 12_000


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "token = abcdefghijkl0 end", 1, 7)], "doc_id long, text string, __secrets int, __slot int")
    (row,) = secrets.redacted(df).collect()
    assert (row["__secrets"], row["__slot"]) == (1, 7) and "abcdefghijkl0" not in row["text"]
    placed = sharding.place(df.withColumn("__key", F.lit(3)).withColumn("__row", F.lit(4)), "doc_id", ["a"], 101).collect()
    assert (placed[0]["__slot"], placed[0]["__key"], placed[0]["__row"], placed[0]["shard"]) == (7, 3, 4, "a")


def test_mixture_of_very_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    table = spark.range(60_000).selectExpr("IF(id % 3 = 0, id, 5L) AS doc_id", "concat('s', id % 2) AS source", "id AS n")
    units = mixing.in_order(mixing.source_units(table, "source", {"s0": 2}, 1))
    rows = mixing.in_parts(table, units, "source", "doc_id", 50)
    assert rows.groupBy("src", "__part").count().agg(F.max("count")).first()[0] <= 150
    mixed = mixing.mix(table, {"s0": 2}, default=1, block_rows=16)
    assert mixed.agg(F.countDistinct("slot", "pos"), F.countDistinct("n")).first() == (60_000, 60_000)
    ranks = mixing.numbered(table, units, "source", "doc_id", 50).groupBy("src").agg(F.countDistinct("rank"), F.max("rank"), F.count(F.lit(1)))
    assert all(r[1] == r[3] == r[2] + 1 for r in ranks.collect())
    ordered = mixing.numbered(table, units, "source", "doc_id", 50).withColumn("md5", F.md5(F.col("doc_id").cast("string"))).where("src = 's0'").orderBy("rank").select("md5").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)


def test_texts_without_an_id_are_put_together_in_all_buckets(spark):
    hashes = np.array([r[0] for r in spark.range(3_000).selectExpr("xxhash64(concat('text ', id))").collect()])
    none = np.full(3_000, (1 << 63) - 1)
    counts = np.bincount(repeats.bucket_of(none, hashes, 8), minlength=8)
    assert counts.min() > 300 and counts.max() < 450
    assert (repeats.bucket_of(none, hashes.view(np.uint64), 8) == repeats.bucket_of(none, hashes, 8)).all()
    docs = spark.range(400).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", "concat(repeat(concat('passage number ', id % 40, ' '), 8), id) AS text")
    left = repeats.remove_repeats(docs)
    assert left.count() == 400 and left.agg(F.sum("n_bytes")).first()[0] == docs.agg(F.sum(F.length("text"))).first()[0]
