"""Streams against their batch forms: out of order, late, and restarted."""

import random

from pyspark.sql import functions as F

from tracewell.operators import visual
from tracewell.streaming import jobs

SAMPLES = "recording_id long, time_us long, blocks array<int>, duration_us long"


def screen(r, n):
    """Samples of a recording: stills, single changes and motion."""
    blocks, out, t = [r.randrange(20) for _ in range(6)], [], r.randrange(400_000)
    while len(out) < n:
        if r.random() < 0.25:
            blocks = [max(0, b + r.randrange(-7, 8)) for b in blocks]
        out.append((t, list(blocks)))
        t += 500_000 if r.random() < 0.98 else r.choice([700_000, 45_000_000, 130_000_000])
    return out


def arrivals(spark, path, parts):
    """A stream of one file for each part, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"{path}/tmp{i}")
        files = list((path / f"tmp{i}").glob("part-*.parquet"))
        (path / "in").mkdir(exist_ok=True)
        yield i, [f.rename(path / "in" / f"{i:03d}-{k}.parquet") for k, f in enumerate(files)]


def test_candidates_of_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(8)
    rows, big = [], 2**53 + 1
    for rec in (1, 2, big):
        found = screen(r, 400)
        length = found[-1][0] + visual.LEAD_US
        rows += [(rec, t, b, length) for t, b in found]
    # in order of time, but each up to three seconds late
    rows.sort(key=lambda x: x[1] + r.randrange(3_000_000))
    parts = [rows[i : i + 300] for i in range(0, len(rows), 300)]
    last = max(x[1] for x in rows)
    closing = [(0, last + 200_000_000, [0] * 6, None)]
    late = [(1, 1_000_000, [99] * 6, None)]

    def run():
        stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.write_candidates(stream, f"{tmp_path}/out", f"{tmp_path}/cp", availableNow=True).awaitTermination(300)

    for i, _ in arrivals(spark, tmp_path, [*parts, closing, late]):
        if i in (1, len(parts), len(parts) + 1):
            run()  # the first time with two files, then again from the checkpoint
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch").where("recording_id <> 0")
    want = visual.candidates(visual.rate_limited(spark.createDataFrame(rows, SAMPLES)).drop("duration_us"))
    assert got.count() == want.count() > 100
    assert got.select(want.columns).exceptAll(want).count() == 0 == want.exceptAll(got.select(want.columns)).count()


def test_rate_limit_of_a_stream(spark, tmp_path):
    rows = [(1, t * 100_000, [t % 3], None) for t in range(100)] + [(1, 30_000_000, [0], None)]
    list(arrivals(spark, tmp_path, [rows[:50][::-1], rows[50:]]))
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.sample_rate_limit(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(200)
    got = sorted(x["time_us"] for x in spark.table("limited").collect())
    want = sorted(x["time_us"] for x in visual.rate_limited(spark.createDataFrame(rows, SAMPLES)).where(F.col("time_us") < 25_000_000).collect())
    assert got == want == [t * 500_000 for t in range(20)]


def test_upserts_merge_on_read(spark, tmp_path):
    r = random.Random(3)
    schema = "key long, sequence long, value string"
    batches = [[(r.choice([None, 2**60, *range(40)]), n * 100 + i, f"{n}-{i}") for i in range(30)] for n in range(9)]
    batches.append([(5, 10_000, "only one key")])

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = jobs.upsert_by_key(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ("key",), ("sequence",), buckets=4, parts=3, availableNow=True)
        query.awaitTermination(300)

    want = {}
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/tmp{n}")
        next((tmp_path / f"tmp{n}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{n:03d}.parquet")
        want |= {k: (s, v) for k, s, v in rows}
        if n in (0, 5, 9):
            run()  # anew from the checkpoint each time
            got = jobs.upserted(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema, ("key",), ("sequence",)).collect()
            assert {x["key"]: (x["sequence"], x["value"]) for x in got} == want and len(got) == len(want)
    folders = jobs.manifest(spark, f"{tmp_path}/out", 9)
    assert all(len(f) <= 3 for f in folders.values()) and sum("merged" in f for x in folders.values() for f in x) >= 2
    # the last batch wrote one bucket, and what no version names is gone
    assert len([p for name in ("batch=9", "merged=9") for p in (tmp_path / f"out/data/{name}").glob("bucket=*")]) == 1
    named = {f for v in (8, 9) for x in jobs.manifest(spark, f"{tmp_path}/out", v).values() for f in x}
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "out/data").glob("*/bucket=*")} == {f.removeprefix("data/") for f in named}
    assert sorted(p.name for p in (tmp_path / "out/manifest").iterdir()) == ["version=8", "version=9"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema = "key long, sequence long, value string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    for cp in ("one", "two"):  # a new checkpoint: batch 0 again over its own results
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.upsert_by_key(stream, f"{tmp_path}/out", f"{tmp_path}/{cp}", ("key",), ("sequence",), availableNow=True).awaitTermination(200)
        assert sorted(tuple(x) for x in jobs.upserted(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema, ("key",), ("sequence",)).collect()) == [(1, 1, "a"), (2, 1, "b")]
        assert len(list((tmp_path / "out/manifest").iterdir())) == 1
