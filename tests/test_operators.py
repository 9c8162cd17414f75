"""The engine's own operators: every SQL pair on the smallest tables, and rules by hand."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.functions import clock, text
from tracewell.operators import evaluate, spans, speech, visual
from tracewell.operators.search import search
from tracewell.plans.all_queries import QUERIES, SQL
from tracewell.plans.views import TABLES
from tracewell.sources import records, sidecar
from tracewell.streaming import hooks, jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the corpus tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(df.columns, rows) == plain(columns, want.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_span_algebra_by_points(spark, seed):
    r = random.Random(seed)
    rows = [[("k", s, s + r.randint(0, 6)) for s in (r.randrange(40) for _ in range(n))] for n in (9, 7)]
    a, b = (spark.createDataFrame(x, "k string, start_us long, end_us long") for x in rows)
    pa, pb = ({p for _, s, e in x for p in range(s, e)} for x in rows)
    points = lambda df: {p for x in df.collect() for p in range(x["start_us"], x["end_us"])}
    assert points(spans.merge_spans(a, ["k"])) == pa
    assert points(spans.span_subtract(a, b, ["k"])) == pa - pb
    assert points(spans.span_intersect(a, b, ["k"])) == pa & pb
    assert points(spans.span_union(a, b, ["k"])) == pa | pb
    merged = sorted((x["start_us"], x["end_us"]) for x in spans.merge_spans(a, ["k"]).collect())
    assert all(x[1] < y[0] for x, y in zip(merged, merged[1:], strict=False))
    joined = list(merged)
    while len(joined) > 3:  # the leftmost of the nearest pairs
        i = min(range(len(joined) - 1), key=lambda i: (joined[i + 1][0] - joined[i][1], i))
        joined[i : i + 2] = [(joined[i][0], joined[i + 1][1])]
    assert sorted((x["start_us"], x["end_us"]) for x in spans.join_nearest(a, ["k"], 3).collect()) == joined
    pairs = spans.overlap_join(a.withColumn("i", F.monotonically_increasing_id()), b.withColumn("j", F.monotonically_increasing_id()), ["k"], 5).collect()
    assert sorted(x["overlap_us"] for x in pairs) == sorted(min(e, f) - max(s, t) for _, s, e in rows[0] for _, t, f in rows[1] if s < f and t < e and s < e and t < f)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [
    ("It's 2,048 MB.", ["it", "s", "2048", "mb"]), ("error E-409", ["error", "e409"]), ("10:32", ["10", "32"]), ("AB-7 31", ["ab7", "31"]), ("1,234,567", ["1234567"]),
    ("twenty five", ["20", "5"]), ("5.50 and 5.00 and .5", ["5.5", "and", "5", "and", "5"]), ("1,2345", ["1", "2345"]), ("Café — naïve", ["café", "naïve"]), ("", []), ("-a- b-", ["a", "b"]),
])
def test_normalised_words(spark, given, want):
    assert one(spark, text.normalise_words(F.lit(given))) == want


@pytest.mark.parametrize(("given", "query", "tier"), [("error code AB-731 found", "ab 731", 1), ("the a b c", "c b", 2), ("abc", "b", None), ("one two", "12", 1), ("5.5 volts", "5.50", 1), ("5x5", "5.5", None)])
def test_search_tiers(spark, given, query, tier):
    rows = spark.createDataFrame([(1, 1, 0, 5, "s", given)], "recording_id long, ordinal long, start_us long, end_us long, speaker string, text string")
    assert [r["tier"] for r in search(rows, query).collect()] == ([tier] if tier else [])


def test_text_rules(spark):
    assert one(spark, text.query_problem(F.lit("a" * 257))) == "too_long" and one(spark, text.query_problem(F.lit("a\tb"))) == "control_character"
    assert one(spark, text.query_problem(F.lit("..."))) == "empty" and one(spark, text.query_problem(F.lit(" ".join("abcdefghijklmnopq")))) == "too_many_terms" and one(spark, text.query_problem(F.lit("fine"))) is None
    assert one(spark, text.render_hidden(F.lit("a\u200bb"))) == "a<U+200B>b" and one(spark, text.sanitize(F.lit("aé\x01é"), 5)) == "aé"
    assert one(spark, text.strip_markup(F.lit(r"{\an8}<i>hi</i> a < b"))) == "hi a < b" and one(spark, text.strip_markup(F.lit("<v Ann>a &amp;lt; b"), True)) == "a &lt; b"
    assert one(spark, text.voice_label(F.lit("<v Ann>x</v> <v Ann>y"))) == "Ann" and one(spark, text.voice_label(F.lit("<v Ann>x <v Bob>y"))) is None
    assert one(spark, text.subrip_text(F.lit("a\n---> b\x02"))) == "a -> b<U+0002>"


@pytest.mark.parametrize(("given", "want"), [
    ("2024-02-29T01:02:03.1234567Z", (1709168523123456, None, None)), ("2024-02-29T01:02:03+01:00", (1709164923000000, 1709168523000000, 3600)), ("2024-02-29T01:02:03-00:00", (1709168523000000, None, None)),
    ("2024-02-29t01:02:03", (None, 1709168523000000, None)), ("2023-02-29T01:02:03Z", None), ("2024-02-29T24:00:00Z", None), ("2024-02-29T01:02:03+15:00", None), ("2024-02-29 01:02:03", None), ("2024-02-29T01:02:03.Z", None),
])
def test_clock_readings(spark, given, want):
    got = one(spark, clock.parse_clock_reading(F.lit(given)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("given", "want"), [("at 9:05 now", (None, 32_700_000_000)), ("23:59:59", (None, 86_399_000_000)), ("24:00", ("no_time", None)), ("1:02 and 3:04", ("several_times", None)), ("v1:02", ("no_time", None)), ("12:345", ("no_time", None)), ("x" * 65, ("too_long", None))])
def test_clock_faces(spark, given, want):
    assert tuple(one(spark, clock.read_clock_face(F.lit(given)))) == want


@pytest.mark.parametrize("time_us", [-70_000, -33_367, -33_366, -1, 0, 1, 33_366, 33_367, 66_733, 10**12])
def test_first_pts_is_the_inverse(spark, time_us):
    micros = lambda p: int(abs(p) * 1001 * 10**6 // 30_000) * (1 if p >= 0 else -1) + 5
    pts = one(spark, clock.first_pts_at_or_after(F.lit(time_us + 5), 1001, 30_000, 5))
    assert micros(pts) >= time_us + 5 > micros(pts - 1)


def test_screen_windows_by_hand(spark):
    still, moved = [10] * 64, [10] * 62 + [20, 20]
    blocks = [still] * 4 + [moved] + [still] + [[i * 9 % 50] * 64 for i in range(5)] + [still] * 3
    samples = spark.createDataFrame([(1, i * 500_000, b) for i, b in enumerate(blocks)], "recording_id int, time_us long, blocks array<int>")
    got = [(r["representative_us"] // 500_000, r["reason"], r["stability"], r["sample_count"]) for r in visual.candidates(samples).orderBy("representative_us").collect()]
    # samples 4 to 11 each differ from the one before: one run of motion that settles at its last sample
    assert got == [(0, "first_frame", "settled", 4), (4, "motion_start", "in_motion", 7), (11, "settled_after_motion", "settled", 3)]
    assert [(r["kind"], r["motion_part"]) for r in visual.plan_screen_changes(visual.candidates(samples)).collect()] == [("motion", "whole")]
    runs = visual.motion_runs(samples).collect()
    assert [(r["start_us"] // 500_000, r["end_us"] // 500_000, r["samples"]) for r in runs] == [(4, 11, 8)]


def test_budget_keeps_the_first_and_the_best(spark):
    samples = spark.createDataFrame([(1, i * 500_000, [(i // 2) % 2 * (10 + i)] * 64) for i in range(120)], "recording_id int, time_us long, blocks array<int>")
    found = visual.candidates(samples).collect()
    assert len(found) <= visual.MAX_CANDIDATES and min(r["representative_us"] for r in found) == 0 and all(r["dropped"] > 0 for r in found)


def test_frames_to_samples(spark):
    pixels = bytes([7] * (128 * 72 - 1) + [199])
    rows = spark.createDataFrame([(1, 0, bytearray(pixels)), (1, 1, bytearray(b"x")), (1, 2, None)], "recording_id long, time_us long, pixels binary")
    blocks = [r["blocks"] for r in visual.frames_to_samples(rows).orderBy("time_us").collect()]
    assert blocks == [[7] * 143 + [10], None, None]


def test_word_edits(spark):
    assert evaluate.aligned("a b c d".split(), "a x c".split()) == (1, 1, 0, 4)
    assert evaluate.aligned([], ["a"]) == (0, 0, 1, 0) and evaluate.aligned(["a"], []) == (0, 1, 0, 1) and evaluate.aligned([], []) == (0, 0, 0, 0)
    hooks.register_functions(spark)
    assert tuple(spark.sql("SELECT word_edits(array('a', 'b'), array('b'))").first()[0]) == (0, 1, 0, 2)


def test_loops(spark):
    rows = spark.createDataFrame([(1, 1, "go on " * 8), (1, 2, "go on " * 7), (1, 3, "a b c d e"), (1, 4, "")], "recording_id long, ordinal long, text string")
    assert [r["loops"] for r in speech.loops(rows).orderBy("ordinal").collect()] == [True, False, False, False]


def test_subrip_and_webvtt(spark, tmp_path):
    (tmp_path / "good.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n\n\n3\n00:01:00,000 --> 00:01:01,000\nEnd\n")
    (tmp_path / "bad.srt").write_text("1\n00:00:01,000 --> 00:00:00,500\nHello\n")
    (tmp_path / "free.srt").write_text("no timing here\n")
    cues, bad = sidecar.read_subrip(spark, f"{tmp_path}/*.srt")
    assert [(r["ordinal"], r["line"], r["start_us"], r["end_us"], r["text"], r["original"]) for r in cues.orderBy("ordinal").collect()] == [(1, 1, 1_000_000, 2_500_000, "Hello\nthere", "<i>Hello</i>\nthere"), (2, 10, 60_000_000, 61_000_000, "End", None)]
    assert {(r["path"].rpartition("/")[2], r["line"], r["problem"]) for r in bad.collect()} == {("bad.srt", 1, "reversed_timing"), ("free.srt", 1, "untimed_text")}
    (tmp_path / "a.vtt").write_text("WEBVTT\nLanguage: en\n\nNOTE x\n\nid\n00:01.000 --> 00:02.000 align:start\n<v Ann>Hi &amp; bye\n")
    cues, bad = sidecar.read_webvtt(spark, f"{tmp_path}/*.vtt")
    assert [(r["start_us"], r["text"], r["speaker"]) for r in cues.collect()] == [(1_000_000, "Hi & bye", "Ann")] and bad.count() == 0
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*").select("path", "content")
    assert {(r["path"].rpartition(".")[2], r["format"]) for r in sidecar.detect_sidecar_format(files).collect()} == {("srt", "subrip"), ("vtt", "webvtt")}


def test_record_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Started\n0.500 -- 1.250 speaker_00\n1.000 -- 1.000 speaker_01\n2.000 -- 3.005 speaker_01 0.9\n")
    (tmp_path / "u.txt").write_text("0.5 -- 1.250 speaker_00\n")
    turns, bad = records.read_turns(spark, f"{tmp_path}/*.txt", end_us=3_000_000)
    assert sorted((r["start_us"], r["end_us"], r["cluster"]) for r in turns.collect()) == [(500_000, 1_250_000, 0), (2_000_000, 3_000_000, 1)] and bad.count() == 1
    (tmp_path / "r.rttm").write_text("SPEAKER f 1 0.50 1.25 <NA> <NA> bob <NA> <NA>\nSPKR-INFO x\n")
    assert [(r["start_us"], r["end_us"], r["speaker"]) for r in records.read_rttm(spark, f"{tmp_path}/r.rttm").collect()] == [(500_000, 1_750_000, "bob")]
    (tmp_path / "w.json").write_text('{"result":{"language":"en"},"transcription":[{"offsets":{"from":10,"to":20},"text":" a","tokens":[{"text":"[_BEG_]","p":0.1},{"text":" a","p":0.5}]}]}')
    segments = records.read_recogniser_json(spark, f"{tmp_path}/w.json")
    assert [(r["start_us"], r["end_us"], r["text"]) for r in segments.collect()] == [(10_000, 20_000, " a")]
    assert [r["confidence_bp"] for r in records.chunk_confidence(segments, ("path",)).collect()] == [5000]
    (tmp_path / "s.jsonl").write_text('{"runner":"x"}\n{"line":{"image":0,"x":1,"y":2,"width":3,"height":4,"text":"hi","confidence":0.87}}\n{"image":{"image":0,"lines":1}}\n{"line":{"image":1,"text":"cut"}}\n')
    lines, open_images = records.read_screen_text_jsonl(spark, f"{tmp_path}/s.jsonl")
    assert [(r["text"], r["confidence_bp"]) for r in lines.collect()] == [("hi", 8700)] and [r["image"] for r in open_images.collect()] == [1]
    (tmp_path / "q.jsonl").write_text('{"operation_id":"a","steps":[]}\nnonsense\n{"steps":[]}\n')
    good, rejected = records.read_request_lines(spark, f"{tmp_path}/q.jsonl")
    assert [r["operation_id"] for r in good.collect()] == ["a"] and sorted(r["line"] for r in rejected.collect()) == [2, 3]
    table = spark.createDataFrame([(i, i * 10, i * 10 + 5) for i in range(20)], "recording_id long, start_us long, end_us long")
    records.write_record_table(table, f"{tmp_path}/table", 4)
    assert records.read_record_table(spark, f"{tmp_path}/table", "recording_id long, start_us long, end_us long, bucket int").drop("bucket").exceptAll(table).count() == 0


def test_provider_failures_are_rows(spark):
    rows = hooks.map_provider(spark.range(4), lambda f: f.assign(y=[1 // int(x - 2) for x in f["id"]]), "id long, y long").collect()
    assert sorted((r["id"] is None, bool(r["failure"])) for r in rows) == [(False, False)] * 3 + [(True, True)]


def stream(spark, tmp_path, df, name, parts=3):
    df.repartition(parts).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def run_to_end(df, tmp_path, name, mode="append"):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    samples = spark.createDataFrame([(1, t * 500_000) for t in range(300)], "recording_id long, time_us long")
    got = run_to_end(jobs.tumbling_index(stream(spark, tmp_path, samples.orderBy("time_us").coalesce(1), "samples", 1)), tmp_path, "windows")
    # the last minute may still grow, so it isn't out
    assert sorted((r["ordinal"], r["samples"]) for r in got) == [(0, 120), (1, 120)]


def test_growing_transcript_only_appends(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = 1_000_000
    said = {0: [(1, 9, "a"), (2, 12, "b"), (2, 12, "b")], 1: [(11, 19, "c"), (13, 14, "within c")], 2: [(21, 29, "d"), (4, 5, "too late")], 4: [(41, 49, "never")]}
    chunks = spark.createDataFrame([(1, i, (i + 1) * 10 * s, [(a * s, b * s, t) for a, b, t in said[i]]) for i in (2, 0, 1, 4)], "recording_id long, idx long, win_end_us long, segments array<struct<start_us: bigint, end_us: bigint, text: string>>")
    got = run_to_end(jobs.growing_transcript(stream(spark, tmp_path, chunks, "chunks", 4)), tmp_path, "grown")
    # chunk 3 never came, so nothing from 25 s on is settled; overlapping segments all come out
    assert [(r["start_us"] // s, r["text"]) for r in got if not r["late"]] == [(1, "a"), (2, "b"), (2, "b"), (11, "c"), (13, "within c"), (21, "d")]
    assert [r["text"] for r in got if r["late"]] == ["too late"]


def test_frame_at_or_after_on_one_recording_of_very_many_rows(spark):
    n = 100_000
    requests = spark.range(n).selectExpr("1L AS recording_id", "id AS request_id", "id * 10 + id % 7 AS at_us")
    frames = spark.range(n).selectExpr("1L AS recording_id", "id * 10 AS time_us")
    for forward, wanted in ((True, "CASE WHEN at_us % 10 = 0 THEN at_us WHEN at_us div 10 < 99999 THEN (at_us div 10 + 1) * 10 END"), (False, "at_us div 10 * 10")):
        found = spans.asof_join(requests, frames, ["recording_id"], "at_us", "time_us", forward=forward)
        assert found.count() == n and found.where(f"NOT time_us <=> {wanted}").count() == 0


def test_queries_meet_segments_however_words_are_cut(spark):
    from tracewell.operators import search

    texts = ["that with", "tha twith", "t hat w ith", "thatwith", "with a that", "thatwit h now", "that", "x that with", "thatwithx", "that  with that with", ""]
    segments = spark.createDataFrame(list(enumerate(texts)), "ordinal int, text string")
    queries = spark.createDataFrame([(1, "that with"), (2, "thatwith"), (3, "w ith"), (4, ""), (5, "t"), (6, "that that"), (7, " ".join("abcdefghijklmnopq"))], "query_id int, query string")
    found = {(r["query_id"], r["ordinal"]): r["tier"] for r in search.queries_by_segments(queries, segments).collect()}

    def tier(query, text):
        terms, words = query.split(), text.split()
        starts = {sum(map(len, words[:i])) for i in range(len(words) + 1)}
        letters, joined = "".join(words), "".join(terms)
        if joined and any(letters[i : i + len(joined)] == joined and i + len(joined) in starts for i in starts):
            return 1
        return 2 if terms and set(terms) <= set(words) else None

    want = {(q, i): tier(t, x) for q, t in ((1, "that with"), (2, "thatwith"), (3, "w ith"), (5, "t"), (6, "that that")) for i, x in enumerate(texts)}
    assert found == {k: v for k, v in want.items() if v}


def test_line_error_by_hand(spark):
    from tracewell.operators import readings

    def best(line, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(line, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    lines = [(1, 0, "total 1204 units"), (1, 1, "of twelve"), (2, 0, ""), (3, 0, "nothing read 77"), (1, 2, "port 8080 open")]
    read = [(1, "totl 1204 unitz 0f twelve port 8090"), (2, "x")]
    got = {(r["frame_id"], r["line_no"]): (r["errors"], r["numbers"], r["numbers_found"], r["numbers_near"]) for r in readings.line_error(spark.createDataFrame(lines, "frame_id int, line_no int, text string"), spark.createDataFrame(read, "frame_id int, text string")).collect()}
    texts = dict(read)
    assert {k: v[0] for k, v in got.items()} == {(f, n): best(t, texts.get(f, "")) for f, n, t in lines}
    assert got[1, 0][1:] == (1, 1, 0) and got[1, 2][1:] == (1, 0, 1) and got[3, 0][1:] == (1, 0, 0)


def test_best_map_shares_the_most_time(spark):
    import itertools

    from tracewell.operators import readings

    r = random.Random(4)
    table = {(k, i, j): r.randint(0, 30) for k in range(12) for i in range(1 + k % 4) for j in range(1 + k % 5)}
    ref, hyp, at = [], [], 0
    for (k, i, j), us in table.items():
        at += 100
        ref.append((k, i, at, at + us))
        hyp.append((k, j, at, at + us))
    found = readings.best_map(spark.createDataFrame(ref, "recording_id int, ref int, start_us long, end_us long"), spark.createDataFrame(hyp, "recording_id int, hyp int, start_us long, end_us long")).collect()
    for k in range(12):
        rows, columns = 1 + k % 4, 1 + k % 5
        wide = range(max(rows, columns))
        best = max(sum(table.get((k, i, j), 0) for i, j in zip(wide, p, strict=True)) for p in itertools.permutations(wide))
        mine = [(x["ref"], x["hyp"]) for x in found if x["recording_id"] == k]
        assert len({a for a, _ in mine}) == len(mine) == len({b for _, b in mine}) and sum(table[k, a, b] for a, b in mine) == best


def test_upserts_leave_the_last_of_each_key(spark, tmp_path):
    events = spark.createDataFrame([(k, n, f"{k}{n}") for k in "ab" for n in range(6)], "key string, sequence long, value string")
    query = jobs.upsert_by_key(stream(spark, tmp_path, events, "events", 3), f"{tmp_path}/out", f"{tmp_path}/cp", ("key",), ("sequence",))
    query.processAllAvailable()
    query.stop()
    assert sorted((r["key"], r["value"]) for r in jobs.upserted(spark, f"{tmp_path}/out", events.schema, ("key",), ("sequence",)).collect()) == [("a", "a5"), ("b", "b5")]


def test_clock_runs_by_hand(spark):
    from tracewell.operators import clocks

    hour = 3_600_000_000
    times = [(0, 10 * hour), (1_500_000, 10 * hour + 1_000_000), (3_000_000, 10 * hour + 3_000_000), (4_000_000, 10 * hour + 64_000_000), (5_000_000, 10 * hour + 65_000_000), (6_000_000, 12 * hour)]
    reads = spark.createDataFrame([(1, t, v, 1_000_000) for t, v in times] + [(2, 0, 24 * hour - 1_000_000, 1_000_000), (2, 1_000_000, 0, 1_000_000)], "recording_id long, time_us long, value_us long, unit_us long")
    runs = clocks.clock_runs(reads)
    assert sorted((r["recording_id"], r["run"], r["reads"]) for r in runs.collect()) == [(1, 0, 3), (1, 1, 2), (1, 2, 1), (2, 0, 2)]  # midnight breaks nothing
    assert [(r["run"], r["kind"]) for r in clocks.clock_jumps(runs).orderBy("run").collect()] == [(1, "gap"), (2, "gap")]
    assert {r["recording_id"]: r["kind"] for r in clocks.clock_kind(reads, runs).collect()} == {1: "time_of_day", 2: "counter"}


def test_lost_segments_close_their_hole(spark):
    from tracewell.operators import seams

    dropped = spark.createDataFrame([(1, 1, 0, 4_000_000), (1, 2, 1_000_000, 9_000_000), (1, 3, 8_900_000, 9_100_000)], "recording_id long, ordinal long, start_us long, end_us long")
    hole = spark.createDataFrame([(1, 0, 9_200_000)], "recording_id long, start_us long, end_us long")
    assert sorted(r["ordinal"] for r in seams.restore_lost(dropped, hole).collect()) == [1, 2]


def test_long_recordings_are_planned_whole_or_refused(spark):
    ranges = spark.createDataFrame([(1, 5, 5 + 8_000_000 * 2_999 + 10_000_000), (2, 0, 10_000_001), (3, 0, 1)], "recording_id long, start_us long, end_us long")
    plan = speech.plan_chunks(ranges, 10_000_000, 2_000_000).collect()
    mine = sorted((r["idx"], r["win_start_us"], r["win_end_us"]) for r in plan if r["recording_id"] == 1)
    assert mine == [(i, 5 + 8_000_000 * i, 5 + 8_000_000 * i + 10_000_000) for i in range(3_000)] and len(plan) == 3_003
    bounded = [tuple(r) for r in speech.plan_chunks(ranges, 10_000_000, 2_000_000, most=2).orderBy("recording_id", "idx").collect()]
    assert bounded == [(1, None, None, None, "too_many_chunks"), (2, 0, 0, 10_000_000, None), (2, 1, 8_000_000, 10_000_001, None), (3, 0, 0, 1, None)]
    assert speech.plan_chunks(ranges, 10_000_000, 2_000_000, most=3_000).count() == 3_003


def candidates_by_hand(samples):
    """{(ordinal, time): (reason, stability, changed, largest)} and the dropped of each window, of one recording's samples."""
    second = 1_000_000

    def figures(a, b):
        steps = [abs(x - y) for x, y in zip(a, b, strict=True)]
        return sum(s >= 4 for s in steps), max(steps)

    changes = lambda f: f[0] >= 2 or f[1] >= 6
    out, dropped = {}, {}
    for w in sorted({t // (60 * second) for t, _ in samples}):
        body = [(t, b) for t, b in samples if t // (60 * second) == w]
        led = [b for (t, b), (n, _) in zip(samples, samples[1:]) if n == body[0][0] and t // (60 * second) == w - 1 and w * 60 * second - t <= second // 2]  # noqa: B905
        blocks = led + [b for _, b in body]
        steps = {i: figures(blocks[i - 1], blocks[i]) for i in range(1, len(blocks))}
        states, anchor = {}, None
        for i in range(len(led), len(blocks)):
            now = steps[i] if i in steps and changes(steps[i]) else figures(blocks[anchor], blocks[i]) if anchor is not None else None
            if anchor is None or (now and changes(now)):
                states[i] = ["visual_change", *now] if now and changes(now) else ["periodic_coverage" if led else "first_frame", None, None]
                anchor = i
        i = len(led)
        while i < len(blocks):
            end = i
            while end < len(blocks) and end in steps and changes(steps[end]):
                end += 1
            if end - i >= 3:
                for j in range(i + 1, end):
                    if j < end - 1 or end == len(blocks):
                        states.pop(j, None)
                states[i][0] = "motion_start"
                if end < len(blocks):
                    states[end - 1][0] = "settled_after_motion"
            i = max(end, i + 1)
        places = sorted(states)
        ends = {p: places[k + 1] if k + 1 < len(places) else None for k, p in enumerate(places)}

        def firm(p):
            if states[p][0] == "motion_start":
                return "in_motion"
            if (ends[p] or len(blocks)) - p > 1:
                return "settled"
            return "transient" if ends[p] else "open_at_window_end"

        cell = lambda i: (body[i - len(led)][0] - w * 60 * second) // (10 * second)  # noqa: B023, E731
        cells = {cell(i) for i in range(len(led), len(blocks))}
        kept = [places[0]]
        for p in sorted(places[1:], key=lambda p: (-(-1 if states[p][1] is None else states[p][1]), -(-1 if states[p][2] is None else states[p][2]), p)):
            if len(kept) + 1 + len(cells - {cell(q) for q in [*kept, p]}) <= 32:
                kept.append(p)
        dropped[w] = len(places) - len(kept)
        for p in kept:
            out[w, body[p - len(led)][0]] = (states[p][0], firm(p), *states[p][1:])
        for c in cells - {cell(p) for p in kept}:
            p = min(i for i in range(len(led), len(blocks)) if cell(i) == c)
            out[w, body[p - len(led)][0]] = ("periodic_coverage", firm(max(q for q in places if q <= p)), None, None)
    return out, dropped


def test_candidates_by_hand(spark):
    r, rows = random.Random(11), {}
    for recording in range(14):
        at, blocks, mode, mine = r.choice([0, 250_000, 70_000]), [r.randint(0, 40) for _ in range(6)], 0, []
        for _ in range(300 if recording == 12 else r.choice([1, 2, 130, 300])):
            mine.append((at, list(blocks)))
            at += 500_000 if recording % 3 == 0 else r.choice([500_000, 500_000, 1_000_000, 700_000, 6_000_000])
            mode = r.choice([0, 1, 2, 3, 4]) if r.random() < 0.1 else mode
            if mode == 1 or (mode == 4 and r.random() < 0.6):
                blocks = [r.randint(0, 40) for _ in blocks]
            elif recording % 5 == 2:  # still and moving in turn, so more states than a window keeps
                if len(mine) % 2:
                    blocks[r.randrange(6)] += r.choice([7, -7, 9])
            elif mode == 2:
                blocks[r.randrange(6)] += r.choice([1, -1, 2, -3])
            elif mode == 3 and r.random() < 0.5:
                blocks[r.randrange(6)] += r.choice([7, -7])
        rows[recording] = mine
    found = visual.candidates(spark.createDataFrame([(k, t, b) for k, mine in rows.items() for t, b in mine], "recording_id int, time_us long, blocks array<int>")).collect()
    some_dropped = False
    for recording, mine in rows.items():
        want, dropped = candidates_by_hand(mine)
        own = [x for x in found if x["recording_id"] == recording]
        assert {(x["ordinal"], x["representative_us"]): (x["reason"], x["stability"], x["changed_blocks"], x["max_block_delta"]) for x in own} == want and len(own) == len(want)
        assert {x["ordinal"]: x["dropped"] for x in own} == dropped
        for w in dropped:
            spans_now = sorted((x["representative_us"], x["span_end_us"]) for x in own if x["ordinal"] == w)
            assert all(a[1] == b[0] for a, b in zip(spans_now, spans_now[1:])) and spans_now[-1][1] == min((w + 1) * 60_000_000, mine[-1][0] + 500_000)  # noqa: B905
            assert sum(x["sample_count"] for x in own if x["ordinal"] == w) == sum(t // 60_000_000 == w for t, _ in mine)
        some_dropped |= any(dropped.values())
    assert some_dropped
    screens = visual.settled_screens(spark.createDataFrame([(1, t * 1_000_000, k) for t, k in ((0, "first_frame"), (3, "visual_change"), (5, "visual_change"), (6, "settled_after_motion"), (10, "visual_change"), (11, "visual_change"), (12, "periodic_coverage"))], "recording_id int, representative_us long, reason string"))
    assert [x["representative_us"] // 1_000_000 for x in screens.orderBy("representative_us").collect()] == [0, 5, 6, 11]


def test_least_distance_to_a_part_by_brute_force():
    import random

    from tracewell.operators.readings import _best_inside

    def table(line, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(line, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(5)
    for _ in range(2_000):
        line, text = ("".join(rng.choice("abcé") for _ in range(rng.randrange(n))) for n in (12, 40))
        assert _best_inside(line, text) == table(line, text), (line, text)
    assert _best_inside("ab" * 200, "") == 400


def test_kinds_of_lost_runs(spark):
    from tracewell.operators import compare

    columns = "recording_id long, ordinal long, start_us long, end_us long, text string"
    reference = [
        (1, 1, 0, 10_000_000, "one two three four"), (1, 2, 20_000_000, 30_000_000, "la la la la la la la la"), (1, 3, 40_000_000, 50_000_000, "five six seven"),
        (2, 1, 0, 10_000_000, "alpha beta gamma delta"), (3, 1, 0, 10_000_000, None), (3, 2, 0, 10_000_000, "..."),
    ]
    subject = [(1, 1, 500_000, 10_500_000, "one two three four"), (1, 3, 40_000_000, 50_000_000, "five six seven"), (2, 1, 0, 10_000_000, "привет мир снова здесь"), (None, 1, 0, 1, "x")]
    a, b = spark.createDataFrame(reference, columns), spark.createDataFrame(subject, columns)
    found = compare.trigram_recall(a, b)
    assert {(r.recording_id, r.word) for r in found.where("found").collect()} == {(1, w) for w in "one two three four five six seven".split()}
    assert {(r.recording_id, r.words, r.kind) for r in compare.lost_runs(found, b).collect()} == {(1, 8, "repetition"), (2, 4, "script")}
    assert compare.lost_runs(compare.trigram_recall(a.where("false"), b), b).count() == 0


def test_control_stretches_and_seam_finding(spark):
    from tracewell.operators import compare

    spans = "recording_id long, start_us long, end_us long"
    s = 1_000_000
    seams = spark.createDataFrame([(1, 30 * s, 32 * s), (1, 60 * s, 62 * s), (3, 5 * s, 90 * s)], spans)
    ranges = spark.createDataFrame([(1, 0, 100 * s), (2, 0, 25 * s), (3, 0, 10 * s)], spans)
    got = sorted((r[0], r[1] // s, r[2] // s) for r in compare.control_stretches(seams, ranges).collect())
    # eight seconds wide; the first stretch after a seam begins whole seconds later, at its end with the margin or just past it
    want, at = [], 0
    while at + 8 <= 100:
        if any(at < b + 3 and at + 8 > a - 3 for a, b in ((30, 32), (60, 62))):
            at += 1
        else:
            want.append((1, at, at + 8))
            at += 8
    assert got == want + [(2, 0, 11), (2, 11, 22)]
    text = " ".join(f"w{i}" for i in range(100))
    reference = spark.createDataFrame([(1, 1, 0, 100 * s, text)], "recording_id long, ordinal long, start_us long, end_us long, text string")
    holes = " ".join(f"w{i}" if not (27 <= i < 35 or 57 <= i < 65) else f"x{i}" for i in range(100))
    subject = reference.withColumn("text", F.lit(holes))
    row = compare.seam_comparison(subject, reference, seams.where("recording_id = 1"), ranges.where("recording_id = 1")).collect()
    assert [(r.seams, r.seam_words, r.seam_found, r.control_words == r.control_found, r.explained, r.longest_loss, r.finding) for r in row] == [(2, 16, 0, True, 0, 8, True)]


def test_frames_of_files_and_regions(spark, tmp_path):
    from tracewell.operators import more
    from tracewell.operators.visual import frames_to_samples
    from tracewell.sources.records import read_frames

    (tmp_path / "7.gray").write_bytes(bytes([10]) * 9216 + bytes([20]) * 9216 + bytes([30]) * 100)
    (tmp_path / "notes.gray").write_bytes(b"x")
    (tmp_path / "8.gray").write_bytes(b"")
    frames = read_frames(spark, str(tmp_path))
    assert sorted((r.recording_id, r.time_us, r.blocks and set(r.blocks)) for r in frames_to_samples(frames).collect()) == [(7, 0, {10}), (7, 500_000, {20}), (7, 1_000_000, None)]
    tiles = [(1, 0, 0, 4), (1, 2, 2, 5), (1, 5, 2, 6), (1, 19, 0, 7), (1, 40, 0, 9), (2, 3, 3, 8)]
    got = more.change_regions(spark.createDataFrame(tiles, "change_id int, tile_x int, tile_y int, changed_pixels int"), 310, 185).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 48, 48, 9), (1, 80, 32, 16, 16, 6), (1, 304, 0, 6, 16, 7), (2, 48, 48, 16, 16, 8)]
