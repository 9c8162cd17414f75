"""Rows and plans that small tables don't show: what is broadcast, what one task gets, what differs from SQL in rare texts."""

import random
import re

from tracewell.operators import compare, evaluate, handoff, more, readings, search
from tracewell.operators.speech import word_timeline
from tracewell.plans import bundle_queries, report_queries, text_queries


def _plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def _kept(df, tmp_path, name):
    """The rows as a file, whose size plans go by."""
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_words_of_repeats_are_not_broadcast(spark, tmp_path, capsys):
    words = _kept(spark.createDataFrame([(1, c, i * 200_000, w) for c in (0, 1) for i, w in enumerate("a b c d".split())], "recording_id long, chunk long, at_us long, word string"), tmp_path, "words")
    found = readings.seam_repeats(words)
    assert "BroadcastHashJoin" not in _plan(found, capsys)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 1, 0)]


def test_resume_cards_are_not_broadcast(spark, tmp_path, capsys):
    orders = _kept(spark.range(20).selectExpr("id AS o_orderkey", "id * 397 AS o_custkey", "'P' AS o_orderstatus"), tmp_path, "orders")
    lineitem = _kept(spark.range(40).selectExpr("id % 20 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 3 AS int) AS l_linenumber"), tmp_path, "lineitem")
    found = bundle_queries.jsn3_handoff_rules(orders, lineitem)
    assert "BroadcastHashJoin" not in _plan(found, capsys)
    long = {i for i in range(20) if i * 397 % 3 and 8 * (i * 397 % 400) > 2048}
    assert {r["report_id"] for r in found.where("finding = 'resume_card_too_long'").collect()} == long


def test_since_page_wants_the_word_itself(spark):
    texts = ["that", "that", "th at", "that", "so", "that"]
    segments = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "recording_id long, ordinal long, text string")
    assert [tuple(r) for r in text_queries.sort7_since_page(segments).collect()] == [(1, 4, 5)]


def test_queries_meet_segments_in_any_place(spark):
    texts = ["abc def", "abcdef", "ab c def", "abc de f", "abcdefg", "xabc def", "def abc", "abc defgh ij", "abcdefghij", "abc def ghij", "the abc of def", "abc abc def", "abc def"]
    segments = spark.createDataFrame(list(enumerate(texts)), "ordinal int, text string")
    queries = spark.createDataFrame([(1, "abc def"), (2, "abc defghij"), (3, "abc"), (4, "abc nowhere"), (5, "def abc abc")], "query_id int, query string")
    found = search.queries_by_segments(queries, segments)
    got = sorted((r["query_id"], r["ordinal"], r["tier"]) for r in found.collect())
    want = []
    for q, asked in (r for r in queries.collect()):
        terms = asked.split()
        for i, text in enumerate(texts):
            words = text.split()
            run = any("".join(words[a:b]) == "".join(terms) for a in range(len(words)) for b in range(a + 1, len(words) + 1))
            if run or set(terms) <= set(words):
                want.append((q, i, 1 if run else 2))
    assert got == want
    assert "array_except" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_regions_of_many_changes_at_once(spark):
    r = random.Random(3)
    rows = [(c, x, y, r.randrange(4, 9)) for c in range(150) for x, y in {(r.randrange(22), r.randrange(13)) for _ in range(r.choice([1, 3, 12, 40]))}]
    tiles = spark.createDataFrame(rows, "change_id long, tile_x int, tile_y int, changed_pixels int")
    want = []
    for c in range(150):
        left = {(x, y): n for i, x, y, n in rows if i == c and x * 16 < 310 and y * 16 < 185}
        while left:
            part, new = {}, [min(left)]
            while new:
                x, y = new.pop()
                if (x, y) in left:
                    part[x, y] = left.pop((x, y))
                    new += [(x + dx, y + dy) for dx in range(-2, 3) for dy in range(-2, 3)]
            xs, ys = [x for x, _ in part], [y for _, y in part]
            want.append((c, min(xs) * 16, min(ys) * 16, min(310, max(xs) * 16 + 16) - min(xs) * 16, min(185, max(ys) * 16 + 16) - min(ys) * 16, sum(part.values())))
    regions = more.change_regions(tiles.coalesce(1), 310, 185)
    assert sorted(map(tuple, regions.collect())) == sorted(want)
    # what is held follows the tiles, not the frame between them
    far = spark.createDataFrame([(1, 0, 0, 4), (1, 2, 1, 5), (1, 900_000, 900_000, 6)], "change_id long, tile_x int, tile_y int, changed_pixels int")
    assert sorted(map(tuple, more.change_regions(far, 16_000_000, 16_000_000).collect())) == [(1, 0, 0, 48, 32, 9), (1, 14_400_000, 14_400_000, 16, 16, 6)]


def _tasks(df):
    """The most partitions that an exchange of the plan deals to."""
    return max(map(int, re.findall(r"hashpartitioning\([^)]*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())))


def test_citations_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(handoff, "DEALT", 3)
    citations = spark.createDataFrame([(i // 3, i % 2) for i in range(30)], "o long, c long")
    found = handoff.citation_references(spark.range(12).selectExpr("id AS o"), citations, "o", "c")
    assert _tasks(found) == 10
    assert sorted((r.o, r.c, r.times, r.finding) for r in found.collect() if r.c is not None) == [(i, i % 2, 2, "duplicate") for i in range(10)]
    assert sorted((r.o, r.times, r.finding) for r in found.collect() if r.c is None) == [(10, 0, "no_citation"), (11, 0, "no_citation")]


def test_turns_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(more, "DEALT", 3)
    sides = [spark.createDataFrame([(i, "a", 0, 1_000_000 * k) for i in range(9)], f"recording_id long, {name} string, start_us long, end_us long") for name, k in (("ref", 2), ("hyp", 1))]
    found = more.diarization_error(*sides, spark.createDataFrame([(i, "a", "a") for i in range(9)], "recording_id long, ref string, hyp string"))
    assert _tasks(found) == 6
    assert sorted(map(tuple, found.collect())) == [(i, 1_500_000, 750_000, 0, 0) for i in range(9)]


def test_equal_readings_are_counted_before_they_are_ranked(spark):
    r = random.Random(4)
    rows = [(k, None if r.random() < 0.1 else r.randrange(6)) for k in "abc" for _ in range(r.randrange(1, 60))]
    found = evaluate.latency_summary(spark.createDataFrame(rows, "k string, v long"), ("k",), "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [k" in plan[plan.index("Window") :]
    for k, n, median, p90, total in found.collect():
        own = sorted(v for key, v in rows if key == k and v is not None)
        assert (n, median, p90, total) == (len(own), (own[(n - 1) // 2] + own[n // 2]) / 2, own[(18 * (n - 1) + 10) // 20], sum(own))


def test_files_of_recordings_are_kept_together(spark):
    from tracewell.plans import record_queries

    turns = spark.range(300).selectExpr("id AS event_id", "id AS recording_id", "id * 1000000 AS start_us", "id * 1000000 + 500000 AS end_us", "'x' AS cluster")
    found = record_queries.src7_read_rttm(turns)
    assert len(found.inputFiles()) < 50
    assert sorted(map(tuple, found.collect())) == [(i, i * 1_000_000, i * 1_000_000 + 500_000, "x") for i in range(300)]
    said = spark.range(200).selectExpr("id div 4 AS recording_id", "id % 4 AS ordinal", "id * 1000 AS start_us", "id * 1000 + 1000 AS end_us", "concat('t', id) AS text")
    for read, most in ((record_queries.src4_read_recogniser_json, 200), (record_queries.src5_read_screen_text, 100)):
        rows = read(said)
        assert len(rows.inputFiles()) < 50 and rows.count() == most


def test_findings_of_lines_look_for_marks_before_patterns(spark):
    lines = ["plain", "soft\u00adhyphen", "Ünïcode", "bell\x07", "tab\tok", "HTTPS://x", "x://y", "C:\\dir", "abc:\\dir", "see 9:\\", "/home/a", "z\u200b http://a D:\\"]
    found = text_queries.report_findings(spark.createDataFrame([(1, "\n".join(lines))], "report_id long, text string"))
    assert sorted((r.line, r.finding) for r in found.collect()) == [(2, "hidden_character"), (4, "control_character"), (6, "web_link"), (8, "local_path"), (11, "local_path"), (12, "hidden_character"), (12, "local_path"), (12, "web_link")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(t" in plan and "octet_length(t" in plan and "://" in plan


def test_words_of_stretches_are_not_sent(spark):
    r, second = random.Random(5), 1_000_000
    columns = "recording_id long, ordinal long, start_us long, end_us long, text string"
    said = [(k, n, n * 4 * second, n * 4 * second + r.randrange(1, 7) * second, " ".join(r.choice("abc") for _ in range(r.randrange(7)))) for k in (1, 2) for n in range(25)]
    reference, subject = (spark.createDataFrame(rows, columns) for rows in (said, [(*x[:2], x[2] + 250_000, x[3] + 250_000, x[4]) for x in said if r.random() < 0.6]))
    # stretches that overlap, begin together, are within one another, are empty or given twice
    stretches = {(k, a * second, (a + r.choice([0, 1, 5, 20])) * second) for k in (1, 2, 3) for a in range(-5, 100) if r.random() < 0.4} | {(1, 0, 30 * second), (1, 0, 40 * second)}
    found = compare.stretch_words(reference, subject, spark.createDataFrame([*stretches, *list(stretches)[:5]], "recording_id long, start_us long, end_us long"))

    def spoken(df, k):
        words = [(w.at_us, w.word) for w in word_timeline(df.where(f"recording_id = {k}")).orderBy("at_us", "ordinal", "n").collect()]
        return words, [(words[i][0], words[i + 2][0], tuple(w for _, w in words[i : i + 3])) for i in range(len(words) - 2)]

    want, sides = [], {k: (spoken(reference, k), spoken(subject, k)) for k in (1, 2)}
    for k, a, b in stretches:
        (words, mine), (_, theirs) = sides.get(k, (([], []), ([], [])))
        heard = {t for at, until, t in theirs if at >= a - compare.NEAR_US and until <= b + compare.NEAR_US}
        want += [(k, a, b, i + 1, w, at, any(t in heard for _, _, t in mine[max(0, i - 2) : i + 1])) for i, (at, w) in enumerate(words) if a <= at < b]
    assert sorted(map(tuple, found.collect())) == sorted(want) and 0 < sum(x[-1] for x in want) < len(want)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("triple" in keys or "place" in keys for keys in dealt)


def test_lost_runs_not_words_are_told_apart(spark):
    segments = spark.createDataFrame([(1, 1, 0, 1_000_000, "a b c d")], "recording_id long, ordinal long, start_us long, end_us long, text string")
    spans = spark.createDataFrame([(1, 0, 30_000_000)], "recording_id long, start_us long, end_us long")
    plan = compare.seam_comparison(segments, segments, spans.selectExpr("recording_id", "start_us + 9000000 AS start_us", "start_us + 11000000 AS end_us"), spans)._jdf.queryExecution()
    (keys,) = re.findall(r"Join LeftSemi, (.*)", plan.optimizedPlan().toString())
    assert "start_us" in keys and "from_us" not in keys
    assert not any("triple" in x or "place" in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan.executedPlan().toString()))


def test_lines_are_compared_where_pieces_of_them_are(spark):
    def plainly(line, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(line, 1):
            above, row = row, [i]
            for j, d in enumerate(text, 1):
                row.append(min(above[j - 1] + (c != d), above[j] + 1, row[-1] + 1))
        return min(row)

    r = random.Random(6)
    for letters in ("ab", "abcdefgh é\U0001f600"):
        for _ in range(60):
            text = "".join(r.choices(letters, k=r.randrange(250)))
            line = list(text[r.randrange(len(text) + 1) :][: r.randrange(90)])
            for _ in range(r.choice([0, 1, 3, 20])):
                i = r.randrange(len(line) + 1)
                line[i : i + r.randrange(2)] = r.choices(letters, k=r.randrange(2))
            assert readings._best_inside("".join(line), text) == plainly("".join(line), text)
    text = "".join(r.choices("abcdefghijklmnop", k=3000))
    line = text[1000:1200] + "x" + text[1201:1400]
    ((a, b),) = readings._near_pieces(line, text, len(line) // readings.PIECE - 1)
    assert a <= 1000 and b >= 1400 and b - a < 500 and readings._best_inside(line, text) == 1
    # the numbers of a frame are looked for before its lines are joined
    frames = spark.createDataFrame([(1, "a 7 b 12")], "frame_id long, text string")
    found = readings.line_error(spark.createDataFrame([(1, 0, "a 7 b"), (1, 1, "13"), (2, 0, "7")], "frame_id long, line_no long, text string"), frames)
    assert sorted((x.frame_id, x.line_no, x.errors, x.numbers, x.numbers_found, x.numbers_near) for x in found.collect()) == [(1, 0, 0, 1, 1, 0), (1, 1, 1, 1, 0, 1), (2, 0, 1, 1, 0, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS __seen" in plan[plan.index("Join LeftOuter") :]


def test_texts_of_events_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(report_queries, "DEALT", 3)
    events = spark.range(40).selectExpr("id AS event_id").coalesce(1)
    found = report_queries.str16_terms_stated(events)
    assert found.rdd.getNumPartitions() == report_queries.str16_fact_words(events).rdd.getNumPartitions() == 14
    assert {r.event_id: r.stated for r in found.collect()} == {i: (1 + i * 7919 % 999999) % 4 != 3 for i in range(40)}


def test_handoffs_are_parsed_once(spark):
    bodies = [
        (1, "s1", '{"citations":[{"segment_id":"tsg_1"},{"segment_id":"tsg_9"},{"evidence_id":"evd_1","type":"crop"}],"session":{"session_id":"s2"},"resume":{"session_id":"s1","to_verify":[{"id":"evd_9"}]}}'),
        (2, "s2", '{"citations":{"a":1},"session":{"session_id":7},"resume":{"session_id":"s1","evidence":[]}}'), (3, None, '{"session":{"session_id":"s3"}}'), (4, "s4", "no JSON"), (5, "s5", None),
    ]
    stores = spark.createDataFrame([("s1", "tsg_1")], "session_id string, segment_id string"), spark.createDataFrame([("s1", "evd_1", "frame")], "session_id string, evidence_id string, kind string")
    findings, checks = handoff.resolve_handoff(spark.createDataFrame(bodies, "report_id long, session_id string, body string"), *stores)
    assert sorted(map(tuple, findings.collect())) == [
        (1, "/citations/1/segment_id", "segment_not_in_session"), (1, "/citations/2/evidence_id", "evidence_kind_mismatch"), (1, "/resume/to_verify/0/id", "evidence_not_in_session"),
        (1, "/session/session_id", "session_mismatch"), (2, "/resume/session_id", "session_mismatch"), (3, "/session/session_id", "session_mismatch"),
    ]
    assert sorted(map(tuple, checks.collect())) == [(1, 4), (2, 0), (3, 0), (4, 0), (5, 0)]
    # one read of the handoffs, beside the two stores
    assert findings._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") + findings._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
