"""Records that break their schema, and handoffs whose identities don't resolve."""

import json

from tracewell.operators import handoff
from tracewell.sources.guard import guard_records

RECORD = "schema_version int NOT NULL, revision_id string NOT NULL, language string, source struct<start_us: bigint NOT NULL, end_us: bigint NOT NULL> NOT NULL, share double, done boolean, segments array<struct<start_us: bigint NOT NULL, text: string>> NOT NULL, tags array<string>"
RULES = {"source_is_forward": "source.start_us < source.end_us", "segments_start_inside": "forall(segments, s -> s.start_us >= source.start_us AND s.start_us < source.end_us)"}


def test_bad_records_are_set_apart(spark):
    good = {"schema_version": 2, "revision_id": "r", "source": {"start_us": 0, "end_us": 10}, "share": 1, "segments": [{"start_us": 0, "text": "a"}, {"start_us": 9}], "tags": ["x", None]}
    lines = {
        1: good, 2: good | {"language": None, "done": True, "share": 0.5, "tags": []}, 3: "{not json", 4: [1], 5: "", 6: good | {"extra": 1, "source": {"start_us": 0, "end_us": 10, "odd/one": 2}},
        7: good | {"segments": [{"start_us": "0"}, {"text": "b", "new": []}, 5, None]}, 8: {k: v for k, v in good.items() if k != "revision_id"} | {"share": "1", "done": 0, "schema_version": 2**40},
        9: good | {"source": {"start_us": 10, "end_us": 10}}, 10: good | {"segments": [{"start_us": 10}]}, 11: {"schema_version": 3, "anything": 1}, 12: good | {"segments": {}}, 13: None, 14: good | {"revision_id": "x" * 3000}, 15: good | {"segments": []},
    }
    df = spark.createDataFrame([(n, x if isinstance(x, str) or x is None else json.dumps(x), "o") for n, x in lines.items()], "line long, text string, segments string")
    ok, bad = guard_records(df, RECORD, RULES, version="schema_version", newest=2, most_bytes=2000)
    assert {r["line"]: (r["record"]["revision_id"], r["record"]["share"], len(r["record"]["segments"])) for r in ok.collect()} == {1: ("r", 1.0, 2), 2: ("r", 0.5, 2), 15: ("r", 1.0, 0)}
    assert ok.columns == ["line", "segments", "record"] and bad.columns == ["line", "segments", "pointer", "reason"]
    found = {}
    for r in bad.collect():
        found.setdefault(r["line"], set()).add((r["pointer"], r["reason"]))
    assert found == {
        3: {("", "not_json")}, 4: {("", "wrong_type")}, 5: {("", "not_json")}, 6: {("/extra", "unknown_member"), ("/source/odd/one", "unknown_member")},
        7: {("/segments/0/start_us", "wrong_type"), ("/segments/1/start_us", "missing_member"), ("/segments/1/new", "unknown_member"), ("/segments/2", "wrong_type")},
        8: {("", "newer_version")}, 9: {("", "source_is_forward"), ("", "segments_start_inside")}, 10: {("", "segments_start_inside")}, 11: {("", "newer_version")}, 12: {("/segments", "wrong_type")}, 13: {("", "not_json")}, 14: {("", "too_large")},
    }
    _, bad = guard_records(df.where("line = 8"), RECORD)
    assert {(r["pointer"], r["reason"]) for r in bad.collect()} == {("/revision_id", "missing_member"), ("/share", "wrong_type"), ("/done", "wrong_type"), ("/schema_version", "wrong_type")}
    ok, bad = guard_records(df.where("false"), RECORD, RULES)
    assert ok.count() == bad.count() == 0


def test_every_identity_of_a_handoff(spark):
    one = {
        "session": {"session_id": "s1"},
        "citations": [{"segment_id": "tsg_1"}, {"segment_id": "tsg_9", "evidence_id": "evd_1", "type": "frame"}, {"evidence_id": "evd_1", "type": "crop", "parent_evidence_id": "evd_7"}, {"evidence_id": "evd_2", "type": "novel"}, {"segment_id": 5}, "odd"],
        "resume": {"session_id": "s2", "evidence": [{"kind": "transcript_segment", "id": "tsg_2"}, {"kind": "audio", "id": "evd_2"}, {"kind": "nothing", "id": "evd_99"}, {"id": "x"}], "to_verify": [{"id": "tsg_404"}, {"id": "evd_1"}, {"id": "other_1"}, {}]},
    }
    rows = [(1, "s1", json.dumps(one)), (2, "s2", json.dumps({"citations": [{"segment_id": "tsg_1"}]})), (3, "s1", "{broken"), (4, None, json.dumps({"citations": [{"segment_id": "tsg_1"}], "session": {"session_id": 5}})), (5, "s1", "{}"), (6, "s1", None), (7, "s1", '{"citations": {"a": {"segment_id": "tsg_1"}}, "resume": 3}')]
    handoffs = spark.createDataFrame(rows, "report_id long, session_id string, body string")
    segments = spark.createDataFrame([("s1", "tsg_1"), ("s1", "tsg_1"), ("s1", "tsg_2"), (None, "tsg_1")], "session_id string, segment_id string")
    evidence = spark.createDataFrame([("s1", "evd_1", "frame"), ("s1", "evd_2", "crop"), ("s1", "evd_2", "audio")], "session_id string, evidence_id string, kind string")
    findings, checks = handoff.resolve_handoff(handoffs, segments, evidence)
    assert sorted(tuple(r) for r in findings.collect()) == [
        (1, "/citations/1/segment_id", "segment_not_in_session"), (1, "/citations/2/evidence_id", "evidence_kind_mismatch"), (1, "/citations/2/parent_evidence_id", "evidence_not_in_session"),
        (1, "/resume/session_id", "session_mismatch"), (1, "/resume/to_verify/0/id", "segment_not_in_session"), (2, "/citations/0/segment_id", "segment_not_in_session"), (4, "/citations/0/segment_id", "segment_not_in_session"),
    ]
    assert {r["report_id"]: r["identities_checked"] for r in checks.collect()} == {1: 10, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0}
