"""Handoffs: their citations against the stores, their own rules, and their clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.shared import parts

#: The largest resume card in bytes, and how near to a gap that a person changed a clock time may be stale.
MOST_RESUME_BYTES = 2_048
STALE_US = 5_000_000
#: Citations that are dealt to one task.
DEALT = 500_000


def not_in_store(citations: DataFrame, store: DataFrame, ids: list[str]) -> DataFrame:
    """Citations whose ids the store doesn't have, of any revision; a null id is in no store."""
    return citations.join(store.select(*ids).distinct(), ids, "left_anti")


def citation_references(owners: DataFrame, citations: DataFrame, owner: str, cited: str) -> DataFrame:
    """owner, cited, times, finding: what an owner cites more than once (``duplicate``), and owners that cite nothing (``no_citation``). Both are dealt by owner once, to more tasks as citations grow."""
    n = parts(citations.sparkSession, citations.count(), DEALT)
    dealt = citations.select(owner, cited).repartition(n, owner)
    twice = dealt.groupBy(owner, cited).agg(F.count(F.lit(1)).alias("times")).where("times > 1").withColumn("finding", F.lit("duplicate"))
    none = owners.select(owner).repartition(n, owner).distinct().join(dealt.select(owner), owner, "left_anti")
    return twice.unionByName(none.select(owner, F.lit(None).cast(dict(citations.dtypes)[cited]).alias(cited), F.lit(0).cast("long").alias("times"), F.lit("no_citation").alias("finding")))


def resolve_citations(citations: DataFrame, store: DataFrame, wanted: Column) -> DataFrame:
    """Citations (with evidence_id) with ``finding``: ``absent``, ``other_kind`` or ``resolved``.

    ``store`` has evidence_id and kind; ``wanted`` is a condition on the joined row
    that says whether the kind is one that the citation may name. An item without
    a kind is of another kind. Of repeated items the least kind counts.
    """
    items = store.groupBy("evidence_id").agg(F.min("kind").alias("kind"), F.lit(True).alias("__there"))
    found = citations.join(items, "evidence_id", "left")
    return found.withColumn("finding", F.when(F.col("__there").isNull(), "absent").when(F.coalesce(wanted, F.lit(False)), "resolved").otherwise("other_kind")).drop("__there")


#: Kinds of evidence, what a segment is called among them, and what ids of segments and of evidence begin with.
EVIDENCE_KINDS, SEGMENT_KIND = ("frame", "crop", "audio"), "transcript_segment"
SEGMENT_PREFIX, EVIDENCE_PREFIX = "tsg_", "evd_"


def handoff_identities(handoffs: DataFrame) -> DataFrame:
    """report_id, session_id, pointer, id, store, kind: every identity that handoffs (report_id, session_id, body) name.

    ``body`` is JSON. ``store`` is ``segment`` or ``evidence`` and ``kind`` what the
    evidence should be, null for any. Looked through are citations (segment,
    evidence of the citation's type, parent evidence), the resume card's evidence and what it
    has to verify, told apart by how an id begins. What isn't a text, or is of no known kind, is no identity.
    """
    return _named(handoffs).where("store <> 'session'")


def _named(handoffs: DataFrame) -> DataFrame:
    """The identities of :func:`handoff_identities` and, with ``session`` as their store, sessions that a handoff names and that aren't its own, in one pass over the bodies."""
    text = lambda v, path: f"IF(schema_of_variant(try_variant_get({v}, '{path}')) = 'STRING', try_variant_get({v}, '{path}', 'string'), NULL)"
    rows = handoffs.select("report_id", "session_id", F.expr("try_parse_json(body)").alias("h"))
    paths = {"/session/session_id": "$.session.session_id", "/resume/session_id": "$.resume.session_id"}
    sessions = F.array(*[F.struct(F.lit(p).alias("member"), F.expr(text("h", v)).alias("id"), F.lit("session").alias("store"), F.lit(None).cast("string").alias("kind")) for p, v in paths.items()])
    rows = rows.withColumn("others", F.filter(sessions, lambda n: n["id"].isNotNull() & ~n["id"].eqNullSafe(F.col("session_id").cast("string"))))
    # the list of sessions has no items, so it is one row without a place
    each = rows.sparkSession.sql(
        """SELECT r.report_id, r.session_id, r.others, l.list, x.pos, x.value AS v
           FROM {rows} r, LATERAL (SELECT explode(map('/session', NULL, '/citations', try_variant_get(r.h, '$.citations'), '/resume/evidence', try_variant_get(r.h, '$.resume.evidence'), '/resume/to_verify', try_variant_get(r.h, '$.resume.to_verify'))) AS (list, items)) l,
                LATERAL variant_explode_outer(l.items) x WHERE x.key IS NULL""", rows=rows,
    )
    named = lambda member, id_, store, kind: F.struct(F.lit(member).alias("member"), id_.alias("id"), store.alias("store"), kind.alias("kind"))
    segment, evidence, any_kind = F.lit("segment"), F.lit("evidence"), F.lit(None).cast("string")
    get = lambda path: F.expr(text("v", path))
    known = lambda k: F.when(k.isin(*EVIDENCE_KINDS), k)
    own, kind = get("$.id"), get("$.kind")
    of_kind = F.when(kind == SEGMENT_KIND, segment).when(kind.isin(*EVIDENCE_KINDS), evidence)
    of_prefix = F.when(own.startswith(SEGMENT_PREFIX), segment).when(own.startswith(EVIDENCE_PREFIX), evidence)
    found = (
        F.when(F.col("list") == "/session", F.col("others")).when(F.col("list") == "/citations", F.array(
            named("segment_id", get("$.segment_id"), segment, any_kind), named("evidence_id", get("$.evidence_id"), evidence, known(get("$.type"))), named("parent_evidence_id", get("$.parent_evidence_id"), evidence, any_kind),
        )).when(F.col("list") == "/resume/evidence", F.array(named("id", own, of_kind, F.when(of_kind == "evidence", kind))))
        .otherwise(F.array(named("id", own, of_prefix, any_kind)))
    )
    out = each.select("report_id", "session_id", "list", "pos", F.explode(found).alias("n")).where("n.id IS NOT NULL AND n.store IS NOT NULL")
    place = F.when(F.col("n.store") != "session", F.concat("list", F.lit("/"), F.col("pos").cast("string")))
    return out.select("report_id", "session_id", F.concat_ws("/", place, "n.member").alias("pointer"), "n.id", "n.store", "n.kind")


def resolve_handoff(handoffs: DataFrame, segments: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (report_id, pointer, finding) and checks (report_id, identities_checked) of handoffs (report_id, session_id, body).

    Every identity is looked up in its session's store, ``segments`` (session_id,
    segment_id) or ``evidence`` (session_id, evidence_id, kind), by one join:
    ``segment_not_in_session``, ``evidence_not_in_session`` or
    ``evidence_kind_mismatch``. A session that the handoff itself names and that isn't
    its own is a ``session_mismatch``. Of evidence that is stored repeatedly the least kind
    counts; a handoff that is no JSON names nothing and has 0 checks. A session without an id stores nothing.
    """
    ids = _named(handoffs)
    store = segments.select("session_id", F.col("segment_id").alias("id"), F.lit("segment").alias("store"), F.lit(None).cast("string").alias("held")).unionByName(
        evidence.select("session_id", F.col("evidence_id").alias("id"), F.lit("evidence").alias("store"), F.col("kind").alias("held"))
    ).groupBy("session_id", "store", "id").agg(F.min("held").alias("held"), F.lit(True).alias("there"))
    met = ids.join(store, ["session_id", "store", "id"], "left")
    wrong_kind = F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.col("held"))
    finding = F.when(F.col("store") == "session", "session_mismatch").when(F.col("there").isNull(), F.concat("store", F.lit("_not_in_session"))).when(wrong_kind, "evidence_kind_mismatch")
    findings = met.select("report_id", "pointer", finding.alias("finding")).where("finding IS NOT NULL")
    counted = handoff_identities(handoffs).groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    checks = handoffs.select("report_id").distinct().join(counted, "report_id", "left").select("report_id", F.coalesce("n", F.lit(0)).cast("long").alias("identities_checked"))
    return findings, checks


def handoff_rules(handoffs: DataFrame) -> DataFrame:
    """report_id, finding, of handoffs by their own content.

    ``handoffs``: report_id, claims array<struct<id, citations array<string>>>, citations
    array<struct<id, kind, inspected boolean>>, from_us, to_us, image_access boolean,
    cut_short boolean, resume_card string, budget_limit, budget_stated.
    """
    claim_ids, cited = F.transform("claims", lambda c: c["id"]), F.flatten(F.transform("claims", lambda c: c["citations"]))
    ids, images = F.transform("citations", lambda c: c["id"]), F.filter("citations", lambda c: c["kind"] == "image")
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    rules = {
        "duplicate_claim_id": twice(claim_ids), "duplicate_citation_id": twice(ids),
        "missing_citation": F.size(F.array_except(cited, ids)) > 0, "unused_citation": F.size(F.array_except(ids, cited)) > 0,
        "claim_without_citation": F.exists("claims", lambda c: F.size(c["citations"]) == 0),
        "image_without_access": (F.size(images) > 0) & ~F.col("image_access"),
        "only_uninspected_images": (F.size("citations") > 0) & F.forall("citations", lambda c: (c["kind"] == "image") & ~c["inspected"]),
        "reversed_window": F.col("from_us") >= F.col("to_us"),
        "resume_card_missing": F.col("cut_short") & (F.coalesce(F.col("resume_card"), F.lit("")) == ""),
        "resume_card_too_long": F.octet_length("resume_card") > MOST_RESUME_BYTES,
        "budget_differs": ~F.col("budget_limit").eqNullSafe(F.col("budget_stated")),
    }
    findings = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    return handoffs.select("report_id", F.explode(findings).alias("finding"))


def clock_time_findings(citations: DataFrame, items: DataFrame, gaps: DataFrame) -> DataFrame:
    """Citations' clock times against what the recording says: report_id, pos, finding.

    ``citations``: report_id, pos, item_id, stated, stated_zone; ``items``: item_id,
    recording_id, at_us, derived (text, null for none), zone (null where none is
    known); ``gaps``: recording_id, at_us, by_person. ``no_item``, ``no_clock`` (nothing to compare with), ``not_an_instant`` (a
    zone is stated where none is known), ``differs``, ``may_be_stale`` (differs
    within ``STALE_US`` of a gap that a person changed) or ``agrees``.
    """
    changed = gaps.where("by_person").select("recording_id", F.explode(F.expr(f"sequence((at_us - {STALE_US}) div {STALE_US}, (at_us + {STALE_US}) div {STALE_US})")).alias("cell"), F.col("at_us").alias("gap_us"))
    near = (
        items.withColumn("cell", F.expr(f"at_us div {STALE_US}")).join(changed, ["recording_id", "cell"]).where(F.abs(F.col("at_us") - F.col("gap_us")) <= STALE_US)
        .select("item_id").distinct().withColumn("near_gap", F.lit(True))
    )
    rows = citations.join(items.withColumn("there", F.lit(True)), "item_id", "left").join(near, "item_id", "left")
    finding = (
        F.when(F.col("there").isNull(), "no_item").when(F.col("derived").isNull(), "no_clock").when(F.col("stated_zone").isNotNull() & F.col("zone").isNull(), "not_an_instant")
        .when(F.col("stated").eqNullSafe(F.col("derived")), "agrees").when(F.col("near_gap"), "may_be_stale").otherwise("differs")
    )
    return rows.select("report_id", "pos", finding.alias("finding"))


def grade_reports(statements: DataFrame, facts: DataFrame, windows: DataFrame) -> DataFrame:
    """report_id, facts, matched, wrong, unverifiable, needs_reading: a report's statements against the truth.

    ``statements``: report_id, fact_id (the fact it is about, null for none), value,
    at_us (null for none); ``facts``: fact_id, value; ``windows``: fact_id, from_us,
    to_us in which it holds (none: always). A statement is wrong if it contradicts
    its fact or its time is outside all windows of the fact, unverifiable if it is
    about no known fact, and needs reading if it gives no value. A fact counts as
    matched once for a report, however often it is stated right.
    """
    bounded = windows.select("fact_id").distinct().withColumn("bounded", F.lit(True))
    inside = statements.join(windows, "fact_id").where((F.col("at_us") >= F.col("from_us")) & (F.col("at_us") < F.col("to_us"))).select("report_id", "fact_id", "at_us").distinct().withColumn("inside", F.lit(True))
    rows = statements.join(facts.withColumnRenamed("value", "true_value").withColumn("known", F.lit(True)), "fact_id", "left").join(bounded, "fact_id", "left").join(inside, ["report_id", "fact_id", "at_us"], "left")
    outside = F.col("bounded") & F.col("at_us").isNotNull() & F.col("inside").isNull()
    verdict = (
        F.when(F.col("known").isNull(), "unverifiable").when(F.col("value").isNull(), "needs_reading")
        .when(~F.col("value").eqNullSafe(F.col("true_value")) | F.coalesce(outside, F.lit(False)), "wrong").otherwise("matched")
    )
    count = lambda name: F.count_if(F.col("verdict") == name).alias(name)
    graded = rows.withColumn("verdict", verdict).groupBy("report_id").agg(F.countDistinct(F.when(F.col("verdict") == "matched", F.col("fact_id"))).alias("matched"), count("wrong"), count("unverifiable"), count("needs_reading"))
    return graded.withColumn("facts", facts.agg(F.count(F.lit(1))).scalar()).select("report_id", "facts", "matched", "wrong", "unverifiable", "needs_reading")


def trace_calls(events: DataFrame) -> DataFrame:
    """A client's event log as tool calls: run_id, call_id, tool, started_us, ended_us, failed, step.

    ``events``: run_id, kind (``tool_use`` or ``tool_result``), call_id, tool, at_us,
    is_error. A call without a result has null ends; ``step`` counts a run's calls by
    their start. Of repeated events of a call the first counts.
    """
    use, result = F.col("kind") == "tool_use", F.col("kind") == "tool_result"
    calls = events.where(F.col("call_id").isNotNull()).groupBy("run_id", "call_id").agg(
        F.min_by(F.when(use, F.col("tool")), F.when(use, F.col("at_us"))).alias("tool"), F.min(F.when(use, F.col("at_us"))).alias("started_us"),
        F.min(F.when(result, F.col("at_us"))).alias("ended_us"), F.min_by(F.when(result, F.col("is_error")), F.when(result, F.col("at_us"))).alias("failed"),
    ).where("started_us IS NOT NULL")
    return calls.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("started_us", "call_id")))


def trace_usage(events: DataFrame) -> DataFrame:
    """run_id, messages, input_tokens, output_tokens: a message is logged several times while it grows, so its largest figures count."""
    each = events.where("message_id IS NOT NULL").groupBy("run_id", "message_id").agg(F.max("input_tokens").alias("i"), F.max("output_tokens").alias("o"))
    return each.groupBy("run_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
