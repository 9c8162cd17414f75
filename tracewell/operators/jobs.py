"""Jobs, attempts, sessions and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The legal steps of a job's state.
LEGAL_STEPS = {
    "queued": ("running", "cancelling", "cancelled"),
    "running": ("committing", "interrupted", "cancelling", "failed"),
    "committing": ("succeeded", "failed", "interrupted"),
    "interrupted": ("running", "cancelled", "queued"),
    "cancelling": ("cancelled", "failed"),
}
POISON_TIMES = 3


def illegal_steps(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """job_id, event_id, from_state, to_state of steps that a job may not take."""
    rows = events.withColumn("from_state", F.lag("to_state").over(Window.partitionBy("job_id").orderBy(*order))).where("from_state IS NOT NULL")
    legal = F.lit(False)
    for state, following in LEGAL_STEPS.items():
        legal = legal | ((F.col("from_state") == state) & F.col("to_state").isin(*following))
    return rows.where(~legal).select("job_id", "event_id", "from_state", "to_state")


def latest_states(events: DataFrame) -> DataFrame:
    """job_id, state, resumable: the latest state of each job and what can be done with it."""
    last = events.groupBy("job_id").agg(F.max_by("to_state", F.struct("ts", "event_id")).alias("state"))
    verdict = (
        F.when(F.col("state").isin("running", "committing", "cancelling"), "live_owner").when(F.col("state").isin("succeeded", "failed", "cancelled"), F.col("state"))
        .when(F.col("state") == "queued", "not_started").otherwise("interrupted")
    )
    return last.withColumn("resumability", verdict)


def poisoned_chunks(attempts: DataFrame) -> DataFrame:
    """job_id, chunk, code, times: chunks that failed three times or more with one code; cancellations don't count."""
    return attempts.where("code <> 'cancelled'").groupBy("job_id", "chunk", "code").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= POISON_TIMES)


def batch_counts(items: DataFrame) -> DataFrame:
    """batch_id and the number of items of each status."""
    kinds = ("complete", "partial", "failed", "cancelled", "rejected")
    return items.groupBy("batch_id").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def idle_sessions(activity: DataFrame, idle_us: int) -> DataFrame:
    """user, start_us, end_us, events: sessions of an activity (user, at_us) apart by more than the idle time; each ends that much after its last event."""
    order = Window.partitionBy("user").orderBy("at_us")
    new = F.coalesce((F.col("at_us") - F.lag("at_us").over(order) > idle_us).cast("int"), F.lit(1))
    rows = activity.withColumn("new", new).withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user", "nth").agg(F.min("at_us").alias("start_us"), (F.max("at_us") + idle_us).alias("end_us"), F.count(F.lit(1)).alias("events")).drop("nth")


def session_expiry(events: DataFrame, idle_us: int, most_us: int) -> DataFrame:
    """session_id, expires_us: each event puts the end off by the idle time, never past the hard limit, until it has expired.

    Events after the end change nothing, so the first gap longer than the idle time ends the session.
    """
    order = Window.partitionBy("session_id").orderBy("at_us")
    opened = F.min("at_us").over(Window.partitionBy("session_id"))
    late = F.coalesce(F.col("at_us") - F.lag("at_us").over(order) >= idle_us, F.lit(False)) | (F.col("at_us") >= opened + most_us)
    alive = events.withColumn("opened", opened).withColumn("late", late.cast("int")).withColumn("dead", F.max("late").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("dead = 0")
    return alive.groupBy("session_id").agg(F.least(F.max("at_us") + idle_us, F.min("opened") + most_us).alias("expires_us"))


def progress_figures(progress: DataFrame) -> DataFrame:
    """Progress rows with percent, speed_milli and remaining_us (only after two fresh chunks and twenty seconds)."""
    share = F.expr("least(100L, (done_until_us - from_us) * 100 div nullif(to_us - from_us, 0))")
    speed = F.expr("fresh_media_us * 1000 div nullif(fresh_elapsed_us, 0)")
    enough = (F.col("fresh_chunks") >= 2) & (F.col("fresh_elapsed_us") >= 20_000_000)
    rest = F.expr("(to_us - done_until_us) * fresh_elapsed_us div nullif(fresh_media_us, 0)")
    return progress.withColumn("percent", share).withColumn("speed_milli", speed).withColumn("remaining_us", F.when(enough, rest))


def idempotent_requests(requests: DataFrame, records: DataFrame) -> DataFrame:
    """request_id, verdict for requests (request_id, key, digest) against records (key, digest, state)."""
    met = requests.join(records.select("key", F.col("digest").alias("__digest"), F.col("state").alias("__state")), "key", "left")
    verdict = (
        F.when(F.col("__digest").isNull(), "start").when(F.col("__digest") != F.col("digest"), "conflict")
        .when(F.col("__state").isin("succeeded", "failed", "cancelled"), "replay").otherwise("continue")
    )
    return met.select("request_id", verdict.alias("verdict"))


def checkpoint_reuse(chunks: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose stored answer has their key, number and window, and the others, still to be worked out."""
    on = ["recognition_key", "idx", "win_start_us", "win_end_us"]
    return chunks.join(checkpoints, on, "left_semi"), chunks.join(checkpoints, on, "left_anti")


def latest_by_key(events: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key, as an upsert by key leaves it."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("__n", last).where("__n = 1").drop("__n")
