"""The row-handler queue, set at a time: what is due, blocked, exhausted, stale, and what follows from outcomes.

Within a row detail handlers run in id order, so blockers and dependants are windows over the detail, never self-joins
on an inequality.  The partitions are a detail's few handlers.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.periods import backoff_seconds, minus
from tidemark.plans.model import Phase, RunStatus, State

def by_detail() -> WindowSpec:
    return Window.partitionBy("detail_id")


def open_state() -> Column:
    return F.col("state").isin(int(State.PENDING), int(State.IN_FLIGHT))


def expired(now: datetime, lease: timedelta) -> Column:
    """An expired lease; leases are half a minute at least."""
    return F.col("claimed_at").isNotNull() & (F.col("claimed_at") <= F.lit(minus(now, max(lease, timedelta(seconds=30)))))


def unblocked(queue: DataFrame) -> DataFrame:
    """Rows with no earlier open row of the same detail."""
    first = F.min(F.when(open_state(), F.col("id"))).over(by_detail())
    return queue.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_first") >= F.col("id"))).drop("_first")


def due(queue: DataFrame, details: DataFrame, runs: DataFrame, *, now: datetime, lease: timedelta, max_attempts: int, due_at: datetime | None = None, limit: int | None = None) -> DataFrame:
    """What to claim next, in order of due time and id: pending and due, or in flight with an expired lease and
    attempts left; not blocked; deferred rows only once their run has settled."""
    pending = (F.col("state") == int(State.PENDING)) & (F.col("next_attempt_at") <= F.lit(due_at or now))
    again = (F.col("state") == int(State.IN_FLIGHT)) & expired(now, lease) & (F.col("attempt") < max_attempts)
    terminal = [int(s) for s in RunStatus if s != RunStatus.STARTED]
    settled = F.col("run_status").isin(terminal) & F.col("run_settled_at").isNotNull()
    ready = unblocked(queue).where(pending | again)
    ready = ready.join(details.select(F.col("id").alias("detail_id"), "run_id"), "detail_id")
    ready = ready.join(runs.select("run_id", F.col("status").alias("run_status"), F.col("settled_at").alias("run_settled_at")), "run_id")
    ready = ready.where((F.col("phase") == int(Phase.IMMEDIATE)) | ((F.col("phase") == int(Phase.AFTER_RUN_SETTLED)) & settled)).select(*queue.columns)
    return ready.orderBy("next_attempt_at", "id").limit(limit) if limit else ready


def claim(rows: DataFrame, now: datetime, token: str) -> DataFrame:
    return rows.withColumns({"state": F.lit(int(State.IN_FLIGHT)), "claimed_at": F.lit(now), "claim_token": F.lit(token), "attempt": F.col("attempt") + 1})


def settle(queue: DataFrame, outcomes: DataFrame, *, now: datetime, base_seconds: int, max_attempts: int, most_seconds: int = 10**9) -> DataFrame:
    """The queue after ``outcomes`` (id, claim_token, error[, final]): success, retry with backoff, or dead letter, at
    once if the error is final.  Outcomes whose token is no longer the row's are ignored; a dead letter takes the later
    open rows of its detail along."""
    final = F.coalesce("final", F.lit(False)) if "final" in outcomes.columns else F.lit(False)
    said = outcomes.select("id", F.col("claim_token").alias("_token"), F.col("error").alias("_error"), F.lit(True).alias("_said"), final.alias("_final"))
    rows = queue.join(said, "id", "left")
    own = F.coalesce(F.col("_said") & (F.col("state") == int(State.IN_FLIGHT)) & (F.col("claim_token") == F.col("_token")), F.lit(False))
    failed = own & F.col("_error").isNotNull()
    dead = failed & ((F.col("attempt") >= max_attempts) | F.col("_final"))
    rows = rows.withColumns({"_own": own, "_failed": failed, "_dead": dead})
    state = F.when(F.col("_dead"), int(State.DEAD_LETTERED)).when(F.col("_failed"), int(State.PENDING)).when(F.col("_own"), int(State.SUCCEEDED)).otherwise(F.col("state"))
    wait = backoff_seconds(F.col("attempt"), base_seconds, most_seconds)
    later = F.timestamp_seconds(F.unix_timestamp(F.lit(now)) + wait)
    rows = rows.withColumns({
        "state": state.cast("int"), "claimed_at": F.when(~F.col("_own"), F.col("claimed_at")), "claim_token": F.when(~F.col("_own"), F.col("claim_token")),
        "next_attempt_at": F.when(F.col("_failed") & ~F.col("_dead"), later).otherwise(F.col("next_attempt_at")),
        "completed_at": F.when(F.col("_own") & (F.col("_dead") | ~F.col("_failed")), F.lit(now)).otherwise(F.col("completed_at")),
        "last_error": F.when(F.col("_failed"), F.col("_error")).otherwise(F.col("last_error")),
    })
    return dead_letter_dependants(rows, now).select(*queue.columns)


def dead_letter_dependants(queue: DataFrame, now: datetime) -> DataFrame:
    """Open rows after a dead-lettered one of the same detail are dead letters too."""
    first = F.min(F.when(F.col("state") == int(State.DEAD_LETTERED), F.col("id"))).over(by_detail())
    hit = open_state() & (F.col("id") > F.col("_first_dead"))
    rows = queue.withColumn("_first_dead", first).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return rows.withColumns({
        "state": F.when(F.col("_hit"), int(State.DEAD_LETTERED)).otherwise(F.col("state")).cast("int"),
        "claimed_at": F.when(~F.col("_hit"), F.col("claimed_at")), "claim_token": F.when(~F.col("_hit"), F.col("claim_token")),
        "completed_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("completed_at")),
        "last_error": F.when(F.col("_hit"), F.lit("an earlier handler of this row was dead-lettered")).otherwise(F.col("last_error")),
    }).drop("_first_dead", "_hit")


def dead_letter_exhausted(queue: DataFrame, *, now: datetime, lease: timedelta, max_attempts: int) -> DataFrame:
    """Expired claims without attempts left are dead letters, with what depends on them."""
    hit = (F.col("state") == int(State.IN_FLIGHT)) & expired(now, lease) & (F.col("attempt") >= max_attempts)
    rows = queue.withColumn("_x", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumns({
        "state": F.when(F.col("_x"), int(State.DEAD_LETTERED)).otherwise(F.col("state")).cast("int"), "completed_at": F.when(F.col("_x"), F.lit(now)).otherwise(F.col("completed_at")),
        "claimed_at": F.when(~F.col("_x"), F.col("claimed_at")), "claim_token": F.when(~F.col("_x"), F.col("claim_token")),
        "last_error": F.when(F.col("_x"), F.lit("the last attempt's lease expired")).otherwise(F.col("last_error")),
    }).drop("_x")
    return dead_letter_dependants(rows, now)


def past(now: datetime, retention: timedelta) -> Column:
    """Details past ``retention``, which is an hour at least."""
    return F.col("at") < F.lit(minus(now, max(retention, timedelta(hours=1))))


def expire(details: DataFrame, *, now: datetime, retention: timedelta) -> DataFrame:
    """Row details less payloads past ``retention``."""
    return details.withColumn("payload", F.when(~past(now, retention), F.col("payload")))


def scrub(details: DataFrame, queue: DataFrame, *, now: datetime, retention: timedelta) -> DataFrame:
    """Row details less payloads whose handlers have all settled or that are past ``retention`` (an hour at least)."""
    waiting = queue.where(open_state()).select(F.col("detail_id").alias("id"), F.lit(True).alias("_open")).distinct()
    rows = details.join(waiting, "id", "left")
    return rows.withColumn("payload", F.when(F.col("_open") & ~past(now, retention), F.col("payload"))).drop("_open").select(*details.columns)


def remainder(queue: DataFrame) -> DataFrame:
    """What a flush left: (pending, in_flight)."""
    return queue.agg(F.count_if(F.col("state") == int(State.PENDING)).alias("pending"), F.count_if(F.col("state") == int(State.IN_FLIGHT)).alias("in_flight"))


def stale_runs(runs: DataFrame, *, now: datetime, timeout: timedelta) -> DataFrame:
    """Runs that started and never settled in time, oldest first."""
    return runs.where((F.col("status") == int(RunStatus.STARTED)) & (F.col("started_at") <= F.lit(minus(now, timeout)))).orderBy("started_at", "run_id")


def fail_stale(runs: DataFrame, *, now: datetime, timeout: timedelta) -> DataFrame:
    hit = (F.col("status") == int(RunStatus.STARTED)) & (F.col("started_at") <= F.lit(minus(now, timeout)))
    return runs.withColumns({
        "duration_seconds": F.when(hit, F.unix_timestamp(F.lit(now)) - F.unix_timestamp("started_at")).otherwise(F.col("duration_seconds")),
        "error": F.when(hit, F.lit("the run was abandoned")).otherwise(F.col("error")), "settled_at": F.when(hit, F.lit(now)).otherwise(F.col("settled_at")),
        "status": F.when(hit, int(RunStatus.FAILED)).otherwise(F.col("status")).cast("int"),
    })
