"""The audit ledger as an append-only event log; runs, summaries and details are aggregates of it.

Progress adds up; held and null-anchor counts, times and provenance are those of the last summary; a dry run has no
progress, so its summaries carry the counts.  ``seq`` orders the events of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.schemas import struct

EVENTS = struct(
    "run_id string, seq long, kind string, at timestamp, tenant_id string, trigger int, dry_run boolean, entity_id string, entity string, category string, strategy int, "
    "period_seconds long, affected long, held long, skipped long, null_anchor long, rule_source string, rule_reason string, record_id string, payload string, status int, error string"
)
KEY = ("run_id", "entity_id", "category", "tenant_id", "strategy")
#: Kinds of events; the terminal ones carry the run's status.
STARTED, PROGRESS, SUMMARY, DETAIL, SETTLED = "started", "progress", "summary", "detail", "settled"


def summaries(events: DataFrame) -> DataFrame:
    """One row per run, entity, category, tenant and strategy."""
    last = lambda c: F.max_by(F.when(F.col("kind") == SUMMARY, F.col(c)), F.when(F.col("kind") == SUMMARY, F.col("seq")))
    moved = lambda c: F.coalesce(F.sum(F.when((F.col("kind") == PROGRESS) | F.col("dry_run"), F.col(c))), F.lit(0))
    rows = events.where(F.col("kind").isin(PROGRESS, SUMMARY))
    return rows.groupBy(*KEY).agg(
        moved("affected").alias("affected"), moved("skipped").alias("skipped"), last("held").alias("held"), last("null_anchor").alias("null_anchor"),
        last("period_seconds").alias("period_seconds"), last("at").alias("at"), last("entity").alias("entity"), last("rule_source").alias("rule_source"), last("rule_reason").alias("rule_reason"),
    )


def runs(events: DataFrame) -> DataFrame:
    """One row per run: status, times, duration and total; the first terminal event counts."""
    is_ = lambda k: F.col("kind") == k
    first = lambda c, k: F.min_by(F.when(is_(k), F.col(c)), F.when(is_(k), F.col("seq")))
    started, settled = first("at", STARTED), first("at", SETTLED)
    total = F.sum(F.when(is_(PROGRESS) | (is_(SUMMARY) & F.col("dry_run")), F.col("affected")))
    return events.groupBy("run_id").agg(
        started.alias("started_at"), F.coalesce(first("status", SETTLED), F.lit(0)).alias("status"), settled.alias("settled_at"),
        (F.unix_timestamp(settled) - F.unix_timestamp(started)).alias("duration_seconds"), first("trigger", STARTED).alias("trigger"), first("dry_run", STARTED).alias("dry_run"),
        first("tenant_id", STARTED).alias("tenant_id"), F.coalesce(total, F.lit(0)).alias("total_affected"), first("error", SETTLED).alias("error"),
    )


def details(events: DataFrame) -> DataFrame:
    """Row details, each record once per run, entity, category, tenant and strategy."""
    return events.where(F.col("kind") == DETAIL).dropDuplicates([*KEY, "record_id"]).select(*KEY, "record_id", "entity", "at", "payload")


def without_committed(candidates: DataFrame, details: DataFrame) -> DataFrame:
    """Candidates whose record this run hasn't written a detail for, so a failing row isn't taken up again."""
    return candidates.join(details.select(*KEY, "record_id"), [*KEY, "record_id"], "left_anti")


def problems(runs: DataFrame) -> DataFrame:
    """Runs that break the ledger's constraints: status range, settled exactly if terminal, no negative totals."""
    wrong = ~F.col("status").between(0, 4) | ((F.col("status") == 0) != F.col("settled_at").isNull()) | (F.coalesce("total_affected", F.lit(0)) < 0) | (F.coalesce("duration_seconds", F.lit(0)) < 0)
    return runs.where(wrong)
