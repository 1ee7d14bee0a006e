"""Legal holds: which are active, who is protected, placing and lifting them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.schemas import HOLDS


def active_holds(holds: DataFrame, at: datetime) -> DataFrame:
    """Active from its creation on, until it expires or is removed, those times excluded."""
    t = F.lit(at)
    open_ = lambda c: F.col(c).isNull() | (F.col(c) > t)
    return holds.where((F.col("created_at") <= t) & open_("expires_at") & open_("removed_at"))


def list_active(holds: DataFrame, at: datetime) -> DataFrame:
    return active_holds(holds, at).orderBy("entity_id", "record_id", "hold_id")


def held_targets(targets: DataFrame, holds: DataFrame, at: datetime) -> DataFrame:
    """The distinct targets (entity_id, record_id, tenant_id) with an active hold; null tenants match null ones."""
    keys = active_holds(holds, at).select("entity_id", "record_id", "tenant_id").distinct()
    on = (F.col("t.entity_id") == F.col("h.entity_id")) & (F.col("t.record_id") == F.col("h.record_id")) & F.col("t.tenant_id").eqNullSafe(F.col("h.tenant_id"))
    return targets.dropDuplicates(["entity_id", "record_id", "tenant_id"]).alias("t").join(keys.alias("h"), on, "left_semi")


def has_active(holds: DataFrame, entity_id: str, record_id: str, tenant_id: str | None, at: datetime) -> bool:
    own = active_holds(holds, at).where((F.col("entity_id") == entity_id) & (F.col("record_id") == record_id))
    return not own.where(F.col("tenant_id").eqNullSafe(F.lit(tenant_id))).limit(1).isEmpty()


def check_ownership(tenant_id: str | None, tenanted: bool) -> None:
    if tenanted != (tenant_id is not None):
        raise ValueError("a tenanted record needs its tenant, a tenantless one must have none")


def place(holds: DataFrame, targets: DataFrame, *, entity_id: str, record_id: str, tenant_id: str | None, reason: str, now: datetime, expires_at: datetime | None = None) -> DataFrame:
    """``holds`` with a new one, if ``targets`` (record_id, tenant_id) has the record."""
    if not reason.strip() or (expires_at is not None and expires_at <= now):
        raise ValueError("a hold needs a reason and must not have expired")
    if targets.where((F.col("record_id") == record_id) & F.col("tenant_id").eqNullSafe(F.lit(tenant_id))).limit(1).isEmpty():
        raise LookupError("no such record")
    row = (str(uuid.uuid4()), entity_id, record_id, tenant_id, reason, now, expires_at, None)
    return holds.unionByName(holds.sparkSession.createDataFrame([row], HOLDS))


def lift(holds: DataFrame, hold_id: str, now: datetime) -> DataFrame:
    """``holds`` with one removed; one that isn't there or already was is an error."""
    own = (F.col("hold_id") == hold_id) & F.col("removed_at").isNull()
    if holds.where(own).limit(1).isEmpty():
        raise LookupError("no such hold")
    return holds.withColumn("removed_at", F.when(own, F.lit(now)).otherwise(F.col("removed_at")))


def guarded_deletion(targets: DataFrame, holds: DataFrame, at: datetime, delete: Callable[[], None]) -> str:
    """All or nothing: ``Protected`` without a call if any target is held, else ``Executed`` after it."""
    if not held_targets(targets, holds, at).limit(1).isEmpty():
        return "Protected"
    delete()
    return "Executed"


def deletion_outcomes(targets: DataFrame, holds: DataFrame, at: datetime, request: str = "request_id") -> DataFrame:
    """The outcome of many deletion requests at once: (request, targets, held, outcome)."""
    keys = active_holds(holds, at).select("entity_id", "record_id", "tenant_id", F.lit(1).alias("_held")).distinct()
    on = (F.col("t.entity_id") == F.col("h.entity_id")) & (F.col("t.record_id") == F.col("h.record_id")) & F.col("t.tenant_id").eqNullSafe(F.col("h.tenant_id"))
    joined = targets.dropDuplicates([request, "entity_id", "record_id", "tenant_id"]).alias("t").join(keys.alias("h"), on, "left")
    held = F.sum(F.coalesce("_held", F.lit(0)))
    return joined.groupBy(request).agg(F.count("*").alias("targets"), held.alias("held"), F.when(held > 0, "Protected").otherwise("Executed").alias("outcome"))
