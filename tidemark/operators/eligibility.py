"""One label per row, from which every count and every change follows.

``out_of_scope``: another tenant, or another subject in an erasure; ``done``: already deleted or anonymised;
``null_anchor``, ``retained``, ``held``, ``eligible``.  Holds are joined as distinct keys, so several holds on a record
count once; the join is an equi-join that the optimizer broadcasts only if the holds are small.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import ZERO, cutoff, effective_period, erasure_cutoff
from tidemark.functions.text import record_id
from tidemark.plans.model import Entity, Rule, Strategy

from .holds import active_holds

LABEL = "_label"


def strategy_open(entity: Entity, strategy: Strategy) -> Column:
    """Rows that the strategy can still act on; an unknown deletion flag is no open row."""
    if strategy == Strategy.SOFT_DELETE:
        return F.coalesce(~F.col(entity.is_deleted), F.lit(False))
    if strategy == Strategy.ANONYMISE:
        return F.col(entity.anonymised_at).isNull()
    return F.lit(strategy == Strategy.PURGE)


def of_subject(entity: Entity, subject: object) -> Column:
    """Rows of which any subject column equals the subject."""
    return F.coalesce(reduce(or_, (F.col(c) == F.lit(subject) for c in entity.subjects)), F.lit(False))


def held_flag(df: DataFrame, entity: Entity, holds: DataFrame, at: datetime) -> DataFrame:
    """``df`` with the boolean ``_held``; a tenantless entity's holds carry no tenant."""
    keys = active_holds(holds.where(F.col("entity_id") == entity.entity_id), at)
    keys = keys.where("tenant_id is not null" if entity.tenant else "tenant_id is null")
    keys = keys.select(F.col("record_id").alias("_hold_record"), F.col("tenant_id").alias("_hold_tenant"), F.lit(True).alias("_hold")).distinct()
    on = record_id(F.col(entity.record_id), entity.record_id_type) == F.col("_hold_record")
    if entity.tenant:
        on &= F.col(entity.tenant) == F.col("_hold_tenant")
    return df.join(keys, on, "left").withColumn("_held", F.coalesce("_hold", F.lit(False))).drop("_hold_record", "_hold_tenant", "_hold")


def countable(df: DataFrame, entity: Entity, rule: Rule, now: datetime, *, tenant: str | None = None, subject: object = None) -> DataFrame:
    """The rows of ``df`` that a pass counts or changes: in scope, open, and without an anchor or past the cutoff.  All
    are plain comparisons below every join, so they reach the Parquet scan."""
    erasing = subject is not None
    limit = erasure_cutoff(now, rule.legal_minimum) if erasing else cutoff(now, rule.period, rule.legal_minimum)
    if tenant is not None and entity.tenant:
        df = df.where(F.col(entity.tenant) == F.lit(tenant))
    if erasing:
        df = df.where(reduce(or_, (F.col(c) == F.lit(subject) for c in entity.subjects)))
    if rule.strategy == Strategy.SOFT_DELETE:
        df = df.where(F.col(entity.is_deleted) == F.lit(False))
    elif rule.strategy == Strategy.ANONYMISE:
        df = df.where(F.col(entity.anonymised_at).isNull())
    elif rule.strategy != Strategy.PURGE:
        df = df.where(F.lit(False))
    return df if limit is None else df.where(F.col(entity.anchor).isNull() | (F.col(entity.anchor) < F.lit(limit)))


def disposition(df: DataFrame, entity: Entity, rule: Rule, now: datetime, holds: DataFrame, *, hold_at: datetime | None = None, tenant: str | None = None, subject: object = None) -> DataFrame:
    """``df`` with its label.  ``tenant``: one tenant's pass, else all tenants at once; ``subject``: an erasure, whose
    cutoff is the legal minimum alone."""
    erasing = subject is not None
    limit = erasure_cutoff(now, rule.legal_minimum) if erasing else cutoff(now, rule.period, rule.legal_minimum)
    scope = F.lit(True)
    if tenant is not None and entity.tenant:
        scope &= F.coalesce(F.col(entity.tenant) == F.lit(tenant), F.lit(False))
    if erasing:
        scope &= of_subject(entity, subject)
    label = F.when(~scope, "out_of_scope").when(~strategy_open(entity, rule.strategy), "done")
    if limit is not None:
        label = label.when(F.col(entity.anchor).isNull(), "null_anchor").when(F.col(entity.anchor) >= F.lit(limit), "retained")
    label = label.when(F.col("_held"), "held").otherwise("eligible")
    return held_flag(df, entity, holds, hold_at or now).withColumn(LABEL, label).drop("_held")


def disposition_by_tenant(df: DataFrame, entity: Entity, rules: DataFrame, rule: Rule, now: datetime, holds: DataFrame, *, hold_at: datetime | None = None) -> DataFrame:
    """``df`` with its label where each tenant has a period of its own: ``rules`` (tenant_id, period_seconds) is a row for
    a tenant; other tenants have the period of ``rule``, which says the strategy and the legal minimum for all.  One
    pass over the table serves all tenants."""
    floor = int((rule.legal_minimum or ZERO).total_seconds())
    own = rules.select(F.col("tenant_id").alias("_rule_tenant"), F.greatest("period_seconds", F.lit(floor)).alias("_period"))
    usual = int(effective_period(rule.period, rule.legal_minimum).total_seconds())
    rows = df.join(own, F.col(entity.tenant) == F.col("_rule_tenant"), "left")
    limit = F.timestamp_micros(F.unix_micros(F.lit(now)) - F.coalesce("_period", F.lit(usual)) * 1_000_000)
    label = F.when(~strategy_open(entity, rule.strategy), "done").when(F.col(entity.anchor).isNull(), "null_anchor").when(F.col(entity.anchor) >= limit, "retained")
    rows = held_flag(rows, entity, holds, hold_at or now).withColumn(LABEL, label.when(F.col("_held"), "held").otherwise("eligible"))
    return rows.drop("_held", "_rule_tenant", "_period")


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(LABEL) == label)
