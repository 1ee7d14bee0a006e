"""Counts from labels: one scan and one aggregation for all tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.model import Entity

from .eligibility import LABEL


def count_of(label: str) -> Column:
    return F.count_if(F.col(LABEL) == label)


def measure(labelled: DataFrame, entity: Entity, *more: str) -> DataFrame:
    """(tenant_id, affected, held, null_anchor) per tenant; a tenantless entity has one row with a null tenant."""
    tenant = F.col(entity.tenant) if entity.tenant else F.lit(None).cast("string")
    counts = {"affected": count_of("eligible"), "held": count_of("held"), "null_anchor": count_of("null_anchor")}
    counts |= {m: count_of(m) for m in more}
    return labelled.groupBy(tenant.alias("tenant_id")).agg(*[c.alias(n) for n, c in counts.items()])


def exempt(df: DataFrame, entity: Entity) -> DataFrame:
    """An exempt entity is reported with zero counts."""
    tenant = F.col(entity.tenant) if entity.tenant else F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    return df.select(tenant.alias("tenant_id")).distinct().select("tenant_id", zero.alias("affected"), zero.alias("held"), zero.alias("null_anchor"))
