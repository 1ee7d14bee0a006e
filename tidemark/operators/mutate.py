"""Changes as projections of a labelled snapshot: the next snapshot is the old one with its eligible rows changed."""

from __future__ import annotations

import inspect
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.model import Anonymised, Entity, FactoryContext, Mode, Rule, Strategy

from .eligibility import LABEL


def purge(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col(LABEL) != "eligible").drop(LABEL)


def soft_delete(labelled: DataFrame, entity: Entity, now: datetime) -> DataFrame:
    hit = F.col(LABEL) == "eligible"
    out = labelled.withColumn(entity.is_deleted, F.when(hit, True).otherwise(F.col(entity.is_deleted)))
    if entity.deleted_at:
        out = out.withColumn(entity.deleted_at, F.when(hit, F.lit(now)).otherwise(F.col(entity.deleted_at)))
    return out.drop(LABEL)


def called(factory, value: object, context: FactoryContext | None) -> object:
    """A factory's value; one that takes a second argument is told what it is called for."""
    takes = [p for p in inspect.signature(factory).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]
    return factory(value, context) if len(takes) > 1 else factory(value)


def replacement(f: Anonymised, kind: T.DataType, context: FactoryContext | None = None) -> Column:
    """A field's new value.  Factories may return columns, which stay inside the engine; plain values are a literal
    or, per row, come from a vectorised function marked as not deterministic."""
    if f.factory is None:
        return F.lit(f.literal).cast(kind)
    if f.mode == Mode.STATIC:
        value = called(f.factory, None, context)
        return value if isinstance(value, Column) else F.lit(value).cast(kind)
    if f.mode == Mode.PER_ROW_WITH_ORIGINAL:
        value = called(f.factory, F.col(f.column), context)
        if isinstance(value, Column):
            return value.cast(kind)
        raise TypeError("a factory of original values gives a column; wrap Python code with per_value()")
    factory = f.factory

    def fresh(ids: pd.Series) -> pd.Series:
        return pd.Series([called(factory, None, context) for _ in ids])

    return F.pandas_udf(fresh, kind).asNondeterministic()(F.monotonically_increasing_id())


def per_value(function, kind: str = "string"):
    """A Python function of one value as a factory of original values, applied in Arrow batches."""

    def batch(values: pd.Series) -> pd.Series:
        return values.map(function)

    return lambda column: F.pandas_udf(batch, kind)(column)


def anonymise(labelled: DataFrame, entity: Entity, now: datetime, tenant: str | None = None) -> DataFrame:
    hit = F.col(LABEL) == "eligible"
    kinds = {f.name: f.dataType for f in labelled.schema}
    new = {f.column: F.when(hit, replacement(f, kinds[f.column], FactoryContext(entity.name, f.column, now, tenant))).otherwise(F.col(f.column)) for f in entity.fields}
    new[entity.anonymised_at] = F.when(hit, F.lit(now)).otherwise(F.col(entity.anonymised_at))
    return labelled.withColumns(new).drop(LABEL)


def apply(labelled: DataFrame, entity: Entity, rule: Rule, now: datetime, tenant: str | None = None) -> DataFrame:
    """The next snapshot under the rule's strategy; an exempt entity's is the same."""
    if rule.strategy == Strategy.PURGE:
        return purge(labelled)
    if rule.strategy == Strategy.SOFT_DELETE:
        return soft_delete(labelled, entity, now)
    if rule.strategy == Strategy.ANONYMISE:
        return anonymise(labelled, entity, now, tenant)
    return labelled.drop(LABEL)
