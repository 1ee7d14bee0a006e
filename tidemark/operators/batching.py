"""Oldest-first order and batches, without a global single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.model import Entity
from tidemark.session import stored


def oldest_first(eligible: DataFrame, entity: Entity, k: int) -> DataFrame:
    """The next batch: by anchor, rows without one last, then by id as text; planned as a distributed top-k."""
    rid = F.col(entity.record_id).cast("string")
    return eligible.withColumn("record_id", rid).orderBy(F.asc_nulls_last(entity.anchor), F.asc("record_id")).limit(k)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``_rn`` from 1 in global order: range partitions are sorted by themselves, and each adds how many
    rows the partitions before it hold (one number per partition)."""
    return _numbered(rows, [], order)


def _numbered(rows: DataFrame, groups: list[str], order) -> DataFrame:
    """``rows`` with ``_rn`` from 1 in order within each of ``groups``.  Range partitions are sorted by themselves, and
    each group's rows in a partition start after those of the partitions before; no task needs a whole group.  Bounds
    of range partitions are sampled anew in each evaluation, so the rows are stored with their places."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.asc_nulls_first(g) for g in groups), *order]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_at", 33)))
    sizes = dealt.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each partition and group in it
    before = Window.partitionBy(*[F.col(g) for g in groups] or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.struct("_part", *groups).alias("_of"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_of._part")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col("_of")[g])
    return dealt.join(starts, same).withColumn("_rn", F.col("_start") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_of", "_first", "_start")


def batches(eligible: DataFrame, entity: Entity, size: int) -> DataFrame:
    """``eligible`` with ``batch_no`` from 0 per tenant, each batch the oldest ``size`` rows left."""
    by = [F.asc_nulls_last(entity.anchor), F.asc("record_id")]
    rows = eligible.withColumn("record_id", F.col(entity.record_id).cast("string"))
    rows = _numbered(rows, [entity.tenant] if entity.tenant else [], by)
    return rows.withColumn("batch_no", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")
