"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the budget over its present size.  Each document's number of
copies inverts the Poisson distribution of that mean at a uniform number hashed from the seed, the document's id and its
text, so it depends on nothing but them.  Copies are exploded and shuffled by a hash of (seed, id, text, copy).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, cut, fresh

#: Sources up to this number are broadcast with their rates (a few kB each at most); beyond it they are joined by
#: shuffle, each in so many parts that no source's documents meet in one task.
BROADCAST_SOURCES = 2_000
PARTS = 64
#: A larger mean is a sum of independent parts, so that exp(-mean) stays a normal number.
PART = 500.0
_UNIT = float(2**52)


def uniform(*what: Column) -> Column:
    """A number in (0, 1) from the md5 of what is given: 52 bits and a half."""
    digits = F.substring(F.md5(F.concat_ws(":", *what).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array, far enough that what is beyond is below the step of the uniforms."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step)["c"]


def rates(docs: DataFrame, *, source_col: str, size: Column, weights: dict | None = None, temperature: float = 1.0, budget: float = 1.0) -> DataFrame:
    """(source, mean, parts, cdf) per source.  Without ``weights`` a source's target is its size to the power
    ``temperature``; with them, its weight, and a source without one has rate 0.  ``budget``: output size over input
    size.  A null source is a source of its own, called by the key null in ``weights``.  Targets are added up as shares
    of the largest, exactly, so neither their scale nor the order of rows matters.  A weight that is negative or not
    finite is an error, and so are weights of which no source of a table with rows has one."""
    if weights is not None and not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    sizes = docs.groupBy(col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size")).where("size > 0")
    if weights is None:
        target = F.pow("size", F.lit(float(temperature)))
    else:
        target = F.lit(0.0)
        for key, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(key)), F.lit(float(w))).otherwise(target)
    aimed = cut(sizes.withColumn("target", target))
    everything, most = aimed.agg(F.sum(F.col("size").cast("decimal(38,0)")), F.max("target")).first()
    if everything is not None and not most:
        raise ValueError("no source of the table has a positive weight")
    share = F.col("target") / F.lit(float(most or 1))
    total = aimed.agg(F.sum(share.cast("decimal(38,18)"))).first()[0]
    mean = F.lit(float(budget)) * F.lit(float(everything or 0)) * share / F.lit(float(total or 1)) / F.col("size")
    out = aimed.select("source", mean.alias("mean"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int")
    return out.withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("mean") / F.col("parts")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, temperature: float = 1.0, budget: float = 1.0, seed: int = 0, keep_order_key: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson count says, shuffled globally: sorted by hash over all
    partitions.  With ``keep_order_key`` the columns (copy, order_key) follow; columns of ``docs`` so called are
    replaced by them.  Other names of columns are no matter.

    A source's size is its texts' number of characters, each text counting one at least, so null and empty texts
    have a size.  A row's uniform number comes from its id and its text (null as empty), so rows that share an id but
    not a text have their own; of rows equal in both each is copied, alike.  Rows with a null id are numbered by their
    place in ``docs``, which should therefore be a stored table; each has its own number, equal texts too.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    side, key, copy, order, part = fresh(docs, "_side", "_key", "_copy", "_order", "_part")
    size = F.greatest(F.coalesce(F.length(col(text_col)), F.lit(0)), F.lit(1))
    by_source = cut(rates(docs, source_col=source_col, size=size, weights=weights, temperature=temperature, budget=budget))
    by_source = by_source.select(F.struct(*by_source.columns).alias(side))
    same = col(source_col).eqNullSafe(F.col(side)["source"])
    place = F.when(col(id_col).isNull(), F.monotonically_increasing_id().cast("string"))
    own = F.concat_ws(":", F.coalesce(col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary")), place)
    keyed = docs.select(*[col(c) for c in docs.columns], own.alias(key))
    if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(by_source), same)
    else:
        dealt = by_source.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        mine = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        joined = keyed.join(dealt, (mine == F.col(part)) & same)
    at = lambda k: uniform(F.lit(str(seed)), F.col(key), k.cast("string"))
    below = lambda u: F.size(F.filter(F.col(side)["cdf"], lambda c: c < u))
    count = F.aggregate(F.sequence(F.lit(1), F.col(side)["parts"]), F.lit(0), lambda n, k: n + below(at(k)))
    copies = joined.withColumn(copy, count).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copy) - 1)))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(key), F.col(copy).cast("string")).cast("binary"))
    names = [c for c in docs.columns if not (keep_order_key and c.lower() in ("copy", "order_key"))]
    out = copies.select(*[col(c) for c in names], F.col(copy), hashed.alias(order))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.repartitionByRange(n, order).sortWithinPartitions(order)
    more = [F.col(copy).alias("copy"), F.col(order).alias("order_key")] if keep_order_key else []
    return dealt.select(*[col(c) for c in names], *more)
