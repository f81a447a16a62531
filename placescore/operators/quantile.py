"""Exact interpolated quantiles without a hot task.

Input rows are first counted per (group, feature, value), which partial
aggregation shrinks on the map side.  The counts are sorted once by (feature,
value) over range partitions, whatever the groups, so that a partition's number
(``PART``) is a coarse rank: even a group with most of the rows is spread over
all partitions.  The totals per (group, feature, partition) form a small table;
its prefix sums name the partition that holds a rank, and a running sum inside
that one piece names the value.  All features, groups and probabilities share
these steps.  Null groups count like any other; null and NaN values are skipped.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.session import cut_lineage

#: Column of the number of the range partition that a count lies in.
PART = "__part"


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., feature, value, weight): rows per distinct value."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    wide = df.select(*by, w.alias("__w"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot([*by, "__w"], list(cols), "feature", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*by, "feature", "value").agg(F.sum("__w").alias("weight"))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def ranged(counts: DataFrame) -> DataFrame:
    """Counts sorted by (feature, value) over range partitions, with the partition's number as ``PART``; the lineage is cut (jobs run here).

    Rows without a value, if there are any, come before a feature's values.
    """
    return cut_lineage(counts.repartitionByRange("feature", "value").withColumn(PART, F.spark_partition_id()))


def part_bounds(counts: DataFrame) -> DataFrame:
    """(feature, bounds): the least value of each of a feature's range partitions, in order, with its number; as many as there are partitions."""
    low = counts.where(F.col("value").isNotNull()).groupBy("feature", PART).agg(F.min("value").alias("low"))
    return low.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("low", F.col(PART).alias("part")))).alias("bounds"))


def part_of(value: Column, bounds: Column) -> Column:
    """The range partition that a value belongs to."""
    held = F.filter(bounds, lambda b: b["low"] <= value)
    return F.when(F.size(held) > 0, F.element_at(held, -1)["part"]).otherwise(F.element_at(bounds, 1)["part"])


def quantiles_of_ranged(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, prob, quantile) from ``ranged`` rows, in any order; a value may have several rows."""
    keys = [*by, "feature"]
    rows = counts.where(F.col("value").isNotNull()).select(*keys, PART, "value", "weight").repartition(*keys, PART)
    # Totals of the pieces: a row per group, feature and partition.
    pieces = rows.groupBy(*keys, PART).agg(F.sum("weight").alias("__n"), F.min("value").alias("__first"))
    w = Window.partitionBy(*keys)
    before = F.sum("__n").over(w.orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    pieces = pieces.select(*keys, PART, "__n", before.alias("__before"), F.sum("__n").over(w).alias("__all"),
                           F.lead("__first").over(w.orderBy(PART)).alias("__then"))
    ranks = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.struct(p.alias("p"), ((F.col("__all") - 1) * p).alias("h")))
    here = F.filter(ranks, lambda t: (F.floor(t["h"]) >= F.col("__before")) & (F.floor(t["h"]) < F.col("__before") + F.col("__n")))
    pieces = pieces.withColumn("__t", here).where(F.size("__t") > 0).drop("__n", "__all")
    # Inside a piece: rows before and up to each, and the next value.
    inside = Window.partitionBy(*keys, PART).orderBy("value")
    rows = rows.withColumns({"__upto": F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.lead("value").over(inside)})
    found = null_safe(rows, pieces, [*keys, PART])
    upto, h = F.col("__before") + F.col("__upto"), F.col("__h.h")
    found = found.withColumn("__h", F.explode("__t")).where((F.floor(h) >= upto - F.col("weight")) & (F.floor(h) < upto))
    above = F.when(F.ceil(h) < upto, F.col("value")).otherwise(F.coalesce("__next", "__then"))
    value = F.when(F.ceil(h) == F.floor(h), F.col("value")).otherwise(F.col("value") + (h - F.floor(h)) * (above - F.col("value")))
    return found.select(*keys, F.col("__h.p").alias("prob"), value.alias("quantile"))


def qcol(c: str, p: float) -> str:
    s = f"{p:.6f}".rstrip("0").rstrip(".").replace(".", "_")
    return f"{c}__q{s}"


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of ``cols`` at ``probs`` per group: columns ``{col}__q{p}``, one row per group.

    Without ``by`` there is always one row (all null without values); a group
    without any value has no row.  The counts are cut (jobs run here).
    """
    q = quantiles_of_ranged(ranged(value_counts(df, cols, by)), probs, by)
    aggs = [F.max(F.when((F.col("feature") == c) & (F.col("prob") == float(p)), F.col("quantile"))).alias(qcol(c, p)) for c in cols for p in probs]
    return q.groupBy(*by).agg(*aggs) if by else q.agg(*aggs)
