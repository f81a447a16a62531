"""Relational joins.

Dimension-side joins carry no broadcast hint unless the side is bounded by
construction (e.g. one row per cluster label); AQE measures the rest at runtime
and broadcasts only what is actually small.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left equi-join on one or several keys (many-to-one)."""
    return left.join(right, on=on if isinstance(on, str) else list(on), how="left")


def checked_unique(df: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with its uniqueness on the key checked inside the plan: running it raises, and names a key, if a key repeats.

    Rows are counted by the aggregate that brings a key's row along, so the check
    needs no job of its own, and its shuffle on the key is the one that a join
    on the key needs anyway.
    """
    rest = [c for c in df.columns if c != on]
    one = df.groupBy(on).agg(F.count(F.lit(1)).alias("__rows"), F.first(F.struct(*rest) if rest else F.lit(0)).alias("__row"))
    message = F.concat(F.lit(f"Expected one row per {on} in the {name}; found duplicates (example): "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
    key = F.when(F.col("__rows") == 1, F.col(on)).otherwise(F.raise_error(message).cast(df.schema[on].dataType))
    return one.select(key.alias(on), *[F.col("__row")[c].alias(c) for c in rest])


def validated_left_join(left: DataFrame, right: DataFrame, on: str, validate: bool = True) -> DataFrame:
    """One-to-one left join; both sides are checked unique on the key while it runs (the run raises)."""
    return chain_left_joins(left, [right], on, validate)


def chain_left_joins(base: DataFrame, others: Sequence[DataFrame], on: str, validate: bool = True) -> DataFrame:
    """E2 chain: the base is checked once, each other side once; no job runs before the result does."""
    for df in (base, *others):
        if on not in df.columns:
            raise KeyError(f"Missing required column: {[on]}")
    if not validate:
        return reduce(lambda acc, o: acc.join(o, on=on, how="left"), others, base)
    sides = [checked_unique(o, on, f"right side {k} of the join") for k, o in enumerate(others, 1)]
    out = reduce(lambda acc, o: acc.join(o, on=on, how="left"), sides, checked_unique(base, on, "left side of the join"))
    return out.select(on, *[c for c in base.columns if c != on], *[c for o in others for c in o.columns if c != on])


def full_outer_slices(slices: Sequence[DataFrame], on: str) -> DataFrame:
    """Full outer join of column slices on the key; later duplicates of a
    non-key column are dropped (first slice wins).

    The slices are stacked and one aggregate per key brings their columns
    together: one shuffle for any number of slices.  A slice has one row per key
    (the run raises and names a key if not); null keys are one key.
    """
    taken, parts = {on}, []
    for k, s in enumerate(slices):
        own = [c for c in s.columns if c not in taken]
        taken |= set(own)
        parts.append(s.select(on, *own, F.lit(k).alias("__slice")))
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    columns = [c for c in every.columns if c not in (on, "__slice")]
    most = F.greatest(F.lit(0), *[F.count_if(F.col("__slice") == k) for k in range(len(slices))])
    out = every.groupBy(on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns], most.alias("__most"))
    message = F.concat(F.lit(f"Expected one row per {on} in each slice; found duplicates (example): "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
    key = F.when(F.col("__most") == 1, F.col(on)).otherwise(F.raise_error(message).cast(every.schema[on].dataType))
    return out.select(key.alias(on), *columns)


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
    """A10: rename every non-key column to ``{name}{suffix}``."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def dim_join(df: DataFrame, dim: DataFrame, on: str | Sequence[str], bounded: bool = False) -> DataFrame:
    """E5: many-to-one dimension join; ``bounded=True`` (e.g. one row per cluster
    label, k fixed by the model) adds an explicit broadcast."""
    d = F.broadcast(dim) if bounded else dim
    return df.join(d, on=on if isinstance(on, str) else list(on), how="left")

