"""Hierarchical median imputation (H1-H3) and group-value alignment.

The panel is read once to count its values per finest cell (all level keys) and
column.  Inside a cell every missing value gets the same fill at every level, so
the panel filled so far is those counts plus, per cell, as many copies of the
fill as values were missing.  The counts are sorted once; each level's medians are
exact quantiles over them and the fills so far (``operators/quantile.py``: no task
holds a whole group), and the last step joins one fill per (cell, column) back to
the panel.  Keys are null-safe throughout.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from placescore.operators.quantile import PART, null_safe, part_bounds, part_of, qcol, quantiles, quantiles_of_ranged, ranged
from placescore.session import store

DEFAULT_LEVELS: tuple[tuple[str, ...], ...] = (("unit_type", "state"), ("state",), ("unit_type",))


def imputation_targets(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """H3: numeric, non-boolean columns not in the id/excluded list."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) and f.name not in ex]


def group_medians(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with the median of each column, named ``{col}__med``."""
    q = quantiles(df, cols, [0.5], by=by)
    return q.select(*by, *[F.col(qcol(c, 0.5)).alias(f"{c}__med") for c in cols])


def align_group_values(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-group values to every row (null key matches null key)."""
    if not by:
        return df.crossJoin(F.broadcast(stats))
    return null_safe(df, stats, by, "left")


def _fills(df: DataFrame, cols: Sequence[str], levels: Sequence[Sequence[str]]) -> DataFrame:
    """(cell keys..., one ``{col}__fill`` per column) for every cell."""
    cell = list(dict.fromkeys(k for lv in levels for k in lv))
    # One pass: value counts of the cells, and the missing ones as rows without a value; sorted once for all levels.
    wide = df.select(*cell, *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(cell, list(cols), "feature", "value").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    counts = ranged(long.groupBy(*cell, "feature", "value").agg(F.count(F.lit(1)).alias("weight")))
    known = counts.where(F.col("value").isNotNull()).select(*cell, "feature", "value", "weight", PART)
    gaps = counts.where(F.col("value").isNull()).join(F.broadcast(part_bounds(counts)), "feature", "left")  # as many bounds as partitions
    fills = gaps.select(*cell, "feature", "value", "weight", F.lit(None).cast("int").alias(PART), "bounds")
    for n, keys in enumerate([*levels, ()]):
        so_far = known.unionByName(fills.where(F.col("value").isNotNull()).drop("bounds")) if n else known
        medians = quantiles_of_ranged(so_far, [0.5], list(keys)).select(*keys, "feature", F.col("quantile").alias("__m"))
        fills = null_safe(fills, medians, [*keys, "feature"], "left").select(
            *cell, "feature", F.coalesce("value", "__m").alias("value"), "weight", F.coalesce(PART, part_of(F.col("__m"), F.col("bounds"))).alias(PART), "bounds")
        if n < len(levels):
            fills = store(fills)  # a row per cell and column: small, and read by the next level
            if fills.where(F.col("value").isNull()).isEmpty():
                break  # broader levels have nothing left to fill
    return fills.groupBy(*cell).agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"{c}__fill") for c in cols])


def hierarchical_median_impute(df: DataFrame, cols: Sequence[str],
                               levels: Sequence[Sequence[str]] = DEFAULT_LEVELS,
                               flag_col: str | None = "contains_imputed") -> DataFrame:
    """H1+H2: fill each column from ever broader group medians, then the global one.

    Each level's medians are those of the table already filled by the levels
    before.  ``flag_col`` (int 0/1) marks rows where any target was missing and
    got a value.  Jobs run here: the counts and one small table per level are stored.
    """
    cols = list(cols)
    cell = list(dict.fromkeys(k for lv in levels for k in lv))
    fills = _fills(df, cols, levels)
    j = align_group_values(df, fills, cell)
    out = [F.coalesce(F.when(~F.isnan(c), F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c), F.col(f"{c}__fill")).alias(c)
           if c in cols else F.col(c) for c in df.columns]
    if flag_col:
        lost = [((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) & F.col(f"{c}__fill").isNotNull()).cast("int") for c in cols]
        out.append(F.greatest(F.lit(0), F.lit(0), *lost).alias(flag_col))
    return j.select(*out)
