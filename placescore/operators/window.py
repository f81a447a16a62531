"""Filters, constraints, windows, sort/limit, set operations."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ D

def drop_region(df: DataFrame, code: str, col: str = "state") -> DataFrame:
    """Drop rows whose trimmed, upper-cased code equals ``code``; missing kept."""
    if col not in df.columns:
        return df
    return df.where(F.coalesce(F.upper(F.trim(F.col(col))), F.lit("")) != F.lit(code.strip().upper()))


def drop_missing(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    """D2 (``how="any"``) and D6 (``how="all"``)."""
    return df.dropna(how=how, subset=list(subset))


def month_range(df: DataFrame, month: str) -> DataFrame:
    """D3."""
    return df.where(F.col(month).between(1, 12))


def lookup_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup."""
    return df.where(F.col(key) == F.lit(value))


def one_row(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, as a frame of exactly one row (a job looks it up); no or several rows raise."""
    rows = lookup_key(df, key, value).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{key} = {value!r}: {'no row' if not rows else 'several rows'}")
    return df.sparkSession.createDataFrame(rows, df.schema)


# ------------------------------------------------------------------ G

def duplicate_key_report(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """G1 query form: every key that occurs more than once, with its count."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, key: str | Sequence[str], examples: int = 10) -> None:
    """G1: raise with up to ``examples`` offending keys; missing key column raises."""
    keys = [key] if isinstance(key, str) else list(key)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"Missing required column: {missing}")
    bad = duplicate_key_report(df, keys).limit(examples).collect()
    if bad:
        ex = [tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]] for r in bad]
        raise ValueError(f"Expected one row per {keys}; found duplicates (examples): {ex}")


def flag_duplicates(df: DataFrame, key: str | Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """Flag every member of a duplicated key.

    Count per key (map-side combined) joined back on the key, instead of a
    window: a key holding a third of all rows would put them all in one
    window task, while the join side is split by AQE's skew-join handling.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cnt = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(out))
    r = cnt.select(*[F.col(k).alias(f"__k_{k}") for k in keys], out)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(r, cond, "left").drop(*[f"__k_{k}" for k in keys])


def dedupe(df: DataFrame, key: str | Sequence[str], order: Sequence[str], keep: str = "first",
           columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key; the survivor is the first (``keep="first"``,
    ascending, missing first) or last (``keep="last"``) row in ``order``.

    ``columns`` names what is wanted of the survivor (default: everything), so
    that the scan reads, and the aggregate carries, no more than that.

    An aggregate (``min_by``/``max_by`` over a struct of the order columns)
    rather than a window: partial aggregation reduces every key to one row per
    partition before the shuffle, so a hot key never gathers in one task.
    Never a bare ``dropDuplicates``: the survivor is always defined.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wanted = list(df.columns) if columns is None else [*keys, *[c for c in columns if c not in keys]]
    rest = [c for c in wanted if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    o = F.struct(*[F.col(c) for c in order])
    pick = F.min_by(row, o) if keep == "first" else F.max_by(row, o)
    g = df.groupBy(*keys).agg(pick.alias("__row"))
    return g.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*wanted)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """``row_number() <= k`` per group (Spark adds a partial WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """Global top-n, descending, missing last, key tie-break (TakeOrderedAndProject)."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(key)).limit(n)


def sort_rows(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Global sort by several columns, missing values last in either direction."""
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(up) != len(by):
        raise ValueError("one direction for each sort column")
    return df.orderBy(*[F.asc_nulls_last(c) if a else F.desc_nulls_last(c) for c, a in zip(by, up)])


def union_all(frames: Sequence[DataFrame], schema=None) -> DataFrame:
    """Row concat by name; no frames -> typed empty frame from ``schema``."""
    if not frames:
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession().createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """G10."""
    return df.unpivot(list(ids), list(values), name, value)


def with_level(df: DataFrame, level: str, col: str = "level") -> DataFrame:
    """G11."""
    return df.withColumn(col, F.lit(level))
