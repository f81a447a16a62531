"""Presentation-ready result tables (K1-K6); drawing is not built.

All inputs are recommendation outputs (scores on 0-5).  User preferences are a
handful of driver-side numbers, so they become a literal-map column expression
(``create_map`` + ``element_at``) -- no join with a made-up table.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placescore.functions.expr import clip, fmt2, round_half_even
from placescore.operators.window import sort_rows, top_n


def _pref_map(prefs: Mapping[str, float]) -> Column:
    return F.create_map(*[x for k, v in prefs.items() for x in (F.lit(k), F.lit(float(v)))])


def _ranked(rec: DataFrame, score: str, key: str) -> DataFrame:
    """The recommendation rows with their place; a recommendation is a limited frame, so one window task is bounded."""
    return rec.withColumn("__place", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), F.asc(key))))


def _best_long(rec: DataFrame, dims: Sequence[str], key: str, score: str) -> DataFrame:
    """(key, dimension, value, order) of the best match."""
    long = top_n(rec, score, key, 1).unpivot([key], list(dims), "dimension", "__v")
    order = F.array_position(F.array(*[F.lit(d) for d in dims]), F.col("dimension"))
    return long.withColumn("__order", order)


def profile_compare(rec: DataFrame, prefs: Mapping[str, float], dims: Sequence[str], key: str,
                    score: str = "recommendation_score") -> DataFrame:
    """K1: best match vs user, one row per dimension (both rounded to 2)."""
    return _best_long(rec, dims, key, score).select(
        key, "dimension", round_half_even("__v", 2).alias("unit_value"),
        round_half_even(F.element_at(_pref_map(prefs), F.col("dimension")), 2).alias("user_value"))


def contributions(rec: DataFrame, prefs: Mapping[str, float], dims: Sequence[str], key: str,
                  score: str = "recommendation_score") -> DataFrame:
    """K2: gap = |unit - user|; contribution = max(0, 100 (1 - gap/5)) * user / 100; largest first."""
    u = F.element_at(_pref_map(prefs), F.col("dimension"))
    gap = F.abs(F.col("__v") - u)
    contrib = F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - gap / 5.0)) * u / 100.0
    out = _best_long(rec, dims, key, score).select(
        key, "dimension", round_half_even(contrib, 2).alias("contribution"), round_half_even(gap, 2).alias("gap"),
        round_half_even(u, 2).alias("user_value"), round_half_even("__v", 2).alias("unit_value"))
    return sort_rows(out, ["contribution", "dimension"], ascending=[False, True])


def map_frame(rec: DataFrame, key: str, lat: str, lon: str, color: str, score_cols: Sequence[str],
              score: str = "recommendation_score", stars: int = 5) -> DataFrame:
    """K3: coordinates, colour value, its range and the top-``stars`` flag, from one pass.

    A numeric colour is rounded to 2 with the range 0-5 for score columns, else
    the observed one (empty -> (0, 1), flat -> lo + 1e-6).  A label colour (text)
    is kept as ``color_label`` with a null value and the range (0, 1).
    """
    label = isinstance(rec.schema[color].dataType, StringType)
    x = F.lit(None).cast("double") if label else F.col(color).cast("double")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if label:
        lo, hi = F.lit(0.0), F.lit(1.0)
    elif color in score_cols or color == score:
        lo, hi = F.lit(0.0), F.lit(5.0)
    else:
        lo = F.coalesce(F.min("__x").over(every), F.lit(0.0))
        hi = F.coalesce(F.max("__x").over(every), F.lit(1.0))
        hi = F.when(hi <= lo, lo + 1e-6).otherwise(hi)
    out = _ranked(rec.withColumn("__x", x), score, key)
    return out.select(key, F.col(lat).alias("lat"), F.col(lon).alias("lon"), round_half_even("__x", 2).alias("color_value"),
                      *([F.col(color).alias("color_label")] if label else []),
                      lo.alias("range_lo"), hi.alias("range_hi"), (F.col("__place") <= stars).alias("is_top"))


def cluster_profile(rec: DataFrame, prefs: Mapping[str, float], dims: Sequence[str], key: str, cluster: str,
                    top_n: int = 25, score: str = "recommendation_score") -> DataFrame:
    """K4: median of each dimension over the top-n members sharing the best
    match's cluster, next to the user's value, long form (feature, series, value)."""
    best = Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = _ranked(rec, score, key).where(F.col("__place") <= top_n).withColumn("__best", F.first(cluster).over(best))
    members = top.where(F.col(cluster).eqNullSafe(F.col("__best")))
    med = members.agg(*[F.median(d).alias(d) for d in dims])  # over at most top_n rows
    pair = lambda f, name, v: F.struct(F.lit(f).alias("feature"), F.lit(name).alias("series"), round_half_even(v, 2).alias("value"))
    rows = [pair(d, "Cluster Median", F.col(d)) for d in dims] + [pair(d, "User Preferences", F.lit(float(prefs[d]))) for d in dims if d in prefs]
    return med.select(F.inline(F.array(*rows)))


def detail_table(rec: DataFrame, key: str, label_cols: Sequence[str], score_cols: Sequence[str], top_n: int = 10,
                 score: str = "recommendation_score") -> DataFrame:
    """K5: top-n rows, ordered columns, numbers as two-decimal text ("—" if missing)."""
    top = rec.orderBy(F.desc_nulls_last(score), F.asc(key)).limit(top_n)
    return top.select(key, *label_cols, fmt2(score).alias(score), *[fmt2(c).alias(c) for c in score_cols])


def feature_map(rec: DataFrame, key: str, lat: str, lon: str, features: Sequence[str]) -> DataFrame:
    """K6: long (lat, lon, feature, value) frame for a feature selector."""
    return rec.select(key, F.col(lat).alias("lat"), F.col(lon).alias("lon"), *features).unpivot(
        [key, "lat", "lon"], list(features), "feature", "value")
