"""Aggregations (F1-F20) and the global/grouped statistics helpers.

Global statistics are a one-row aggregate attached with
``crossJoin(broadcast(one_row))`` -- a provably one-row broadcast -- instead of a
window without ``partitionBy`` (which would move every row into one task).

Quantiles are in ``operators/quantile.py``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions.expr import col, safe_div
from placescore.operators.window import sort_rows


# ---------------------------------------------------------------- helpers

def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row (broadcast of one row)."""
    return df.crossJoin(F.broadcast(one_row))


# ---------------------------------------------------------------- F1-F7

def group_sum(df: DataFrame, by: Sequence[str], cols: Sequence[str], dropna_keys: bool = True) -> DataFrame:
    """group sum; an all-missing group sums to missing (not 0)."""
    d = df.dropna(subset=list(by)) if dropna_keys else df
    return d.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])


def group_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str], dropna_keys: bool = True) -> DataFrame:
    """group mean of several columns (missing skipped)."""
    d = df.dropna(subset=list(by)) if dropna_keys else df
    return d.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def weighted_mean_expr(value: str | Column, weight: str | Column) -> Column:
    """mean over rows with value and weight present and weight > 0; none -> null."""
    v, w = col(value), col(weight)
    ok = v.isNotNull() & w.isNotNull() & (w > 0)
    return safe_div(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def weighted_rollup(df: DataFrame, by: Sequence[str], measures: Sequence[str], weight: str,
                    row_id: str | None = None) -> DataFrame:
    """all weighted means in one aggregate, plus distinct row count and weight total, in order of the keys."""
    aggs = [weighted_mean_expr(m, weight).alias(m) for m in measures]
    if row_id:
        aggs.insert(0, F.count_distinct(row_id).alias("n_rows"))
    aggs.insert(1 if row_id else 0, F.sum(weight).alias("total_weight"))
    return sort_rows(df.groupBy(*by).agg(*aggs), by)


def group_mode(df: DataFrame, by: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """most common non-missing value per group; ties -> smallest value.

    Two-level aggregate: count per (group, value) (map-side combined), then
    ``min_by`` over (count desc, value) per group -- no group is collected.
    """
    out = out or value
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(
        F.min_by(F.col(value), F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(out))


def distinct_count(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """F6."""
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(f"n_distinct_{c}") for c in cols])


# Days per month with a 28-day February (month 1..12).
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def month_days_expr(month: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in MONTH_DAYS]), col(month).cast("int"))


def annual_summary(df: DataFrame, station: str, month: str, temp: str, prcp: str, snow: str | None,
                   order_col: str | None = None) -> DataFrame:
    """F7 + D3 + D5: station-year summary from monthly normals.

    Day-weighted mean temperature over months with a value; January/July value =
    first non-missing by ``order_col`` (file order; month when absent); totals;
    months present; complete-year flag.  Stations with no temperature or no
    precipitation at all are dropped (D5).
    """
    d = df.where(F.col(month).between(1, 12))
    order = F.col(order_col) if order_col else F.col(month)
    wd = month_days_expr(month).cast("double")
    tv = F.col(temp)
    first_of = lambda m: F.min_by(tv, F.when((F.col(month) == m) & tv.isNotNull(), order))
    aggs = [
        safe_div(F.sum(F.when(tv.isNotNull(), tv * wd)), F.sum(F.when(tv.isNotNull(), wd))).alias("avg_annual_temp"),
        first_of(1).alias("jan_avg_temp"),
        first_of(7).alias("jul_avg_temp"),
        F.sum(prcp).alias("annual_precipitation"),
        (F.sum(snow) if snow else F.lit(None).cast("double")).alias("annual_snowfall"),
        F.count_distinct(F.col(month)).alias("n_months_available"),
        F.count(tv).alias("__nt"),
        F.count(F.col(prcp)).alias("__np"),
    ]
    s = d.groupBy(station).agg(*aggs)
    s = s.where((F.col("__nt") > 0) & (F.col("__np") > 0)).drop("__nt", "__np")
    return s.withColumn("has_complete_year", F.col("n_months_available") == 12)


# ---------------------------------------------------------------- F10, F13

def shape_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), tail_z: float = 4.0) -> DataFrame:
    """bias-corrected skewness (G1) and excess kurtosis (G2), plus tail share.

    Spark's ``skewness``/``kurtosis`` are population moments; the sample
    corrections are applied as expressions.  Tail share = ``100 * mean(|x| > tail_z)``.
    """
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__n"), F.skewness(c).alias(f"{c}__g1"), F.kurtosis(c).alias(f"{c}__g2"),
                 (F.avg(F.when(F.col(c).isNotNull(), (F.abs(F.col(c)) > tail_z).cast("double"))) * 100.0).alias(f"{c}__tail")]
    g = df.groupBy(*by) if by else df
    s = g.agg(*aggs)
    outs = list(by)
    for c in cols:
        n = F.col(f"{c}__n").cast("double")
        g1, g2 = F.col(f"{c}__g1"), F.col(f"{c}__g2")
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        outs += [skew.alias(f"{c}_skew"), kurt.alias(f"{c}_kurt"), F.col(f"{c}__tail").alias(f"{c}_tail_pct")]
    return s.select(*outs)


def iqr_expr(p25: str | Column, p75: str | Column) -> Column:
    """interquartile range, zero -> null."""
    return F.nullif(col(p75) - col(p25), F.lit(0.0))


# ---------------------------------------------------------------- F17-F20

def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """missing count and percent per column, most-missing first."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.unpivot(["__rows"], cols, "column_name", "missing_count")
    out = long.select(
        "column_name",
        F.col("missing_count").cast("long").alias("missing_count"),
        (F.col("missing_count") * 100.0 / F.nullif(F.col("__rows"), F.lit(0))).alias("missing_pct"),
    )
    return sort_rows(out, ["missing_count", "column_name"], ascending=[False, True])


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """equal-width histogram per column (min/max one-row aggregate, then counts).

    Output long form ``(column_name, bin, bin_lo, bin_hi, n)``; the maximum
    falls in the last bin.  Bins with no rows are not emitted.
    """
    mm = df.agg(*[F.min(c).cast("double").alias(f"{c}__min") for c in cols],
                *[F.max(c).cast("double").alias(f"{c}__max") for c in cols])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols])).alias("__kv")) \
          .select(F.col("__kv.k").alias("column_name"), F.col("__kv.v").alias("value"))
    bounds = mm.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"{c}__min").alias("lo"),
                                                    F.col(f"{c}__max").alias("hi")) for c in cols])).alias("__b")) \
        .select(F.col("__b.k").alias("column_name"), F.col("__b.lo").alias("lo"), F.col("__b.hi").alias("hi"))
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(bounds), "column_name")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width).cast("int") + 1, F.lit(bins)))
    h = j.withColumn("bin", b).groupBy("column_name", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return h.select("column_name", "bin",
                    (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"),
                    "n")


def density_grid(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """Gaussian KDE (Scott bandwidth ``sigma * n^(-1/5)``) on an even grid.

    One aggregate gives count, spread and range; a second one has a kernel sum
    per grid point (``points`` columns, so no row is multiplied) and is turned
    into rows at the end.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("v"))
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    at = lambda g: F.col("lo") + F.lit(g) * (F.col("hi") - F.col("lo")) / (points - 1)
    z = lambda g: (at(g) - F.col("v")) / F.col("h")
    sums = attach_one_row(rows, st).groupBy("n", "lo", "hi", "h").agg(
        *[F.sum(F.exp(-z(g) * z(g) / 2)).alias(f"s{g}") for g in range(points)])
    grid = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), at(g).alias("x"), F.col(f"s{g}").alias("s")) for g in range(points)]))
    return sums.select("n", "h", grid.alias("p")).select(
        F.col("p.g").alias("grid_index"), F.col("p.x").alias("x"),
        (F.col("p.s") / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))).alias("density"))


# ---------------------------------------------------------------- F14-F16

def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """number of clusters, smallest and largest cluster size."""
    s = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return s.agg(F.count(F.lit(1)).alias("n_clusters"), F.min("__n").alias("cluster_min_size"),
                 F.max("__n").alias("cluster_max_size"))


def wcss(df: DataFrame, key: str, vec: str, label: str, dims: int | None = None) -> DataFrame:
    """within-cluster sum of squared distances to the cluster mean.

    ``sum |x|^2 - n |mu|^2`` per cluster and dimension, with all vectors shifted
    by the overall mean first so that the difference keeps its digits.
    """
    x = F.transform(F.col(vec) if dims is None else F.slice(F.col(vec), 1, dims), lambda v: v.cast("double"))
    long = df.select(F.col(label).alias("__l"), F.posexplode(x).alias("dim", "x"))
    means = long.groupBy("dim").agg(F.avg("x").alias("m"))
    shift = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("__m"))  # one row of d numbers
    moved = attach_one_row(df.select(F.col(label).alias("__l"), x.alias("__x")), shift).select(
        "__l", F.posexplode(F.zip_with("__x", "__m", lambda v, m: v - m)).alias("dim", "x"))
    per = moved.groupBy("__l", "dim").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("wcss"))


def cluster_centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Per label: size, mean vector (as an array) and mean squared norm."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    lg = df.select(label, F.posexplode(x).alias("dim", "x"))
    mu = lg.groupBy(label, "dim").agg(F.avg("x").alias("m"))
    mu = mu.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mu"))
    sq = df.select(label, F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v).alias("__sq")) \
        .groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("__sq").alias("s"))
    return sq.join(mu, label)


def silhouette(df: DataFrame, vec: str, label: str) -> DataFrame:
    """F16: mean silhouette on squared Euclidean distance, exact, O(n * k).

    ``a(i)`` = mean squared distance to the other members of its cluster,
    ``b(i)`` = smallest mean squared distance to another cluster, both from the
    identity ``sum_j ||x_i - x_j||^2 = n (||x_i||^2 - 2 x_i . mu + mean ||x_j||^2)``.
    The k centroids (k = number of clusters, a model parameter) travel as one
    broadcast row; no pair of points is ever formed.  The reference's plain
    Euclidean silhouette needs every pair of points and is not built (README).
    """
    cents = cluster_centroids(df, vec, label)
    one = cents.agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "s", "mu")).alias("__cents"))
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    p = df.select(F.col(label).alias("__own"), x.alias("__x")).crossJoin(F.broadcast(one))
    nx = F.aggregate(F.col("__x"), F.lit(0.0), lambda acc, v: acc + v * v)
    p = p.withColumn("__nx", nx)
    d = F.transform(F.col("__cents"), lambda c: F.struct(
        c["l"].alias("l"), c["n"].alias("n"),
        (F.col("__nx") - 2 * F.aggregate(F.zip_with(F.col("__x"), c["mu"], lambda a, b: a * b), F.lit(0.0),
                                          lambda acc, v: acc + v) + c["s"]).alias("d")))
    p = p.withColumn("__d", d)
    own = F.filter(F.col("__d"), lambda e: e["l"] == F.col("__own"))[0]
    others = F.filter(F.col("__d"), lambda e: e["l"] != F.col("__own"))
    a = F.when(own["n"] > 1, own["d"] * own["n"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda e: e["d"]))
    p = p.select(own["n"].alias("__n"), a.alias("__a"), b.alias("__b"))
    sil = F.when((F.col("__n") <= 1) | F.col("__b").isNull(), F.lit(0.0)).otherwise(
        (F.col("__b") - F.col("__a")) / F.greatest(F.col("__a"), F.col("__b")))
    return p.agg(F.avg(sil).alias("silhouette"))
