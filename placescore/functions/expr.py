"""Column-expression helpers shared by every operator.

All helpers return ``Column`` objects so callers can put many of them in one
``select`` / ``withColumns`` (one projection, whole-stage codegen friendly).
Missing values are ``null``; NaN is turned into null at ingest.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

# Fixed value: mean Earth radius in km used by the nearest-station join.
EARTH_RADIUS_KM = 6371.0088


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed once a row: a generator's output is not copied into what uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def clip(c: str | Column, lo=None, hi=None) -> Column:
    """``clip`` that keeps null (``greatest/least`` would skip the null operand)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNotNull(), out)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Guarded division: zero or missing denominator gives null (never raises)."""
    return F.try_divide(col(num), col(den))


def coerce_numeric(c: str | Column, strip_commas: bool = True) -> Column:
    """Text to double; bad text, NaN and infinities become null (``errors=coerce``)."""
    x = F.trim(col(c).cast("string"))
    if strip_commas:
        x = F.regexp_replace(x, ",", "")
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Null-propagating row-wise sum (``a + b + ...``)."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def total_with_missing_as_zero(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(col(a), F.lit(0.0)) + F.coalesce(col(b), F.lit(0.0))


def growth_rate(cur: str | Column, prior: str | Column) -> Column:
    return safe_div(col(cur) - col(prior), col(prior))


def share(numerators: Sequence[str | Column], denominator: str | Column, scale: float = 100.0) -> Column:
    """``scale * (n1 + n2 + ...) / d`` with null propagation and a guarded divide."""
    return safe_div(row_sum(numerators), denominator) * F.lit(scale)


def simpson_diversity(counts: Sequence[str | Column], total: str | Column) -> Column:
    """``1 - sum((n_i / N)^2)``; missing counts are 0; zero/missing total -> null."""
    n = F.nullif(col(total), F.lit(0.0))
    return F.lit(1.0) - reduce(
        lambda a, b: a + b,
        [F.pow(F.coalesce(col(c), F.lit(0.0)) / n, 2) for c in counts],
    )


def log1p_safe(c: str | Column) -> Column:
    """``log1p`` with null for values <= -1 (numpy gives -inf/NaN there)."""
    x = col(c)
    return F.when(x > -1, F.log1p(x))


def asinh(c: str | Column) -> Column:
    return F.asinh(col(c))


def distance_to(c: str | Column, target: float) -> Column:
    return F.abs(col(c) - F.lit(float(target)))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km between two lat/lon columns in degrees."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat = p2 - p1
    dlon = F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def round_half_even(c: str | Column, decimals: int = 2) -> Column:
    """Round like NumPy/pandas: ``rint(x * 10^d) / 10^d`` (half-even on the scaled double).

    ``bround`` rounds the exact binary value instead, so e.g. 919.575 (stored as
    919.57499...) gives 919.57 there but 919.58 in pandas.
    """
    f = float(10 ** decimals)
    x = col(c).cast("double")
    return F.rint(x * F.lit(f)) / F.lit(f)


def fmt2(c: str | Column, missing: str = "—") -> Column:
    """Two-decimal text after half-even rounding; missing -> em dash."""
    x = round_half_even(c, 2)
    return F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise(F.lit(missing))


def round_numeric(df: DataFrame, decimals: int = 2, exclude: Iterable[str] = ()) -> DataFrame:
    """Round every fractional numeric column half-even (integers untouched)."""
    ex = set(exclude)
    frac = {"double", "float"}
    cols = []
    for f in df.schema.fields:
        if f.name not in ex and f.dataType.simpleString() in frac or (
            f.name not in ex and f.dataType.simpleString().startswith("decimal")
        ):
            cols.append(round_half_even(F.col(f.name), decimals).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


