"""Transforms and 0-1 scoring.

Whole feature-score build = one projection for transforms, ONE global aggregate
(all lower/upper quantiles, or min/max when not winsorising) attached as a
one-row broadcast, and one projection for all scores.  After clipping to
[q_lo, q_hi] the column's min and max are exactly q_lo and q_hi, so min-max
needs no second pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions.expr import asinh, clip, distance_to, log1p_safe, round_half_even
from placescore.operators.quantile import qcol, quantiles


@dataclass(frozen=True)
class Feature:
    """One scored feature: optional transform, optional inversion.

    ``source``/``target`` make a derived feature ``abs(source - target)``
    computed from the raw value before any transform (C27).
    """

    name: str
    transform: str | None = None  # "log1p" | "asinh" | None
    invert: bool = False
    source: str | None = None
    target: float | None = None


def transform_expr(c: str | Column, transform: str | None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    if transform is None:
        return x
    if transform == "log1p":
        return log1p_safe(x)
    if transform == "asinh":
        return asinh(x)
    raise ValueError(f"unknown transform {transform!r}")


def apply_transforms(df: DataFrame, transforms: Mapping[str, str | None], skip_missing: bool = True) -> DataFrame:
    """H4: transform named columns in one projection; absent columns skipped (or raise)."""
    present = set(df.columns)
    missing = [c for c in transforms if c not in present]
    if missing and not skip_missing:
        raise KeyError(f"Missing columns for transforms: {missing}")
    return df.select(*[transform_expr(c, transforms[c]).alias(c) if c in transforms else F.col(c) for c in df.columns])


def winsorize(df: DataFrame, cols: Sequence[str], lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """H5: clip every column to its own [lower, upper] quantiles (one aggregate)."""
    cols = [c for c in cols if c in df.columns]
    q = quantiles(df, cols, [lower, upper])
    j = df.crossJoin(F.broadcast(q))
    out = j.select(*[clip(c, F.col(qcol(c, lower)), F.col(qcol(c, upper))).alias(c) if c in cols else F.col(c)
                     for c in df.columns])
    return out


def minmax_expr(x: Column, lo: Column, hi: Column, invert: bool = False, constant: float = 0.5,
                scale: float = 1.0) -> Column:
    """H6: (x-lo)/(hi-lo); constant or empty column -> ``constant`` for EVERY row."""
    s = F.when(lo.isNull() | hi.isNull() | (hi == lo), F.lit(constant / scale)).otherwise((x - lo) / (hi - lo))
    if invert:
        s = F.lit(1.0) - s
    return clip(s, 0.0, 1.0) * F.lit(scale) if scale != 1.0 else clip(s, 0.0, 1.0)


def minmax_scores(df: DataFrame, cols: Sequence[str], invert: Sequence[str] = (), suffix: str = "_minmax") -> DataFrame:
    """H6 on its own: one min/max aggregate for all columns."""
    mm = df.agg(*[F.min(c).alias(f"{c}__min") for c in cols], *[F.max(c).alias(f"{c}__max") for c in cols])
    j = df.crossJoin(F.broadcast(mm))
    inv = set(invert)
    return j.select(*df.columns, *[
        minmax_expr(F.col(c), F.col(f"{c}__min"), F.col(f"{c}__max"), c in inv).alias(f"{c}{suffix}") for c in cols])


def feature_scores(df: DataFrame, features: Sequence[Feature], id_cols: Sequence[str],
                   winsorize_scores: bool = True, lower: float = 0.05, upper: float = 0.95,
                   scale: float = 1.0, constant: float = 0.5, use_transforms: bool = True,
                   suffix: str = "_feature_score") -> DataFrame:
    """H7 (and H11 with ``scale=100, use_transforms=False, constant=50``).

    Returns ``id_cols`` + one ``{feature}{suffix}`` per feature, higher = better.
    A listed raw feature missing from ``df`` raises, like the reference.
    """
    need = {f.source or f.name for f in features if f.source or f.target is None}
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise KeyError(f"Missing required feature columns: {missing}")
    names = [f.name for f in features]
    prep = df.select(*id_cols, *[
        transform_expr(distance_to(f.source, f.target) if f.source else F.col(f.name),
                       f.transform if use_transforms else None).cast("double").alias(f.name)
        for f in features])
    if winsorize_scores:
        q = quantiles(prep, names, [lower, upper])
        lo = {n: F.col(qcol(n, lower)) for n in names}
        hi = {n: F.col(qcol(n, upper)) for n in names}
        val = {n: clip(n, lo[n], hi[n]) for n in names}
    else:
        q = prep.agg(*[F.min(n).alias(f"{n}__min") for n in names], *[F.max(n).alias(f"{n}__max") for n in names])
        lo = {n: F.col(f"{n}__min") for n in names}
        hi = {n: F.col(f"{n}__max") for n in names}
        val = {n: F.col(n) for n in names}
    j = prep.crossJoin(F.broadcast(q))
    return j.select(*id_cols, *[
        minmax_expr(val[f.name], lo[f.name], hi[f.name], f.invert, constant=constant, scale=scale)
        .alias(f"{f.name}{suffix}") for f in features])


def dimension_scores(df: DataFrame, weights: Mapping[str, Mapping[str, float]],
                     suffix: str = "_feature_score") -> DataFrame:
    """H8: composite scores = weighted sums of feature scores, clipped to [0, 1]."""
    dims = []
    for dim, parts in weights.items():
        terms = [F.col(f"{feat}{suffix}") * F.lit(float(w)) for feat, w in parts.items()]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        dims.append(clip(total, 0.0, 1.0).alias(dim))
    return df.select("*", *dims)


def feature_and_dimension_scores(df: DataFrame, features: Sequence[Feature], weights: Mapping[str, Mapping[str, float]],
                                 id_cols: Sequence[str], **kw) -> DataFrame:
    """H9: H7 then H8, with a check that every dimension column exists."""
    out = dimension_scores(feature_scores(df, features, id_cols, **kw), weights)
    missing = [d for d in weights if d not in out.columns]
    if missing:
        raise KeyError(f"Composite score columns were not created: {missing}")
    return out


def score_columns_0_5(columns: Sequence[str], dimension_cols: Sequence[str]) -> list[str]:
    """H10 column rule: dimension columns, ``recommendation_score`` and ``*_feature_score``."""
    dims = set(dimension_cols)
    return [c for c in columns if c in dims or c == "recommendation_score" or c.endswith("_feature_score")]


def scale_to_0_5(df: DataFrame, dimension_cols: Sequence[str], hi: float = 5.0, decimals: int = 2) -> DataFrame:
    """Stored 0-1 scores to 0-5, clipped, rounded half-even to ``decimals``."""
    targets = set(score_columns_0_5(df.columns, dimension_cols))
    return df.select(*[round_half_even(clip(F.col(c).cast("double") * hi, 0.0, hi), decimals).alias(c) if c in targets
                       else F.col(c) for c in df.columns])
