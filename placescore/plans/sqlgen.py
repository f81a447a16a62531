"""DuckDB oracle SQL for panel-derived queries, generated from the same specs.

The SQL is written independently of the Spark plans (window medians instead of
group-by + join, ``quantile_cont`` instead of ``percentile``), so agreement
checks the operator semantics, not shared code.
"""

from __future__ import annotations

from placescore.plans.panel import PANEL_SQL
from placescore.plans.spec import (IMPUTE_TARGETS, PANEL_DIMENSIONS, PANEL_FEATURES)

IDS = "unit_key, unit_name, state, unit_type"


def _replace(cols, fmt):
    return ", ".join(f"{fmt.format(c=c)} AS {c}" for c in cols)


def impute_ctes(targets=IMPUTE_TARGETS, levels=(("unit_type", "state"), ("state",), ("unit_type",))) -> str:
    """CTEs panel -> imp (hierarchical medians, each level on the filled table)."""
    flags = ", ".join(f"{c} IS NULL AS __m_{c}" for c in targets)
    ctes = [f"panel AS ({PANEL_SQL})", f"l0 AS (SELECT *, {flags} FROM panel)"]
    prev = "l0"
    for i, keys in enumerate(list(levels) + [()], start=1):
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        rep = _replace(targets, "coalesce({c}, median({c}) OVER (" + part + "))")
        ctes.append(f"l{i} AS (SELECT * REPLACE ({rep}) FROM {prev})")
        prev = f"l{i}"
    flag = " OR ".join(f"(__m_{c} AND {c} IS NOT NULL)" for c in targets)
    drop = ", ".join(f"__m_{c}" for c in targets)
    ctes.append(f"imp AS (SELECT * EXCLUDE ({drop}), CAST(CASE WHEN {flag} THEN 1 ELSE 0 END AS INTEGER) AS contains_imputed FROM {prev})")
    return ",\n".join(ctes)


def _transform(expr: str, t: str | None) -> str:
    if t == "log1p":
        return f"CASE WHEN {expr} > -1 THEN ln(1 + {expr}) END"
    if t == "asinh":
        return f"asinh({expr})"
    return expr


def _clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"


def score_ctes(src: str = "imp", features=PANEL_FEATURES, winsorize=True, lower=0.05, upper=0.95,
               scale=1.0, constant=0.5, use_transforms=True, suffix="_feature_score") -> str:
    """CTEs prep -> q -> fs (feature scores) from table ``src``."""
    cols = []
    for f in features:
        raw = f"abs({f.source} - {float(f.target)!r})" if f.source else f.name
        cols.append(f"CAST({_transform(raw, f.transform if use_transforms else None)} AS DOUBLE) AS {f.name}")
    prep = f"prep AS (SELECT {IDS}, {', '.join(cols)} FROM {src})"
    if winsorize:
        q = ", ".join(f"quantile_cont({f.name}, {lower}) AS {f.name}__lo, quantile_cont({f.name}, {upper}) AS {f.name}__hi"
                      for f in features)
    else:
        q = ", ".join(f"min({f.name}) AS {f.name}__lo, max({f.name}) AS {f.name}__hi" for f in features)
    qc = f"q AS (SELECT {q} FROM prep)"
    outs = []
    for f in features:
        lo, hi = f"q.{f.name}__lo", f"q.{f.name}__hi"
        v = _clip(f"prep.{f.name}", lo, hi) if winsorize else f"prep.{f.name}"
        s = f"CASE WHEN {lo} IS NULL OR {hi} IS NULL OR {hi} = {lo} THEN {constant / scale!r} ELSE ({v} - {lo}) / ({hi} - {lo}) END"
        if f.invert:
            s = f"1.0 - ({s})"
        s = _clip(f"({s})", "0.0", "1.0")
        if scale != 1.0:
            s = f"({s}) * {scale!r}"
        outs.append(f"{s} AS {f.name}{suffix}")
    fs = f"fs AS (SELECT {', '.join('prep.' + c.strip() for c in IDS.split(','))}, {', '.join(outs)} FROM prep CROSS JOIN q)"
    return ",\n".join([prep, qc, fs])


def dimension_cte(src: str = "fs", dims=PANEL_DIMENSIONS, suffix="_feature_score") -> str:
    outs = []
    for d, parts in dims.items():
        tot = " + ".join(f"{feat}{suffix} * {float(w)!r}" for feat, w in parts.items())
        outs.append(f"{_clip('(' + tot + ')', '0.0', '1.0')} AS {d}")
    return f"ds AS (SELECT *, {', '.join(outs)} FROM {src})"


def scored_panel_ctes() -> str:
    """panel -> imp -> fs -> ds (ids + feature scores + dimension scores)."""
    return ",\n".join([impute_ctes(), score_ctes(), dimension_cte()])


def similarity_sql(ratings: dict) -> str:
    num = " + ".join(f"coalesce(power({c} - {min(max(r / 5.0, 0.0), 1.0)!r}, 2), 0.0)" for c, r in ratings.items())
    cnt = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ratings)
    return _clip(f"(1.0 - ({num}) / nullif({cnt}, 0))", "0.0", "1.0")


def weighted_sql(weights: dict) -> str:
    tot = " + ".join(f"{c} * {w!r}" for c, w in weights.items())
    return _clip(f"({tot})", "0.0", "1.0")


def scale05(c: str) -> str:
    return f"round_even({_clip(f'CAST({c} AS DOUBLE) * 5.0', '0.0', '5.0')}, 2)"
