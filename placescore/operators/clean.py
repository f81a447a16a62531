"""Projection, rename, cast and cleaning operators.

Every operator is one ``select``/``withColumns`` (a single projection), so many
of them chain into one whole-stage-codegen span.
"""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions.expr import (coerce_numeric, col, growth_rate, safe_div, share, simpson_diversity,
                                       total_with_missing_as_zero)


def rename_columns(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Rename by label map; unknown names untouched."""
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})


def snake_case(name: str) -> str:
    """C2 rule: the runs of letters and digits, lower-cased and joined by ``_``."""
    return "_".join(re.findall("[a-z0-9]+", name.lower()))


def snake_case_expr(c: str | Column) -> Column:
    """``snake_case`` of a text column (headers that are data)."""
    return F.array_join(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1), "_")


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Schema-level header normalisation."""
    return df.toDF(*[snake_case(c) for c in df.columns])


def strip_header_padding(df: DataFrame) -> DataFrame:
    """A3: strip padding around header names."""
    return df.toDF(*[c.strip() for c in df.columns])


def coerce_numeric_columns(df: DataFrame, cols: Sequence[str], strip_commas: bool = True) -> DataFrame:
    """Text to double (thousands commas dropped, bad text -> null)."""
    cs = set(cols)
    return df.select(*[coerce_numeric(c, strip_commas).alias(c) if c in cs else F.col(c) for c in df.columns])


def add_growth_rates(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{out: (current, prior)}`` -> ``(cur - prior) / prior`` guarded."""
    return df.withColumns({o: growth_rate(c, p) for o, (c, p) in pairs.items()})


def add_shares(df: DataFrame, spec: Mapping[str, tuple[Sequence[str], str]], scale: float = 100.0) -> DataFrame:
    """C6+C7: ``{out: ([numerators], denominator)}`` -> ``scale * sum / denominator``."""
    return df.withColumns({o: share(nums, den, scale) for o, (nums, den) in spec.items()})


def add_diversity(df: DataFrame, counts: Sequence[str], total: str, out: str = "diversity_index") -> DataFrame:
    """Simpson diversity; zero or missing total -> null (O1)."""
    return df.withColumn(out, simpson_diversity(counts, total))


def add_ratio(df: DataFrame, out: str, num: str, den: str, scale: float = 1.0) -> DataFrame:
    """Density or rate per population, guarded."""
    e = safe_div(num, den)
    return df.withColumn(out, e * F.lit(scale) if scale != 1.0 else e)


def split_unit_name(df: DataFrame, name: str, city: str = "city", state: str = "state",
                    unit_type: str = "cbsa_type") -> DataFrame:
    """``"City, ST Metro Area"`` -> city, state, type (Metro/Micro/null).

    Split on the FIRST ``", "`` only; no comma -> the whole text is the city and
    state is empty, type null.
    """
    parts = F.split(F.coalesce(F.col(name), F.lit("")), ", ", 2)
    rest = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    typ = F.when(rest.endswith(" Metro Area"), F.lit("Metro")).when(rest.endswith(" Micro Area"), F.lit("Micro"))
    st = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\s+Metro Area$", ""), r"\s+Micro Area$", ""))
    return df.withColumns({city: F.element_at(parts, 1), unit_type: typ, state: st})


def normalize_name_expr(c: str | Column) -> Column:
    """C11: trim, newlines -> space, collapse whitespace, upper case."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(col(c), r"[\r\n]", " ")), r"\s+", " "))


def lookup_expr(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup by a literal map; miss -> null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, col(c))


def strip_code_suffix(c: str | Column) -> Column:
    """C14: drop a trailing ``.0`` and trim."""
    return F.trim(F.regexp_replace(col(c).cast("string"), r"\.0$", ""))


def parse_point(df: DataFrame, c: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``POINT (lon lat)`` -> two doubles; unparsable -> null."""
    pat = r"POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)"
    x = F.regexp_extract(F.col(c), pat, 1)
    y = F.regexp_extract(F.col(c), pat, 2)
    return df.withColumns({lon: F.nullif(x, F.lit("")).try_cast("double"),
                           lat: F.nullif(y, F.lit("")).try_cast("double")})


def fallback_weight(primary: str | Column, fallback: str | Column) -> Column:
    """Adult population, else total population."""
    return F.coalesce(col(primary), col(fallback))


def drop_by_suffix(df: DataFrame, suffix: str, also: Sequence[str] = ()) -> DataFrame:
    """Drop ``*suffix`` columns and listed duplicates (absent names ignored)."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)], *[c for c in also if c in df.columns])


def reorder_columns(df: DataFrame, first: Sequence[str], blocks: Sequence[Sequence[str]] = (),
                    last: Sequence[str] = ()) -> DataFrame:
    """Ids first, then source blocks, then the rest, then tail columns."""
    seen: list[str] = []
    for grp in [first, *blocks]:
        seen += [c for c in grp if c in df.columns and c not in seen]
    tail = [c for c in last if c in df.columns and c not in seen]
    rest = [c for c in df.columns if c not in seen and c not in tail]
    return df.select(*seen, *rest, *tail)


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C20."""
    return df.fillna(0, subset=[c for c in cols if c in df.columns])


def add_total(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    """Total with missing parts as 0 (parts stay missing)."""
    return df.withColumn(out, total_with_missing_as_zero(a, b))


def seasonal_flags(df: DataFrame, hot: str, cold: str, amount: str, seasonality: str = "temp_seasonality",
                   flag: str = "snow_binary") -> DataFrame:
    """``seasonality = hot - cold`` and ``flag = amount > 0`` (missing -> 0)."""
    return df.withColumns({seasonality: F.col(hot) - F.col(cold),
                           flag: F.when(F.col(amount) > 0, F.lit(1)).otherwise(F.lit(0))})


def display_label(final: str | Column, short: str | Column, missing: str = "—") -> Column:
    """First non-blank of final name, short text, else a dash."""
    nb = lambda x: F.nullif(F.trim(col(x)), F.lit(""))
    return F.coalesce(nb(final), nb(short), F.lit(missing))


def place_name(city: str | Column, state: str | Column) -> Column:
    """``"city, state"`` display name (missing parts skipped)."""
    return F.concat_ws(", ", col(city), col(state))


def fill_empty_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C26."""
    return df.fillna("", subset=[c for c in cols if c in df.columns])
