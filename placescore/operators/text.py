"""Text operators (L1-L6, A8, A11) as column expressions and joins."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.functions.expr import col, once
from placescore.operators.clean import snake_case, snake_case_expr


def combine_texts(a: str | Column, b: str | Column, sep: str = "\n") -> Column:
    """L1: ``a + sep + b`` with missing parts as empty strings."""
    return F.concat(F.coalesce(col(a), F.lit("")), F.lit(sep), F.coalesce(col(b), F.lit("")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_tagged(df: DataFrame, text: str, tagline: str = "tagline", summary: str = "summary") -> DataFrame:
    """L3: ``TAGLINE: ... SUMMARY: ...`` -> two columns.

    tagline = text after the first ``TAGLINE:`` up to the next marker or the
    first ``SUMMARY:`` after it; summary = text after the first ``SUMMARY:`` (up
    to a second one); both stripped.  A text without both markers gives a null
    tagline and the whole, unstripped text as summary.
    """
    t = F.col(text)
    ok = t.contains("TAGLINE:") & t.contains("SUMMARY:")
    tag = F.try_element_at(F.split(F.try_element_at(F.split(t, "TAGLINE:"), F.lit(2)), "SUMMARY:"), F.lit(1))
    summ = F.try_element_at(F.split(t, "SUMMARY:"), F.lit(2))
    return df.withColumns({tagline: F.when(ok, _strip(tag)), summary: F.when(ok, _strip(summ)).otherwise(t)})


def title_fallback(units: DataFrame, key: str, candidates: Sequence[Column], titles: DataFrame, title_col: str,
                   text_col: str, out: str = "text") -> DataFrame:
    """L4: first candidate title (in the given order) that exists with non-empty
    text wins.  Candidates are exploded with their rank, equi-joined to the
    titles table and reduced with ``min_by(text, rank)``."""
    cand = units.select(key, F.posexplode(F.array(*candidates)).alias("__rank", "__title"))
    t = titles.where(F.col(text_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0)) \
        .select(F.col(title_col).alias("__title"), F.col(text_col).alias("__text"))
    j = cand.join(t, "__title")
    best = j.groupBy(key).agg(F.min_by("__text", "__rank").alias(out), F.min_by("__title", "__rank").alias("matched_title"))
    return units.select(key).join(best, key, "left")


def link_harvest(pages: DataFrame, key: str, url: str, html: str, pattern: str = r"""(?i)href\s*=\s*["']([^"']+)["']""",
                 extension: str | None = None) -> DataFrame:
    """Every ``href`` (optionally only ``extension``), resolved against the
    page URL, deduplicated per page keeping the first occurrence."""
    links = pages.select(key, url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 1)).alias("pos", "href"))
    if extension:
        links = links.where(F.lower("href").endswith(extension.lower()))
    links = links.withColumn("link", resolve_url(F.col(url), F.col("href")))
    return links.groupBy(key, "link").agg(F.min("pos").alias("pos"))


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments of an absolute path removed; ``..`` above the root goes."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(parts, -1)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference resolved against the url of its page (RFC 3986, 5.2; the results of ``urljoin``)."""
    base = F.regexp_replace(F.coalesce(base, F.lit("")), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    authority = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    root = F.concat(scheme, authority)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.when((path == "") & (authority != ""), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    merged = F.regexp_replace(F.concat(folder, ref_path), "/{2,}", "/")  # empty segments go, as in urljoin
    merged = F.when(merged.startswith("/"), _without_dots(merged)).otherwise(merged)
    return (F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, ref))
            .when(ref_path.startswith("/"), F.concat(root, _without_dots(ref_path), ref_rest))
            .when((ref == "") | ref.startswith("#"), F.concat(base, ref))
            .when(ref.startswith("?"), F.concat(root, path, ref))
            .otherwise(F.concat(root, merged, ref_rest)))


def matrix_rows(df: DataFrame, key: str, text: str, places: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``[[header...], [row...], ...]`` JSON -> (rows, quarantine): key, row, ``__h`` (header) and ``__r`` (values) of each row.

    With ``places`` a row has ``__at`` as well: the first places of these names in its header (0: none), found once a text.
    The quarantine (key, reason) holds keys whose text is not a JSON array of
    string arrays, is an error object, or has a row whose width differs from the
    header.
    """
    parsed = once(df.select(key, text), "__m", F.from_json(F.col(text), "array<array<string>>"))
    width_ok = F.forall(F.col("__m"), lambda r: F.size(r) == F.size(F.element_at(F.col("__m"), 1)))
    good = F.col("__m").isNotNull() & (F.size("__m") >= 1) & width_ok & ~F.trim(F.col(text)).startswith("{")
    bad = parsed.where(~F.coalesce(good, F.lit(False))).select(key, F.lit("bad shape").alias("reason"))
    ok = parsed.where(F.coalesce(good, F.lit(False)))
    if places:
        ok = once(ok, "__at", F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.array_position(F.element_at("__m", 1), p)))
    return ok.select(key, F.element_at("__m", 1).alias("__h"), *["__at" for _ in places[:1]],
                     F.posexplode(F.slice("__m", 2, F.greatest(F.size("__m") - 1, F.lit(0)))).alias("row", "__r")), bad


def json_matrix(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Matrix JSON -> long (key, row, column, value), and the quarantine of ``matrix_rows``."""
    rows, bad = matrix_rows(df, key, text)
    cells = rows.select(key, "row", F.explode(F.arrays_zip(F.col("__h").alias("column"), F.col("__r").alias("value"))).alias("__z"))
    return cells.select(key, "row", F.col("__z.column").alias("column"), F.col("__z.value").alias("value")), bad


def csv_fields(line: Column, sep: str = ",") -> Column:
    """The fields of one CSV record: quotes may hold separators, line breaks and doubled quotes."""
    q = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(f'("(?:[^"]++|"")*+"|[^{q}]*+){q}'), 1)
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def csv_records(text: Column) -> Column:
    """The records of a CSV text; a line break inside quotes does not end one."""
    clean = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    return F.regexp_extract_all(F.concat(clean, F.lit("\n")), F.lit('((?:[^"\n]++|"[^"]*+")*+)\n'), 1)


def header_drift_rows(df: DataFrame, key: str, text: str, required: Sequence[str],
                      sep: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Many small CSV texts with varying headers -> rows bound BY NAME.

    Each text's first record is its header (snake-cased); every other record
    becomes a map of header to field, missing trailing fields null.  Returns
    (rows, skipped, quarantine): skipped has the keys of texts without one of the
    ``required`` columns, quarantine the records with more fields than the header.
    """
    t = once(df.select(key, text), "__all", csv_records(F.col(text)))
    t = once(t, "__h", F.transform(csv_fields(F.element_at("__all", 1), sep), snake_case_expr))
    t = t.select(key, "__h", F.filter(
        F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(0))), lambda r: F.length(F.trim(r)) > 0).alias("__records"))
    need = F.array(*[F.lit(snake_case(r)) for r in required])
    whole = F.size(F.array_except(need, "__h")) == 0
    skipped = t.where(~whole).select(key)
    rows = t.where(whole).select(key, "__h", F.posexplode("__records").alias("line_no", "__l"))
    rows = once(rows, "__f", csv_fields(F.col("__l"), sep))
    n = F.size("__h")
    quarantine = rows.where(F.size("__f") > n).select(key, "line_no", F.col("__l").alias("record"))
    padded = F.concat("__f", F.array_repeat(F.lit(None).cast("string"), F.greatest(n - F.size("__f"), F.lit(0))))
    fields = F.when(F.size("__f") <= n, F.map_from_arrays("__h", padded))  # Spark may test later filters first
    rows = once(rows.where(F.size("__f") <= n), "fields", fields).select(key, "line_no", "fields")
    return rows, skipped, quarantine


def rollup_texts(df: DataFrame, parent: str, order: str, text: str, sep: str = "\n\n", out: str = "text") -> DataFrame:
    """Concatenate child texts per parent in order.

    One value per parent is the feature; a parent whose texts exceed what a
    value can hold (2 GB) makes Spark raise, nothing is cut.
    """
    return df.groupBy(parent).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), sep).alias(out))


def pending_only(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet (left anti join)."""
    return todo.join(done.select(key), key, "left_anti")


def intro_extract(df: DataFrame, key: str, response: str, out: str = "extract") -> DataFrame:
    """Intro text from a stored page-extract response
    ``{"query": {"pages": {"<id>": {"extract": ...}}}}``; a missing page (no
    ``extract``) or an unparsable response gives null.  The first page with an
    extract wins (pages ordered by id)."""
    schema = "struct<query: struct<pages: map<string, struct<extract: string>>>>"
    pages = F.from_json(F.col(response), schema)["query"]["pages"]
    ex = F.filter(F.transform(F.array_sort(F.map_entries(pages)), lambda e: e["value"]["extract"]),
                  lambda x: x.isNotNull())
    return df.select(key, F.try_element_at(ex, F.lit(1)).alias(out))
