"""End-to-end place pipeline (M1-M7) as DataFrame -> DataFrame functions.

Each source build takes landed tables (see FIXTURES.md for their shapes) and
returns one row per unit key.  The base panel is materialised once (reliable
checkpoint) because imputation, clustering and scoring all read it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.operators import agg, clean, cluster, geo, impute, joins, landed, quantile, score, text, window
from placescore.session import cut_lineage
from placescore.sources import files, sinks
from placescore.specs import (AGE_BUCKETS, CENSUS_NAME_HEADER, CENSUS_PRIOR_VARIABLES, CENSUS_SHARES, CENSUS_UNIT_HEADER, CENSUS_VARIABLES,
                              CLUSTER_ASINH, CLUSTER_DROP, CLUSTER_LEVELS, CLUSTER_LOG1P,
                              GAZETTEER_COLUMNS, HEALTH_MEASURES, INDUSTRY_TOTAL, NAME_FEATURES, NAME_PHRASES,
                              PLACE_DIMENSIONS, PLACE_FEATURES, PLACE_ID_COLS, RACE_GROUPS, RACE_TOTAL, STATE_TO_CODE,
                              STATION_MEASURES, STATION_REQUIRED, TRADEOFF_RULES)

KEY = "cbsa_code"
POPULATION = "TotalPopulation_B01003"

# current/prior column pairs for the four growth rates.
GROWTH_PAIRS = {
    "population_growth": ("TotalPopulation_B01003", "TotalPopulation_B01003_prior"),
    "job_growth": ("IndustryTotalEmployed_C24050", "IndustryTotalEmployed_C24050_prior"),
    "median_rent_growth": ("MedianGrossRent_B25064", "MedianGrossRent_B25064_prior"),
    "median_home_value_growth": ("MedianHomeValue_B25077", "MedianHomeValue_B25077_prior"),
}


def _keyed(df: DataFrame, col: str = KEY) -> DataFrame:
    return df.withColumn(col, F.trim(F.col(col).cast("string")))


def lifestyle_features(df: DataFrame) -> DataFrame:
    """Age totals, all census shares and the diversity index; the age buckets go."""
    buckets = {total: [f"{sex}_{b}_B01001" for sex in ("Male", "Female") for b in names] for total, names in AGE_BUCKETS.items()}
    need = {c for cs in buckets.values() for c in cs} | {c for nums, den in CENSUS_SHARES.values() for c in [*nums, den]}
    lost = sorted(c for c in need | {RACE_TOTAL, *RACE_GROUPS} if c not in df.columns and c not in buckets)
    if lost:
        raise KeyError(f"census columns for shares are missing: {lost}")
    df = df.withColumns({total: reduce(lambda a, b: a + b, [F.col(c) for c in cs]) for total, cs in buckets.items()})
    df = clean.add_shares(df, CENSUS_SHARES)
    df = clean.add_diversity(df, RACE_GROUPS, RACE_TOTAL)
    return df.drop(*[c for cs in buckets.values() for c in cs])


def census_build(current: DataFrame, prior: DataFrame | None, gazetteer: DataFrame | None,
                 numeric: Sequence[str] | None = None) -> DataFrame:
    """M1: typed census table + growth, name parts, shares, diversity, areas, centroids, density.

    ``numeric`` names the number columns (default: all but key and name).  The
    shares need the whole census table; a table without industries gets none.
    """
    numbers = [c for c in current.columns if c not in (KEY, "cbsa_name")] if numeric is None else list(numeric)
    df = clean.coerce_numeric_columns(_keyed(current), numbers)
    if prior is not None:
        pr = _keyed(prior)
        df = joins.left_join(df, clean.coerce_numeric_columns(pr, [c for c in pr.columns if c != KEY]), KEY)
        df = clean.add_growth_rates(df, {o: p for o, p in GROWTH_PAIRS.items() if p[0] in df.columns and p[1] in df.columns})
    if "cbsa_name" in df.columns:
        df = clean.split_unit_name(df, "cbsa_name")
    if INDUSTRY_TOTAL in df.columns:
        df = lifestyle_features(df)
    if gazetteer is not None:
        g = clean.rename_columns(clean.strip_header_padding(gazetteer), {**GAZETTEER_COLUMNS, "GEOID": KEY})
        kept = [c for c in GAZETTEER_COLUMNS.values() if c in g.columns]
        df = joins.left_join(df, clean.coerce_numeric_columns(_keyed(g).select(KEY, *kept), kept), KEY)
        df = clean.add_ratio(df, "population_density_per_sq_mile", POPULATION, "land_area_sqmi")
    return clean.drop_by_suffix(df, "_prior")


def census_from_responses(current: DataFrame, prior: DataFrame | None, gazetteer: DataFrame | None, order: str = "slice",
                          payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """A8-A10 -> M1: (census table, quarantine) from landed matrix responses of both years.

    ``order`` ranks the responses of a year: the first that has a unit's variable
    gives it.  The quarantine has the responses (year, order, reason) that gave nothing.
    """
    names = {CENSUS_NAME_HEADER: "cbsa_name", **CENSUS_VARIABLES}
    now, bad = landed.matrix_table(current, order, payload, CENSUS_UNIT_HEADER, names, KEY)
    bad = bad.select(F.lit("current").alias("year"), order, "reason")
    before = None
    if prior is not None:
        before, lost = landed.matrix_table(prior, order, payload, CENSUS_UNIT_HEADER, {v: CENSUS_VARIABLES[v] for v in CENSUS_PRIOR_VARIABLES}, KEY)
        before = joins.suffix_columns(before, "_prior", [KEY])
        bad = bad.unionByName(lost.select(F.lit("prior").alias("year"), order, "reason"))
    return census_build(now, before, gazetteer), bad


def crime_build(city_crime: DataFrame, zip_cbsa: DataFrame) -> DataFrame:
    """M2: city crime counts (cleaned city and state names) rolled up to units through the most common ZIP unit."""
    from placescore.sources.files import clean_headers

    c = clean_headers(city_crime)
    c = c.select(clean.normalize_name_expr("City_Clean").alias("city"),
                 clean.lookup_expr(F.upper(F.trim(F.col("State_Clean"))), STATE_TO_CODE).alias("state"),
                 *[clean.coerce_numeric(F.col(n)).alias(o) for n, o in
                   (("Violent crime", "violent_crime_count"), ("Property crime", "property_crime_count"))])
    c = clean.add_total(c, "total_crime_count", "violent_crime_count", "property_crime_count")
    z = zip_cbsa.select(clean.normalize_name_expr("USPS_ZIP_PREF_CITY").alias("city"),
                        F.upper(F.trim("USPS_ZIP_PREF_STATE")).alias("state"),
                        clean.strip_code_suffix("CBSA").alias(KEY)).where(F.col(KEY).isNotNull() & (F.col(KEY) != ""))
    xwalk = agg.group_mode(z, ["city", "state"], KEY)
    j = joins.left_join(c, xwalk, ["city", "state"]).where(F.col(KEY).isNotNull())
    return agg.group_sum(j, [KEY], ["violent_crime_count", "property_crime_count", "total_crime_count"])


def health_build(tracts: DataFrame, polygon_edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """M3: tract health shares -> point-in-polygon -> weighted rollup per unit.

    A tract counts once per unit: of repeated rows the least by weight, shares
    and place stays.  ``titles`` (key, cbsa_title) adds the unit's title.
    """
    t = clean.parse_point(tracts, "geolocation")
    t = t.select(clean.strip_code_suffix("tractfips").alias("tractfips"), "lon", "lat",
                 clean.fallback_weight(clean.coerce_numeric("totalpop18plus"), clean.coerce_numeric("totalpopulation")).alias("population_weight"),
                 *[clean.coerce_numeric(f"{m.lower()}_crudeprev").alias(f) for m, f in HEALTH_MEASURES.items()])
    shares = list(HEALTH_MEASURES.values())
    t = t.withColumn("__place", F.concat_ws("|", "tractfips", "lon", "lat"))
    hits = geo.points_in_polygons(t.dropDuplicates(["__place"]), "__place", "lon", "lat", polygon_edges, KEY)
    j = t.join(hits, "__place")
    j = window.dedupe(j, [KEY, "tractfips"], ["population_weight", *shares, "lon", "lat"], columns=["population_weight", *shares])
    out = agg.weighted_rollup(j, [KEY], shares, "population_weight", row_id="tractfips")
    out = clean.rename_columns(out, {"n_rows": "n_tracts", "total_weight": "total_population_weight"})
    if titles is None:
        return out
    return joins.left_join(out, titles.select(KEY, "cbsa_title"), KEY).select(
        KEY, "cbsa_title", "n_tracts", "total_population_weight", *shares)


def walkability_build(block_groups: DataFrame) -> DataFrame:
    """M4: plain means + population-weighted walk index per unit."""
    b = block_groups.select(clean.strip_code_suffix("CBSA").alias(KEY),
                            *[clean.coerce_numeric(c).alias(c) for c in ("TotPop", "NatWalkInd", "D1B", "D1D", "D3B")])
    b = b.where(F.col(KEY).isNotNull() & (F.col(KEY) != ""))
    return b.groupBy(KEY).agg(F.avg("NatWalkInd").alias("nat_walk_index_mean"),
                              F.avg("D1B").alias("population_density_mean"),
                              F.avg("D1D").alias("activity_density_mean"),
                              F.avg("D3B").alias("intersection_density_mean"),
                              agg.weighted_mean_expr("NatWalkInd", "TotPop").alias("nat_walk_index_pop_weighted"))


def station_months(texts: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A6 -> F7: station files (one text each) as typed monthly rows.

    Returns (rows, skipped, quarantine): ``skipped`` has the paths of files that
    lack one of the id columns, ``quarantine`` records with surplus fields.
    """
    rows, skipped, bad = text.header_drift_rows(texts, path, content, STATION_REQUIRED)
    return _station_rows(rows, lambda c: F.try_element_at("fields", F.lit(c)), path), skipped, bad


def station_months_of_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``station_months`` of a folder of files: a native scan for each different header, no file as one string."""
    rows, skipped, bad = files.read_drifting_csv(spark, folder, STATION_REQUIRED)
    return _station_rows(rows, lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string"), "path"), skipped, bad


def _station_rows(rows: DataFrame, field, path: str) -> DataFrame:
    out = rows.select(
        field("station").alias("station"), field("name").alias("name"), clean.coerce_numeric(field("latitude")).alias("latitude"),
        clean.coerce_numeric(field("longitude")).alias("longitude"), clean.coerce_numeric(field("month")).cast("int").alias("month"),
        *[clean.coerce_numeric(field(c)).alias(c) for c in STATION_MEASURES], F.struct(path, "line_no").alias("file_order"))
    return window.month_range(out, "month")


def station_summaries(months: DataFrame) -> DataFrame:
    """M5, first half: a row per station with its year summary, place and name."""
    order = "file_order" if "file_order" in months.columns else "month"
    s = agg.annual_summary(months, "station", "month", "mly_tavg_normal", "mly_prcp_normal",
                           "mly_snow_normal" if "mly_snow_normal" in months.columns else None, order)
    first = lambda c: F.min_by(F.col(c), F.col(order)) if c in months.columns else F.lit(None).cast("string")
    facts = window.month_range(months, "month").groupBy("station").agg(
        first("latitude").alias("station_lat"), first("longitude").alias("station_lon"), first("name").alias("station_name"))
    return s.join(facts, "station").withColumnRenamed("station", "station_id")


def cached_station_summaries(spark: SparkSession, texts: DataFrame | str, path: str, metrics_path: str | None = None,
                             extra: Mapping[str, str] | None = None, force_rebuild: bool = False) -> DataFrame:
    """A13 + B3: the station summaries at ``path`` if a whole cache is there, else from station files, with the run's metrics.

    ``texts`` is a folder of files or a frame of whole texts.

    The metrics (files read, files without the id columns, records with surplus
    fields, stations summarised, time) are written as one JSON line to
    ``metrics_path`` before the cache is published; reading a cache writes none.
    """
    def write(run: str) -> None:
        if isinstance(texts, str):
            (months, skipped, rejected), n_files = station_months_of_files(spark, texts), len(spark.read.text(texts).inputFiles())
        else:
            (months, skipped, rejected), n_files = station_months(texts), texts.count()
        counts = {"n_files_total": n_files, "n_files_skipped": skipped.count(), "n_records_rejected": rejected.count()}
        sinks.write_with_metrics(station_summaries(months), run, {"n_stations_summarized": F.col("station_id").isNotNull()}, metrics_path,
                                 {**(extra or {}), **counts, "cache_path": path})

    return files.cached_or_rebuild(spark, path, None, force_rebuild, write=write)


def weather_build(months: DataFrame, centroids: DataFrame) -> DataFrame:
    """M5: station-year summaries -> nearest station per unit centroid -> flags."""
    return station_weather(station_summaries(months), centroids)


def station_weather(s: DataFrame, centroids: DataFrame) -> DataFrame:
    """M5, second half: nearest station per unit centroid, and flags; ``s`` has a row per station."""
    keep = ("station_name", "avg_annual_temp", "jan_avg_temp", "jul_avg_temp", "annual_precipitation", "annual_snowfall",
            "n_months_available", "has_complete_year")
    near = geo.nearest_station(centroids, KEY, "centroid_lat", "centroid_lon", s, "station_id", "station_lat", "station_lon", keep=keep)
    near = near.withColumnRenamed("distance_km", "station_distance_km")
    return clean.seasonal_flags(near, "jul_avg_temp", "jan_avg_temp", "annual_snowfall")


def base_panel(census: DataFrame, others: Sequence[DataFrame], zero_fill: Sequence[str] = ("annual_snowfall",),
               exclude: Sequence[str] = (KEY, "contains_imputed"), checkpoint: bool = True) -> DataFrame:
    """M6: validated left joins, zero fill, hierarchical imputation, crime rates, one row per unit.

    Columns: ids, then the sources in the order given, then the crime rates and
    the flag.  A column that an earlier source has is not taken again.
    """
    seen, blocks = set(census.columns), []
    for o in others:
        blocks.append(o.select(KEY, *[c for c in o.columns if c not in seen and c != "cbsa_title"]))
        seen |= set(o.columns)
    df = clean.zero_fill(joins.chain_left_joins(census, blocks, KEY), [c for c in zero_fill if c in seen])
    targets = impute.imputation_targets(df, exclude=exclude)
    df = impute.hierarchical_median_impute(df, targets, levels=(("cbsa_type", "state"), ("state",), ("cbsa_type",)))
    for n in ("violent", "property"):
        if f"{n}_crime_count" in df.columns and POPULATION in df.columns:
            df = clean.add_ratio(df, f"{n}_crime_per_population", f"{n}_crime_count", POPULATION)
    df = clean.reorder_columns(df, PLACE_ID_COLS, last=["contains_imputed"])
    df = cut_lineage(df) if checkpoint else df
    window.assert_unique(df, KEY)
    return df


@dataclass(frozen=True)
class Enriched:
    """M7/J8 results: the panel, one row per unit with all label columns, a row per model, a row per label."""

    panel: DataFrame
    mapping: DataFrame
    metrics: DataFrame
    label_names: DataFrame


REPORT_COLUMNS = ["key_traits", "candidate_name_1", "candidate_name_2", "candidate_name_3", "final_name", "description", "tradeoffs"]


def cluster_tables(base: DataFrame, levels: dict[str, int] | None = None, starts: int = 10,
                   overrides: Mapping[str, DataFrame] | None = None,
                   phrases: Mapping[str, tuple[str, str]] = NAME_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping, metrics, label names) of all cluster levels on a complete panel.

    Key traits are looked for in all numeric columns of the panel, names in the
    naming features.  ``overrides``: by level, a frame of texts written by people
    (the level's label and any of ``REPORT_COLUMNS``) that take precedence.
    ``phrases``: ``NAME_PHRASES_BY_VALUE`` turns the four pairs that read against their values.
    """
    levels = levels or CLUSTER_LEVELS
    unknown = sorted(set(overrides or {}) - set(levels))
    if unknown:
        raise KeyError(f"overrides for unknown levels: {unknown}")
    features = cluster.cluster_columns(base, [KEY, *CLUSTER_DROP])
    kinds = {**dict.fromkeys(CLUSTER_ASINH, "asinh"), **dict.fromkeys(CLUSTER_LOG1P, "log1p")}
    x = score.apply_transforms(base.select(KEY, *features), {c: k for c, k in kinds.items() if c in features})
    lab = cluster.assign_clusters(x, KEY, features, ks=tuple(levels.values()), starts=starts)
    lab = lab.withColumnsRenamed({f"cluster_k{k}": name for name, k in levels.items()})
    panel = base.join(lab, KEY)
    named = [f for f in NAME_FEATURES if f in base.columns]
    traits = impute.imputation_targets(base, exclude=(KEY,))
    mapping, names = lab.select(KEY, *levels), []
    for level in levels:
        stats = cluster.cluster_stats(panel.select(level, *traits), level, traits)
        short = cluster.short_names(panel, level, named, phrases, out=f"{level}_text", stats=stats)
        report = cluster.label_report(panel, level, traits, phrases, TRADEOFF_RULES, overrides=(overrides or {}).get(level), stats=stats,
                                      name_features=named)
        names.append(report.select(F.lit(level).alias("level"), F.col(level).alias("label"), *REPORT_COLUMNS))
        both = quantile.null_safe(short, report, [level]).withColumnsRenamed({c: f"{level}_{c}" for c in REPORT_COLUMNS})
        mapping = joins.dim_join(mapping, both, level, bounded=True)  # one row per label
    columns = [c for level in levels for c in (level, f"{level}_text", *[f"{level}_{r}" for r in REPORT_COLUMNS])]
    metrics = cluster.model_metrics(lab, KEY, list(levels)).withColumn(
        "model", F.concat(F.lit("pcareducedk"), F.element_at(F.create_map(*[x for n, k in levels.items() for x in (F.lit(n), F.lit(str(k)))]), F.col("model"))))
    return mapping.select(KEY, *columns), metrics, window.union_all(names)


def enriched_panel(base: DataFrame, drop_code: str = "PR", starts: int = 10, overrides: Mapping[str, DataFrame] | None = None,
                   phrases: Mapping[str, tuple[str, str]] = NAME_PHRASES) -> Enriched:
    """M7: clusters (on every unit) and feature/dimension scores (region dropped
    first, O11) joined back one-to-one; each step is checked for one row per unit."""
    window.assert_unique(base, KEY)
    mapping, metrics, names = cluster_tables(base, starts=starts, overrides=overrides, phrases=phrases)
    scores = score.feature_and_dimension_scores(window.drop_region(base, drop_code), PLACE_FEATURES, PLACE_DIMENSIONS, [KEY])
    out = joins.chain_left_joins(base, [scores, cut_lineage(mapping)], KEY)
    return Enriched(window.drop_region(out, drop_code), mapping, metrics, names)
