"""Registered queries: the source builds (M2, M4, M5) and cleaning steps on frames derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.operators import clean
from placescore.plans import pipeline
from placescore.plans.panel import PANEL_SQL, STATIONS_SQL, stations, table, unit_panel
from placescore.plans.q_models import _HAV
from placescore.plans.q_relational import _MONTH_DAYS_SQL, _STATION_MONTHS_SQL, station_months
from placescore.plans.registry import query
from placescore.specs import (AGE_BUCKETS, CENSUS_NAME_HEADER, CENSUS_PRIOR_VARIABLES, CENSUS_SHARES, CENSUS_UNIT_HEADER,
                              CENSUS_VARIABLES, RACE_GROUPS, RACE_TOTAL, STATE_TO_CODE)

_NAMES = ", ".join(f"'{n.title()}'" for n in STATE_TO_CODE)
_CODES = ", ".join(f"'{c}'" for c in STATE_TO_CODE.values())
_N = len(STATE_TO_CODE)


# City crime: one row per customer, 120 city names, every 9th in an unknown state, counts as text with commas.
@query("crime_build", covers="M2 C3 C11 C12 C14 C21 E4 F1 F5", sql=f"""
WITH city AS (SELECT 'CITY ' || (c_custkey % 120) AS city, CASE WHEN c_custkey % 9 <> 0 THEN ([{_CODES}])[CAST(c_custkey % {_N} AS INTEGER) + 1] END AS state,
    CASE WHEN c_custkey % 13 <> 0 THEN CAST(1000 + c_custkey AS DOUBLE) END AS v, CASE WHEN c_custkey % 17 <> 0 THEN CAST(2000 + 3 * c_custkey AS DOUBLE) END AS p FROM customer),
zip AS (SELECT 'CITY ' || (o_custkey % 120) AS city, ([{_CODES}])[CAST(o_custkey % {_N} AS INTEGER) + 1] AS state, CAST(o_orderkey % 23 AS VARCHAR) AS code
    FROM orders WHERE o_orderkey % 5 <> 0),
best AS (SELECT city, state, code FROM (SELECT city, state, code, row_number() OVER (PARTITION BY city, state ORDER BY count(*) DESC, code) AS r FROM zip GROUP BY 1, 2, 3) WHERE r = 1)
SELECT code AS cbsa_code, sum(v) AS violent_crime_count, sum(p) AS property_crime_count, sum(coalesce(v, 0) + coalesce(p, 0)) AS total_crime_count
FROM city JOIN best USING (city, state) GROUP BY code""")
def crime_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    state = F.when(k % 9 == 0, F.lit("Atlantis")).otherwise(F.element_at(F.array(*[F.lit(n.title()) for n in STATE_TO_CODE]), (k % _N).cast("int") + 1))
    city = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" city\n "), (k % 120).cast("string"), F.lit(" ")).alias("City_Clean"), state.alias("State_Clean"),
        F.when(k % 13 != 0, F.format_number(1000 + k, 0)).alias("Violent\ncrime"), F.when(k % 17 != 0, F.format_number(2000 + 3 * k, 0)).otherwise(F.lit("n/a")).alias("Property\ncrime"))
    o = F.col("o_orderkey")
    codes = F.array(*[F.lit(c.lower()) for c in STATE_TO_CODE.values()])
    zips = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("City "), (F.col("o_custkey") % 120).cast("string")).alias("USPS_ZIP_PREF_CITY"),
        F.element_at(codes, (F.col("o_custkey") % _N).cast("int") + 1).alias("USPS_ZIP_PREF_STATE"),
        F.when(o % 5 != 0, F.concat((o % 23).cast("string"), F.when(o % 2 == 0, F.lit(".0")).otherwise(F.lit("")))).alias("CBSA"))
    return pipeline.crime_build(city, zips)


@query("walkability_build", covers="M4 C3 C14 F2 F3", sql="""
WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS cbsa_code, CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS INTEGER) - 3 AS DOUBLE) END AS w,
    CAST(l_linenumber AS DOUBLE) AS walk, CAST(CAST(l_discount * 100 AS INTEGER) AS DOUBLE) AS d1, CAST(CAST(l_tax * 100 AS INTEGER) AS DOUBLE) AS d2,
    CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS DOUBLE) END AS d3 FROM lineitem WHERE l_partkey % 11 <> 0)
SELECT cbsa_code, avg(walk) AS nat_walk_index_mean, avg(d1) AS population_density_mean, avg(d2) AS activity_density_mean, avg(d3) AS intersection_density_mean,
  sum(CASE WHEN w > 0 THEN walk * w END) / nullif(sum(CASE WHEN w > 0 THEN w END), 0) AS nat_walk_index_pop_weighted FROM b GROUP BY 1""")
def walkability_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("int").cast("string")
    groups = li.select(
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.lit(".0")).otherwise(F.lit(" ")))).alias("CBSA"),
        F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(s(F.col("l_quantity").cast("int") - 3)).alias("TotPop"),
        s(F.col("l_linenumber")).alias("NatWalkInd"), s(F.col("l_discount") * 100).alias("D1B"), s(F.col("l_tax") * 100).alias("D1D"),
        F.when(F.col("l_linestatus") == "O", s(F.col("l_linenumber"))).alias("D3B"))
    return pipeline.walkability_build(groups)


@query("weather_build", covers="M5 C22 E7 F7 D5", sql=f"""
WITH sm AS ({_STATION_MONTHS_SQL}), panel AS ({PANEL_SQL}), st AS ({STATIONS_SQL}),
w AS (SELECT *, CAST(({_MONTH_DAYS_SQL})[month] AS DOUBLE) AS wd FROM sm),
y AS (SELECT station, sum(CASE WHEN temp IS NOT NULL THEN temp * wd END) / nullif(sum(CASE WHEN temp IS NOT NULL THEN wd END), 0) AS avg_annual_temp,
   arg_min(temp, file_order) FILTER (WHERE month = 1 AND temp IS NOT NULL) AS jan, arg_min(temp, file_order) FILTER (WHERE month = 7 AND temp IS NOT NULL) AS jul,
   sum(prcp) AS annual_precipitation, sum(snow) AS annual_snowfall, CAST(count(DISTINCT month) AS BIGINT) AS n_months_available
   FROM w GROUP BY station HAVING count(temp) > 0 AND count(prcp) > 0),
s AS (SELECT st.*, y.* FROM y JOIN st ON y.station = st.station_id),
d AS (SELECT CAST(p.unit_key AS VARCHAR) AS cbsa_code, s.*, {_HAV} AS dist FROM panel p CROSS JOIN s),
r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cbsa_code ORDER BY dist, station_id) = 1)
SELECT cbsa_code, station_id, station_name, dist AS station_distance_km, avg_annual_temp, annual_snowfall, n_months_available,
  n_months_available = 12 AS has_complete_year, jul - jan AS temp_seasonality, CASE WHEN annual_snowfall > 0 THEN 1 ELSE 0 END AS snow_binary FROM r""")
def weather_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = stations(spark, sf_dir).select(F.col("station_id").alias("station"), F.col("station_name").alias("name"),
                                        F.col("station_lat").alias("latitude"), F.col("station_lon").alias("longitude"))
    months = station_months(spark, sf_dir).join(st, "station").withColumnsRenamed(
        {"temp": "mly_tavg_normal", "prcp": "mly_prcp_normal", "snow": "mly_snow_normal"})
    centroids = unit_panel(spark, sf_dir).select(F.col("unit_key").cast("string").alias("cbsa_code"), F.col("lat").alias("centroid_lat"), F.col("lon").alias("centroid_lon"))
    out = pipeline.weather_build(months, centroids)
    return out.select("cbsa_code", "station_id", "station_name", "station_distance_km", "avg_annual_temp", "annual_snowfall",
                      F.col("n_months_available").cast("long").alias("n_months_available"), "has_complete_year", "temp_seasonality", "snow_binary")


@query("column_cleaning", covers="C1 C2 C14 C16 C18 C19", sql="""
SELECT CAST(c_custkey AS VARCHAR) AS unit_code, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE CAST(c_nationkey AS DOUBLE) END AS weight,
  c_mktsegment AS market_segment FROM customer""")
def column_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias(" Market--Segment "), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("adults"),
        F.col("c_nationkey").cast("double").alias("people"), F.lit(1).alias("people_prior"), F.concat(F.col("c_custkey").cast("string"), F.lit(".0 ")).alias("Code"))
    df = clean.drop_by_suffix(clean.rename_columns(clean.snake_case_columns(raw), {"code": "unit_code", "not_there": "x"}), "_prior")
    df = df.withColumns({"unit_code": clean.strip_code_suffix(F.trim("unit_code")), "weight": clean.fallback_weight("adults", "people")})
    return clean.reorder_columns(df.drop("adults", "people"), ["unit_code"], [["weight"]])


# Census responses: units are customers, 50 to a block; a block has two responses of the current year (40 variables and the
# rest) and one of the earlier year, each missing some units; some responses are error objects.
_VARIABLES = list(CENSUS_VARIABLES)
_SLICES = [_VARIABLES[:40], _VARIABLES[40:]]


def _census_value(i: int) -> str:
    """Text of variable ``i`` of unit ``k``: a number, null, or text that is none; the same in Spark and DuckDB."""
    return (f"CASE WHEN (k + {i}) % 29 = 0 THEN NULL WHEN (k + {3 * i}) % 31 = 0 THEN '(X)' "
            f"ELSE CAST(100 + (k * {i + 7}) % {50 + i} AS STRING) END")


def _prior_value(i: int) -> str:
    return f"CAST((k * {i + 5}) % {40 + i} AS STRING)"


_CENSUS_NAME = "concat('City ', CAST(k AS STRING), CASE WHEN k % 3 = 0 THEN ', OH Metro Area' WHEN k % 3 = 1 THEN ', NY-NJ Micro Area' ELSE '' END)"
#: slice: its rows, its errors, header and values.
_CENSUS_RESPONSES = {
    ("current", 0): ("k % 10 <> 0", "block % 5 = 4", [CENSUS_NAME_HEADER, *_SLICES[0]], [_CENSUS_NAME, *[_census_value(i) for i in range(40)]]),
    ("current", 1): ("k % 11 <> 0", "block % 7 = 3", _SLICES[1], [_census_value(i) for i in range(40, len(_VARIABLES))]),
    ("prior", 0): ("k % 13 <> 0", "block % 6 = 5", CENSUS_PRIOR_VARIABLES, [_prior_value(i) for i in range(len(CENSUS_PRIOR_VARIABLES))]),
}


def _census_responses(spark: SparkSession, sf_dir: str, year: str) -> DataFrame:
    """(slice, payload): a JSON text per block of 50 customers and slice."""
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("(c_custkey - 1) div 50").alias("block"))
    out = None
    for (of, n), (rows, error, header, values) in _CENSUS_RESPONSES.items():
        if of != year:
            continue
        cells = F.array(*[F.expr(v) for v in values], F.concat(F.lit(" "), F.col("k").cast("string")))
        one = units.where(rows).groupBy("block").agg(F.collect_list(cells).alias("rows"))
        head = F.array(F.array(*[F.lit(h) for h in [*header, CENSUS_UNIT_HEADER]]))
        text_ = F.when(F.expr(error), F.lit('{"error": "unknown variable"}')).otherwise(F.to_json(F.concat(head, "rows"), {"ignoreNullFields": "false"}))
        one = one.select((F.col("block") * 2 + n).alias("slice"), text_.alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def _census_sql() -> str:
    flags = {("current", 0): "c0", ("current", 1): "c1", ("prior", 0): "p0"}
    base = ", ".join(f"({rows}) AND NOT ({error}) AS {flags[key]}" for key, (rows, error, _, _) in _CENSUS_RESPONSES.items())
    number = lambda v: f"TRY_CAST({v.replace('STRING', 'VARCHAR')} AS DOUBLE)"
    cols = [f"CASE WHEN c{int(i >= 40)} THEN {number(_census_value(i))} END AS \"{CENSUS_VARIABLES[v]}\"" for i, v in enumerate(_VARIABLES)]
    cols += [f"CASE WHEN p0 THEN {number(_prior_value(i))} END AS \"{CENSUS_VARIABLES[v]}_prior\"" for i, v in enumerate(CENSUS_PRIOR_VARIABLES)]
    ages = [f"{' + '.join(f'{s}_{b}_B01001' for s in ('Male', 'Female') for b in names)} AS {out}" for out, names in AGE_BUCKETS.items()]
    shares = [f"({' + '.join(nums)}) / nullif({den}, 0) * 100 AS {out}" for out, (nums, den) in CENSUS_SHARES.items()]
    growth = [f"({a} - {b}) / nullif({b}, 0) AS {out}" for out, (a, b) in pipeline.GROWTH_PAIRS.items()]
    diversity = " + ".join(f"power(coalesce({g}, 0) / nullif({RACE_TOTAL}, 0), 2)" for g in RACE_GROUPS)
    return f"""
WITH u AS (SELECT c_custkey AS k, (c_custkey - 1) // 50 AS block FROM customer), f AS (SELECT *, {base} FROM u),
v AS (SELECT k, c0, {", ".join(cols)} FROM f WHERE c0 OR c1), a AS (SELECT *, {", ".join(ages)} FROM v)
SELECT CAST(k AS VARCHAR) AS cbsa_code, CASE WHEN c0 THEN 'City ' || k ELSE '' END AS city,
  CASE WHEN c0 AND k % 3 = 0 THEN 'OH' WHEN c0 AND k % 3 = 1 THEN 'NY-NJ' ELSE '' END AS state,
  CASE WHEN c0 AND k % 3 = 0 THEN 'Metro' WHEN c0 AND k % 3 = 1 THEN 'Micro' END AS cbsa_type,
  TotalPopulation_B01003, MedianHomeValue_B25077, age_22_34_total, age_65_plus_total, {", ".join(shares)}, {", ".join(growth)},
  1 - ({diversity}) AS diversity_index FROM a"""


@query("census_build", covers="M1 A8 A9 A10 E3 C3 C5 C6 C7 C8 C10", sql=_census_sql())
def census_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = pipeline.census_from_responses(_census_responses(spark, sf_dir, "current"), _census_responses(spark, sf_dir, "prior"), None)
    return out.select("cbsa_code", "city", "state", "cbsa_type", "TotalPopulation_B01003", "MedianHomeValue_B25077", *AGE_BUCKETS,
                      *CENSUS_SHARES, *pipeline.GROWTH_PAIRS, "diversity_index")


@query("census_quarantine", covers="A8 M1", sql="""
WITH b AS (SELECT DISTINCT (c_custkey - 1) // 50 AS block FROM customer)
SELECT 'current' AS year, block * 2 AS slice, 'bad shape' AS reason FROM b WHERE block % 5 = 4
UNION ALL SELECT 'current', block * 2 + 1, 'bad shape' FROM b WHERE block % 7 = 3 UNION ALL SELECT 'prior', block * 2, 'bad shape' FROM b WHERE block % 6 = 5""")
def census_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.census_from_responses(_census_responses(spark, sf_dir, "current"), _census_responses(spark, sf_dir, "prior"), None)[1]
