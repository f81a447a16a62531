"""Registered queries: cleaning (C), filters (D), joins (E1-E5), aggregations (F),
constraints/windows/set operations (G) on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.functions.expr import coerce_numeric, fmt2, round_numeric, safe_div
from placescore.operators import agg, clean, joins, window
from placescore.plans import sqlgen
from placescore.plans.panel import PANEL_KEY, PANEL_SQL, table, unit_panel
from placescore.plans.registry import query
from placescore.plans.spec import PANEL_DIMENSION_COLS
from placescore.specs import STATE_FIPS, STATE_TO_CODE

T = table
SPLIT = "1998-06-01"


# ------------------------------------------------------------------ C

def _order_periods(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    prior = F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")
    return o.groupBy("o_custkey").agg(
        F.sum(F.when(prior, F.col("o_totalprice"))).alias("spend_prior"),
        F.sum(F.when(~prior, F.col("o_totalprice"))).alias("spend"),
        F.count_if(prior).cast("double").alias("orders_prior"),
        F.count_if(~prior).cast("double").alias("orders"),
    )


@query("growth_rates", covers="C5 C4", sql=f"""
WITH p AS (SELECT o_custkey,
  sum(CASE WHEN o_orderdate < TIMESTAMP '{SPLIT}' THEN o_totalprice END) AS spend_prior,
  sum(CASE WHEN o_orderdate >= TIMESTAMP '{SPLIT}' THEN o_totalprice END) AS spend,
  CAST(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SPLIT}') AS DOUBLE) AS orders_prior,
  CAST(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{SPLIT}') AS DOUBLE) AS orders
  FROM orders GROUP BY o_custkey)
SELECT o_custkey, (spend - spend_prior) / nullif(spend_prior, 0) AS spend_growth,
       (orders - orders_prior) / nullif(orders_prior, 0) AS orders_growth FROM p""")
def growth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = clean.add_growth_rates(_order_periods(spark, sf_dir), {"spend_growth": ("spend", "spend_prior"),
                                                                "orders_growth": ("orders", "orders_prior")})
    return p.select("o_custkey", "spend_growth", "orders_growth")


def _flag_qty(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("qty_r"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("qty_a"),
        F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("qty_n"),
        F.sum("l_quantity").alias("qty_total"),
        F.max("l_extendedprice").alias("price_max"),
        F.min("l_extendedprice").alias("price_min"),
    )


_FLAG_SQL = """SELECT l_orderkey,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n,
  sum(l_quantity) AS qty_total, max(l_extendedprice) AS price_max, min(l_extendedprice) AS price_min
  FROM lineitem GROUP BY l_orderkey"""


@query("shares", covers="C6 C7", sql=f"""
WITH f AS ({_FLAG_SQL})
SELECT l_orderkey, (qty_r + qty_a) / nullif(qty_total, 0) * 100.0 AS returned_share,
       qty_n / nullif(qty_total, 0) * 100.0 AS open_share,
       (qty_r + qty_a + qty_n) AS qty_parts_sum FROM f""")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = clean.add_shares(_flag_qty(spark, sf_dir), {"returned_share": (["qty_r", "qty_a"], "qty_total"),
                                                     "open_share": (["qty_n"], "qty_total")})
    from placescore.functions.expr import row_sum
    return f.select("l_orderkey", "returned_share", "open_share", row_sum(["qty_r", "qty_a", "qty_n"]).alias("qty_parts_sum"))


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("diversity_index", covers="C8", sql=f"""
WITH c AS (SELECT c_nationkey, {', '.join(f"CAST(count(*) FILTER (WHERE c_mktsegment = '{s}') AS DOUBLE) AS n_{s.lower()}" for s in _SEGS)},
           CAST(count(*) AS DOUBLE) AS n_total FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, 1.0 - ({' + '.join(f"power(coalesce(n_{s.lower()}, 0.0) / nullif(n_total, 0), 2)" for s in _SEGS)}) AS diversity_index FROM c""")
def diversity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        *[F.count_if(F.col("c_mktsegment") == s).cast("double").alias(f"n_{s.lower()}") for s in _SEGS],
        F.count(F.lit(1)).cast("double").alias("n_total"))
    return clean.add_diversity(c, [f"n_{s.lower()}" for s in _SEGS], "n_total").select("c_nationkey", "diversity_index")


@query("rates_guarded", covers="C4 C9 C17 O9", sql="""
WITH s AS (SELECT n.n_nationkey, CAST(count(DISTINCT c.c_custkey) AS DOUBLE) AS customers,
                  CAST(count(o.o_orderkey) AS DOUBLE) AS orders,
                  CAST(count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'P') AS DOUBLE) AS pending
           FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
           LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_nationkey)
SELECT n_nationkey, orders / nullif(customers, 0) AS orders_per_customer,
       orders / nullif(pending, 0) AS orders_per_pending,
       pending / nullif(orders, 0) * 1000.0 AS pending_per_1000 FROM s""")
def rates_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T(spark, sf_dir, "nation").select("n_nationkey")
    c = T(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = T(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    oc = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("no"), F.count_if(F.col("o_orderstatus") == "P").alias("np"))
    cn = c.join(oc, c.c_custkey == oc.o_custkey, "left").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("customers"),
        F.coalesce(F.sum("no"), F.lit(0)).cast("double").alias("orders"),
        F.coalesce(F.sum("np"), F.lit(0)).cast("double").alias("pending"))
    s = n.join(cn, n.n_nationkey == cn.c_nationkey, "left").select(
        "n_nationkey", F.coalesce("customers", F.lit(0.0)).alias("customers"),
        F.coalesce("orders", F.lit(0.0)).alias("orders"), F.coalesce("pending", F.lit(0.0)).alias("pending"))
    s = clean.add_ratio(s, "orders_per_customer", "orders", "customers")
    s = clean.add_ratio(s, "orders_per_pending", "orders", "pending")
    s = clean.add_ratio(s, "pending_per_1000", "pending", "orders", 1000.0)
    return s.select("n_nationkey", "orders_per_customer", "orders_per_pending", "pending_per_1000")


@query("numeric_coerce", covers="C3 N10", sql="""
WITH t AS (SELECT event_id,
  CASE event_type WHEN 'error' THEN 'n/a' WHEN 'signup' THEN 'NaN' WHEN 'view' THEN '  ' || CAST(event_id AS VARCHAR) || '.25 '
       ELSE format('{:,}', event_id * 1000 + 123) END AS raw FROM events)
SELECT event_id, raw, CASE WHEN isnan(TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE)) THEN NULL
                           ELSE TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) END AS value FROM t""")
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "events")
    raw = (F.when(F.col("event_type") == "error", F.lit("n/a"))
           .when(F.col("event_type") == "signup", F.lit("NaN"))
           .when(F.col("event_type") == "view", F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(".25 ")))
           .otherwise(F.format_number(F.col("event_id") * 1000 + 123, 0)))
    return e.select("event_id", raw.alias("raw")).withColumn("value", coerce_numeric("raw"))


@query("total_with_missing", covers="C21 C22 N4", sql=f"""
WITH f AS ({_FLAG_SQL})
SELECT l_orderkey, qty_r, qty_a, coalesce(qty_r, 0.0) + coalesce(qty_a, 0.0) AS qty_returned_total,
       price_max - price_min AS price_spread, CASE WHEN qty_r > 0 THEN 1 ELSE 0 END AS has_returns FROM f""")
def total_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = clean.add_total(_flag_qty(spark, sf_dir), "qty_returned_total", "qty_r", "qty_a")
    f = clean.seasonal_flags(f, "price_max", "price_min", "qty_r", "price_spread", "has_returns")
    return f.select("l_orderkey", "qty_r", "qty_a", "qty_returned_total", "price_spread", "has_returns")


def _unit_name_spark(p):
    typ = F.when(F.col("p_size") % 3 == 0, F.lit(" Metro Area")).when(F.col("p_size") % 3 == 1, F.lit(" Micro Area")).otherwise(F.lit(""))
    return (F.when(F.col("p_size") % 7 == 0, F.col("p_name"))
            .when(F.col("p_size") % 11 == 0, F.concat_ws(", ", "p_name", "p_type", "p_brand"))
            .otherwise(F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), typ)))


_UNIT_NAME_SQL = """CASE WHEN p_size % 7 = 0 THEN p_name
  WHEN p_size % 11 = 0 THEN p_name || ', ' || p_type || ', ' || p_brand
  ELSE p_name || ', ' || p_brand || CASE p_size % 3 WHEN 0 THEN ' Metro Area' WHEN 1 THEN ' Micro Area' ELSE '' END END"""


@query("name_split", covers="C10 O27", sql=f"""
WITH t AS (SELECT p_partkey, {_UNIT_NAME_SQL} AS unit_name FROM part),
s AS (SELECT p_partkey, unit_name,
  CASE WHEN strpos(unit_name, ', ') > 0 THEN substr(unit_name, 1, strpos(unit_name, ', ') - 1) ELSE unit_name END AS city,
  CASE WHEN strpos(unit_name, ', ') > 0 THEN substr(unit_name, strpos(unit_name, ', ') + 2) ELSE '' END AS rest FROM t)
SELECT p_partkey, unit_name, city,
  trim(regexp_replace(regexp_replace(rest, '\\s+Metro Area$', ''), '\\s+Micro Area$', '')) AS state,
  CASE WHEN ends_with(rest, ' Metro Area') THEN 'Metro' WHEN ends_with(rest, ' Micro Area') THEN 'Micro' END AS cbsa_type
FROM s""")
def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part").select("p_partkey", _unit_name_spark(None).alias("unit_name"))
    return clean.split_unit_name(p, "unit_name").select("p_partkey", "unit_name", "city", "state", "cbsa_type")


@query("name_normalise", covers="C11", sql="""
SELECT p_partkey, upper(regexp_replace(trim(regexp_replace('  ' || replace(p_name, ' ', E' \\n  ') || E'\\r\\n', '[\\r\\n]', ' ', 'g')), '\\s+', ' ', 'g')) AS city_clean
FROM part""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part")
    raw = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" \n  ")), F.lit("\r\n"))
    return p.select("p_partkey", clean.normalize_name_expr(raw).alias("city_clean"))


_STATE_NAMES = list(STATE_TO_CODE)


def _values(rows, cols):
    body = ", ".join("(" + ", ".join(("'" + str(v).replace("'", "''") + "'") if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


@query("code_lookup", covers="C12 C13", sql=f"""
WITH st AS (SELECT * FROM {_values([(i + 1, n) for i, n in enumerate(_STATE_NAMES)], ['idx', 'state_name'])}),
codes AS (SELECT * FROM {_values(list(STATE_TO_CODE.items()), ['state_name', 'state_code'])}),
fips AS (SELECT * FROM {_values(list(STATE_FIPS.items()), ['fips', 'fips_state'])}),
c AS (SELECT c_custkey, c_name, CAST(c_custkey % 60 + 1 AS INTEGER) AS idx,
             lpad(CAST(c_nationkey * 2 + 1 AS VARCHAR), 2, '0') AS fips FROM customer)
SELECT c.c_custkey, coalesce(st.state_name, 'Atlantis') AS state_name, codes.state_code, c.fips,
       CASE WHEN fips.fips_state IS NULL THEN NULL ELSE concat_ws(', ', c.c_name, fips.fips_state) END AS wiki_title
FROM c LEFT JOIN st ON st.idx = c.idx LEFT JOIN codes ON codes.state_name = coalesce(st.state_name, 'Atlantis')
LEFT JOIN fips ON fips.fips = c.fips""")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "customer")
    names = F.array(*[F.lit(n) for n in _STATE_NAMES])
    st = F.coalesce(F.try_element_at(names, (F.col("c_custkey") % 60 + 1).cast("int")), F.lit("Atlantis"))
    fips = F.lpad((F.col("c_nationkey") * 2 + 1).cast("string"), 2, "0")
    fstate = clean.lookup_expr(fips, STATE_FIPS)
    return c.select("c_custkey", st.alias("state_name"), clean.lookup_expr(st, STATE_TO_CODE).alias("state_code"),
                    fips.alias("fips"),
                    F.when(fstate.isNotNull(), F.concat_ws(", ", F.col("c_name"), fstate)).alias("wiki_title"))


@query("point_parse", covers="C15", sql="""
WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'POINT EMPTY'
   WHEN event_type = 'view' THEN ''
   ELSE 'POINT (' || CAST(-value AS VARCHAR) || ' ' || CAST(value / 2 AS VARCHAR) || ')' END AS geolocation FROM events)
SELECT event_id, geolocation,
  TRY_CAST(nullif(regexp_extract(geolocation, 'POINT\\s*\\(\\s*([-+0-9.eE]+)\\s+([-+0-9.eE]+)\\s*\\)', 1), '') AS DOUBLE) AS lon,
  TRY_CAST(nullif(regexp_extract(geolocation, 'POINT\\s*\\(\\s*([-+0-9.eE]+)\\s+([-+0-9.eE]+)\\s*\\)', 2), '') AS DOUBLE) AS lat
FROM t""")
def point_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "events")
    g = (F.when(F.col("event_type") == "error", F.lit("POINT EMPTY")).when(F.col("event_type") == "view", F.lit(""))
         .otherwise(F.concat(F.lit("POINT ("), (-F.col("value")).cast("string"), F.lit(" "),
                             (F.col("value") / 2).cast("string"), F.lit(")"))))
    return clean.parse_point(e.select("event_id", g.alias("geolocation")), "geolocation")


@query("label_fallback", covers="C24", sql="""
WITH t AS (SELECT p_partkey, p_name, p_brand,
  CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE p_name END AS final_name,
  CASE WHEN p_size % 2 = 0 THEN p_type ELSE NULL END AS short_name FROM part)
SELECT p_partkey, coalesce(nullif(trim(final_name), ''), nullif(trim(short_name), ''), '—') AS label,
       concat_ws(', ', p_name, p_brand) AS display_name FROM t""")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part")
    fin = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 3 == 1, F.lit("  ")).otherwise(F.col("p_name"))
    short = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return p.select("p_partkey", clean.display_label(fin, short).alias("label"),
                    clean.place_name("p_name", "p_brand").alias("display_name"))


@query("format_cells", covers="C25", sql="""
SELECT p_partkey, coalesce(printf('%.2f', round_even(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / 7.0 END, 2)), '—') AS price_text
FROM part""")
def format_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part")
    x = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") / 7.0)
    return p.select("p_partkey", fmt2(x).alias("price_text"))


@query("round_numeric", covers="C23", sql="""
SELECT p_partkey, p_size, round_even(p_retailprice / 3.0, 2) AS price_third, round_even(p_retailprice * 1.005, 2) AS price_up
FROM part""")
def round_numeric_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 3.0).alias("price_third"),
                                         (F.col("p_retailprice") * 1.005).alias("price_up"))
    return round_numeric(p, 2, exclude=["p_partkey"])


# ------------------------------------------------------------------ D

@query("drop_region", covers="D1 O28", sql=f"""
WITH panel AS ({PANEL_SQL})
SELECT unit_key, state FROM panel WHERE coalesce(upper(trim(state)), '') <> 'NATION_7'""")
def drop_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = unit_panel(spark, sf_dir).withColumn("state", F.lower(F.col("state")))
    return window.drop_region(p, " nation_7 ").select(PANEL_KEY, F.upper("state").alias("state"))


@query("drop_missing", covers="D2 D6", sql=f"""
WITH panel AS ({PANEL_SQL})
SELECT unit_key, CAST(event_value_mean IS NOT NULL AND spend_growth IS NOT NULL AS INTEGER) AS complete
FROM panel WHERE NOT (event_value_mean IS NULL AND event_count IS NULL AND order_count IS NULL)""")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = unit_panel(spark, sf_dir)
    some = window.drop_missing(p, ["event_value_mean", "event_count", "order_count"], how="all")
    full = window.drop_missing(some, ["event_value_mean", "spend_growth"], how="any").select(PANEL_KEY, F.lit(1).alias("__c"))
    return some.join(full, PANEL_KEY, "left").select(PANEL_KEY, F.coalesce("__c", F.lit(0)).alias("complete"))


@query("month_range", covers="D3", sql="""
SELECT CAST(month(l_shipdate) + l_linenumber - 1 AS INTEGER) AS month, count(*) AS n_rows
FROM lineitem WHERE month(l_shipdate) + l_linenumber - 1 BETWEEN 1 AND 12 GROUP BY 1""")
def month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem").select((F.month("l_shipdate") + F.col("l_linenumber") - 1).cast("int").alias("month"))
    return window.month_range(li, "month").groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"))


_INCOMES = [2_000_000.0, 6_000_000.0, 10_000_000.0]


@query("affordability_modes", covers="D4", sql=f"""
WITH panel AS ({PANEL_SQL}),
inc AS (SELECT * FROM {_values([(i,) for i in _INCOMES], ['income'])}),
m AS (SELECT * FROM {_values([('rent',), ('buy',), ('either',)], ['housing_mode'])})
SELECT inc.income, m.housing_mode, count(p.unit_key) AS n_affordable
FROM inc CROSS JOIN m LEFT JOIN panel p ON
  (m.housing_mode = 'rent' AND p.avg_order_value <= inc.income / 12.0 * 0.3) OR
  (m.housing_mode = 'buy' AND p.total_spend <= inc.income * 3.5) OR
  (m.housing_mode = 'either' AND (p.avg_order_value <= inc.income / 12.0 * 0.3 OR p.total_spend <= inc.income * 3.5))
GROUP BY 1, 2""")
def affordability_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placescore.operators.recommend import affordability_predicate
    cases = [(inc, mode) for inc in _INCOMES for mode in ("rent", "buy", "either")]
    counts = unit_panel(spark, sf_dir).agg(*[
        F.count_if(affordability_predicate(F.lit(inc), mode, "avg_order_value", "total_spend")).alias(f"n{k}")
        for k, (inc, mode) in enumerate(cases)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(inc).alias("income"), F.lit(mode).alias("housing_mode"), F.col(f"n{k}").alias("n_affordable"))
        for k, (inc, mode) in enumerate(cases)])))


def station_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly station normals stand-in: supplier x ship month from lineitem.

    temperature = mean discount x 100 (missing for return flag R only months),
    precipitation = mean tax x 100 over non-R rows, snow = returned quantity.
    """
    li = T(spark, sf_dir, "lineitem")
    m = F.month("l_shipdate")
    notr = F.col("l_returnflag") != "R"
    return li.groupBy(F.col("l_suppkey").alias("station"), m.alias("month")).agg(
        (F.avg(F.when(notr, F.col("l_discount"))) * 100.0).alias("temp"),
        (F.avg(F.when(notr & (F.col("l_linestatus") == "O"), F.col("l_tax"))) * 100.0).alias("prcp"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("snow"),
        F.min("l_orderkey").alias("file_order"),
    )


_STATION_MONTHS_SQL = """SELECT l_suppkey AS station, month(l_shipdate) AS month,
  avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END) * 100.0 AS temp,
  avg(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN l_tax END) * 100.0 AS prcp,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS snow,
  min(l_orderkey) AS file_order
  FROM lineitem GROUP BY 1, 2"""

_MONTH_DAYS_SQL = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"


@query("annual_summary", covers="F7 D3 D5 O25", sql=f"""
WITH sm AS ({_STATION_MONTHS_SQL}),
w AS (SELECT *, CAST(({_MONTH_DAYS_SQL})[month] AS DOUBLE) AS wd FROM sm WHERE month BETWEEN 1 AND 12),
s AS (SELECT station,
   sum(CASE WHEN temp IS NOT NULL THEN temp * wd END) / nullif(sum(CASE WHEN temp IS NOT NULL THEN wd END), 0) AS avg_annual_temp,
   arg_min(temp, file_order) FILTER (WHERE month = 1 AND temp IS NOT NULL) AS jan_avg_temp,
   arg_min(temp, file_order) FILTER (WHERE month = 7 AND temp IS NOT NULL) AS jul_avg_temp,
   sum(prcp) AS annual_precipitation, sum(snow) AS annual_snowfall,
   CAST(count(DISTINCT month) AS BIGINT) AS n_months_available,
   count(temp) AS nt, count(prcp) AS np FROM w GROUP BY station)
SELECT station, avg_annual_temp, jan_avg_temp, jul_avg_temp, annual_precipitation, annual_snowfall,
       n_months_available, n_months_available = 12 AS has_complete_year FROM s WHERE nt > 0 AND np > 0""")
def annual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = agg.annual_summary(station_months(spark, sf_dir), "station", "month", "temp", "prcp", "snow", "file_order")
    return s.withColumn("n_months_available", F.col("n_months_available").cast("long"))


@query("station_eligibility", covers="D5", sql=f"""
WITH sm AS ({_STATION_MONTHS_SQL})
SELECT station, count(temp) AS n_temp, count(prcp) AS n_prcp FROM sm GROUP BY station HAVING count(temp) > 0 AND count(prcp) > 0""")
def station_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    sm = station_months(spark, sf_dir)
    g = sm.groupBy("station").agg(F.count("temp").alias("n_temp"), F.count("prcp").alias("n_prcp"))
    return g.where((F.col("n_temp") > 0) & (F.col("n_prcp") > 0))


# ------------------------------------------------------------------ E1-E5

@query("left_composite_join", covers="E1 D2", sql="""
WITH dim AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty_1995 FROM lineitem
             WHERE year(l_shipdate) = 1995 GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, d.qty_1995 FROM lineitem l LEFT JOIN dim d
  ON l.l_partkey = d.l_partkey AND l.l_suppkey = d.l_suppkey""")
def left_composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem")
    dim = li.where(F.year("l_shipdate") == 1995).groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty_1995"))
    return joins.left_join(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), dim,
                           ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "qty_1995")


@query("validated_chain_join", covers="E2 G1", sql="""
WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1),
e AS (SELECT user_id AS c_custkey, count(*) AS n_events FROM events GROUP BY 1),
n AS (SELECT n_nationkey AS c_nationkey, n_name FROM nation)
SELECT c.c_custkey, n.n_name, o.n_orders, e.n_events FROM customer c
LEFT JOIN o USING (c_custkey) LEFT JOIN e USING (c_custkey) LEFT JOIN n USING (c_nationkey)""")
def validated_chain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    e = T(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    out = joins.chain_left_joins(c, [o, e], "c_custkey")
    n = T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.left_join(out, n, "c_nationkey")
    return out.select("c_custkey", "n_name", "n_orders", "n_events")


@query("outer_slices", covers="E3 A9", sql="""
WITH a AS (SELECT o_custkey, count(*) AS n_finished FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey, sum(o_totalprice) AS open_value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
c AS (SELECT o_custkey, max(o_orderpriority) AS top_priority FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT * FROM a FULL OUTER JOIN b USING (o_custkey) FULL OUTER JOIN c USING (o_custkey)""")
def outer_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_finished"))
    b = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("open_value"))
    c = o.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("top_priority"))
    return joins.full_outer_slices([a, b, c], "o_custkey")


@query("prior_period_join", covers="E4 A10 C5", sql="""
WITH cur AS (SELECT o_custkey, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS n FROM orders
             WHERE year(o_orderdate) = 1997 GROUP BY 1),
pri AS (SELECT o_custkey, sum(o_totalprice) AS spend_prior, CAST(count(*) AS DOUBLE) AS n_prior FROM orders
             WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT cur.o_custkey, spend, spend_prior, (spend - spend_prior) / nullif(spend_prior, 0) AS spend_growth,
       (n - n_prior) / nullif(n_prior, 0) AS count_growth FROM cur LEFT JOIN pri USING (o_custkey)""")
def prior_period_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders")
    per = lambda y: o.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("n"))
    pri = joins.suffix_columns(per(1996), "_prior", keep=["o_custkey"])
    j = joins.left_join(per(1997), pri, "o_custkey")
    j = clean.add_growth_rates(j, {"spend_growth": ("spend", "spend_prior"), "count_growth": ("n", "n_prior")})
    return j.select("o_custkey", "spend", "spend_prior", "spend_growth", "count_growth")


@query("dim_label_join", covers="E5", sql="""
WITH lbl AS (SELECT c_custkey, CAST(c_custkey % 5 AS INTEGER) AS cluster FROM customer),
names AS (SELECT CAST(r_regionkey AS INTEGER) AS cluster, r_name AS cluster_name FROM region)
SELECT lbl.c_custkey, lbl.cluster, names.cluster_name FROM lbl LEFT JOIN names USING (cluster)""")
def dim_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lbl = T(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("cluster"))
    names = T(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("cluster"), F.col("r_name").alias("cluster_name"))
    return joins.dim_join(lbl, names, "cluster", bounded=True).select("c_custkey", "cluster", "cluster_name")


# ------------------------------------------------------------------ F

@query("weighted_rollup", covers="F3 F4 F6 O26", sql="""
SELECT l_suppkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_rows, sum(l_quantity) AS total_weight,
  sum(CASE WHEN l_discount IS NOT NULL AND l_quantity > 0 THEN l_discount * l_quantity END)
    / nullif(sum(CASE WHEN l_discount IS NOT NULL AND l_quantity > 0 THEN l_quantity END), 0) AS l_discount,
  sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 0 THEN l_tax * l_quantity END)
    / nullif(sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 0 THEN l_quantity END), 0) AS tax_returned,
  sum(CASE WHEN l_extendedprice IS NOT NULL AND l_quantity > 0 THEN l_extendedprice * l_quantity END)
    / nullif(sum(CASE WHEN l_extendedprice IS NOT NULL AND l_quantity > 0 THEN l_quantity END), 0) AS l_extendedprice
FROM lineitem GROUP BY l_suppkey""")
def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem").withColumn("tax_returned", F.when(F.col("l_returnflag") == "R", F.col("l_tax")))
    return agg.weighted_rollup(li, ["l_suppkey"], ["l_discount", "tax_returned", "l_extendedprice"], "l_quantity",
                               row_id="l_orderkey")


@query("group_sum_mean", covers="F1 F2 N2", sql="""
SELECT CAST(month(l_shipdate) AS INTEGER) AS ship_month, l_returnflag,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS qty_open, sum(l_extendedprice) AS revenue,
  avg(l_discount) AS l_discount, avg(l_tax) AS l_tax
FROM lineitem GROUP BY 1, 2""")
def group_sum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem").select(F.month("l_shipdate").cast("int").alias("ship_month"), "l_returnflag",
                                              F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("qty_open"),
                                              F.col("l_extendedprice").alias("revenue"), "l_discount", "l_tax")
    s = agg.group_sum(li, ["ship_month", "l_returnflag"], ["qty_open", "revenue"])
    m = agg.group_mean(li, ["ship_month", "l_returnflag"], ["l_discount", "l_tax"])
    return s.join(m, ["ship_month", "l_returnflag"])


@query("mode_crosswalk", covers="F5 O6", sql="""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM c)
SELECT o_custkey, o_orderpriority AS top_priority FROM r WHERE rn = 1""")
def mode_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_mode(T(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "top_priority")


@query("distinct_counts", covers="F6", sql="""
SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct_l_partkey, count(DISTINCT month(l_shipdate)) AS n_distinct_ship_month
FROM lineitem GROUP BY 1""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem").withColumn("ship_month", F.month("l_shipdate"))
    return agg.distinct_count(li, ["l_suppkey"], ["l_partkey", "ship_month"])


_NP_COLS = ["acctbal", "order_count", "total_spend", "avg_order_value", "open_order_share", "spend_growth",
            "event_value_mean", "event_count"]


@query("null_profile", covers="F18", sql=f"""
WITH panel AS ({PANEL_SQL}),
c AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in _NP_COLS)} FROM panel)
SELECT column_name, CAST(missing_count AS BIGINT) AS missing_count, missing_count * 100.0 / nullif(n, 0) AS missing_pct
FROM c UNPIVOT (missing_count FOR column_name IN ({', '.join(_NP_COLS)}))""")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.null_profile(unit_panel(spark, sf_dir), _NP_COLS)


_H_COLS = ["acctbal", "avg_order_value", "event_value_mean"]


@query("histogram30", covers="F19", sql=f"""
WITH panel AS ({PANEL_SQL}),
l AS (SELECT column_name, CAST(value AS DOUBLE) AS value FROM panel UNPIVOT (value FOR column_name IN ({', '.join(_H_COLS)}))),
b AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1),
x AS (SELECT l.column_name, b.lo, b.hi, CASE WHEN b.hi = b.lo THEN 1
        ELSE least(CAST(floor((l.value - b.lo) / ((b.hi - b.lo) / 30)) AS INTEGER) + 1, 30) END AS bin
      FROM l JOIN b USING (column_name) WHERE l.value IS NOT NULL)
SELECT column_name, bin, lo + (bin - 1) * (hi - lo) / 30 AS bin_lo, lo + bin * (hi - lo) / 30 AS bin_hi, count(*) AS n
FROM x GROUP BY column_name, bin, lo, hi""")
def histogram30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.histogram(unit_panel(spark, sf_dir), _H_COLS, 30).withColumn("bin", F.col("bin").cast("int"))


@query("density_grid", covers="F20", sql="""
WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL),
st AS (SELECT count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM v),
g AS (SELECT CAST(gi AS INTEGER) AS gi, lo + gi * (hi - lo) / 49 AS x, sd * power(CAST(n AS DOUBLE), -0.2) AS h, n
      FROM st CROSS JOIN range(50) AS r(gi))
SELECT g.gi AS grid_index, g.x, sum(exp(-((g.x - v.v) / g.h) * ((g.x - v.v) / g.h) / 2)) / (g.n * g.h * sqrt(2 * pi())) AS density
FROM g CROSS JOIN v GROUP BY g.gi, g.x, g.h, g.n""")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agg.density_grid(T(spark, sf_dir, "events"), "value", points=50)
    return d.withColumn("grid_index", F.col("grid_index").cast("int"))


@query("shape_stats", covers="F10", sql="""
SELECT p_type, skewness(p_retailprice) AS p_retailprice_skew, kurtosis(p_retailprice) AS p_retailprice_kurt,
  avg(CASE WHEN p_retailprice IS NOT NULL THEN CAST(abs(p_retailprice) > 1500 AS DOUBLE) END) * 100.0 AS p_retailprice_tail_pct,
  skewness(CAST(p_size AS DOUBLE)) AS p_size_skew, kurtosis(CAST(p_size AS DOUBLE)) AS p_size_kurt,
  avg(CASE WHEN p_size IS NOT NULL THEN CAST(abs(p_size) > 1500 AS DOUBLE) END) * 100.0 AS p_size_tail_pct
FROM part GROUP BY p_type""")
def shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return agg.shape_stats(p, ["p_retailprice", "p_size"], by=["p_type"], tail_z=1500.0)


# ------------------------------------------------------------------ G

@query("duplicate_keys", covers="G1 G2", sql="""
SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.duplicate_key_report(T(spark, sf_dir, "lineitem"), "l_orderkey")


@query("duplicate_flags", covers="G2", sql="""
SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 AS is_duplicate FROM orders""")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders")
    return window.flag_duplicates(o, ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderkey", "is_duplicate")


@query("dedupe_last", covers="G4", sql="""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir, "events")
    return window.dedupe(e, "user_id", ["ts", "event_id"], keep="last", columns=["event_id", "event_type", "value"])


@query("dedupe_first", covers="G5", sql="""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T(spark, sf_dir, "lineitem")
    return window.dedupe(li, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("union_levels", covers="G9 G11", sql="""
SELECT 'region' AS level, CAST(r.r_regionkey AS BIGINT) AS label, count(*) AS n_customers, avg(c.c_acctbal) AS mean_acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey
UNION ALL
SELECT 'nation' AS level, CAST(c.c_nationkey AS BIGINT) AS label, count(*) AS n_customers, avg(c.c_acctbal) AS mean_acctbal
FROM customer c GROUP BY c.c_nationkey""")
def union_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T(spark, sf_dir, "customer")
    n = T(spark, sf_dir, "nation")
    reg = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg("c_acctbal").alias("mean_acctbal"))
    nat = c.groupBy(F.col("c_nationkey").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg("c_acctbal").alias("mean_acctbal"))
    return window.union_all([window.with_level(reg, "region"), window.with_level(nat, "nation")]).select(
        "level", "label", "n_customers", "mean_acctbal")


@query("unpivot_scores", covers="G10", sql=f"""
WITH {sqlgen.scored_panel_ctes()}
SELECT unit_key, dimension, score FROM (SELECT unit_key, {', '.join(PANEL_DIMENSION_COLS)} FROM ds)
UNPIVOT INCLUDE NULLS (score FOR dimension IN ({', '.join(PANEL_DIMENSION_COLS)}))""")
def unpivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placescore.plans.q_scoring import scored_panel
    sp = scored_panel(spark, sf_dir)
    return window.unpivot(sp, [PANEL_KEY], PANEL_DIMENSION_COLS, "dimension", "score")
