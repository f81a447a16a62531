"""Unit panel built from the driver tables (one row per customer).

The panel stands in for the place panel: ``unit_key`` = customer, ``state`` =
nation name, ``unit_type`` = market segment.  Order and event statistics become
measures; most customers have no events, so event measures are truly missing and
exercise the hierarchical imputation.  Coordinates are synthetic but derived from
the key by a fixed formula, so every engine computes the same values.

Scale notes: orders and events are pre-aggregated per customer before the join
(map-side partial aggregation, one shuffle each on the customer key); the
customer/aggregate joins are then co-partitioned on that key.  ``nation`` is a
25-row dimension (broadcast by AQE's size check).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values for the derived panel (the SQL oracle uses the same numbers).
GROWTH_SPLIT_DATE = "1998-06-01"
LAT_BASE, LAT_MULT, LAT_MOD = 25, 37, 2400
LON_BASE, LON_MULT, LON_MOD = -125, 91, 5800
ST_LAT_MULT, ST_LON_MULT = 239, 577
#: Customers of this nation have no state; customers whose key this divides have no type.
NO_STATE, NO_TYPE = 7, 11

PANEL_KEY = "unit_key"
PANEL_STATE = "state"
PANEL_TYPE = "unit_type"
PANEL_IDS = [PANEL_KEY, "unit_name", PANEL_STATE, PANEL_TYPE]
PANEL_MEASURES = [
    "acctbal",
    "order_count",
    "total_spend",
    "avg_order_value",
    "open_order_share",
    "spend_growth",
    "event_value_mean",
    "event_count",
]
PANEL_COORDS = ["lat", "lon"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def synthetic_lat(key: str) -> F.Column:
    return (F.lit(LAT_BASE) + (F.col(key) * LAT_MULT % LAT_MOD) / F.lit(100.0)).cast("double")


def synthetic_lon(key: str) -> F.Column:
    return (F.lit(LON_BASE) + (F.col(key) * LON_MULT % LON_MOD) / F.lit(100.0)).cast("double")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as weather stations with synthetic coordinates."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("station_id"),
        F.col("s_name").alias("station_name"),
        (F.lit(LAT_BASE) + (F.col("s_suppkey") * ST_LAT_MULT % LAT_MOD) / F.lit(100.0)).cast("double").alias("station_lat"),
        (F.lit(LON_BASE) + (F.col("s_suppkey") * ST_LON_MULT % LON_MOD) / F.lit(100.0)).cast("double").alias("station_lon"),
    )


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    prior = F.col("o_orderdate") < F.lit(GROWTH_SPLIT_DATE).cast("timestamp")
    return o.groupBy(F.col("o_custkey").alias(PANEL_KEY)).agg(
        F.count(F.lit(1)).cast("double").alias("order_count"),
        F.sum("o_totalprice").alias("total_spend"),
        F.avg("o_totalprice").alias("avg_order_value"),
        F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("open_orders"),
        F.sum(F.when(prior, F.col("o_totalprice"))).alias("spend_prior"),
        F.sum(F.when(~prior, F.col("o_totalprice"))).alias("spend_current"),
    )


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias(PANEL_KEY)).agg(
        F.avg("value").alias("event_value_mean"),
        F.count(F.lit(1)).cast("double").alias("event_count"),
    )


def unit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: ids, eight measures (some missing) and coordinates."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias(PANEL_KEY),
        F.col("c_name").alias("unit_name"),
        F.when(F.col("c_nationkey") != NO_STATE, F.col("n_name")).alias(PANEL_STATE),
        F.when(F.col("c_custkey") % NO_TYPE != 0, F.col("c_mktsegment")).alias(PANEL_TYPE),
        F.col("c_acctbal").alias("acctbal"),
    )
    o = order_stats(spark, sf_dir)
    e = event_stats(spark, sf_dir)
    p = base.join(o, PANEL_KEY, "left").join(e, PANEL_KEY, "left")
    return p.select(
        *PANEL_IDS,
        "acctbal",
        "order_count",
        "total_spend",
        "avg_order_value",
        (F.try_divide(F.col("open_orders"), F.col("order_count")) * F.lit(100.0)).alias("open_order_share"),
        F.try_divide(F.col("spend_current") - F.col("spend_prior"), F.col("spend_prior")).alias("spend_growth"),
        "event_value_mean",
        "event_count",
        synthetic_lat(PANEL_KEY).alias("lat"),
        synthetic_lon(PANEL_KEY).alias("lon"),
    )


PANEL_SQL = f"""
WITH ord AS (
  SELECT o_custkey AS unit_key,
         CAST(count(*) AS DOUBLE) AS order_count,
         sum(o_totalprice) AS total_spend,
         avg(o_totalprice) AS avg_order_value,
         CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS open_orders,
         sum(CASE WHEN o_orderdate < TIMESTAMP '{GROWTH_SPLIT_DATE}' THEN o_totalprice END) AS spend_prior,
         sum(CASE WHEN o_orderdate >= TIMESTAMP '{GROWTH_SPLIT_DATE}' THEN o_totalprice END) AS spend_current
  FROM orders GROUP BY o_custkey),
ev AS (
  SELECT user_id AS unit_key, avg(value) AS event_value_mean, CAST(count(*) AS DOUBLE) AS event_count
  FROM events GROUP BY user_id)
SELECT c.c_custkey AS unit_key, c.c_name AS unit_name, CASE WHEN c.c_nationkey <> {NO_STATE} THEN n.n_name END AS state,
       CASE WHEN c.c_custkey % {NO_TYPE} <> 0 THEN c.c_mktsegment END AS unit_type,
       c.c_acctbal AS acctbal, o.order_count, o.total_spend, o.avg_order_value,
       o.open_orders / nullif(o.order_count, 0) * 100.0 AS open_order_share,
       (o.spend_current - o.spend_prior) / nullif(o.spend_prior, 0) AS spend_growth,
       e.event_value_mean, e.event_count,
       CAST({LAT_BASE} + (c.c_custkey * {LAT_MULT} % {LAT_MOD}) / 100.0 AS DOUBLE) AS lat,
       CAST({LON_BASE} + (c.c_custkey * {LON_MULT} % {LON_MOD}) / 100.0 AS DOUBLE) AS lon
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN ord o ON o.unit_key = c.c_custkey
LEFT JOIN ev e ON e.unit_key = c.c_custkey
"""

STATIONS_SQL = f"""
SELECT s_suppkey AS station_id, s_name AS station_name,
       CAST({LAT_BASE} + (s_suppkey * {ST_LAT_MULT} % {LAT_MOD}) / 100.0 AS DOUBLE) AS station_lat,
       CAST({LON_BASE} + (s_suppkey * {ST_LON_MULT} % {LON_MOD}) / 100.0 AS DOUBLE) AS station_lon
FROM supplier
"""
