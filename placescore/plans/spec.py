"""Scoring spec for the driver-table unit panel (mirrors the place spec's shape).

Same structure as the place scoring in ``placescore.specs``: raw measures with a
transform and a direction, one distance-to-target feature, and composite
dimensions with fixed weights.
"""

from placescore.operators.score import Feature

# Fixed values for the panel spec (shared with the SQL oracle).
PANEL_FEATURES = [
    Feature("acctbal", "asinh", False),
    Feature("order_count", "log1p", False),
    Feature("total_spend", "log1p", True),
    Feature("avg_order_value", "log1p", True),
    Feature("open_order_share", None, True),
    Feature("spend_growth", "asinh", False),
    Feature("event_value_mean", None, False),
    Feature("event_count", "log1p", False),
    Feature("lat", None, True),
    Feature("_lat_distance", None, True, source="lat", target=37.0),
]

PANEL_DIMENSIONS = {
    "affordability_score": {"avg_order_value": 0.5, "total_spend": 0.5},
    "activity_score": {"order_count": 0.6, "event_count": 0.4},
    "growth_score": {"spend_growth": 0.7, "open_order_share": 0.3},
    "wealth_score": {"acctbal": 1.0},
    "engagement_score": {"event_value_mean": 1.0},
    "warmth_score": {"lat": 1.0},
    "mildness_score": {"_lat_distance": 1.0},
}
PANEL_DIMENSION_COLS = list(PANEL_DIMENSIONS)

# Affordability stand-ins: "rent" = average order value, "home value" = total spend.
PANEL_RENT_COL = "avg_order_value"
PANEL_HOME_COL = "total_spend"

# The flagship user (one slider set, income and housing mode, as the app sends).
FLAGSHIP_RATINGS = {
    "affordability_score": 4,
    "activity_score": 3,
    "growth_score": 5,
    "wealth_score": 2,
    "engagement_score": 1,
    "warmth_score": 3,
    "mildness_score": 0,
}
FLAGSHIP_INCOME = 9_000_000.0
FLAGSHIP_MODE = "rent"
FLAGSHIP_TOP_N = 15

IMPUTE_TARGETS = ["order_count", "total_spend", "avg_order_value", "open_order_share", "spend_growth",
                  "event_value_mean", "event_count"]

# Cluster naming on the panel: features the names look at, phrase pairs
# (above / below the median) and trade-off rules, same shape as the place spec.
PANEL_NAME_FEATURES = ["acctbal", "order_count", "total_spend", "avg_order_value", "open_order_share",
                       "spend_growth", "event_value_mean", "event_count", "lat", "lon"]
PANEL_PHRASES = {
    "acctbal": ("Higher balance", "Lower balance"),
    "order_count": ("Frequent buyers", "Rare buyers"),
    "total_spend": ("Big spenders", "Small spenders"),
    "avg_order_value": ("Large baskets", "Small baskets"),
    "spend_growth": ("Growing spend", "Shrinking spend"),
    "event_value_mean": ("High engagement", "Low engagement"),
    "event_count": ("Active online", "Quiet online"),
    "lat": ("Northern", "Southern"),
}
PANEL_TRADEOFFS = [
    (("Big spenders", "Large baskets"), "higher spend"),
    (("Quiet online", "Low engagement"), "less engagement"),
    (("Shrinking spend",), "weaker growth"),
]
