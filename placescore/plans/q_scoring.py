"""Registered queries: imputation, scoring and recommendation on the unit panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.operators import clean, impute, recommend as rec, score
from placescore.plans import sqlgen
from placescore.plans.panel import PANEL_IDS, PANEL_KEY, table, unit_panel
from placescore.plans.registry import query
from placescore.session import cut_lineage
from placescore.plans.spec import (FLAGSHIP_INCOME, FLAGSHIP_MODE, FLAGSHIP_RATINGS, FLAGSHIP_TOP_N,
                                   IMPUTE_TARGETS, PANEL_DIMENSION_COLS, PANEL_DIMENSIONS, PANEL_FEATURES,
                                   PANEL_HOME_COL, PANEL_RENT_COL)

IDS = PANEL_IDS


def imputed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored panel that scoring, clustering and recommendation read: built once, its lineage cut."""
    return cut_lineage(impute.hierarchical_median_impute(unit_panel(spark, sf_dir), IMPUTE_TARGETS))


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed raw measures + feature scores + dimension scores, one row per unit."""
    imp = imputed_panel(spark, sf_dir)
    # raw columns the recommender needs ride through the scoring as renamed
    # pass-through ids, so the imputed panel is consumed without a self-join
    raw = [PANEL_RENT_COL, PANEL_HOME_COL, "lat", "lon"]
    imp = imp.withColumns({f"__raw_{c}": F.col(c) for c in raw})
    fs = score.feature_and_dimension_scores(imp, PANEL_FEATURES, PANEL_DIMENSIONS, IDS + [f"__raw_{c}" for c in raw])
    rest = [c for c in fs.columns if c not in IDS and not c.startswith("__raw_")]
    return fs.select(PANEL_KEY, *[F.col(f"__raw_{c}").alias(c) for c in raw], *[c for c in IDS if c != PANEL_KEY], *rest)


# ------------------------------------------------------------------ recommendation

def _rec_out(df: DataFrame) -> DataFrame:
    return df.select(*IDS, PANEL_RENT_COL, PANEL_HOME_COL, *PANEL_DIMENSION_COLS, "recommendation_score")


def _rec_sql(filter_sql: str, score_sql: str, top_n: int) -> str:
    dims = ", ".join(f"{sqlgen.scale05(d)} AS {d}" for d in PANEL_DIMENSION_COLS)
    return f"""
WITH {sqlgen.scored_panel_ctes()},
sp AS (SELECT ds.*, imp.{PANEL_RENT_COL}, imp.{PANEL_HOME_COL} FROM ds JOIN imp USING (unit_key)),
flt AS (SELECT * FROM sp WHERE {filter_sql}),
sc AS (SELECT *, {score_sql} AS recommendation_score FROM flt),
top AS (SELECT * FROM sc ORDER BY recommendation_score DESC NULLS LAST, unit_key LIMIT {top_n})
SELECT unit_key, unit_name, state, unit_type, {PANEL_RENT_COL}, {PANEL_HOME_COL}, {dims},
       {sqlgen.scale05('recommendation_score')} AS recommendation_score
FROM top
"""


def _afford_sql(income: float, mode: str, either: str = "OR") -> str:
    rent = f"{PANEL_RENT_COL} <= {income!r} / 12.0 * 0.3"
    home = f"{PANEL_HOME_COL} <= {income!r} * 3.5"
    return rent if mode == "rent" else home if mode == "buy" else f"(({rent}) {either} ({home}))"


@query("recommend_topn", covers="I4 D4 I2 G7 H10 H1 H7 H8 F8 F9",
       sql=_rec_sql(_afford_sql(FLAGSHIP_INCOME, FLAGSHIP_MODE), sqlgen.similarity_sql(FLAGSHIP_RATINGS), FLAGSHIP_TOP_N))
def recommend_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = scored_panel(spark, sf_dir)
    out = rec.recommend(sp, FLAGSHIP_RATINGS, PANEL_DIMENSION_COLS, PANEL_KEY, income=FLAGSHIP_INCOME,
                        housing_mode=FLAGSHIP_MODE, top_n=FLAGSHIP_TOP_N, rent_col=PANEL_RENT_COL,
                        home_col=PANEL_HOME_COL)
    return _rec_out(out)


_W_RATINGS = {"affordability_score": 5, "activity_score": 0, "growth_score": 2, "wealth_score": 4,
              "engagement_score": None, "warmth_score": 1, "mildness_score": -1}
_W_VALID = {k: v for k, v in _W_RATINGS.items() if v is not None and v >= 0}


@query("recommend_weighted", covers="I3 I1 D4(buy)",
       sql=_rec_sql(_afford_sql(700_000.0, "buy"),
                    sqlgen.weighted_sql(rec.preference_weights(_W_VALID)), 20))
def recommend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = scored_panel(spark, sf_dir)
    out = rec.recommend(sp, _W_RATINGS, PANEL_DIMENSION_COLS, PANEL_KEY, income=700_000.0, housing_mode="buy",
                        top_n=20, mode="weighted_average", rent_col=PANEL_RENT_COL, home_col=PANEL_HOME_COL)
    return _rec_out(out)


_L_RATINGS = {"affordability_score": 3, "activity_score": 4, "growth_score": 1, "wealth_score": 5,
              "engagement_score": 2, "warmth_score": 0, "mildness_score": 2}


@query("recommend_legacy", covers="I6 D4(either=AND)",
       sql=_rec_sql(_afford_sql(9_000_000.0, "either", "AND"),
                    sqlgen.weighted_sql(rec.preference_weights(_L_RATINGS, "sum")), 25))
def recommend_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = scored_panel(spark, sf_dir)
    out = rec.recommend_legacy(sp, _L_RATINGS, PANEL_DIMENSION_COLS, PANEL_KEY, income=9_000_000.0,
                               housing_mode="either", top_n=25, rent_col=PANEL_RENT_COL, home_col=PANEL_HOME_COL)
    return _rec_out(out)


# ------------------------------------------------------------------ imputation and scores

_IMP_OUT = IDS + IMPUTE_TARGETS + ["contains_imputed"]


@query("impute_hierarchical", covers="H1 H2 F8 E9 G3",
       sql=f"WITH {sqlgen.impute_ctes()} SELECT {', '.join(_IMP_OUT)} FROM imp")
def impute_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputed_panel(spark, sf_dir).select(*_IMP_OUT)


_LEVEL1 = ["unit_type", "state"]


@query("impute_group_medians", covers="F8 G3 E9: exact medians per (type, state), null keys included",
       sql=f"""WITH panel AS ({sqlgen.PANEL_SQL})
SELECT unit_type, state, {', '.join(f'median({c}) AS {c}__med' for c in IMPUTE_TARGETS)} FROM panel GROUP BY unit_type, state""")
def impute_group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.group_medians(unit_panel(spark, sf_dir), IMPUTE_TARGETS, _LEVEL1)


_ZERO = ["event_count"]


def _impute_flag_sql() -> str:
    ctes = sqlgen.impute_ctes().replace(
        "l0 AS (SELECT *,", "l0 AS (SELECT * REPLACE (coalesce(event_count, 0.0) AS event_count),", 1)
    return f"WITH {ctes} SELECT unit_key, event_count, event_value_mean, contains_imputed FROM imp"


@query("impute_flag", covers="H2 C20 H3", sql=_impute_flag_sql())
def impute_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = clean.zero_fill(unit_panel(spark, sf_dir), _ZERO)
    targets = impute.imputation_targets(p.drop("lat", "lon"), exclude=[PANEL_KEY])
    targets = [t for t in targets if t in IMPUTE_TARGETS]
    out = impute.hierarchical_median_impute(p, targets)
    return out.select(PANEL_KEY, "event_count", "event_value_mean", "contains_imputed")


_TRANSFORMS = {f.name: f.transform for f in PANEL_FEATURES if f.transform and not f.source}


def _transform_sql() -> str:
    cols = ", ".join(f"{sqlgen._transform(c, t)} AS {c}" for c, t in _TRANSFORMS.items())
    return f"WITH {sqlgen.impute_ctes()} SELECT unit_key, {cols} FROM imp"


@query("transform_scale", covers="H4", sql=_transform_sql())
def transform_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.apply_transforms(imputed_panel(spark, sf_dir), _TRANSFORMS)
    return out.select(PANEL_KEY, *_TRANSFORMS)


_WCOLS = ["acctbal", "total_spend", "avg_order_value", "spend_growth", "event_value_mean"]


def _winsor_sql() -> str:
    q = ", ".join(f"quantile_cont({c}, 0.05) AS {c}__lo, quantile_cont({c}, 0.95) AS {c}__hi" for c in _WCOLS)
    cols = ", ".join(f"{sqlgen._clip('imp.' + c, f'q.{c}__lo', f'q.{c}__hi')} AS {c}" for c in _WCOLS)
    return f"WITH {sqlgen.impute_ctes()}, q AS (SELECT {q} FROM imp) SELECT imp.unit_key, {cols} FROM imp CROSS JOIN q"


@query("winsorize", covers="H5 F9", sql=_winsor_sql())
def winsorize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.winsorize(imputed_panel(spark, sf_dir), _WCOLS).select(PANEL_KEY, *_WCOLS)


_MM = ["acctbal", "order_count", "avg_order_value", "event_value_mean", "event_count"]
_MM_INV = ["avg_order_value"]


def _minmax_sql() -> str:
    mm = ", ".join(f"min({c}) AS {c}__lo, max({c}) AS {c}__hi" for c in _MM)
    outs = []
    for c in _MM:
        lo, hi = f"q.{c}__lo", f"q.{c}__hi"
        s = f"CASE WHEN {lo} IS NULL OR {hi} IS NULL OR {hi} = {lo} THEN 0.5 ELSE (p.{c} - {lo}) / ({hi} - {lo}) END"
        if c in _MM_INV:
            s = f"1.0 - ({s})"
        outs.append(f"{sqlgen._clip('(' + s + ')', '0.0', '1.0')} AS {c}_minmax")
    return f"""WITH panel AS ({sqlgen.PANEL_SQL}), q AS (SELECT {mm} FROM panel)
SELECT p.unit_key, {', '.join(outs)} FROM panel p CROSS JOIN q"""


@query("minmax_scores", covers="H6 F11 O12", sql=_minmax_sql())
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.minmax_scores(unit_panel(spark, sf_dir), _MM, invert=_MM_INV)
    return out.select(PANEL_KEY, *[f"{c}_minmax" for c in _MM])


_FS = [f"{f.name}_feature_score" for f in PANEL_FEATURES]


@query("feature_scores", covers="H7 C27 H4 H5 H6",
       sql=f"WITH {sqlgen.impute_ctes()}, {sqlgen.score_ctes()} SELECT {', '.join(IDS)}, {', '.join(_FS)} FROM fs")
def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.feature_scores(imputed_panel(spark, sf_dir), PANEL_FEATURES, IDS)


@query("dimension_scores", covers="H8 H9",
       sql=f"WITH {sqlgen.scored_panel_ctes()} SELECT unit_key, {', '.join(PANEL_DIMENSION_COLS)} FROM ds")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_panel(spark, sf_dir).select(PANEL_KEY, *PANEL_DIMENSION_COLS)


@query("scores_0_100", covers="H11",
       sql=f"WITH {sqlgen.impute_ctes()}, "
           f"{sqlgen.score_ctes(use_transforms=False, scale=100.0, constant=50.0, suffix='_score100')} "
           f"SELECT unit_key, {', '.join(f.name + '_score100' for f in PANEL_FEATURES)} FROM fs")
def scores_0_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.feature_scores(imputed_panel(spark, sf_dir), PANEL_FEATURES, IDS, scale=100.0, constant=50.0,
                               use_transforms=False, suffix="_score100")
    return out.select(PANEL_KEY, *[f.name + "_score100" for f in PANEL_FEATURES])


@query("scores_0_5", covers="H10",
       sql=f"WITH {sqlgen.scored_panel_ctes()} SELECT unit_key, "
           + ", ".join(f"{sqlgen.scale05(c)} AS {c}" for c in _FS + PANEL_DIMENSION_COLS) + " FROM ds")
def scores_0_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = scored_panel(spark, sf_dir).select(PANEL_KEY, *_FS, *PANEL_DIMENSION_COLS)
    return score.scale_to_0_5(sp, PANEL_DIMENSION_COLS)
