"""Physical-plan properties that matter at scale."""

import __spark_entry__ as E

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_point_in_polygon_has_no_pairwise_join(spark):
    p = _plan(E.queries()["point_in_polygon"](spark, SF_DIR))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_dedupe_and_flags_are_aggregates_not_windows(spark):
    for name in ("dedupe_first", "dedupe_last", "duplicate_flags"):
        p = _plan(E.queries()[name](spark, SF_DIR))
        assert "Window" not in p, name


def test_group_mode_combines_map_side(spark):
    import re
    p = _plan(E.queries()["mode_crosswalk"](spark, SF_DIR))
    nodes = re.findall(r"^\((\d+)\) (\w+)", p, re.M)   # numbered from the scan upwards
    first = {}
    for n, op in nodes:
        first.setdefault(op, int(n))
    # a partial aggregate runs before the first shuffle
    assert first["HashAggregate"] < first["Exchange"]


def test_scans_prune_columns(spark):
    p = _plan(E.queries()["weighted_rollup"](spark, SF_DIR))
    schema = [l for l in p.splitlines() if l.startswith("ReadSchema")][0]
    assert "l_shipdate" not in schema and "l_linestatus" not in schema


def _count(plan: str, node: str) -> int:
    import re
    return len(re.findall(rf"^\(\d+\) {node}", plan, re.M))


def test_imputed_panel_is_built_once_and_read_back(spark):
    """The panel's tables are scanned while its counts are cut and once for the stored panel, not by what reads it."""
    for name in ("feature_scores", "recommend_topn", "map_frame", "contributions", "cluster_profile", "cluster_report", "cluster_short_names"):
        p = _plan(E.queries()[name](spark, SF_DIR))
        assert _count(p, "Scan parquet") == 0, name
        assert "percentile(" not in p or name == "cluster_profile", name  # that one is over the limited rows


def test_imputation_has_no_window_over_rows(spark):
    p = _plan(E.queries()["impute_hierarchical"](spark, SF_DIR))
    assert _count(p, "Window") == 0 and _count(p, "Scan parquet") <= 4


def test_no_pairs_in_nearest_station_or_density(spark):
    p = _plan(E.queries()["nearest_station"](spark, SF_DIR))
    assert "CartesianProduct" not in p
    p = _plan(E.queries()["density_grid"](spark, SF_DIR))
    assert _count(p, "Generate") <= 1 and "CartesianProduct" not in p


def test_dedupe_reads_only_wanted_columns(spark):
    p = _plan(E.queries()["dedupe_last"](spark, SF_DIR))
    assert "props" not in [x for x in p.splitlines() if x.startswith("ReadSchema")][0]


def test_affordability_is_one_aggregate(spark):
    p = _plan(E.queries()["affordability_modes"](spark, SF_DIR))
    assert "InMemoryTableScan" not in p and _count(p, "Scan parquet") <= 4
