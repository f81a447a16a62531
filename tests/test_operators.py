"""Hand-worked checks of operator semantics (null algebra, ties, edge cases)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placescore.functions.expr import clip, coerce_numeric, fmt2, round_half_even, safe_div
from placescore.operators import agg, clean, cluster, geo, impute, present, quantile, recommend as rec, score, text, window


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-3.0,)], "x double")
    out = [r[0] for r in df.select(clip("x", 0.0, 1.0)).collect()]
    assert out == [None, 1.0, 0.0]


def test_safe_div_and_coerce(spark):
    df = spark.createDataFrame([("1,234.5", 0.0), ("n/a", 2.0), ("NaN", 1.0), (" 7 ", None)], "s string, d double")
    rows = df.select(coerce_numeric("s").alias("v"), safe_div(F.lit(1.0), F.col("d")).alias("q")).collect()
    assert [r.v for r in rows] == [1234.5, None, None, 7.0]
    assert [r.q for r in rows] == [None, 0.5, 1.0, None]


def test_round_half_even_like_pandas(spark):
    df = spark.createDataFrame([(0.125,), (919.575,), (2.675,), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    import numpy as np
    assert got[:3] == [float(np.round(v, 2)) for v in (0.125, 919.575, 2.675)]
    assert got[3] is None
    assert [r[0] for r in df.select(fmt2("x")).collect()][3] == "—"


def test_quantiles_interpolate(spark):
    import numpy as np
    rnd = random.Random(3)
    rows = [("a", 5.0)] * 400 + [("a", rnd.random()) for _ in range(300)] + [(None, rnd.gauss(0, 1) * 10.0 ** rnd.randint(-300, 300)) for _ in range(200)]
    rows += [("b", v) for v in (0.0, -0.0, -1.5, float("nan"), None, 5e-324, -5e-324, 1e308, -1e308)] + [("c", None)]
    probs = [0.05, 0.25, 0.5, 0.95]
    got = {r[0]: list(r)[1:] for r in quantile.quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], probs, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert np.allclose(q, np.quantile(v, probs), rtol=1e-12, atol=0), g
    assert quantile.quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]).collect()[0][0] is None


def test_ranks_follow_the_order_of_doubles(spark):
    rnd = random.Random(1)
    vals = sorted({rnd.gauss(0, 1) * 2.0 ** rnd.randint(-1074, 1000) for _ in range(500)} | {2.0 ** 52, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1e308, float("-inf")})
    probs = [k / (len(vals) - 1) for k in (0, 1, 7, 250, len(vals) - 2, len(vals) - 1)]
    got = quantile.quantiles(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"], probs).collect()[0]
    for p, q in zip(probs, got):
        assert min(abs(vals.index(q) - p * (len(vals) - 1)) if q in vals else 1, abs(q - vals[round(p * (len(vals) - 1))])) <= 1e-9 * abs(q) + 1e-300


def test_a_group_with_most_rows_is_spread_over_the_partitions(spark):
    rnd = random.Random(8)
    rows = [(None if k % 3 else k % 50, rnd.random()) for k in range(6000)]
    counts = quantile.ranged(quantile.value_counts(spark.createDataFrame(rows, "g int, x double"), ["x"], ["g"]).repartition(8))
    sizes = [r["n"] for r in counts.where("g is null").groupBy(quantile.PART).agg(F.count(F.lit(1)).alias("n")).collect()]
    pieces = counts.rdd.getNumPartitions()
    assert sum(sizes) == 4000 and (pieces == 1 or max(sizes) < 4000 * 3 / pieces)
    bounds = counts.join(quantile.part_bounds(counts), "feature").where(F.col(quantile.PART) != quantile.part_of(F.col("value"), F.col("bounds")))
    assert bounds.count() == 0


def test_hierarchical_impute_levels(spark):
    rows = [
        (1, "Metro", "AA", 1.0), (2, "Metro", "AA", None),   # level 1: (Metro, AA) median 1
        (3, "Micro", "AA", 5.0), (4, "Micro", "BB", None),   # (Micro, BB) empty -> state BB empty -> type Micro
        (5, "Metro", "CC", None), (6, None, "CC", 9.0),      # (Metro, CC) empty -> state CC median 9
        (7, None, None, None),                              # null keys are their own group -> global
    ]
    df = spark.createDataFrame(rows, "k int, unit_type string, state string, x double")
    out = {r.k: (r.x, r.contains_imputed) for r in impute.hierarchical_median_impute(df, ["x"]).collect()}
    assert out[2] == (1.0, 1)
    assert out[4] == (5.0, 1)
    assert out[5] == (9.0, 1)
    assert out[1] == (1.0, 0)
    # a missing type is its own group (with row 6), so level 3 fills row 7 with 9
    assert out[7] == (9.0, 1)


def test_minmax_constant_column_gives_half_for_every_row(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None)], "k int, x double")
    out = score.minmax_scores(df, ["x"]).orderBy("k").collect()
    assert [r.x_minmax for r in out] == [0.5, 0.5, 0.5]


def test_preference_weights_and_errors():
    w = rec.preference_weights({"a": 3, "b": 4, "c": None, "d": -1})
    assert w == {"a": 9 / 25, "b": 16 / 25}
    with pytest.raises(ValueError):
        rec.preference_weights({"a": 0, "b": 0})
    with pytest.raises(ValueError):
        rec.preference_weights({"a": None})


def test_similarity_skips_missing_dimensions(spark):
    df = spark.createDataFrame([(1, 0.8, None), (2, 0.2, 0.4)], "k int, a double, b double")
    out = rec.score_units(df, {"a": 4, "b": 2}, ["a", "b"]).orderBy("k").collect()
    assert math.isclose(out[0].recommendation_score, 1.0)          # only a: (0.8-0.8)^2
    assert math.isclose(out[1].recommendation_score, 1 - ((0.2 - 0.8) ** 2 + 0) / 2)


def test_affordability_modes(spark):
    df = spark.createDataFrame([(1, 1000.0, 100000.0), (2, 3000.0, 400000.0)], "k int, MedianGrossRent_B25064 double, MedianHomeValue_B25077 double")
    assert [r.k for r in rec.affordability_filter(df, 60000.0, "rent").collect()] == [1]
    assert sorted(r.k for r in rec.affordability_filter(df, 120000.0, "buy").collect()) == [1, 2]
    assert rec.affordability_filter(df, None, "rent").count() == 2
    with pytest.raises(ValueError):
        rec.affordability_filter(df, 1.0, "lease")


def test_empty_recommendation_keeps_schema(spark):
    df = spark.createDataFrame([(1, 5000.0, 1e7, 0.5)], "k int, MedianGrossRent_B25064 double, MedianHomeValue_B25077 double, a double")
    out = rec.recommend(df, {"a": 3}, ["a"], "k", income=1000.0, housing_mode="rent")
    assert out.count() == 0 and "recommendation_score" in out.columns


def test_group_mode_ties_smallest(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("x", "a"), ("y", None)], "k string, v string")
    out = {r.k: r.v for r in agg.group_mode(df, ["k"], "v").collect()}
    assert out == {"x": "a"}


def test_weighted_mean_rules(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 3.0, 0.0), ("g", None, 5.0), ("h", 1.0, 0.0)], "g string, v double, w double")
    out = {r.g: r.v for r in agg.weighted_rollup(df, ["g"], ["v"], "w").collect()}
    assert out == {"g": 1.0, "h": None}


def test_split_unit_name_cases(spark):
    df = spark.createDataFrame([("Austin-Round Rock, TX Metro Area",), ("Aberdeen, SD Micro Area",), ("Nowhere",),
                                ("A, B, C",), (None,)], "n string")
    out = [tuple(r) for r in clean.split_unit_name(df, "n").select("city", "state", "cbsa_type").collect()]
    assert out == [("Austin-Round Rock", "TX", "Metro"), ("Aberdeen", "SD", "Micro"), ("Nowhere", "", None),
                   ("A", "B, C", None), ("", "", None)]


def test_tagged_split(spark):
    df = spark.createDataFrame([("TAGLINE:  Hi \n SUMMARY: body text \n",), ("no markers",)], "t string")
    out = [tuple(r) for r in text.split_tagged(df, "t").select("tagline", "summary").collect()]
    assert out == [("Hi", "body text"), (None, "no markers")]


def test_dedupe_first_and_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, o int, v string")
    assert sorted(r.v for r in window.dedupe(df, "k", ["o"]).collect()) == ["a", "c"]
    assert sorted(r.v for r in window.dedupe(df, "k", ["o"], keep="last").collect()) == ["b", "c"]


def test_point_in_polygon_hole_and_boundary(spark):
    polys = spark.createDataFrame([(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))")], "p int, wkt string")
    edges = geo.polygon_edges(polys, "p", "wkt")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.0, 5.0), (4, 11.0, 5.0), (5, 0.0, 0.0)],
                                "k int, x double, y double")
    hits = sorted(r.k for r in geo.points_in_polygons(pts, "k", "x", "y", edges, "p", cell=3.0).collect())
    assert hits == [1]


def _hav(a, b, c, d):
    r = 6371.0088
    p1, p2 = math.radians(a), math.radians(c)
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(d) - math.radians(b)) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(x))


def test_nearest_station_matches_brute_force(spark):
    rnd = random.Random(11)
    st = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(40)]
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(200)] + [(999, 89.9, 179.9), (1000, None, 3.0)]
    sdf = spark.createDataFrame(st, "sid int, slat double, slon double")
    pdf = spark.createDataFrame(pts, "k int, lat double, lon double")
    got = {r.k: r.sid for r in geo.nearest_station(pdf, "k", "lat", "lon", sdf, "sid", "slat", "slon").collect()}
    for k, la, lo in pts:
        if la is None:
            assert got[k] is None
            continue
        best = min(st, key=lambda s: (_hav(la, lo, s[1], s[2]), s[0]))
        assert got[k] == best[0], k


def test_nearest_station_repeated_and_null_keys(spark):
    st = spark.createDataFrame([(1, 10.1, 10.1, "near"), (2, 60.1, 60.1, "far"), (3, None, 0.0, "x")], "sid int, slat double, slon double, what string")
    pts = [(7, 10.0, 10.0), (7, 60.0, 60.0), (None, 60.0, 60.0), (None, 10.0, 10.0), (None, None, 5.0), (8, 10.0, 10.0), (8, 10.0, 10.0)]
    df = spark.createDataFrame(pts, "k int, lat double, lon double").repartition(3)
    got = geo.nearest_station(df, "k", "lat", "lon", st, "sid", "slat", "slon", keep=("what",)).collect()
    want = [(k, None if la is None else 1 if la == 10.0 else 2) for k, la, _ in pts]
    assert sorted(((r.k, r.sid) for r in got), key=str) == sorted(want, key=str)
    assert {r.sid: r.what for r in got} == {1: "near", 2: "far", None: None}


def test_nearest_station_has_many_blocks_and_two_shuffles(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 3)
    monkeypatch.setattr(geo, "GROUP", 4)
    rnd = random.Random(12)
    st = [(i, rnd.uniform(-90, 90), rnd.choice([rnd.uniform(-180, 540), 179.99, -179.99])) for i in range(300)]
    pts = [(i, rnd.uniform(-90, 90), rnd.choice([rnd.uniform(-180, 180), 180.0, -180.0])) for i in range(150)]
    df = geo.nearest_station(spark.createDataFrame(pts, "k int, lat double, lon double"), "k", "lat", "lon",
                             spark.createDataFrame(st, "sid int, slat double, slon double"), "sid", "slat", "slon")
    for r, (k, la, lo) in zip(sorted(df.collect()), pts):
        d, best = min((_hav(la, lo, s[1], s[2]), s[0]) for s in st)
        assert r.k == k and math.isclose(r.distance_km, d, rel_tol=1e-9, abs_tol=1e-9) and r.sid == best
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    # Points: the join with their blocks and the aggregate; the blocks move once.
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 3 and "Window" not in plan


def test_nearest_station_clustered_shared_and_far(spark):
    rnd = random.Random(4)
    st = [(i, 40 + rnd.random() * 1e-3, -100 + rnd.random() * 1e-3) for i in range(300)]           # one dense city
    st += [(1000 + i, 40.0005, -99.9995) for i in range(50)] + [(5000, -80.0, 179.95), (5001, 89.99, 10.0)]
    pts = [(i, 40 + rnd.uniform(-2e-3, 2e-3), -100 + rnd.uniform(-2e-3, 2e-3)) for i in range(60)]
    pts += [(100 + i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)] + [(200, -80.0, -179.99), (201, -90.0, 0.0), (202, 40.0005, 260.0005)]
    sdf = spark.createDataFrame(st, "sid int, slat double, slon double")
    got = {r.k: r for r in geo.nearest_station(spark.createDataFrame(pts, "k int, lat double, lon double"), "k", "lat", "lon", sdf, "sid", "slat", "slon").collect()}
    for k, la, lo in pts:
        d, best = min((_hav(la, lo, s[1], s[2]), s[0]) for s in st)
        assert got[k].sid == best and math.isclose(got[k].distance_km, d, rel_tol=1e-9, abs_tol=1e-9), k
    with pytest.raises(ValueError):
        geo.nearest_station(spark.createDataFrame(pts, "k int, lat double, lon double"), "k", "lat", "lon", sdf.limit(0), "sid", "slat", "slon")


def test_nearest_station_deals_out_the_points_of_one_partition(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 2)
    st = [(i, i * 0.7 - 60, i * 1.9 - 150) for i in range(90)] + [(7, 3.0, 3.0), (None, 50.0, 9.0)]
    pts = [(i, i % 171 - 85.5, i * 7 % 359 - 179.5) for i in range(3000)] + [(None, None, 1.0)]
    df = spark.createDataFrame(pts, "k int, lat double, lon double").coalesce(1)
    out = geo.nearest_station(df, "k", "lat", "lon", spark.createDataFrame(st, "sid int, slat double, slon double"), "sid", "slat", "slon")
    plan = out._jdf.queryExecution().executedPlan().toString()
    walk = plan[plan.index("MapInArrow"):]
    assert "hashpartitioning(__row" in walk  # below the walk: each task has its share of the points
    got = {r.k: (r.sid, r.distance_km) for r in out.collect()}
    assert len(got) == 3001 and got[None] == (None, None)
    for k, la, lo in pts[:-1:37]:
        assert math.isclose(got[k][1], min(_hav(la, lo, s[1], s[2]) for s in st), rel_tol=1e-9), k


def test_nearest_station_builds_its_stations_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    st = spark.createDataFrame([(i, float(i % 80), float(i)) for i in range(120)], "sid int, slat double, slon double")
    st = st.mapInArrow(look, st.schema)
    pts = spark.createDataFrame([(1, 10.2, 10.1), (2, 30.2, 110.1)], "k int, lat double, lon double")
    got = {r.k: r.sid for r in geo.nearest_station(pts, "k", "lat", "lon", st, "sid", "slat", "slon").collect()}
    assert got == {1: 10, 2: 110} and seen.value == 120


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_matrix_response_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '[["a","b"],["1","2"],[null,"4"]]'), (2, '{"error": 1}'), (3, '[["a"],["1","2"]]'), (4, None), (5, "[]")], "s int, t string")
    rows, bad = text.matrix_rows(df, "s", "t")
    for x in (rows.select("row", "__r"), bad):
        assert _optimized(x).count("from_json(") == 1  # not once for each row and test of the shape
    assert sorted(map(tuple, rows.select("s", "row", "__r").collect())) == [(1, 0, ["1", "2"]), (1, 1, [None, "4"])]
    assert sorted(map(tuple, bad.collect())) == [(k, "bad shape") for k in (2, 3, 4, 5)]


def test_a_csv_text_is_cut_once(spark):
    df = spark.createDataFrame([(1, 'Id, Month \n7,3\n"a ""b"", c",4,5\n\n8'), (2, "x\n1"), (3, None)], "k int, t string")
    rows, skipped, bad = text.header_drift_rows(df, "k", "t", ["id", "month"])
    month = rows.where(F.try_element_at("fields", F.lit("month")) == "3")
    assert _optimized(month).count("regexp_extract_all(") <= 4 and _optimized(month).count("map_from_arrays(") == 1
    assert _optimized(bad).count("regexp_extract_all(") <= 4 and _optimized(skipped).count("regexp_extract_all(") <= 3
    assert sorted((r.k, r.line_no, r.fields["id"], r.fields["month"]) for r in rows.collect()) == [(1, 0, "7", "3"), (1, 2, "8", None)]
    assert [tuple(r) for r in bad.collect()] == [(1, 1, '"a ""b"", c",4,5')] and [r.k for r in month.collect()] == [1]
    assert [r.k for r in skipped.collect()] == [2]


def test_matrix_table_moves_rows_and_not_cells(spark):
    from placescore.operators import landed

    texts = [(2, '[["u","a","b"],["x ","a2","b2"],["y",null,"by"],["","q","q"]]'), (1, '[["a","u","a"],["a1","x","a9"],[null,"z","a8"]]'),
             (1, '[["u"],["w"]]'), (3, '[["a"],["1"]]'), (4, '[["a"]]'), (5, "{}")]
    wide, bad = landed.matrix_table(spark.createDataFrame(texts, "s int, t string"), "s", "t", "u", {"a": "A", "b": "B", "c": "C"})
    plan = _optimized(wide)
    assert plan.count("Generate") <= 3 and "pivot" not in plan and plan.count("Aggregate") == 1
    # The first slice that has the column gives the value, also if that is null; a header's first place counts.
    assert sorted(map(tuple, wide.collect())) == [("w", None, None, None), ("x", "a1", "b2", None), ("y", None, "by", None), ("z", None, None, None)]
    assert sorted(map(tuple, bad.collect())) == [(2, "no unit code"), (3, "no unit column"), (5, "bad shape")]


def test_wcss_and_metrics_match_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, [1e6 + rnd.gauss(i % 4, 0.5) for _ in range(3)], i % 4) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>, l int")
    want = 0.0
    for lab in range(4):
        own = [v for _, v, x in rows if x == lab]
        mu = [sum(c) / len(own) for c in zip(*own)]
        want += sum((a - m) ** 2 for v in own for a, m in zip(v, mu))
    assert math.isclose(agg.wcss(df, "id", "v", "l").collect()[0][0], want, rel_tol=1e-6)
    m = cluster.model_metrics(df, "id", ["l"], "v").collect()[0]
    assert (m.model, m.n_clusters, m.cluster_min_size, m.cluster_max_size) == ("l", 4, 20, 20)


def test_clustering_refuses_missing_features(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "k int, a double, b double")
    with pytest.raises(ValueError, match="a"):
        cluster.assign_clusters(df, "k", ["a", "b"], ks=(2,), starts=1)


def test_similar_units_unknown_key_raises(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [0.0])], "k int, l int, v array<double>")
    assert [r.k for r in cluster.similar_units(df, "k", 1, "l", "v").collect()] == [2]
    with pytest.raises(KeyError):
        cluster.similar_units(df, "k", 9, "l", "v")


def test_short_names_use_two_different_phrases(spark):
    rows = [(i % 2, float(i % 2 * 10 + i % 3), float(i % 2 * 10 + i % 5), float(i % 2 * 10 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "l int, a double, b double, c double")
    names = {r.l: r.n for r in cluster.short_names(df, "l", ["a", "b", "c"], {"a": ("Big", "Small"), "b": ("Big", "Small"), "c": ("Wide", "Narrow")}, out="n").collect()}
    assert names == {0: "Small / Narrow", 1: "Big / Wide"} or names == {0: "Narrow / Small", 1: "Wide / Big"}


def test_attach_text_needs_an_order(spark):
    units = spark.createDataFrame([("1",), ("2",)], "k string")
    texts = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "k string, summary string, o int")
    with pytest.raises(ValueError):
        rec.attach_text(units, texts, "k")
    got = sorted((r.k, r.summary, r.tagline) for r in rec.attach_text(units, texts, "k", "o").collect())
    assert got == [("1", "new", ""), ("2", "", "")]
    assert sorted(r.summary for r in rec.attach_text(units, None, "k").collect()) == ["", ""]


def test_urls_resolve_like_urljoin(spark):
    from urllib.parse import urljoin
    bases = ["https://x.org", "https://x.org/", "https://x.org/a/b/c.html?q=1#f", "http://h:80/a/", "https://x.org/a/./b/../c"]
    refs = ["a.csv", "../b.csv", "../../../../c", "./d", "/e/../f", "//host/g", "?y=2", "#z", "", "g/", "g/..", "g/./h?i=/../j", "mailto:a@b", "http://z/", "..", ".", "a//b"]
    rows = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "b string, r string").withColumn("u", text.resolve_url(F.col("b"), F.col("r")))
    bad = [(x.b, x.r, x.u, urljoin(x.b, x.r)) for x in df.collect() if x.u.split("#")[0] != urljoin(x.b, x.r).split("#")[0]]
    assert bad == []


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, 5)], "k int, v int")
    assert [r.k for r in window.sort_rows(df, ["v", "k"], [False, True]).collect()] == [2, 4, 3, 1]
    assert [r.k for r in window.sort_rows(df, ["v", "k"]).collect()] == [3, 2, 4, 1]


def test_map_frame_with_a_label_colour(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "A", 4.0), (2, 1.0, 2.0, "B", 5.0)], "k int, lat double, lon double, lab string, recommendation_score double")
    got = present.map_frame(df, "k", "lat", "lon", "lab", [], stars=1).orderBy("k").collect()
    assert [(r.color_label, r.color_value, r.range_lo, r.range_hi, r.is_top) for r in got] == [("A", None, 0.0, 1.0, False), ("B", None, 0.0, 1.0, True)]


def test_silhouette_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(i % 3 * 3, 1.0) for _ in range(4)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, l int")
    got = agg.silhouette(df, "v", "l").collect()[0][0]

    def d2(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))
    s = []
    for i, v, lab in rows:
        own = [d2(v, w) for j, w, l2 in rows if l2 == lab and j != i]
        a = sum(own) / len(own)
        b = min(sum(d2(v, w) for j, w, l2 in rows if l2 == o) / sum(1 for r in rows if r[2] == o) for o in {0, 1, 2} - {lab})
        s.append((b - a) / max(a, b))
    assert math.isclose(got, sum(s) / len(s), rel_tol=1e-9)


def test_shape_stats_bias_corrected(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = agg.shape_stats(df, ["x"]).collect()[0]
    import pandas as pd
    s = pd.Series(vals)
    assert math.isclose(r.x_skew, s.skew(), rel_tol=1e-9)
    assert math.isclose(r.x_kurt, s.kurt(), rel_tol=1e-9)


def test_json_matrix_quarantine(spark):
    df = spark.createDataFrame([(1, '[["a","b"],["1","2"],["3","4"]]'), (2, '{"error": "x"}'), (3, '[["a","b"],["1"]]'),
                                (4, "not json")], "k int, t string")
    cells, bad = text.json_matrix(df, "k", "t")
    assert cells.count() == 4
    assert sorted(r.k for r in bad.collect()) == [2, 3, 4]


def test_header_drift_binds_by_name(spark):
    df = spark.createDataFrame([(1, "station,month,temp\nA,1,5"), (2, "Month, Station ,temp,snow\n2,B,6,1"),
                                (3, "id,month\nC,3")], "k int, t string")
    rows, skipped, bad = text.header_drift_rows(df, "k", "t", ["station"])
    got = sorted((r.k, r.fields["station"], r.fields["month"], r.fields.get("snow")) for r in rows.collect())
    assert got == [(1, "A", "1", None), (2, "B", "2", "1")]
    assert [r.k for r in skipped.collect()] == [3] and bad.count() == 0


def test_header_drift_quotes_and_surplus(spark):
    df = spark.createDataFrame([
        (1, '\ufeff"STATION","Name, Long",month,tavg\r\nS1,"AUSTIN, TX US",1,50.5\r\nS2,"A ""B""\nC",2\r\nS3,x,3,4,5\r\n'),
        (2, "station;month\nS|4;7")], "k int, t string")
    rows, _, bad = text.header_drift_rows(df.where("k = 1"), "k", "t", ["station", "month"])
    got = sorted(tuple(r.fields[c] for c in ("station", "name_long", "month", "tavg")) for r in rows.collect())
    assert got == [("S1", "AUSTIN, TX US", "1", "50.5"), ("S2", 'A "B"\nC', "2", None)]
    assert [(r.k, r.record) for r in bad.collect()] == [(1, "S3,x,3,4,5")]
    rows, _, _ = text.header_drift_rows(df.where("k = 2"), "k", "t", ["station"], sep=";")
    assert rows.collect()[0].fields == {"station": "S|4", "month": "7"}


def test_label_report_fallbacks(spark):
    rows = [(i, i % 2, float(i), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, lab int, a double, flat double")
    rep = {r.lab: r for r in cluster.label_report(df, "lab", ["a", "flat"], {"a": ("Higher a", "Lower a")},
                                                  [(("Higher a",), "costly")]).collect()}
    assert set(rep) == {0, 1}
    assert rep[0].candidate_name_1.endswith(" Hubs")
    assert rep[1].key_traits.startswith("a: higher vs avg (")


def test_fmt_g4_matches_python(spark):
    from placescore.operators.cluster import _fmt_g4
    rnd = random.Random(17)
    vals = [36.135, 12345.0, 0.000123456, -2.5, 9.99951, 801000000.0]
    vals += [round(rnd.uniform(-1000, 1000), rnd.randint(0, 5)) for _ in range(300)]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 12) for _ in range(300)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r[0] for r in df.select(_fmt_g4(F.col("x"))).collect()]
    assert got == ["%.4g" % v for v in vals]


def test_chain_joins_check_keys_while_they_run(spark):
    from placescore.operators import joins
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    b = spark.createDataFrame([(1, 2.0), (3, 3.0)], "k int, y double")
    twice = spark.createDataFrame([(2, 5), (2, 6)], "k int, z int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    others = [b.withColumnRenamed("y", f"y{i}") for i in range(5)]
    out = joins.chain_left_joins(a, others, "k")
    assert not tracker.getJobIdsForGroup("chain")
    assert sorted(map(str, out.collect())) == sorted(map(str, a.join(b, "k", "left").select("k", "x", *[F.col("y").alias(f"y{i}") for i in range(5)]).collect()))
    for left, right in ((a, [b, twice]), (twice, [b])):
        with pytest.raises(Exception, match="Expected one row per k .*: 2"):
            joins.chain_left_joins(left, right, "k").collect()
    assert joins.chain_left_joins(a, [twice], "k", validate=False).count() == 4
    with pytest.raises(KeyError):
        joins.validated_left_join(a, b, "q")


def test_matrix_table_takes_the_first_slice_and_quarantines(spark):
    from placescore.operators import landed
    rows = [(0, '[["NAME","a","geo"],["N1","1"," 7 "],["N2",null,"8"]]'), (1, '[["a","b","geo"],["9","2","7"],["5","x","9"],["0","0",null]]'),
            (2, '{"error": "x"}'), (3, '[["b"],["1"]]'), (4, "nonsense"), (5, '[["a","geo"],["1"]]'), (6, '[["zz","geo"],["1","10"]]')]
    table, bad = landed.matrix_table(spark.createDataFrame(rows, "slice int, payload string"), "slice", "payload", "geo", {"NAME": "name", "a": "A", "b": "B", "c": "C"})
    assert sorted(map(tuple, table.collect()), key=lambda r: int(r[0])) == [
        ("7", "N1", "1", "2", None), ("8", "N2", None, None, None), ("9", None, "5", "x", None), ("10", None, None, None, None)]
    assert sorted(map(tuple, bad.collect())) == [(1, "no unit code"), (2, "bad shape"), (3, "no unit column"), (4, "bad shape"), (5, "bad shape")]


def test_names_without_naming_features_are_labels(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (4, 5.0)], "l int, x double")
    assert sorted(map(tuple, cluster.short_names(df, "l", [], {}).collect())) == [(1, "1"), (4, "4")]


def test_outer_slices_are_one_aggregate(spark):
    from placescore.operators import joins
    a = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (None, "n", 3.0)], "k int, x string, y double")
    b = spark.createDataFrame([(2, "other", True), (4, "z", False)], "k int, x string, f boolean")
    c = spark.createDataFrame([(None, 7), (1, None)], "k int, n int")
    out = joins.full_outer_slices([a, b, c], "k")
    assert out.columns == ["k", "x", "y", "f", "n"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a", 1.0, None, None), (2, None, 2.0, True, None), (None, "n", 3.0, None, 7), (4, None, None, False, None)], key=str)
    assert out.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="one row per k in each slice.*: 4"):
        joins.full_outer_slices([a, b.union(b.where("k = 4"))], "k").collect()


def _within(px, py, edges):
    """Crossings of the ray to the right over all edges; on an edge is outside."""
    odd = False
    for x1, y1, x2, y2 in edges:
        if (abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= 1e-12 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2)):
            return False
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_point_in_polygon_matches_all_edges_for_a_dense_city(spark):
    import math
    import random
    rnd = random.Random(4)

    def star(cx, cy, r, n):
        at = [(2 * math.pi * k / n, r * rnd.uniform(0.4, 1)) for k in range(n)]
        return [(cx + d * math.cos(a), cy + d * math.sin(a)) for a, d in at]

    rings = {"coast": [star(5, 5, 40, 3000)], "city": [star(10.3, 50.2, 0.05, 700), star(10.3, 50.2, 0.015, 40)], "block": [[(10.25, 50.2), (10.3, 50.2), (10.3, 50.25), (10.25, 50.25)]],
             "grid": [[(0, 0), (8, 0), (8, 8), (4, 8), (4, 4), (0, 4)]], "sliver": [[(-170, -80), (170, 80), (170, 80.001)]], "dot": [[(1, 1), (1, 1), (1, 1)]]}
    edges = [(name, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for name, rs in rings.items() for r in rs for a, b in zip(r, r[1:] + r[:1])]
    pts = [(rnd.gauss(10.3, 0.03), rnd.gauss(50.2, 0.03)) for _ in range(1500)]  # a dense city
    pts += [(rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for _ in range(500)] + [(float(a), float(b)) for a in range(-1, 10) for b in range(-1, 10)]
    pts += [(x, y) for rs in rings.values() for r in rs for x, y in r[:60]] + [(x, (x * 8 / 17) + 0.0002) for x in range(-160, 170, 20)]
    pts += [(10.28, 50.22)] * 3 + [(1e300, 0.0), (float("nan"), 1.0), (None, 2.0)]
    df = spark.createDataFrame([(k, None if x is None else float(x), float(y)) for k, (x, y) in enumerate(pts)], "k long, x double, y double").repartition(3)
    e = spark.createDataFrame(edges, "p string, x1 double, y1 double, x2 double, y2 double").repartition(4)
    got = sorted((r["k"], r["p"]) for r in geo.points_in_polygons(df, "k", "x", "y", e, "p").collect())
    own = {name: [x[1:] for x in edges if x[0] == name] for name in rings}
    want = sorted((k, name) for k, (x, y) in enumerate(pts) if x is not None and x == x for name in rings if _within(x, y, own[name]))
    assert got == want and {n for _, n in want} == set(rings) - {"dot"}
    assert geo.points_in_polygons(df, "k", "x", "y", e.limit(0), "p").count() == 0


def test_drifting_csv_files_are_bound_by_name(spark, tmp_path):
    from placescore.plans import pipeline
    from placescore.sources import files
    texts = {
        "a.csv": 'station,name,month,mly_tavg_normal\n"S1","A ""x"", y",1,10.5\nS1,"two\nlines",2\nS1,too,3,1,surplus\n',
        "b.csv": '"STATION","NAME",Month,MLY-TAVG-NORMAL,latitude\r\nS2,B,1,3,47.5\r\n',
        "c.csv": 'station,name,month,mly_tavg_normal\nS3,C,1,7\n',
        "d.csv": "id,month\n1,2\n", "e.csv": "", "f.csv": "station,name,month,month,latitude\nS4,D,5,6,1\n", "g.csv": "station,name,month\n"}
    folder = tmp_path / "st x"
    folder.mkdir()
    for name, t in texts.items():
        (folder / name).write_bytes(t.encode())
    rows, skipped, bad = files.read_drifting_csv(spark, str(folder), ["station", "name", "month"])
    got = sorted((r["path"][-5:], r["station"], r["name"], r["month"], r["mly_tavg_normal"], r["latitude"]) for r in rows.collect())
    assert got == [("a.csv", "S1", 'A "x", y', "1", "10.5", None), ("a.csv", "S1", "two\nlines", "2", None, None),
                   ("b.csv", "S2", "B", "1", "3", "47.5"), ("c.csv", "S3", "C", "1", "7", None), ("f.csv", "S4", "D", "5", None, "1")]
    assert sorted(r["path"][-5:] for r in skipped.collect()) == ["d.csv", "e.csv"]
    assert bad.count() == 1 and [(r["path"][-5:], r["record"]) for r in bad.collect()] == [("a.csv", "S1,too,3,1,surplus")]
    assert rows.select("station").distinct().count() == 4
    whole = tmp_path / "whole"
    whole.mkdir()
    head = "STATION,LATITUDE,LONGITUDE,NAME,month,MLY-TAVG-NORMAL,MLY-PRCP-NORMAL"
    for k in range(4):
        lines = [f'S{k},{30 + k},-{100 + k},"TOWN {k}, TX",{m},{k + m},{m}' + (f",{m}" if k % 2 else "") for m in range(1, 14)]
        (whole / f"s{k}.csv").write_text("\n".join([head + (",MLY-SNOW-NORMAL" if k % 2 else ""), *lines, "S,1,2,n,1,2,3,4,5"]) + "\n")
    plain = lambda f: sorted(map(str, f.drop("file_order").collect()))
    got, want = pipeline.station_months_of_files(spark, str(whole)), pipeline.station_months(files.read_texts(spark, str(whole)))
    assert plain(got[0]) == plain(want[0]) and got[0].count() == 48 and got[2].count() == want[2].count() == 4
    first = pipeline.station_summaries(got[0]).collect()
    assert sorted(map(str, first)) == sorted(map(str, pipeline.station_summaries(want[0]).collect())) and len(first) == 4
