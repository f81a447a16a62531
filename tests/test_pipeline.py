"""Source builds (M1-M5) and readers on tiny landed files shaped like FIXTURES.md."""

import math
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from placescore.plans import pipeline
from placescore.sources import files


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_crime_build_with_bom_and_newline_headers(spark):
    tmp = tempfile.mkdtemp(prefix="ps-test-")
    crime = _write(tmp, "crime.csv", '﻿State,City,Population,"Violent\ncrime","Property\ncrime",State_Clean,City_Clean\r\n'
                                     'TEXAS2,Austin4,"900,000","4,000","30,000",TEXAS, austin \r\n'
                                     'Texas,Austin,1,,5,Texas,Austin\r\n'
                                     'Atlantis,Sunk,1,1,1,Atlantis,Sunk\r\n')
    zips = _write(tmp, "zip.csv", "USPS_ZIP_PREF_CITY,USPS_ZIP_PREF_STATE,CBSA\n"
                                  "AUSTIN,TX,12420\nAUSTIN,TX,12420\nAUSTIN,TX,99999\nSUNK,ZZ,\n")
    c = files.read_csv(spark, crime, multiline=True)
    z = files.read_csv(spark, zips)
    out = {r.cbsa_code: r for r in pipeline.crime_build(c, z).collect()}
    assert set(out) == {"12420"}
    r = out["12420"]
    assert r.violent_crime_count == 4000.0          # missing part skipped in the sum
    assert r.property_crime_count == 30005.0
    assert r.total_crime_count == 34005.0


def test_walkability_build(spark):
    bg = spark.createDataFrame([("100", "10", "5", "1", "2", "3"), ("100", "0", "15", "1", "2", "3"),
                                ("100.0", "30", "10", "3", "4", "5"), (None, "5", "5", "5", "5", "5")],
                               "CBSA string, TotPop string, NatWalkInd string, D1B string, D1D string, D3B string")
    r = pipeline.walkability_build(bg).collect()
    assert len(r) == 1 and r[0].cbsa_code == "100"
    assert math.isclose(r[0].nat_walk_index_mean, 10.0)
    assert math.isclose(r[0].nat_walk_index_pop_weighted, (5 * 10 + 10 * 30) / 40)


def test_weather_build_nearest_and_flags(spark):
    rows = []
    for m in range(1, 13):
        rows.append(("S1", 30.0, -97.0, m, 50.0 + m, 3.0, None if m > 2 else 1.0, m))
        rows.append(("S2", 45.0, -93.0, m, 30.0 + m, 2.0, 4.0, 100 + m))
    rows.append(("S3", 40.0, -100.0, 5, None, 2.0, None, 500))        # no temperature: not eligible
    sm = spark.createDataFrame(rows, "station string, latitude double, longitude double, month int, "
                                     "mly_tavg_normal double, mly_prcp_normal double, mly_snow_normal double, file_order int")
    cen = spark.createDataFrame([("A", 30.5, -97.5), ("B", 44.0, -93.5), ("C", None, None)],
                                "cbsa_code string, centroid_lat double, centroid_lon double")
    out = {r.cbsa_code: r for r in pipeline.weather_build(sm, cen).collect()}
    assert out["A"].station_id == "S1" and out["B"].station_id == "S2" and out["C"].station_id is None
    assert out["A"].n_months_available == 12 and out["A"].has_complete_year and out["A"].station_distance_km < 100
    assert out["A"].temp_seasonality == 6.0
    assert out["A"].snow_binary == 1 and out["B"].snow_binary == 1


def test_census_build_growth_and_names(spark):
    cur = spark.createDataFrame([(" 1 ", "Austin, TX Metro Area", "110", "55"), ("2", "Nowhere", "50", None)],
                                "cbsa_code string, cbsa_name string, TotalPopulation_B01003 string, "
                                "MedianGrossRent_B25064 string")
    pri = spark.createDataFrame([("1", 100.0, 50.0)], "cbsa_code string, TotalPopulation_B01003_prior double, "
                                                     "MedianGrossRent_B25064_prior double")
    out = {r.cbsa_code: r for r in pipeline.census_build(cur, pri, None, numeric=["TotalPopulation_B01003",
                                                                                 "MedianGrossRent_B25064"]).collect()}
    assert math.isclose(out["1"].population_growth, 0.1)
    assert out["1"].state == "TX" and out["1"].cbsa_type == "Metro"
    assert out["2"].population_growth is None
    assert "TotalPopulation_B01003_prior" not in out["1"].asDict()


def _census(spark, n):
    import random
    from placescore.specs import AGE_BUCKETS, CENSUS_SHARES, RACE_GROUPS, RACE_TOTAL
    rnd = random.Random(8)
    cols = ["MedianHouseholdIncome_B19013", "MedianGrossRent_B25064", "MedianHomeValue_B25077", "TotalPopulation_B01003", RACE_TOTAL, *RACE_GROUPS]
    cols += [c for nums, den in CENSUS_SHARES.values() for c in [*nums, den] if c not in AGE_BUCKETS]
    cols += [f"{s}_{b}_B01001" for s in ("Male", "Female") for bs in AGE_BUCKETS.values() for b in bs]
    cols = list(dict.fromkeys(cols))
    rows = []
    for k in range(n):
        state = ["TX", "OH", "PR"][k % 3]
        kind = ["Metro", "Micro"][k % 2]
        rows.append((f"{100 + k}", f"City{k}, {state} {kind} Area", *[str(1000 + rnd.randrange(9000)) for _ in cols]))
    schema = "cbsa_code string, cbsa_name string, " + ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame(rows, schema), cols


def test_landed_files_to_enriched_panel(spark, tmp_path):
    """M1-M7 with A3-A7 and B1-B4 on small landed files."""
    from placescore.sources import sinks
    from placescore.specs import HEALTH_MEASURES, NAME_FEATURES, PLACE_DIMENSIONS
    tmp, n = str(tmp_path), 36
    current, cols = _census(spark, n)
    prior = current.select("cbsa_code", *[(F.col(c).cast("double") / 2).alias(f"{c}_prior") for c in
                                          ("TotalPopulation_B01003", "IndustryTotalEmployed_C24050", "MedianGrossRent_B25064", "MedianHomeValue_B25077")])
    gaz = _write(tmp, "gaz.txt", "CSAFP\tGEOID \tNAME\tCBSA_TYPE\tALAND\tAWATER\tALAND_SQMI\tAWATER_SQMI\tINTPTLAT\tINTPTLONG   \n"
                 + "".join(f"\t{100 + k}\tx\t1\t10\t1\t{2 + k}\t1\t{30 + k * 0.5}\t{-100 + k * 0.5}\n" for k in range(n)))
    census = pipeline.census_build(current, prior, files.read_tsv(spark, gaz))
    r = {x.cbsa_code: x for x in census.collect()}
    raw = {x.cbsa_code: x for x in current.collect()}
    f = lambda c, k="100": float(raw[k][c])
    assert math.isclose(r["100"].population_growth, 1.0) and r["100"].centroid_lat == 30.0 and r["100"].land_area_sqmi == 2.0
    assert math.isclose(r["100"].population_density_per_sq_mile, f("TotalPopulation_B01003") / 2)
    assert math.isclose(r["100"].white_collar_share, 100 * (f("ManagementBusiness_C24010") + f("ScienceEngineering_C24010")) / f("TotalEmployed_C24010"))
    young = sum(f(f"{s}_{b}_B01001") for s in ("Male", "Female") for b in ("22to24", "25to29", "30to34"))
    assert math.isclose(r["100"].age_22_34_share, 100 * young / f("TotalPopulation_B01003")) and "Male_22to24_B01001" not in census.columns

    walk = pipeline.walkability_build(spark.createDataFrame(
        [(f"{100 + k}", str(k), str(5 + k % 7), str(1 + k), "2", str(k % 4)) for k in range(n) if k != 5], "CBSA string, TotPop string, NatWalkInd string, D1B string, D1D string, D3B string"))
    tract_rows = [(f"T{k}", f"{k + 1},000", None if k % 4 else "500", f"POINT ({-100 + k * 0.5} {30 + k * 0.5})", *[str(10 + (k + j) % 9) for j in range(11)]) for k in range(n)]
    tracts = spark.createDataFrame([*tract_rows, tract_rows[0]], "tractfips string, totalpopulation string, totalpop18plus string, geolocation string, "
                                   + ", ".join(f"{m.lower()}_crudeprev string" for m in HEALTH_MEASURES))
    squares = spark.createDataFrame([(f"{100 + k}", f"POLYGON (({-100.1 + k * .5} {29.9 + k * .5}, {-99.9 + k * .5} {29.9 + k * .5}, {-99.9 + k * .5} {30.1 + k * .5}, {-100.1 + k * .5} {30.1 + k * .5}))")
                                     for k in range(n)], "cbsa_code string, wkt string")
    from placescore.operators import geo
    titles = squares.select("cbsa_code", F.concat(F.lit("Title "), "cbsa_code").alias("cbsa_title"))
    health = pipeline.health_build(tracts, geo.polygon_edges(squares, "cbsa_code", "wkt"), titles)
    h = {x.cbsa_code: x for x in health.collect()}
    assert len(h) == n and h["100"].n_tracts == 1 and h["100"].total_population_weight == 500.0 and h["101"].total_population_weight == 2000.0
    assert h["100"].obesity_share == 10.0 and h["100"].cbsa_title == "Title 100"
    crime = spark.createDataFrame([(f"{100 + k}", float(k), float(2 * k), float(3 * k)) for k in range(n)], "cbsa_code string, violent_crime_count double, property_crime_count double, total_crime_count double")

    os.mkdir(os.path.join(tmp, "st"))
    for k in range(8):
        head = "STATION,LATITUDE,LONGITUDE,NAME,month,MLY-TAVG-NORMAL,MLY-PRCP-NORMAL" + (",MLY-SNOW-NORMAL" if k % 2 else "")
        lines = [f'S{k},{30 + 2 * k},{-100 + 2 * k},"TOWN {k}, TX US",{m},{40 + k + m},{1 + k}' + (f",{m}" if k % 2 else "") for m in range(1, 14 if k else 12)]
        _write(os.path.join(tmp, "st"), f"s{k}.csv", "\n".join([head, *lines, "S,1,2,n,1,2,3,4,5"]) + "\n")
    _write(os.path.join(tmp, "st"), "bad.csv", "ID,month\n1,2\n")
    months, skipped, bad = pipeline.station_months(files.read_texts(spark, os.path.join(tmp, "st")))
    assert skipped.count() == 1 and bad.count() == 8 and months.count() == 8 * 12 - 1
    weather = pipeline.weather_build(months, census.select("cbsa_code", "centroid_lat", "centroid_lon"))
    w = {x.cbsa_code: x for x in weather.collect()}
    assert w["100"].station_id == "S0" and w["100"].station_name == "TOWN 0, TX US" and w["100"].n_months_available == 11 and not w["100"].has_complete_year
    assert w["100"].annual_snowfall is None and w["104"].annual_snowfall == 78.0 and w["104"].temp_seasonality == 6.0 and w["104"].station_distance_km == 0.0

    base = pipeline.base_panel(census, [walk, health, crime, weather])
    b = {x.cbsa_code: x for x in base.collect()}
    assert len(b) == n and base.columns[:5] == ["cbsa_code", "cbsa_name", "city", "state", "cbsa_type"] and base.columns[-1] == "contains_imputed"
    assert b["100"].annual_snowfall == 0.0 and b["105"].contains_imputed == 1 and b["106"].contains_imputed == 0
    assert b["105"].nat_walk_index_mean is not None and math.isclose(b["110"].violent_crime_per_population, 10 / f("TotalPopulation_B01003", "110"))

    e = pipeline.enriched_panel(base, starts=2)
    panel = e.panel.collect()
    assert len(panel) == n * 2 // 3 and all(x.state != "PR" for x in panel)
    assert e.mapping.count() == n and len(e.mapping.columns) == 19
    assert {x.sub_cluster for x in e.mapping.collect()} == set(range(22)) and {x.cluster for x in e.mapping.collect()} == set(range(5))
    assert all(0 <= x[d] <= 1 for x in panel for d in PLACE_DIMENSIONS)
    names = e.label_names.collect()
    assert sorted((x.level, x.label) for x in names) == [("cluster", k) for k in range(5)] + [("sub_cluster", k) for k in range(22)]
    numeric = {f for f, kind in base.dtypes if kind in ("double", "int", "bigint")}
    assert all(t.split(":")[0] in numeric for x in names for t in x.key_traits.split(" | "))
    assert [(x.model, x.n_clusters) for x in e.metrics.orderBy("n_clusters").collect()] == [("pcareducedk5", 5), ("pcareducedk22", 22)]
    path = os.path.join(tmp, "panel.parquet")
    e.panel.write.parquet(path)
    assert files.read_panel(spark, path, cache=False).count() == len(panel)
    assert sinks is not None


def test_cached_or_rebuild_and_optional_table(spark):
    tmp = tempfile.mkdtemp(prefix="ps-test-")
    path = os.path.join(tmp, "cache.parquet")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).withColumn("x", F.col("id") * 2)

    assert files.cached_or_rebuild(spark, path, build).count() == 3
    assert files.cached_or_rebuild(spark, path, build).count() == 3
    assert len(calls) == 1
    assert files.optional_table(spark, os.path.join(tmp, "missing.csv")) is None


def test_cache_survives_killed_and_parallel_writers(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ps-test-"), "cache.parquet")

    def killed():
        spark.range(5).write.parquet(f"{path}/{files.RUNS}/half")  # files of a run that was never published
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        files.cached_or_rebuild(spark, path, killed)
    assert files.cached_or_rebuild(spark, path, lambda: spark.range(7)).count() == 7

    def slow():
        # Another writer starts later and ends first.
        assert files.cached_or_rebuild(spark, path, lambda: spark.range(9), force_rebuild=True).count() == 9
        return spark.range(8)

    assert files.cached_or_rebuild(spark, path, slow, force_rebuild=True).count() == 8
    assert files.cached_or_rebuild(spark, path, lambda: 1 / 0).count() == 9
    plain = os.path.join(tempfile.mkdtemp(prefix="ps-test-"), "plain")
    spark.range(4).write.parquet(plain)
    assert files.cached_or_rebuild(spark, plain, lambda: 1 / 0).count() == 4


def test_station_cache_writes_its_run_metrics(spark):
    import json
    tmp = tempfile.mkdtemp(prefix="ps-test-")
    os.mkdir(os.path.join(tmp, "st"))
    for k in range(3):
        with open(os.path.join(tmp, "st", f"{k}.csv"), "w") as f:
            f.write("station,latitude,longitude,name,month,mly_tavg_normal,mly_prcp_normal\n" if k else "station,latitude,month\n")
            f.writelines(f"S{k},{40 + k},{-80 - k},N{k},{m},{10 + m},1.5\n" if k else "S0,1,1\n" for m in range(1, 13))
            f.write("S1,41,-81,N1,1,2,3,surplus\n" if k == 1 else "")
    texts, path = files.read_texts(spark, os.path.join(tmp, "st")), os.path.join(tmp, "cache")
    first = pipeline.cached_station_summaries(spark, texts, path, os.path.join(tmp, "metrics"), {"source": "unit"})
    assert sorted(r.station_id for r in first.collect()) == ["S1", "S2"]
    m = json.loads(spark.read.text(os.path.join(tmp, "metrics")).collect()[0][0])
    assert (m["n_files_total"], m["n_files_skipped"], m["n_records_rejected"], m["n_stations_summarized"], m["source"]) == (3, 1, 1, 2, "unit")
    again = pipeline.cached_station_summaries(spark, texts.limit(0), path)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    near = pipeline.station_weather(again, spark.createDataFrame([("1", 41.0, -81.0)], "cbsa_code string, centroid_lat double, centroid_lon double")).collect()
    assert [(r.cbsa_code, r.station_id) for r in near] == [("1", "S1")]
