"""Sinks (B1-B4) and readers (A3, A4, A7) on small folders."""

import json
import os

from pyspark.sql import functions as F

from placescore.sources import files, sinks


def _frame(spark):
    return spark.createDataFrame([("01", 1.5, "a,b"), ("02", None, "x")], "k string, v double, t string")


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = _frame(spark)
    sinks.write_csv(df, f"{tmp_path}/c")
    back = files.read_keyed_csv(spark, f"{tmp_path}/c", "k").orderBy("k").collect()
    assert [tuple(r) for r in back] == [("01", "1.5", "a,b"), ("02", None, "x")]
    sinks.write_parquet(df, f"{tmp_path}/p", partition_by=["k"])
    assert sorted(d for d in os.listdir(f"{tmp_path}/p") if d.startswith("k=")) == ["k=01", "k=02"]
    assert files.read_panel(spark, f"{tmp_path}/p", cache=False).count() == 2


def test_run_metrics_count_in_the_same_pass(spark, tmp_path):
    m = sinks.write_with_metrics(_frame(spark), f"{tmp_path}/out", {"missing": F.col("v").isNull()}, f"{tmp_path}/metrics", {"source": "unit"})
    assert (m["rows_written"], m["missing"], m["source"]) == (2, 1, "unit")
    line = spark.read.text(f"{tmp_path}/metrics").collect()[0][0]
    assert json.loads(line)["rows_written"] == 2


def test_cluster_artifacts(spark, tmp_path):
    df = _frame(spark)
    sinks.write_cluster_artifacts(df, df, df, df, str(tmp_path / "art"))
    assert sorted(os.listdir(tmp_path / "art")) == ["full", "label_names", "mapping", "metrics"]


def test_tsv_headers_and_whole_texts(spark, tmp_path):
    (tmp_path / "g.txt").write_text("GEOID \t INTPTLAT  \n1\t2.5\n", encoding="utf-8")
    assert files.read_tsv(spark, str(tmp_path / "g.txt")).columns == ["GEOID", "INTPTLAT"]
    os.mkdir(tmp_path / "st")
    (tmp_path / "st" / "a.csv").write_text("x\n1\n2\n")
    (tmp_path / "st" / "b.csv").write_text("y\n")
    assert sorted(r.content for r in files.read_texts(spark, str(tmp_path / "st")).collect()) == ["x\n1\n2\n", "y\n"]
