"""Writers (B1-B4).

Parquet is the default sink; CSV is available for hand-off files.  Run metrics
are gathered with ``df.observe`` while the data is written (no extra pass).
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B1: CSV with header, no index; parent folders are created by the writer."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """B2."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_with_metrics(df: DataFrame, path: str, counters: Mapping[str, F.Column], metrics_path: str | None = None,
                       extra: Mapping[str, str] | None = None) -> dict:
    """Write ``df`` as Parquet while counting ``counters`` (name -> boolean
    column) in the same pass; returns and optionally writes the run metrics."""
    obs = Observation("run_metrics")
    o = df.observe(obs, F.count(F.lit(1)).alias("rows_written"),
                   *[F.count_if(c).alias(n) for n, c in counters.items()])
    o.write.mode("overwrite").parquet(path)
    m = dict(obs.get)
    m.update({"written_at_utc": datetime.now(timezone.utc).isoformat(), "output_path": path})
    if extra:
        m.update(extra)
    if metrics_path:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(m, default=str),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(metrics_path)
    return m


def write_cluster_artifacts(full: DataFrame, mapping: DataFrame, metrics: DataFrame, labels: DataFrame,
                            base_path: str, fmt: str = "parquet") -> None:
    """The four cluster artefact tables."""
    for name, d in (("full", full), ("mapping", mapping), ("metrics", metrics), ("label_names", labels)):
        p = f"{base_path.rstrip('/')}/{name}"
        write_csv(d, p) if fmt == "csv" else write_parquet(d, p)
