"""Readers for landed input files.

Every reader takes an explicit schema or header handling -- no ``inferSchema``
-- so scans are typed, pruned and pushed down.
"""

from __future__ import annotations

import csv
import time
import uuid
from typing import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placescore.operators.clean import snake_case, strip_header_padding
from placescore.operators.text import csv_fields
from placescore.operators.window import union_all
from placescore.session import cut_lineage


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True,
             multiline: bool = False, sep: str = ",") -> DataFrame:
    """A1/A2/A5: CSV with header (a UTF-8 BOM is dropped by the reader); embedded
    newlines in quoted header names need ``multiline=True``.  Without a schema
    every column is read as text (coerce later with ``coerce_numeric_columns``)."""
    r = spark.read.option("header", header).option("sep", sep).option("multiLine", multiline) \
        .option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def clean_headers(df: DataFrame, newline_to: str = " ") -> DataFrame:
    """A2: header names with embedded CR/LF normalised (``"Violent\\ncrime"`` ->
    ``"Violent crime"``) and padding stripped."""
    return df.toDF(*[" ".join(c.replace("\r\n", "\n").replace("\n", newline_to).split()) for c in df.columns])


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A3: tab-separated gazetteer with padded header names."""
    return strip_header_padding(read_csv(spark, path, schema, sep="\t"))


def read_keyed_csv(spark: SparkSession, path: str, key: str, schema: StructType | str | None = None) -> DataFrame:
    """A4: keyed CSV; key kept as trimmed text."""
    df = read_csv(spark, path, schema)
    return df.withColumn(key, F.trim(F.col(key).cast("string")))


def read_snake_csv(spark: SparkSession, path: str) -> DataFrame:
    """C2 at the scan: CSV with snake_case headers."""
    df = read_csv(spark, path)
    return df.toDF(*[snake_case(c) for c in df.columns])


def read_drifting_csv(spark: SparkSession, path: str, required: Sequence[str], sep: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder of CSV files with varying headers -> rows bound by name.

    The first line of each file is its header; files with the same header are read
    by one native CSV scan with that header's snake-cased names, and the scans are united by
    name.  Returns (rows, skipped, quarantine): ``rows`` has ``path``, ``line_no``
    (grows within a file) and a text column per name (missing trailing fields and
    columns that a file lacks are null; of a repeated name the first counts);
    ``skipped`` has the paths of files without one of the ``required`` names, empty files
    included; ``quarantine`` the path, line_no and text of records with surplus fields.
    Quoted fields may hold line breaks, header names may not.  The headers are read
    when this is called; the driver holds the paths, as Spark's file index does.
    """
    text = spark.read.text(path)
    listed = spark.createDataFrame([(p,) for p in text.inputFiles()], "path string")  # scans pass empty files over
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"))
    heads = (lines.filter("__start = 0").withColumn("__at", F.monotonically_increasing_id())
             .groupBy("path").agg(F.min_by("value", "__at").alias("header")))
    same = F.regexp_replace("path", "^file:/+", "/")
    heads = cut_lineage(listed.withColumn("__p", same).join(heads.select(same.alias("__p"), "header"), "__p", "left").select("path", "header"))
    rows, skipped, bad = [], heads.filter(F.col("header").isNull()).select("path"), []
    for r in heads.filter(F.col("header").isNotNull()).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").toLocalIterator():
        names = [snake_case(c.strip().lstrip("\ufeff")) for c in next(csv.reader([r["header"]], delimiter=sep), [])]
        if not set(map(snake_case, required)) <= set(names):
            skipped = skipped.unionByName(heads.filter(F.col("header") == r["header"]).select("path"))
            continue
        first = {}
        for k, c in enumerate(names):
            first.setdefault(c, f"c{k}")
        schema = ", ".join([f"c{k} string" for k in range(len(names))] + ["record string"])
        scan = (spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "record").option("columnPruning", False)
                .csv([unquote(p) for p in r["paths"]]))
        scan = scan.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), "*")
        # A record is set aside by the reader if it has too few fields or too many; only the latter is an error.
        # The first field is looked at as well: a scan of nothing but set-aside records is not allowed.
        surplus = F.col("record").isNotNull() & (F.size(csv_fields(F.col("record"), sep)) > len(names)) & (F.length(F.coalesce("c0", F.lit(""))) >= 0)
        rows.append(scan.filter(~surplus).select("path", "line_no", *[F.col(c).alias(name) for name, c in first.items()]))
        bad.append(scan.filter(surplus).select("path", "line_no", "record"))
    names = ", ".join(["path string", "line_no long", *[f"{snake_case(c)} string" for c in required]])
    none = spark.createDataFrame([], names)
    return (union_all(rows) if rows else none, skipped,
            union_all(bad) if bad else spark.createDataFrame([], "path string, line_no long, record string"))


def read_panel(spark: SparkSession, path: str, cache: bool = True) -> DataFrame:
    """Enriched panel scan (Parquet), cached for repeated queries."""
    df = spark.read.parquet(path)
    return df.cache() if cache else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop-FS existence check (works for any scheme the cluster mounts)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


#: Name of a cache's manifest, and of the folder of its runs.
MANIFEST, RUNS = "_manifest", "runs"


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Run folders that were published whole, the latest first."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n[len(MANIFEST) + 1:] for n in names if n.startswith(MANIFEST + "-")), reverse=True)


def cached_or_rebuild(spark: SparkSession, path: str, build, force_rebuild: bool = False, write=None) -> DataFrame:
    """Read the cache at ``path`` if a whole one was published (and not forced), else build, publish and read it.

    ``build()`` gives the frame to write; or ``write(folder)`` writes the Parquet
    folder itself.  A build is written to a run folder of its own.  When its write has ended, an
    empty manifest file that names the run is put in place by one rename; readers
    look at manifests only, so a killed write leaves nothing that counts, and of
    two writers each leaves a whole cache, of which the one that started later is read.  A
    forced rebuild publishes a new run; runs that readers may still hold are kept.
    Plain Parquet folders of earlier versions are caches if Spark marked them done.
    """
    found = _manifests(spark, path)
    if found and not force_rebuild:
        return spark.read.parquet(f"{path}/{RUNS}/{found[0]}")
    if not force_rebuild and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    if write is None:
        build().write.parquet(f"{path}/{RUNS}/{run}")
    else:
        write(f"{path}/{RUNS}/{run}")
    publish(spark, path, run)
    return spark.read.parquet(f"{path}/{RUNS}/{run}")


def publish(spark: SparkSession, path: str, run: str) -> None:
    """Put the manifest of a run that was written whole in place."""
    jvm = spark._jvm
    draft, name = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}/{RUNS}/.{run}", f"{path}/{MANIFEST}-{run}"))
    fs = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(draft).close()
    if not fs.rename(draft, name):
        raise OSError(f"the cache at {path} was not published")


def optional_table(spark: SparkSession, path: str | None, reader=None) -> DataFrame | None:
    """A side table that may be absent -> ``None`` (callers fill empty text)."""
    if not path or not path_exists(spark, path):
        return None
    return (reader or (lambda p: read_csv(spark, p)))(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A6 helper: many small text files as (path, content) rows, one row per file."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()) \
        .select("path", F.col("value").alias("content"))

