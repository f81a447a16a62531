"""Sharding by extendible hashing.

A directory maps prefixes of a 64-bit row hash to shards.  It starts at the empty
prefix.  The byte counts of cells (prefixes of ``step`` bits more than any
shard of even load would need) are rolled up once to all shorter prefixes, and
each cell takes the shortest prefix that fits the limit: only oversized buckets
split on another bit.  Cells that are themselves too large are refined from
their own rows only.  Rows that share all 64 bits (repeated rows) and still
exceed the limit fill numbered overflow pages.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placescore.llm.common import cut

BITS = 64


def _prefix(depth) -> F.Column:
    """The first ``depth`` bits of ``_hash`` as an unsigned number in a long (depth up to 62)."""
    return F.when(F.lit(depth) == 0, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned("_hash", BITS - depth if depth else 1))


def _shards(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, bytes) of the shortest prefix from ``low`` to ``high`` bits that fits; null depth: none does."""
    up = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= limit)
    hit = up.drop("bytes").join(sums, ["depth", "prefix"])
    best = hit.groupBy("cell").agg(F.min(F.struct("depth", "bytes")).alias("_b"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.col("_b.depth").alias("depth"), F.col("_b.bytes").alias("shard_bytes"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", step: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, shard, depth, page, shard_bytes.

    ``shard`` is the prefix in binary digits (empty: the only shard) and, for
    overflow pages, ``+page``.  Each shard holds at most ``limit_bytes`` unless a
    single document is larger; such a document never shares a shard that could
    still split.  The hash is of id and text, so results do not depend on order
    or partitions; repeated rows share a hash.  Null ids and texts hash as such;
    a null text has 0 bytes.  An empty table gives no rows.
    """
    rows = cut(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_hash")))
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    high = min(40, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + step)
    low, left, placed = 0, rows, None
    while True:
        cells = left.groupBy(_prefix(high).alias("cell")).agg(F.sum("_bytes").alias("bytes"))
        got = _shards(cells, low, high, limit_bytes)
        joined = left.withColumn("cell", _prefix(high)).join(got, "cell")
        done = joined.filter(F.col("depth").isNotNull()).select(
            "_id", "_bytes", "shard_bytes", "depth", F.lit(0).alias("page"),
            F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftright(cell, {high} - depth)), depth, '0')")).alias("shard"))
        placed = done if placed is None else placed.unionByName(done)
        left = joined.filter(F.col("depth").isNull()).select("_id", "_bytes", "_hash")
        if high >= 62:
            break
        if got.filter(F.col("depth").isNull()).isEmpty():
            left = None
            break
        left = cut(left)
        low, high = high + 1, min(62, high + 8)
    if left is not None:
        # Rows of one hash are repeats of one row, so of one size: pages of as many as fit.
        w = W.partitionBy("_hash").orderBy("_id", "_bytes")
        fit = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.col("_bytes"), F.lit(1))))
        pages = left.withColumn("page", F.floor((F.row_number().over(w) - 1) / fit).cast("int"))
        sums = pages.groupBy("_hash", "page").agg(F.sum("_bytes").alias("shard_bytes"))
        pages = pages.join(sums, ["_hash", "page"])
        placed = placed.unionByName(pages.select(
            "_id", "_bytes", "shard_bytes", F.lit(62).alias("depth"), "page",
            F.concat(F.lpad(F.bin(_prefix(62)), 62, "0"), F.lit("+"), F.col("page").cast("string")).alias("shard")))
    return placed.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), "shard",
                         F.col("depth").cast("int").alias("depth"), "page", "shard_bytes")
