"""The corpus pipeline: five stages of ``placescore.llm`` operators over ``documents``.

Each stage reads what its predecessor kept, as Parquet, and decides over all of
it; all but the last return the columns of ``documents``, whatever further
columns there are.  The classifier drops what it scores under 0.5, the similarity
join keeps the least id of each group of linked texts, decontamination drops documents that hold
a benchmark item, mixing leaves a document's row as often as the mix takes it
(not at all, once, or repeated), and sharding gives each row its shard.  Ids may
be null or repeat: rows are told apart by a 128-bit digest of id and text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.llm import decontaminate, mixing, ngram_join, quality_model, sharding
from placescore.llm.common import checkpoint_folder, row_key, table

#: Near copies: five-word shingles, a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20


#: The column that tells rows apart while a stage decides.
KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, row_key("doc_id", "text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, scores at least 0.5."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.keep_scored(docs, model, 0.5)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least id (null first), then the least digest; of rows equal in id and text the least by their other columns."""
    sets = ngram_join.similar_sets(docs, SHINGLE_WORDS, SIMILAR_PERCENT, "doc_id", "text")
    heads = sets.filter("n > 0").groupBy("component").agg(F.min(F.struct("id", "key")).alias("_h")).select(F.col("_h.key").alias(KEY))
    heads = heads.unionByName(sets.filter("n = 0").select(F.col("key").alias(KEY)))
    others = F.to_json(F.struct(F.lit(0).alias(KEY), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    rows = _keyed(docs).groupBy(KEY).agg(F.min_by(F.struct(*docs.columns), others).alias("_row"))
    return rows.join(heads, KEY, "left_semi").select("_row.*")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    leaks = decontaminate.find_leaks(_keyed(docs).select(KEY, "text"), table(spark, sf_dir, "benchmark"), id_col=KEY)
    return _keyed(docs).join(leaks.select(KEY).distinct(), KEY, "left_anti").select(*docs.columns)


def keep_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words, which no target counts, once."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.greatest("size", F.lit(1))).otherwise(1).cast("int")
    mixed = mixing.mix(_keyed(docs).select(KEY, "text", "source"), id_col=KEY).groupBy(KEY).agg(F.max(times).alias("_times")).filter("_times > 0")
    taken = _keyed(docs).join(mixed, KEY).withColumn("_time", F.explode(F.sequence(F.lit(1), "_times")))
    return taken.select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard, depth, page, shard_bytes of each document."""
    return sharding.assign_shards(docs, SHARD_BYTES)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", keep_mixed),
    ("sharding", assign_shards),
]

#: Boosted trees, component search and flows are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written, and read again, in the session's checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
