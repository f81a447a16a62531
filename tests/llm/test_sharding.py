from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from placescore.llm import sharding


@pytest.mark.parametrize("limit", [400, 3000, 10 ** 9])
def test_shards_cover_all_rows_and_fit(spark, limit):
    rows = [(k, "w " * (k % 37), "x") for k in range(800)] + [(None, None, "x"), (5000, "", "x"), (5001, "y" * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.assign_shards(df, limit).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["doc_id"] is not None) == sorted((False, r[0]) for r in rows if r[0] is not None)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    for name, own in shards.items():
        size = sum(r["n_bytes"] for r in own)
        assert {r["shard_bytes"] for r in own} == {size}
        assert size <= limit or len([r for r in own if r["n_bytes"]]) == 1
    names = sorted(n for n in shards if "+" not in n)
    # No shard's prefix lies within another's.
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_only_oversized_buckets_split(spark):
    rows = [(k, "x" * 100) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, 5000)
    sizes = {r["shard"]: r["n"] for r in got.groupBy("shard").agg(F.sum("n_bytes").alias("n")).collect()}
    start = min(len(s) for s in sizes)
    for s in sizes:
        if len(s) > start:  # its parent was too large
            parent = s[:-1]
            assert sum(n for t, n in sizes.items() if t.startswith(parent)) > 5000


def test_repeated_rows_fill_overflow_pages(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y")], "doc_id long, text string")
    got = sharding.assign_shards(df, 1000).collect()
    assert len(got) == 51
    assert max(r["shard_bytes"] for r in got) <= 1000


def test_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0


def test_one_large_document_does_not_split_the_others(spark):
    rows = [(k, "x" * 500) for k in range(200)] + [(1000, "y" * 1_000_000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4000).collect()
    own = defaultdict(int)
    for r in got:
        own[r["shard"]] += r["n_bytes"]
    assert sum(own.values()) == 1_100_000
    for s in own:  # a shard is only there if its parent was too large
        assert not s or sum(n for t, n in own.items() if t.startswith(s[:-1])) > 4000
