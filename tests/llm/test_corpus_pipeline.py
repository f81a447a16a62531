import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from placescore.llm.common import WORD

GOOD = "abcdefghijklmnop"


def _fixture(spark, folder):
    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choice(GOOD) for _ in range(rnd.randint(2, 8))) for _ in range(n)).capitalize() + "."
    item = prose(40)
    docs, bad, near, leaks = [], set(), {}, set()
    for k in range(160):
        t = prose(rnd.randint(60, 150))
        if k % 8 == 0:
            t = " ".join(w + "###" for w in t.split())
            bad.add(k)
        elif k % 8 == 1 and k > 10:
            base = docs[k - 6][1]
            t = base if k % 16 == 1 else base + " extra"
            near[k] = k - 6
        elif k % 20 == 7:
            t = t + "\n" + item
            leaks.add(k)
        docs.append((k, t, "en", f"s{k % 3}", len(t), "more"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k not in bad), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bad, near, leaks


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, bad, near, leaks = _fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_ids = set(range(160))
    want = [all_ids - bad, all_ids - bad - set(near), all_ids - bad - set(near) - {k for k in all_ids if k in leaks or near.get(k) in leaks}]
    for (_, stage), ids in zip(P.STAGES[:3], want):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{len(ids)}-{stage.__name__}")
        docs = spark.read.parquet(f"{folder}/{len(ids)}-{stage.__name__}")
        assert {r[0] for r in docs.select("doc_id").collect()} == ids
    mixed = P.keep_mixed(spark, docs, folder)
    assert mixed.columns == docs.columns
    words = lambda d: {r[0]: r[1] for r in d.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD)))).collect()}
    before, after = words(docs), words(mixed)
    for k, s in enumerate(sorted(before)):
        assert abs(after[s] - sum(before.values()) * (k + 1) / 6) <= 160
    shards = P.assign_shards(spark, mixed, folder)
    assert shards.count() == mixed.count()


def test_run_and_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    _fixture(spark, folder)
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "n_bytes", "shard", "depth", "page", "shard_bytes"] and out.count() > 100
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_rows_of_null_and_repeated_ids_are_kept_by_text(spark, tmp_path):
    folder = str(tmp_path)
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice(GOOD) for _ in range(5)) for _ in range(60)) for _ in range(9)]
    item = " ".join("".join(rnd.choice(GOOD) for _ in range(5)) for _ in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(None, texts[0], "s"), (None, texts[1], "s"), (None, texts[1], "r"), (None, texts[2] + " " + item, "s"), (5, texts[3], "s"), (5, texts[4], "s"),
            (5, texts[5] + " " + item, "s"), (6, texts[4] + " tail", "s"), (7, texts[6], "s"), (7, None, "s"), (8, "", "s"), (None, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").repartition(3)
    rows_of = lambda d: sorted((tuple(r) for r in d.select("doc_id", "text", "source").collect()), key=repr)
    want = sorted(set(rows) - {rows[1], rows[7]}, key=repr)  # of (null, texts[1]) the one with the lesser source
    one = P.keep_one_of_similar(spark, docs, folder)
    assert one.columns == docs.columns and rows_of(one) == want
    clean = P.keep_uncontaminated(spark, one, folder)
    assert clean.columns == docs.columns and rows_of(clean) == [r for r in want if item not in (r[1] or "")]
    # Rows without an id are dealt one by one: the mix stays near its targets.
    many = spark.createDataFrame([(None, f"{' '.join(texts[k % 9].split()[:20])} {k}", "en", "ab"[k % 2]) for k in range(400)], docs.schema)
    taken = dict(P.keep_mixed(spark, many, folder).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD)))).collect())
    assert abs(taken["a"] - 2800) <= 42 and abs(taken["b"] - 5600) <= 42
