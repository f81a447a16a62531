import duckdb
import numpy as np
import pyarrow as pa

from placescore.llm import queries, quality_model as Q

SF = "/root/testdata/sf0.01"


def test_trees_fit_and_flatten():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] < 0.3)).astype(float)
    m = Q.fit_trees(x, y, trees=40, depth=3)
    p = m.score(x)
    assert ((p >= 0.5) == y).mean() > 0.98

    def walk(row):
        total = m.base
        for t in range(len(m.feature)):
            i = 0
            for _ in range(m.depth):
                i = 2 * i + (2 if row[m.feature[t, i]] > m.cut[t, i] else 1)
            total += m.leaf[t, i - (2 ** m.depth - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], p[:50])
    assert np.allclose(Q.fit_trees(x, y, trees=40, depth=3).score(x), p)


def test_one_class_and_no_rows():
    x = np.ones((3, 2))
    assert (Q.fit_trees(x, np.ones(3)).score(x) > 0.5).all()
    assert np.allclose(Q.fit_trees(np.zeros((0, 2)), np.zeros(0)).score(x), 0.5)


def test_statistics_by_hand():
    x = Q.statistics(pa.array(["aa BB aa\naa", None, "", "x!", "é"]))
    f = {n: k for k, n in enumerate(Q.FEATURES)}
    assert x.shape == (5, len(Q.FEATURES))
    assert np.isclose(x[0, f["log_words"]], np.log1p(4)) and np.isclose(x[0, f["distinct_words"]], 0.5)
    assert np.isclose(x[0, f["top_word"]], 0.75) and np.isclose(x[0, f["same_as_last"]], 0.25) and np.isclose(x[0, f["upper"]], 2 / 11)
    assert (x[1] == 0).all() and (x[2] == 0).all()
    assert x[3, f["shouts"]] == 1 and x[3, f["end_marks"]] == 1 and x[4, f["non_ascii"]] == 1
    # Batches are cut into slices; a slice boundary changes nothing.
    many = pa.array([f"w{k} " * (k % 50) for k in range(3000)] + ["long " * 700_000])
    assert np.allclose(Q.statistics(many), np.vstack([Q.statistics(many.slice(k, 500)) for k in range(0, len(many), 500)]))


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op7_quality_model(spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (2, "a b", 3.0), (2, "a b", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (9, None)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert Q.score(docs, model).count() == 4
    assert Q.keep_scored(docs, model, 0.0).columns == docs.columns
    assert Q.keep_scored(docs, model, 0.0).count() == 4
    empty = docs.limit(0)
    assert Q.score(empty, Q.train(empty, labels)).count() == 0
