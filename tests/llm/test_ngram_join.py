import random
import re

import numpy as np
import pytest

from placescore.llm import ngram_join as N


def brute(rows, width, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_matches_brute_force(spark, width, percent):
    rnd = random.Random(width)
    line = " ".join(f"common{k}" for k in range(15))
    base = [[f"{rnd.choice('abcdefgh')}{rnd.randrange(60)}" for _ in range(rnd.randint(3, 120))] for _ in range(40)]
    texts = []
    for w in base:
        texts.append(" ".join(w) + "\n" + line)
        for _ in range(rnd.randint(0, 6)):
            v = list(w)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = f"edit{rnd.randrange(10 ** 6)}"
            texts.append(" ".join(v) + "\n" + line)
    chain = [f"c{k}" for k in range(200)]
    for k in range(25):  # each links with the next only
        texts.append(" ".join(chain[2 * k:2 * k + 150]))
    texts += [None, "", " \n", "one", "ONE", "two words", "Two  Words", "Élan élan x", "élan Élan x", "big " + " ".join(str(k) for k in range(60_000))]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.join_similar(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_trie_walk_counts_exactly():
    rnd = np.random.default_rng(0)
    for percent in (50, 80, 90):
        for _ in range(30):
            a = np.unique(rnd.integers(0, 400, 150).astype(np.uint64))
            others = [np.unique(np.where(rnd.random(len(a)) < rnd.choice([0.02, 0.1, 0.5]), a + np.uint64(1000), a)) for _ in range(6)]
            others += [a, a[:-1], a[:1]]
            got = N.trie_links(a, others, percent)
            want = [100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in others]
            assert got.tolist() == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (5, "x"), (6, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0) for r in N.join_similar(df).collect())
    assert got == [(0, 2, 0), (4, 2, 0), (4, 2, 0), (5, 1, 5), (6, 0, 6)]
    assert N.join_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_that_share_an_id_keep_all_their_links(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (3, b), (3, None), (7, a + " tail"), (8, b + " tail"), (None, c), (None, "far off " + b[::-1]), (9, c + " tail"), (10, "alone")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        got = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in N.join_similar(df).collect()}
        assert got == {(3, True): 3, (3, False): 3, (7, True): 3, (8, True): 3, (None, True): None, (9, True): None, (10, True): 10}
