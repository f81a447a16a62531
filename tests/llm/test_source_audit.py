import random
from collections import Counter

import numpy as np

from placescore.llm import source_audit as A


def dominated(up, down, order, i):
    return sum(1 for j in range(len(up)) if j != i and up[j] >= up[i] and down[j] <= down[i] and order[j] < order[i])


def test_skyband_against_brute_force():
    rnd = np.random.default_rng(3)
    for n, k, top in ((0, 3, 5), (1, 1, 5), (400, 1, 9), (900, 5, 40), (2500, 20, 6), (1500, 3, 10 ** 6)):
        up, down, order = rnd.integers(1, top, n), rnd.integers(1, 2 * top, n), rnd.permutation(n)
        got = sorted(A.skyband(up, down, order, k).tolist())
        assert got == [i for i in range(n) if dominated(up, down, order, i) < k]


def test_merged_skybands_are_the_skyband():
    rnd = np.random.default_rng(4)
    up, down, order = rnd.integers(1, 30, 1200), rnd.integers(1, 60, 1200), rnd.permutation(1200)
    parts = [np.arange(k, 1200, 5) for k in range(5)]
    left = np.concatenate([p[A.skyband(up[p], down[p], order[p], 7)] for p in parts])
    assert sorted(left[A.skyband(up[left], down[left], order[left], 7)]) == sorted(A.skyband(up, down, order, 7))


def brute(rows, top=A.TOP):
    rows = [(s or "", lang or "", text or "") for text, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(s, [t.decode() for t in A.terms_of(text)]) for s, la, text in rows if la == lang]
        df = Counter(t for _, ts in docs for t in set(ts))
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())
        count = {s: Counter() for s, _ in docs}
        for s, ts in docs:
            count[s].update(t for t in ts if df[t] >= 3)
        p = lambda c, t, n: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept))
        whole = sum(count.values(), Counter())
        f = lambda a, b: (a - b) ** 2 // b
        ps = {s: {t: p(c, t, sum(c.values())) for t in kept} for s, c in count.items()}
        q = {t: p(whole, t, sum(whole.values())) for t in kept}
        for s in count:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            out += [(lang, s, "pair", x[2], -x[0], k) for k, x in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x[2], -x[0], k) for k, x in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def _rows():
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdeÉé中z") for _ in range(rnd.randint(1, 3))) for _ in range(150)]
    rows = [(" ".join(rnd.choice(vocabulary[k % 7 * 10:]) + rnd.choice(["", ",", "1", "\x7f"]) for _ in range(rnd.randint(0, 40))),
             rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s2", "s3", "S3", None])) for k in range(200)]
    return rows + [(None, "en", "empty"), ("", "xx", "only"), ("", "xx", "other"), ("rare words", "yy", "one"), ("word " * 100_000, "de", "s1"), rows[0], rows[0]]


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "ENTRIES", 50)
    monkeypatch.setattr(A, "CELLS", 64)
    rows = _rows()
    df = spark.createDataFrame([(*r, None, "x", 1) for r in rows], "text string, lang string, source string, doc_id long, term string, value int").repartition(5)
    for top in (A.TOP, 4):
        got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in A.audit(df, top).collect())
        assert got == brute(rows, top)


def test_large_counts_are_exact(spark):
    rows = [(c, t) for c in (0, 1, 10 ** 6, 10 ** 12 + 7, 9 * 10 ** 14) for t in (c + 1, 3 * c + 11, 9 * 10 ** 15)]
    df = spark.createDataFrame(rows, "c long, t long")
    assert [r[0] for r in df.select(A.share(df.c, df.t)).collect()] == [1 + 10 ** 9 * (c + 1) // t for c, t in rows]


def test_empty_table(spark):
    assert A.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
