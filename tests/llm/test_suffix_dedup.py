import random

from placescore.llm import suffix_dedup as S


def brute(rows):
    """rows: (id, text) in order of id."""
    seen, out = set(), {}
    for i, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k:k + 100]
            if w in seen:
                gone[k:k + 100] = b"\1" * 100
            else:
                seen.add(w)
        out[i] = (len(b), bytes(c for c, g in zip(b, gone) if not g))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    base = [" ".join(word() for _ in range(rnd.randint(5, 300))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    texts = list(base)
    for t in base[:20]:
        texts.append(t)
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "EDIT"
        texts.append(" ".join(w))
        texts.append(t[:rnd.randint(0, len(t))] + passage + t[5:])
        texts.append(passage[:99] + word())
        texts.append(word() + passage[1:101] + word())
    texts += [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 5000, "ab" * 300, "the the the " * 400, passage * 3]
    big = " ".join(word() for _ in range(400_000))
    texts += [big, "z" + big[700_000:1_600_000]]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i, texts[i]) for i in order]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in S.drop_repeats(df).collect()}
    want = brute(sorted(rows))
    assert got.keys() == want.keys()
    assert [i for i in want if got[i] != want[i]] == []


def test_repeated_rows_null_ids_and_empty_table(spark):
    a = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (None, a)], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"], len(r["spans"])) for r in S.drop_repeats(df).collect())
    assert got == [(False, 0, 0, 0), (True, 1, len(a), 1), (True, 1, len(a), 1), (True, 2, len(a), 1)]
    assert S.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    p, z, y, u, v = text(400), text(300), text(839), text(909), text(500)
    rows = [(1, p), (5, z + p), (5, y), (5, y), (None, p[:250] + u), (None, u + v), (None, v), (None, None), (5, ""), (-(2 ** 63), v + "tail"), (-(2 ** 63), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in S.drop_repeats(df).collect())
    # The order in which the library takes documents: null ids first, then ids, then the digest.
    filled = df.selectExpr("doc_id", "coalesce(text, '') AS text").distinct().withColumn("k", S.row_key("doc_id", "text")).collect()
    filled.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["k"]))
    cut = brute([((r["doc_id"], r["text"]), r["text"]) for r in filled])
    want = sorted((i is not None, i or 0, cut[i, t or ""][0], cut[i, t or ""][0] - len(cut[i, t or ""][1]), cut[i, t or ""][1]) for i, t in rows)
    assert got == want
    assert [g[3] for g in got if g[2] == len(y)] == [0, 0]
