import random
import re
from collections import Counter

import numpy as np

from placescore.llm import decontaminate as D


def brute(docs, items, least=0.8):
    """Best weighted Jaccard over all windows of the item's size."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    out = {}
    for i, t in docs:
        w = words(t)
        for j, x in items:
            v = words(x)
            if len(v) < 5 or len(w) < 5:
                continue
            b = grams(v)
            best = 0
            for k in range(max(1, len(w) - len(v) + 1)):
                a = grams(w[k:k + len(v)])
                low = sum((a & b).values())
                best = max(best, low / (sum(a.values()) + sum(b.values()) - low))
            if best >= least:
                out[i, j] = best
    return out


def test_finds_what_brute_force_finds(spark):
    rnd = random.Random(5)
    some = lambda n: [f"{rnd.choice('abcdé')}{rnd.randrange(300)}" for _ in range(n)]
    items = [(k, " ".join(some(rnd.choice([5, 12, 30, 60])))) for k in range(40)] + [(90, "too few words"), (91, None), (92, ""), (93, "so so so so so so so so so")]
    docs = []
    for k in range(150):
        w = some(rnd.randint(0, 200))
        if k % 2:
            x = items[k % 40][1].split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2])):
                x[rnd.randrange(len(x))] = "edit"
            at = rnd.randint(0, len(w))
            w[at:at] = [y.upper() if "é" not in y and rnd.random() < 0.3 else y for y in x]
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(w)))
    docs += [(200, None), (201, ""), (202, items[3][1][:60]), (203, "so " * 400), (204, " ".join(some(60_000)) + " " + items[2][1])]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, similarity double").repartition(4)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute([d for d in docs if d[0] != 204], items)
    want[204, 2] = 1.0
    # What is clearly similar must be found, at its similarity; nothing under the threshold may be.
    assert all(k in want and abs(got[k] - want[k]) < 1e-9 for k in got)
    assert [k for k, s in want.items() if k not in got] == []


def test_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(1)
    items = D.Items(list(range(50)), [" ".join(f"w{k * 31 + j}" for j in range(20)) for k in range(50)])
    prints = []
    for k in range(300):
        bits = np.unpackbits(items.prints[k % 50])
        flip = rnd.choice(128, rnd.integers(0, 45), replace=False)
        bits[flip] ^= 1
        prints.append(np.packbits(bits))
    prints = np.array(prints)
    r, i = items.near(prints)
    want = {(a, b) for a in range(300) for b in range(50) if np.bitwise_count(prints[a] ^ items.prints[b]).sum() <= D.RADIUS}
    assert set(zip(r.tolist(), i.tolist())) == want


def test_repeated_rows_and_empty_tables(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, item), (1, item), (None, "x " + item)], "doc_id long, text string")
    items = spark.createDataFrame([("q", item), ("q", item)], "item_id string, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"], r["similarity"]) for r in D.find_leaks(docs, items).collect()) == [(0, "q", 1.0), (1, "q", 1.0), (1, "q", 1.0)]
    assert D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.find_leaks(docs.limit(0), items).count() == 0
