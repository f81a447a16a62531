import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placescore.llm import queries, token_alignment as T

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
ALIGNER = T.Aligner(*[T.read_file(p) for p in PATHS])


def brute_groups(text):
    """[(A ids, B ids, links)] of each group by plain walking, from the libraries' own tokens; None if they do not spell the text."""
    if not text:
        return None
    data = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    symbols = T._byte_symbols()
    bytes_a = [bytes(symbols[c] for c in A.id_to_token(k)) if k != 50256 else b"<|endoftext|>" for k in a]
    bytes_b = [bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return None
    spans = []
    for tokens in (bytes_a, bytes_b):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        spans.append(out)
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    out, start, i, j = [], 0, 0, 0
    for end in common:
        ga, gb = [], []
        while i < len(a) and spans[0][i][1] <= end:
            ga.append(i)
            i += 1
        while j < len(b) and spans[1][j][1] <= end:
            gb.append(j)
            j += 1
        over = [(a[x], b[y]) for x in ga for y in gb if max(spans[0][x][0], spans[1][y][0]) < min(spans[0][x][1], spans[1][y][1])]
        out.append(([a[x] for x in ga], [b[y] for y in gb], over))
    return out


def brute(texts):
    every = [brute_groups(t) for t in texts]
    count = Counter(x for g in every if g for _, _, over in g for x in over)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for g in every:
        if not g:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        over = [x for _, _, o in g for x in o]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in g)
        out.append((sum(len(a) for a, _, _ in g), sum(len(b) for _, b, _ in g), len(g), len(over), sum(count[x] == best[x[1]] for x in over),
                    sum(count[x] for x in over), hashlib.sha256(shown.encode()).hexdigest()))
    return out


TEXTS = [None, "", " ", "  two  spaces ", "Hello, world! don't <|endoftext|> <s> </s> <unk>", "a▁b", "naïve café\nline\r\n\ttab\x0bx", "你好 世界 😀👩‍👩‍👧", "x" * 5000,
         "the cat sat on the mat, the cat sat. " * 40, "nul\x00 byte \x01\x7f", " nbsp  x", "é é ﬁ ①", "Hello, world! don't <|endoftext|> <s> </s> <unk>", "12345 67.89% &c; (x)", " \u0085 \x1c y"]


def _rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("most", [0, 30, T.FREQUENT])
def test_documents_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(T, "SLICE_CHARS", 200)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = TEXTS + docs
    df = spark.createDataFrame([(k if k % 4 else None, t, "clash", 1.0, "x") for k, t in enumerate(texts)], "doc_id long, text string, groups string, n_a double, _row string").repartition(3)
    aligned = T.align_documents(df, *PATHS).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    got = T.count_links(aligned, *T.vocabulary_sizes(*PATHS), most=most)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")
    want = sorted((k if k % 4 else -1, *row) for k, row in enumerate(brute(texts)))
    assert _rows(got) == want


def test_query_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = queries.op11_token_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(d["doc_id"], *w) for d, w in zip(docs, brute([d["text"] for d in docs]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.randoms(use_true_random=False))
def test_ends(sizes, rnd):
    total = sum(sizes)
    other = []
    while sum(other) < total:
        other.append(min(rnd.choice([1, 1, 2, 5]), total - sum(other)))
    a, b = np.cumsum(np.array(sizes, int)), np.cumsum(np.array(other, int))
    ga, gb = T.align_ends(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert [a[x - 1] for x in ga] == common == [b[x - 1] for x in gb]


def test_long_runs_and_shifts():
    rnd = random.Random(1)
    a, b = list(range(1, 4000)), list(range(1, 4000))
    for x in rnd.sample(range(1, 3999), 25):
        (a if rnd.random() < 0.5 else b).remove(x)
    ga, gb = T.align_ends(np.array(a), np.array(b))
    assert [a[x - 1] for x in ga] == sorted(set(a) & set(b)) == [b[x - 1] for x in gb]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab' s.,1é  \n▁<|>")), max_size=50))
def test_any_text(text):
    found = ALIGNER.tokens([text])[0]
    want = brute_groups(text)
    assert (found is None) == (want is None)
    if want:
        assert found[0].tolist() == [x for a, _, _ in want for x in a] and found[1].tolist() == [x for _, b, _ in want for x in b]


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "MEMO", 10)
    aligner = T.Aligner(*[T.read_file(p) for p in PATHS])
    texts = ["one two " + "y" * 100 + f" w{k} ▁" for k in range(30)]
    assert aligner.rows(texts[:5])[0] == (0, 0, 0, 0, b"", b"", b"")
    for t in texts:
        aligner.rows([t[:-2], t])
    assert len(aligner.known[0]) <= 12 and not any(len(p) > T.MEMO_CHARS for p in aligner.known[0])


def test_empty_table(spark):
    aligned = T.align_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert T.count_links(aligned, 50257, 32000).count() == 0


def test_a_part_is_aligned_once(monkeypatch):
    walked = []
    ends = T.align_ends
    monkeypatch.setattr(T, "align_ends", lambda a, b: walked.append(len(a)) or ends(a, b))
    aligner = T.Aligner(*[T.read_file(p) for p in PATHS])
    text = "Heureusement, the cat's façade sat in Unverträglichkeit of the thntanin."
    once = sum(len(a) for a, _, _ in brute_groups(" ".join(dict.fromkeys(text.split(" ")))))
    rows = aligner.rows([" ".join([text] * 30)] * 5) + aligner.rows([text] * 50)
    assert sum(walked) == once and [r[0] for r in rows[5:]] == [len(A.encode(" " + text).ids)] * 50


def test_forgotten_parts_and_wide_pairs(monkeypatch):
    texts = [*TEXTS, None, " ".join(f"wörd{k % 37}, {k}² ½×" for k in range(300)), "a " + "z" * 90 + " ▁ b", "a " + "z" * 90 + " b"]
    want = T.Aligner(*[T.read_file(p) for p in PATHS]).rows(texts)
    for t, row in zip(texts, want):
        assert row[4].decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in brute_groups(t) or [])
    for name, value in (("MEMO", 10), ("MEMO_CHARS", 4), ("BLOCK", 3)):
        monkeypatch.setattr(T, name, value)
    aligner = T.Aligner(*[T.read_file(p) for p in PATHS])
    assert [aligner.rows([t])[0] for t in texts] == want and aligner.rows([]) == [] and aligner.rows(texts) == want
    monkeypatch.setattr(T, "MEMO", 1 << 20)
    monkeypatch.setattr(T, "MEMO_BYTES", 0)
    assert [aligner.rows([t])[0] for t in texts] == want
    aligner.rows(["one"])
    assert [*aligner.known[0]] == ["one"]
    aligner.kind = np.dtype("<u8")
    aligner._forget()
    wide = aligner.rows(texts)
    assert [np.frombuffer(r[5], "<u8").tolist() for r in wide] == [np.frombuffer(r[5], "<u4").tolist() for r in want]
    assert [r[:5] + r[6:] for r in wide] == [r[:5] + r[6:] for r in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([chr(c) for c in range(0x21, 0x250) if T._PLAIN(chr(c))] + list("'stlé2²")), min_size=1, max_size=12), min_size=1, max_size=6))
def test_plain_parts_as_the_library_cuts_them(parts):
    ids, upto = ALIGNER.a.encode(parts, True)
    assert np.split(ids, upto[:-1])[0].tolist() == A.encode(" " + parts[0], add_special_tokens=False).ids
    assert ids.tolist() == A.encode(" " + " ".join(parts), add_special_tokens=False).ids
    assert all(T._PLAIN(c) for c in map(chr, range(0x21, 0x250)) if T.SPACE.split(f"{c} {c}") == [c, c])
