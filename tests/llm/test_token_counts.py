import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from placescore.llm.token_counts import Counter, count_tokens, merged_count, read_file

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = Counter(read_file(PATH))


def library_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def merge_by_rescanning(symbols, ranks, made):
    while True:
        found = [(ranks[x << 32 | y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x << 32 | y in ranks]
        if not found:
            return len(symbols)
        rank, i = min(found)
        symbols = symbols[:i] + [made[rank]] + symbols[i + 2:]


def test_heap_merging_equals_rescanning():
    rnd = random.Random(5)
    for _ in range(300):
        kinds, ranks, made = 3, {}, []
        for rank in range(rnd.randint(0, 12)):
            pair = rnd.randrange(kinds) << 32 | rnd.randrange(kinds)
            if pair not in ranks:
                ranks[pair] = len(made)
                made.append(kinds)
                kinds += 1
        word = [rnd.randrange(3) for _ in range(rnd.randint(0, 40))]
        assert merged_count(list(word), ranks, made) == merge_by_rescanning(word, ranks, made)


TEXTS = [None, "", " ", "\n\t\x0b\x0c\r ", "Hello, World's 42 <|endoftext|> x", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a" * 3000, "don't WE'LL'd",
         "İstanbul ẞ ß Σίσυφος", "é é 각 ﬁ ①²", "a b　c\x1cd\x85e", "😀👩‍👩‍👧 नमस्ते 你好", "x " * 5000, "ab" * 20000, "́ ́a", "Hello, World's 42 <|endoftext|> x"]


def test_texts_as_the_library_counts_them(spark):
    rows = [(k if k % 5 else None, t, "clash", 1) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _id int")
    got = sorted(tuple(r) for r in count_tokens(df.select("doc_id", "text", "n_tokens", "_id"), PATH, limit=100).fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), library_count(t or ""), library_count(t or "") > 100) for i, t, *_ in rows)
    assert got == want
    assert any(r[3] for r in got) and not all(r[3] for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbs'tT 019.<|>\ńé")), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == library_count(text)


def test_another_byte_level_file():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), Counter(read_file(path))
    for t in TEXTS:
        assert counter.count(t or "") == len(library.encode(t or "", add_special_tokens=False).ids)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: library_count(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, PATH).collect()} == want


def test_empty_table_and_wrong_files(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError):
        Counter(b'{"model": {"type": "Unigram"}, "added_tokens": []}')
