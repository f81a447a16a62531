"""Token counts by heap-and-linked-list byte-pair merging, without token ids.

A text is cut at ASCII white space; as the tokenizer's normaliser and
pre-tokenizer never look across it, the count of a text is the sum over its
pieces, and a piece met before in a task costs one lookup.  A new piece is cut
into words as the tokenizer file says.  A word's symbols form a linked list, and
a heap holds its adjacent pairs by merge rank, then place: the lowest pair is
popped and merged, and its new neighbours pushed, until no pair is left.  A word
counts as many tokens as it had symbols, less the merges.

Texts stay in their rows: the operator is one narrow pass.  The tokenizer file
is read on the driver and sent to the executors as it is (at most
``MAX_FILE_BYTES``).  Null texts are empty: 0 bytes, 0 tokens.  Rows that repeat,
null ids and further columns pass as they are; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest tokenizer file that is sent to the executors.
MAX_FILE_BYTES = 64 << 20
#: Pieces, and words, whose counts a task remembers at a time, and the longest piece remembered.
#: They only save time: what is forgotten is counted again.
MEMO, MEMO_CHARS = 1 << 19, 64

_GAPS = re.compile(r"[\x20\x09-\x0D]+")
#: A normaliser and pre-tokenizer under which ASCII white space separates, and the same cut for printable ASCII.
_SPACED = ("NFC Replace Lowercase", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def merged_count(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """How many symbols are left when the lowest-ranked adjacent pair (leftmost of equals) is merged again and again.

    ``ranks`` has the rank of the pair x, y under ``x << 32 | y``, and ``made`` the symbol that the merge of a rank makes.
    """
    n = left = len(symbols)
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        r = rank_of(symbols[i] << 32 | symbols[i + 1])
        if r is not None:
            heap.append(r << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = pop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        # A pair whose left symbol went (-1), or that changed since it was pushed, has another rank or none.
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue
        whole = made[rank]
        symbols[i], symbols[j] = whole, -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank_of(whole << 32 | symbols[k])
            if r is not None:
                push(heap, r << 32 | i)
        k = before[i]
        if k >= 0:
            r = rank_of(symbols[k] << 32 | whole)
            if r is not None:
                push(heap, r << 32 | k)
    return left


class Counter:
    """Counts the tokens of texts as the library does for a byte-level BPE file, by its own merging."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain byte-pair tokenizer file")
        special = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("special tokens with rules of their own are not supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = self.vocab = model["vocab"]
        self.ranks = {vocab[x] << 32 | vocab[y]: rank for rank, (x, y) in enumerate(merges)}
        self.made = [vocab[x + y] for x, y in merges]
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        steps = " ".join(s["type"] for s in (spec["normalizer"] or {}).get("normalizers", []))
        cut = [s.get("pattern", {}).get("Regex") for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.spaced = (steps, cut[0] if cut else None) == _SPACED
        library = Tokenizer.from_str(file.decode())
        self.normal = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not self.spaced:
            return self._piece(text)
        known, total = self.pieces, 0
        for piece in _GAPS.split(text):
            n = known.get(piece)
            if n is None:
                n = self._piece(piece)
                if len(piece) <= MEMO_CHARS:
                    if len(known) >= MEMO:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def _piece(self, piece: str) -> int:
        if not piece:
            return 0
        if self.special is None or "<" not in piece:
            return self._plain(piece)
        parts = self.special.split(piece)  # plain, special, plain, ...
        return len(parts) // 2 + sum(self._plain(p) for p in parts[::2] if p)

    def _plain(self, piece: str) -> int:
        if self.spaced and piece.isascii() and piece.isprintable():
            cut = _ASCII_WORDS.findall(piece.lower())  # printable ASCII stands for itself among byte symbols
        else:
            cut = [w for w, _ in self.cut(self.normal(piece))]
        return sum(map(self._word, cut))

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            vocab = self.vocab
            n = merged_count([*[vocab[c] for c in word[:-1]], vocab[word[-1] + self.end]], self.ranks, self.made)
            if len(word) <= MEMO_CHARS:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = n
        return n


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        file = f.read(MAX_FILE_BYTES + 1)
    if len(file) > MAX_FILE_BYTES:
        raise ValueError(f"tokenizer file over {MAX_FILE_BYTES} bytes")
    return file


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; over_limit: more than ``limit`` tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(sent.value)
            text = b.column("_text")
            n = pa.array([0 if (t := v.as_py()) is None else counter.count(t) for v in text], pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), size, n], ["_id", "_bytes", "_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(counted, f"_id {kind}, _bytes long, _tokens long")
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"),
                      (F.col("_tokens") > limit).alias("over_limit"))
