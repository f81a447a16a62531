"""Benchmark decontamination by SimHash windows of the size of each item.

An item of n words is held against the n-word windows of every document.  A
window's 128-bit SimHash adds up the signs of its five-word shingles, once per
occurrence.  Eight blocks of 16 bits index the items' fingerprints under every
value within three bits of their own: two fingerprints at most 31 bits apart
agree to three bits in some block, so the index finds every item within the
radius.  What it finds is verified by the weighted Jaccard similarity of the
shingles (weights: occurrences).  Windows without any shingle of an item of
their size can't be similar to one and are not fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import mix, text_slices, word_hashes, word_spans

WIDTH = 5
RADIUS, BLOCKS, BLOCK_BITS = 31, 8, 16
#: Items that one pass over the documents takes; more items take more passes.
ITEMS_A_PASS = 1000


def run_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they lie in one text."""
    n = len(h)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        if n > k:
            out[:n - k] = mix(out[:n - k] ^ h[k:]) + np.uint64(k)
    ok = np.zeros(n, bool)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            ok[a:b - width + 1] = True
    return out, ok


def signs(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of each shingle."""
    both = np.column_stack([mix(shingle ^ np.uint64(0xA5A5A5A5)), mix(shingle + np.uint64(0x1234567))])
    bits = np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """Packed 16-byte fingerprints of rows of 128 sums."""
    return np.packbits(totals > 0, axis=1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    low = np.minimum(ca[ia], cb[ib]).sum()
    return float(low / (len(a) + len(b) - low))


class Items:
    """Items of one pass: shingles, sizes, fingerprints, and the block index."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.sizes, self.sets, prints = [], [], [], []
        for _, part, offs in text_slices(pa.array(texts, pa.large_string())):
            starts, ends, first = word_spans(part, offs, alnum=True)
            h = word_hashes(part, starts, ends)
            run, ok = run_hashes(h, first, WIDTH)
            for a, b in zip(first[:-1], first[1:]):
                self.sizes.append(int(b - a))
                self.sets.append(run[a:b][ok[a:b]])
        keep = [k for k, n in enumerate(self.sizes) if n >= WIDTH]
        self.ids = [ids[k] for k in keep]
        self.sizes = np.array([self.sizes[k] for k in keep], np.int64)
        self.sets = [self.sets[k] for k in keep]
        prints = [fingerprints(signs(s).sum(axis=0, keepdims=True))[0] for s in self.sets]
        self.prints = np.array(prints, np.uint8).reshape(len(keep), 16)
        owners = np.repeat(np.arange(len(keep)), [len(s) for s in self.sets])
        all_ = np.concatenate(self.sets) if keep else np.zeros(0, np.uint64)
        pairs = np.unique(np.column_stack([all_, self.sizes[owners].astype(np.uint64)]), axis=0) if keep else np.zeros((0, 2), np.uint64)
        self.shingle, self.shingle_size = pairs[:, 0], pairs[:, 1].astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingle >> np.uint64(44)).astype(np.int64)] = True
        flips = np.array([0] + [sum(1 << b for b in c) for k in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint16)
        self.index = []
        for j in range(BLOCKS):
            own = self.block(self.prints, j)
            keys = (own[:, None] ^ flips[None, :]).ravel()
            items = np.repeat(np.arange(len(keep), dtype=np.int32), len(flips))
            order = np.argsort(keys, kind="stable")
            self.index.append((np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1)), items[order]))

    @staticmethod
    def block(prints: np.ndarray, j: int) -> np.ndarray:
        return prints[:, 2 * j].astype(np.uint16) << 8 | prints[:, 2 * j + 1]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all fingerprints within the radius."""
        rows, items = [], []
        for j, (bounds, listed) in enumerate(self.index):
            v = self.block(prints, j).astype(np.int64)
            lo, n = bounds[v], bounds[v + 1] - bounds[v]
            r = np.repeat(np.arange(len(v)), n)
            at = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            rows.append(r)
            items.append(listed[at])
        pair = np.unique(np.concatenate(rows) * len(self.ids) + np.concatenate(items))
        r, i = pair // len(self.ids), pair % len(self.ids)
        far = np.bitwise_count(prints[r] ^ self.prints[i]).sum(axis=1)
        return r[far <= RADIUS], i[far <= RADIUS]

    def search(self, col: pa.Array, least: float) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, first word, similarity) of the best window of each similar item."""
        for row, part, offs in text_slices(col):
            starts, ends, first = word_spans(part, offs, alnum=True)
            run, ok = run_hashes(word_hashes(part, starts, ends), first, WIDTH)
            maybe = np.flatnonzero(ok & self.seen[(run >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(self.shingle, run[maybe], "left")
            n = np.searchsorted(self.shingle, run[maybe], "right") - lo
            at = np.repeat(maybe, n)
            size = self.shingle_size[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            doc = np.searchsorted(first, at, "right") - 1
            for d in np.unique(doc):
                mine = doc == d
                yield from ((row + int(d), i, s, j) for i, s, j in self._one(run[first[d]:first[d + 1] - WIDTH + 1], at[mine] - first[d], size[mine], least))

    def _one(self, run: np.ndarray, at: np.ndarray, size: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        best: dict[int, tuple[float, int]] = {}
        for n in np.unique(size):
            k = min(int(n) - WIDTH + 1, len(run))  # shingles of a window; a shorter text is one window
            hits = at[size == n]
            wanted = np.zeros(len(run) - k + 2, np.int64)
            np.add.at(wanted, np.clip(hits - k + 1, 0, len(run) - k), 1)
            np.add.at(wanted, np.minimum(hits, len(run) - k) + 1, -1)
            opens = np.flatnonzero(wanted[:-1].cumsum() > 0)
            for part in np.split(opens, np.flatnonzero((np.diff(opens) > 1) | (np.diff(opens // 4096) > 0)) + 1):
                lo, hi = int(part[0]), int(part[-1]) + k
                total = np.zeros((hi - lo + 1, 128), np.int32)
                np.cumsum(signs(run[lo:hi]), axis=0, out=total[1:])
                prints = fingerprints(total[part + k - lo] - total[part - lo])
                r, items = self.near(prints)
                same = self.sizes[items] == n
                for w, i in zip(part[r[same]], items[same]):
                    sim = weighted_jaccard(run[w:w + k], self.sets[i])
                    if sim >= least and (int(i) not in best or sim > best[int(i)][0]):
                        best[int(i)] = (sim, int(w))
        return [(i, w, s) for i, (s, w) in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, item id, first word, similarity): the best window of each item that a document holds.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes.  A
    document shorter than an item is one window.  Null texts, and items and
    documents under five words, match nothing.  Repeated rows of ``docs`` each
    give their rows, repeated items count once.  Without items or documents the
    result is empty.
    """
    spark = docs.sparkSession
    found = None
    known = items.select(F.col(item_id_col).alias("_item"), F.col(item_text_col).alias("_text")).filter("_text IS NOT NULL").distinct()
    passes = max(1, -(-known.count() // ITEMS_A_PASS))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    for k in range(passes):
        part = known.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(passes)) == k).orderBy("_item", "_text").collect()
        # Plain arrays: a broadcast is unpickled by name, and workers may not have this package.
        shared = spark.sparkContext.broadcast(vars(Items([r["_item"] for r in part], [r["_text"] for r in part])))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Items.__new__(Items)
            vars(own).update(shared.value)
            for b in batches:
                ids = b.column("_id")
                hits = list(own.search(b.column("_text"), least)) if own.ids else []
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([own.ids[h[1]] for h in hits], out_kind),
                    pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.float64())],
                    ["_id", "_item", "first_word", "similarity"])

        from pyspark.sql.pandas.types import to_arrow_type
        out_kind = to_arrow_type(items.schema[item_id_col].dataType)
        hits = rows.mapInArrow(search, f"_id {kind}, _item {item_kind}, first_word int, similarity double")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id_col), "first_word", "similarity")
