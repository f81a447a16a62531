"""Suffix dedup: distributed prefix doubling over sampled suffixes.

The rank of a position is a fingerprint of its next 8, 16, 32, 64, 100 bytes;
each is made from the pair of ranks at the position and at a growing offset, so
equal ranks mean equal prefixes.  Sorting every position at every round would
move many times the corpus, so the first round sorts samples: of each 100-byte
window, the position with the least 32-byte rank stands for it (its anchor; a
rule of the window's bytes alone, so equal windows have equal anchors).

* Round 1 sorts anchors by rank and by the rank of their context (all bytes of
  the windows they stand for).  Anchors with a unique rank drop out: nothing
  they stand for occurs twice.  Of equal contexts all but the first are repeats.
* Round 2 takes the first of each context whose anchor rank has other contexts,
  and sorts its windows by their 100-byte rank: all but the first are repeats.

Ranks are 128 and 96 bits (64 + 64; 64 + 32) of nested fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placescore.llm.common import loads, row_key, stored, text_slices

LENGTH, GRAM = 100, 32
_HI = np.uint64(~((1 << 24) - 1) & ((1 << 64) - 1))
_LO = np.uint64((1 << 24) - 1)
_MOST = np.uint64((1 << 64) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_H, _S = np.uint64(32), np.uint64(29)
#: Bytes of text that are ranked at a time (arrays of 8 bytes a position stay in cache).
RANKED = 1 << 18
#: A candidate row's n is below SHARED; SHARED is added if its anchor rank is known to have other contexts.
SHARED = 1000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    x = (a * _A) ^ b
    x ^= x >> _H
    x *= _B
    x ^= x >> _S
    x *= _C
    x ^= x >> _H
    return x


def ranks(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the next 32, 64 and 100 bytes of every position of ``part`` that has them."""
    r = loads(part).astype(np.uint64)
    for offset in (8, 16):
        r = _pair(r[:-offset], r[offset:])
    r32 = r
    r64 = _pair(r32[:-32], r32[32:])
    return r32, r64, _pair(r64[:-36], r64[36:])


def second_rank(r32: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 more bits for 100-byte windows."""
    x = (r32[at] * _C) ^ (r32[at + 32] * _A) ^ (r32[at + 64] * _B) ^ r32[at + 68]
    x ^= x >> _S
    x *= _A
    return (x >> _H).astype(np.uint32).view(np.int32)


def anchors(part: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: its rank, its context's rank, its first window and the number of windows.

    ``part``: whole texts up to under 16 MB with at least 100 bytes after them; ``ends``: their ends.
    """
    n = int(ends[-1])
    r32, _, r100 = ranks(part)
    pos = np.arange(n, dtype=np.uint64)
    v = (r32[:n] & _HI) | pos
    begins = np.concatenate([[0], ends[:-1]])
    for b, e in zip(begins, ends):
        v[max(b, e - GRAM + 1):e] = _MOST
    least = np.concatenate([v, np.full(LENGTH, _MOST)])
    for offset in (1, 2, 4, 8, 16, 32, 5):  # over 2, 4, ..., 64, 69 positions
        least = np.minimum(least[:-offset], least[offset:])
    whole = np.zeros(n + 1, np.int64)
    for b, e in zip(begins, ends):
        if e - b >= LENGTH:
            whole[b] += 1
            whole[e - LENGTH + 1] -= 1
    windows = np.flatnonzero(whole.cumsum()[:n] > 0)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = (least[windows] & _LO).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    k = np.flatnonzero(new)
    lo, hi, p = windows[k], windows[np.append(k[1:], len(at)) - 1], at[k]
    place = ((p - lo) * 128 + (hi - lo)).astype(np.uint64)
    context = _pair(_pair(r100[lo], r100[hi]), place)
    return r32[p], context, lo, hi - lo + 1


def _pieces(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes with 100 zeros after them, ends, start in the text) of runs of texts, or of overlapping parts of a long one."""
    for row, part, offs in text_slices(col):
        k = 0
        while k < len(offs) - 1:
            end = max(k + 1, int(np.searchsorted(offs, offs[k] + RANKED, "right")) - 1)
            size = int(offs[end] - offs[k])
            if end == k + 1 and size > 4 * RANKED:
                for lo in range(0, size - LENGTH + 1, RANKED):  # windows that start in [lo, lo + RANKED)
                    hi = min(size, lo + RANKED + LENGTH - 1)
                    yield row + k, _padded(part[offs[k] + lo:offs[k] + hi]), np.array([hi - lo]), lo
            else:
                yield row + k, _padded(part[offs[k]:offs[end]]), offs[k + 1:end + 1] - offs[k], 0
            k = end


def _padded(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + LENGTH + GRAM + 8, np.uint8)
    out[:len(x)] = x
    return out


def _placed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers in one, so that a shuffled row has one changing field less."""
    return high << 32 | low


def _high(c: str) -> Column:
    return F.shiftright(c, 32).cast("int")


def _low(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent or overlapping runs of window starts, merged; sorted by document and start."""
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], (lo + n)[o]
    if not len(doc):
        return doc, lo, hi
    new = np.ones(len(doc), bool)
    # Starts are sorted, so the reach so far is a running maximum within a document.
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    group = first.cumsum()
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + group * span) - group * span
    new[1:] = first[1:] | (lo[1:] > reach[:-1])
    k = np.flatnonzero(new)
    return doc[k], lo[k], reach[np.append(k[1:], len(doc)) - 1] - lo[k]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1, on the map side: anchors of a batch, with the repeats that the batch itself shows already decided."""
    for b in batches:
        ids = b.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
        got = []
        for row, part, ends, start in _pieces(b.column("_text")):
            rank, context, lo, n = anchors(part, ends)
            at = np.searchsorted(ends, lo, "right")
            begin = np.concatenate([[0], ends[:-1]])[at]
            got.append((rank.view(np.int64), context.view(np.int64), ids[row + at], lo - begin + start, n))
        if not got:
            continue
        rank, context, doc, lo, n = (np.concatenate(x) for x in zip(*got))
        o = np.lexsort((lo, doc, context, rank))
        rank, context, doc, lo, n = rank[o], context[o], doc[o], lo[o], n[o]
        first = np.ones(len(rank), bool)
        first[1:] = (rank[1:] != rank[:-1]) | (context[1:] != context[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
        again = ~first & ((doc != doc[head]) | (lo != lo[head]))
        md, ml, mn = _spans(doc[again], lo[again], n[again])
        rank, context, doc, lo, n = rank[first], context[first], doc[first], lo[first], n[first]
        near = np.zeros(len(rank), bool)
        same = rank[1:] == rank[:-1]
        near[1:] |= same
        near[:-1] |= same
        # Anchors with several contexts in this batch are dealt by context, so that a frequent
        # passage does not meet in one task; one row of each tells the others of its rank.
        tell = np.flatnonzero(near & np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, int)
        told = rank[tell]
        # In the order of the texts, so that ids and places compress in the shuffle.
        o = np.lexsort((lo, doc))
        rank, context, doc, lo, n, near, told_doc = rank[o], context[o], doc[o], lo[o], n[o], near[o], doc[tell]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
            np.concatenate([np.where(near, context, rank), told, md]),
            np.concatenate([context, np.zeros(len(tell) + len(md), np.int64)]),
            _placed(np.concatenate([n + SHARED * near, np.full(len(tell), SHARED), -mn]), np.concatenate([lo, np.zeros(len(tell), np.int64), ml])),
            np.concatenate([doc, told_doc, md]))], ["route", "context", "place", "doc"])


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2, on the map side: 100-byte ranks of the windows in question; n is 1, or -1 for repeats within the batch."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        ids = b.column("doc").to_numpy(zero_copy_only=False)
        got = []
        lists = b.column("runs")
        for k in range(len(b)):
            text = unpack.decompress(b.column("text")[k].as_py())
            runs = lists[k].values
            lo, n = np.asarray(runs.field("lo")).astype(np.int64), np.asarray(runs.field("n")).astype(np.int64)
            inside = lo + n + LENGTH - 1 <= len(text)
            lo, n = lo[inside], n[inside]
            for base in range(0, max(1, len(text) - LENGTH + 1), 4 * RANKED):
                mine = (lo < base + 4 * RANKED) & (lo + n > base)
                if not mine.any():
                    continue
                raw = np.frombuffer(text, np.uint8, count=min(len(text), base + 4 * RANKED + LENGTH - 1) - base, offset=base)
                r32, _, r100 = ranks(_padded(raw))
                a, e = np.maximum(lo[mine] - base, 0), np.minimum(lo[mine] + n[mine] - base, 4 * RANKED)
                at = np.unique(np.repeat(a - np.cumsum(np.append(0, (e - a)[:-1])), e - a) + np.arange((e - a).sum()))
                got.append((r100[at].view(np.int64), second_rank(r32, at), np.full(len(at), ids[k]), at + base))
        if not got:
            continue
        rank, more, doc, lo = (np.concatenate(x) for x in zip(*got))
        o = np.lexsort((lo, doc, more, rank))
        rank, more, doc, lo = rank[o], more[o], doc[o], lo[o]
        first = np.ones(len(rank), bool)
        first[1:] = (rank[1:] != rank[:-1]) | (more[1:] != more[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
        again = ~first & ((doc != doc[head]) | (lo != lo[head]))
        md, ml, mn = _spans(doc[again], lo[again], np.ones(again.sum(), np.int64))
        # In the order of the texts, so that ids and places compress in the shuffle.
        o = np.flatnonzero(first)[np.lexsort((lo[first], doc[first]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
            np.concatenate([rank[o], md]), _placed(np.concatenate([more[o], np.zeros(len(md), np.int32)]).astype(np.int64), np.concatenate([lo[o], ml])),
            np.concatenate([doc[o], md]), np.concatenate([np.ones(len(o), np.int64), -mn]).astype(np.int32))], ["rank", "place", "doc", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they are about to be shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = b.column("_text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), b.column("_name"), pa.array([pack.compress(t.as_buffer()) for t in texts], pa.binary())], ["doc", "name", "text"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes that the repeated windows cover."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        lists = b.column("runs")
        for k in range(len(b)):
            text = unpack.decompress(b.column("text")[k].as_py())
            spans: list[tuple[int, int]] = []
            if lists[k].is_valid and text:
                runs = lists[k].values
                lo, n = np.asarray(runs.field("lo")).astype(np.int64), np.asarray(runs.field("n")).astype(np.int64)
                inside = lo + n + LENGTH - 1 <= len(text)
                zero = np.zeros(inside.sum(), np.int64)
                _, lo, n = _spans(zero, lo[inside], n[inside] + LENGTH - 1)
                spans = list(zip(lo.tolist(), (lo + n).tolist()))
            edges = [0, *[x for s in spans for x in s], len(text)]
            out[0].append(len(text))
            out[1].append(sum(e - s for s, e in spans))
            out[2].append([{"start": s, "end": e} for s, e in spans])
            out[3].append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([
            b.column("name"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
            pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out[3], pa.binary())],
            ["name", "n_bytes", "n_removed", "spans", "kept"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _name, _text): ``_name`` is the id, ``_id`` a number of the document in the order of the documents.

    Ids that no two rows share are such numbers.  Where one repeats, the distinct
    (id, text) are sorted over range partitions, whose numbers with the places in
    them are the documents' numbers; equal rows get the same.
    """
    name, text = F.col(id_col).cast("long").alias("_name"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    least = F.lit(-(2 ** 63)).cast("long")
    number = F.coalesce(F.col(id_col).cast("long"), least)
    if docs.groupBy(number.alias("_id")).count().filter("count > 1").isEmpty():
        return docs.select(number.alias("_id"), name, text)
    keyed = docs.select(name, text).withColumn("_key", row_key("_name", "_text"))
    kinds = keyed.groupBy("_key").agg(F.first("_name").alias("_name"))
    order = [F.col("_name").asc_nulls_first(), F.col("_key")]
    sort = kinds.repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = stored(sort.select("_key", F.monotonically_increasing_id().alias("_id")))
    return stored(keyed.join(numbers, "_key").select("_id", "_name", "_text"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (removed bytes, maximal), kept (the other bytes).

    A byte goes if a 100-byte string over it also starts earlier: in a smaller
    id, or earlier in the same text; matches end with their text.  Texts are
    UTF-8 bytes, a null text is empty.  Ids are whole numbers; a null id is the
    smallest.  Rows that share an id but not the text (null is as empty here) are documents
    that follow each other by a digest of id and text; rows equal in both are one
    document, which does not repeat itself, and lose the same bytes.  Other
    columns are not read; an empty table gives no rows.
    """
    rows = _numbered(docs, id_col, text_col)
    packed = rows.mapInArrow(_packed, "doc long, name long, text binary")
    sampled = rows.mapInArrow(_sampled, "route long, context long, place long, doc long").repartition("route")
    sampled = sampled.select("route", "context", "doc", _low("place").alias("lo"), _high("place").alias("n"))
    group = W.partitionBy("route")
    ordered = sampled.select(
        "doc", "lo", "n", F.rank().over(W.partitionBy("route", "context").orderBy("doc", "lo")).alias("_rank"),
        (F.min("context").over(group) != F.max("context").over(group)).alias("_two"), F.max("n").over(group).alias("_most"))
    again = (F.col("n") < 0) | (F.col("_rank") > 1)
    left = F.col("_two") | (F.col("_most") >= SHARED)
    decided = stored(ordered.filter((F.col("n") != SHARED) & (again | left)).select(
        "doc", "lo", (F.abs("n") - F.when(F.col("n") >= SHARED, SHARED).otherwise(0)).alias("n"), again.alias("again")))
    # The runs of a document are at most as many as its windows.
    runs = F.collect_list(F.struct("lo", "n")).alias("runs")
    open_ = decided.filter(~F.col("again")).groupBy("doc").agg(runs)
    ranked = packed.select("doc", "text").join(open_, "doc").mapInArrow(_windowed, "rank long, place long, doc long, n int").repartition("rank")
    ranked = ranked.select("rank", _high("place").alias("more"), "doc", _low("place").alias("lo"), "n")
    later = ranked.select("doc", "lo", "n", F.rank().over(W.partitionBy("rank", "more").orderBy("doc", "lo")).alias("_rank"))
    later = later.filter((F.col("n") < 0) | (F.col("_rank") > 1)).select("doc", "lo", F.abs("n").alias("n"))
    repeats = decided.filter("again").select("doc", "lo", "n").unionByName(later).groupBy("doc").agg(runs)
    out = packed.join(repeats, "doc", "left").mapInArrow(
        _removed, "name long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(F.col("name").alias(id_col), "n_bytes", "n_removed", "spans", "kept")
