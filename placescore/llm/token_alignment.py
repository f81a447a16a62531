"""Alignment of two tokenizers over the same texts, and how often ids meet.

Tokenizer A is a byte-level BPE file of the library ``tokenizers``, B a
``sentencepiece`` model whose pieces begin with the space that it adds; both
encode space + text, special strings as plain text.  Byte offsets at which tokens
of both end cut the tokens into groups.

The end arrays are compared along a diagonal: while A's i-th and B's j-th token
end together the shift j - i stays, so runs of one-to-one groups are jumped by
exponential probing (1, 2, 4, ... equal ends, then halving down to the first
that differs).  There an irregular group is resolved by advancing whichever side
ends first, and the shift updated.

A text is parted at single spaces, where no token of either crosses, so that a
part's end is a group's end.  A part is encoded and aligned when a task first
meets it, with other new parts behind each other in one walk; a text's groups and
links are those of its parts in order, each fetched by the part's number.

A and B tokens whose bytes overlap are linked; the count of an id pair is the
number of its links in the whole table.  Each row keeps its distinct pairs; the
counts are added up by Spark.  To bring them back, the ``FREQUENT`` most frequent
pairs at most are broadcast, and rows shuffle only their rarer pairs, none of
which is hot.

Null and empty texts, and texts that the tokens of A or B do not spell exactly,
have no tokens: all numbers are 0 and ``groups`` is ''.  Null and repeated ids are
separate rows; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import stored
from placescore.llm.token_counts import read_file

#: Text characters (and rows) that are put together from their parts at a time.
SLICE_CHARS, SLICE_ROWS = 1 << 20, 2000
#: Ends that a run's first probe compares.
PROBE = 8
#: Pairs that are sent to all tasks at most (17 bytes each).
FREQUENT = 1 << 20
#: Parts of texts whose alignment a task remembers at a time, and the longest one remembered; parts that are aligned in one walk.
MEMO, MEMO_CHARS, BLOCK = 1 << 20, 64, 4096
#: Bytes of groups and pairs from which on the remembered parts are forgotten before others are met.
MEMO_BYTES = 1 << 26
#: A space between two of these characters (printable in all versions of Unicode) parts a text: no token of either
#: tokenizer has such a space but at its start.
SPACE = re.compile(" (?<=[!-~¡-¬®-ɏ] )(?=[!-~¡-¬®-ɏ])")


# --- alignment -------------------------------------------------------------------

def align_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, in order, one past its last A token and one past its last B token.

    ``ends_a`` and ``ends_b`` rise strictly and have the same last value.
    """
    n = len(ends_a)
    a, b = ends_a.tolist(), ends_b.tolist()
    runs: list[tuple[int, int, int]] = []  # first A token, first B token, groups; an irregular group is a run of one, from its last tokens
    add = runs.append
    i = j = 0
    while i < n:
        first_i, first_j, size = i, j, PROBE
        while (probe := a[i:i + size]) == b[j:j + size] and probe:
            i += len(probe)
            j += len(probe)
            size *= 2
        if i < n:
            while size > PROBE:
                size //= 2
                if a[i:i + size] == b[j:j + size]:
                    i += size
                    j += size
            while a[i] == b[j]:
                i += 1
                j += 1
        add((first_i, first_j, i - first_i))
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            add((i, j, 1))
            i += 1
            j += 1
    run = np.array(runs, np.int64).reshape(-1, 3)
    size = run[:, 2]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    return np.repeat(run[:, 0], size) + step, np.repeat(run[:, 1], size) + step


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B token of each link: between two neighbouring ends of either side lies one overlap."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    both = both[np.diff(both, prepend=0) > 0]
    return np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)


# --- tokenizers --------------------------------------------------------------------

#: A's pre-tokens of texts of ``_PLAIN`` characters and spaces between them, of which all versions of Unicode say the same.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+| ?[^ A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+").findall
_PLAIN = re.compile("[!-~¡-¬®-ɏ]+").fullmatch


def _byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(file)
        self.library = Tokenizer.from_str(file.decode())
        self.library.encode_special_tokens = True
        before = spec["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level tokenizer file")
        symbols = _byte_symbols()
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, k in ids.items():
            self.bytes[k] = token.encode() if token in special else bytes(symbols[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        names = {x: c for c, x in symbols.items()} | {0x0A: "\n"}  # line feeds part words
        self.symbols = "".join(names[x] for x in range(256))

    def encode(self, parts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many of them there are up to each part's end; ``plain`` parts are all of ``_PLAIN`` characters."""
        if plain:  # each begins a word with its space, so that they can stand behind each other
            words = charmap_decode("\n".join(_WORDS(" " + " ".join(parts))).encode(), "strict", self.symbols)[0].split("\n")
            merged = self.library.model.tokenize
            ids = np.array([t.id for w in words for t in merged(w)], np.int64)
            return ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) + 1 for p in parts]), "right")
        return _flat([x.ids for x in self.library.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)])


class Pieces:
    """Tokenizer B; it puts the space before the text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        # Texts may be parted at a space if no piece crosses it and spaces are kept as they are.
        self.parted = not any(re.search("[^▁]▁", x) for x in names) and self.model.normalize(" a  b ") == "▁▁a▁▁b▁"

    def encode(self, parts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode(parts, num_threads=1))


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(chain.from_iterable(found)), np.int64), np.cumsum(list(map(len, found)))


# --- parts -----------------------------------------------------------------------

class Pile:
    """An array that grows at its end."""

    def __init__(self, kind, *width: int):
        self.data, self.n = np.zeros((1 << 10, *width), kind), 0

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.data):
            data = np.zeros((max(n, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            data[:self.n] = self.data[:self.n]
            self.data = data
        self.data[self.n:n] = more
        self.n = n


def _joined(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of the given numbers behind each other, and their ends after a 0; string k ends at ``ends[k + 1]``."""
    got = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).take(pa.array(at))
    _, ends, data = got.buffers()
    ends = np.frombuffer(ends, np.int64)[:len(at) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8)[:ends[-1]], ends


def _strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


class Aligner:
    def __init__(self, file_a: bytes, file_b: bytes):
        self.a, self.b = ByteLevel(file_a), Pieces(file_b)
        # An id and what follows it: in a group, at the group's end of A, at that of B.
        n, m = len(self.a.bytes), len(self.b.bytes)
        self.shown = _strings([b"%d," % k for k in range(n)] + [b"%d|" % k for k in range(n)] + [b"%d," % k for k in range(m)] + [b"%d;" % k for k in range(m)])
        self.spelled = [_strings(t.bytes) for t in (self.a, self.b)]
        self.kind = np.dtype("<u8" if n * m > 1 << 32 else "<u4")
        self._forget()

    def _forget(self, keep: int = 0) -> None:
        """All parts but the first ``keep``."""
        if not keep:
            # Parts and their numbers; of each number: tokens of A and of B, groups, links and 1 if a side does not spell it; groups as shown; linked pairs.
            self.known: tuple[dict[str, int], Pile, list[Pile], list[Pile]] = ({}, Pile(np.int64, 5), [Pile(np.uint8), Pile(np.int64)], [Pile(np.uint8), Pile(np.int64)])
            for data, ends in self.known[2:]:
                ends.add([0])
            return
        number, fields, *strings = self.known
        for part in list(islice(reversed(number), len(number) - keep)):
            del number[part]
        fields.n = keep
        for data, ends in strings:
            ends.n, data.n = keep + 1, ends.data[keep]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both, read back from the groups, or None where there are none or they do not spell the text."""
        shown = [[g.split("|") for g in row[4].decode().split(";")] if row[4] else None for row in self.rows(texts)]
        return [g and tuple(np.array(",".join(x[s] for x in g).split(","), np.uint32) for s in (0, 1)) for g in shown]

    def _learn(self, parts: list[str], plain: bool) -> None:
        """Align the tokens of parts that are not known; in one walk, as a part's end is an end of both."""
        number, fields, *strings = self.known
        data = [b" " + p.encode() for p in parts]
        ends = np.cumsum(list(map(len, data)))
        good, found = np.ones(len(parts), bool), []
        for tokenizer, spelled in zip((self.a, self.b), self.spelled):
            ids, upto = tokenizer.encode(parts, plain)
            got, at = _joined(*spelled, ids)
            got, at = got.tobytes(), np.r_[0, at[upto]]
            if got != b"".join(data) or (at[1:] != ends).any():
                good &= [got[lo:hi] == x for lo, hi, x in zip(at[:-1], at[1:], data)]
            found.append((ids, np.diff(upto, prepend=0)))
        values, shown, pairs = np.zeros((len(parts), 5), np.int64), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        values[:, 4] = ~good
        texts, linked = np.zeros(0, np.uint8), np.zeros(0, self.kind)
        if good.any():
            (a, size_a), (b, size_b) = ((ids[np.repeat(good, size)], size[good]) for ids, size in found)
            row_a, row_b = np.cumsum(size_a), np.cumsum(size_b)
            ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
            group_a, group_b = align_ends(ends_a, ends_b)
            link_a, link_b = links(ends_a, ends_b)
            groups, n_links = np.searchsorted(group_a, row_a, "right"), np.searchsorted(link_a, row_a)
            values[good, :4] = np.column_stack([size_a, size_b, np.diff(groups, prepend=0), np.diff(n_links, prepend=0)])
            # A's token i stands behind all B tokens of the groups before, B's token j behind all A tokens up to its group.
            of_a, of_b = (np.repeat(np.arange(len(g)), np.diff(g, prepend=0)) for g in (group_a, group_b))
            last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            last_a[group_a - 1], last_b[group_b - 1] = True, True
            n, m = len(self.a.bytes), len(self.b.bytes)
            order = np.empty(len(a) + len(b), np.int64)
            order[np.arange(len(a)) + np.r_[0, group_b[:-1]][of_a]] = a + n * last_a
            order[np.arange(len(b)) + group_a[of_b]] = 2 * n + b + m * last_b
            texts, at = _joined(*self.shown, order)
            shown[good] = np.diff(at[row_a + row_b], prepend=0)
            linked = (a[link_a] * m + b[link_b]).astype(self.kind)
            pairs = values[:, 3] * self.kind.itemsize
        number.update(zip(parts, range(len(number), len(number) + len(parts))))
        fields.add(values)
        for (data, ends), more, size in zip(strings, (texts, linked.view(np.uint8)), (shown, pairs)):
            ends.add(data.n + np.cumsum(size))
            data.add(more)

    def _numbers(self, parts: list[str]) -> tuple[np.ndarray, int]:
        """Numbers of parts, which are known from now on, and how many of the known are to be remembered."""
        number = self.known[0]
        found = list(map(number.get, parts))
        if None not in found:
            return np.array(found, np.int64), len(number)
        new = list(dict.fromkeys(p for p, k in zip(parts, found) if k is None))
        if len(number) + len(new) > MEMO or sum(data.n for data, _ in self.known[2:]) > MEMO_BYTES:
            self._forget()
            number, new = self.known[0], list(dict.fromkeys(parts))
        kinds = [[], [], []]  # plain and others, then those that are too long to remember
        for p in new:
            kinds[2 if len(p) > MEMO_CHARS else not _PLAIN(p)].append(p)
        keep = len(number) + len(kinds[0]) + len(kinds[1])
        for k, some in enumerate(kinds):
            for at in range(0, len(some), BLOCK):
                self._learn(some[at:at + BLOCK], k == 0)
        return np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)), keep

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each text."""
        cut = [(SPACE.split(t) if self.b.parted else [t]) if t else [] for t in texts]
        part, keep = self._numbers(list(chain.from_iterable(cut)))
        upto = np.cumsum([0, *map(len, cut)])
        _, fields, *strings = self.known
        total = np.zeros((len(part) + 1, 5), np.int64)
        np.cumsum(fields.data[part], axis=0, out=total[1:])
        total = np.diff(total[upto], axis=0)
        (shown, shown_at), (pair, _) = (_joined(data.data, ends.data[:ends.n], part) for data, ends in strings)
        if keep < len(self.known[0]):
            self._forget(keep)
        # Distinct pairs of each row.
        pair, row = pair.view(self.kind), np.repeat(np.arange(len(texts), dtype=np.uint64), total[:, 3])
        if self.kind.itemsize == 4:
            both = np.sort(row << np.uint64(32) | pair)
            pair, row = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        else:
            by = np.lexsort((pair, row))
            pair, row = pair[by], row[by]
        start = np.flatnonzero(np.r_[len(pair) > 0, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])
        times, pair = np.diff(start, append=len(pair)).astype("<u4"), pair[start].astype(self.kind)
        bounds = np.searchsorted(row[start], np.arange(len(texts) + 1, dtype=np.uint64))
        at, shown = shown_at[upto].tolist(), shown.tobytes()
        out: list[tuple] = [(0, 0, 0, 0, b"", b"", b"")] * len(texts)
        for k, (*n, bad) in enumerate(total.tolist()):
            if n[0] and not bad:
                lo, hi = bounds[k], bounds[k + 1]
                out[k] = (*n, shown[at[k]:at[k + 1] - 1], pair[lo:hi].tobytes(), times[lo:hi].tobytes())
        return out


# --- operators ---------------------------------------------------------------------

def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    first, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= SLICE_CHARS or len(part) >= SLICE_ROWS:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, _pairs, _times) of each row.

    ``groups`` has the ids of each group in order, ``a1,a2|b1;a3|b2,b3``;
    ``_pairs`` the row's distinct linked pairs (``a * size of B + b``) as
    little-endian integers, and ``_times`` how often each occurs.
    """
    sent = docs.sparkSession.sparkContext.broadcast((read_file(path_a), read_file(path_b)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "_pairs", "_times"]
    types = [pa.int64()] * 4 + [pa.binary()] * 3

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for b in batches:
            aligner = aligner or Aligner(*sent.value)
            for first, texts in _slices(b.column("_text")):
                columns = [pa.array(c, t) for c, t in zip(zip(*aligner.rows(texts)), types)]
                columns[4] = columns[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(first, len(texts)), *columns], names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(aligned, f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, _pairs binary, _times binary")
    return out.withColumnRenamed("_id", id_col)


def _unpacked(b: pa.RecordBatch, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, pair, times) of all rows' pairs."""
    pairs = [np.frombuffer(v.as_buffer(), "<u8" if wide else "<u4") for v in b.column("_pairs")]
    times = [np.frombuffer(v.as_buffer(), "<u4") for v in b.column("_times")]
    row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    return row, np.concatenate([*pairs, np.zeros(0, np.uint32)]).astype(np.int64), np.concatenate([*times, np.zeros(0, np.uint32)]).astype(np.int64)


def pair_counts(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair in all rows; best: no A id is linked with the pair's B id more often."""
    wide = size_a * size_b > 1 << 32

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 20

        def merged(pairs, n):
            kinds, of = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(kinds), np.int64)
            np.add.at(total, of, n)
            return kinds, total

        for b in batches:
            _, more, times = _unpacked(b, wide)
            pairs, n = np.concatenate([pairs, more]), np.concatenate([n, times])
            if len(pairs) >= least:
                pairs, n = merged(pairs, n)
                if len(pairs) >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                    pairs, n = pairs[:0], n[:0]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(pairs, n)], ["pair", "n"])

    counts = aligned.select("_pairs", "_times").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("_b", F.col("pair") % F.lit(size_b)))
    most = counts.groupBy("_b").agg(F.max("n").alias("_most"))  # a row per id of B
    return counts.join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in order, n, best) of all pairs above a count, as low a one (by eighths of powers of two) as gives at most ``most``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)  # at most 512 rows
    least, total = None, 0
    for s, size in sizes:
        total += size
        if total > most:
            break
        least = s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    got = counts.filter(step >= least).orderBy("pair").toArrow()
    return tuple(got.column(c).to_numpy() for c in ("pair", "n", "best"))


def count_links(aligned: DataFrame, size_a: int, size_b: int, most: int = FREQUENT) -> DataFrame:
    """``aligned`` without its pairs, with n_best (links whose pair is best) and count_sum (their pairs' counts added up)."""
    wide = size_a * size_b > 1 << 32
    rest = [c for c in aligned.columns if c not in ("_pairs", "_times")]
    key = "_row" + "_" * max(len(c) for c in rest)
    rows = stored(aligned.withColumn(key, F.monotonically_increasing_id()))  # fixed once written
    counts = stored(pair_counts(rows, size_a, size_b))
    sent = rows.sparkSession.sparkContext.broadcast(_frequent(counts, most))

    def found(b: pa.RecordBatch):
        pairs, n, best = sent.value
        row, pair, times = _unpacked(b, wide)
        if not len(pairs):
            return row, pair, times, np.zeros(len(pair), bool), np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        return row, pair, times, pairs[at] == pair, n[at], best[at]

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, times, hit, n, best = found(b)
            sums = []
            for value in (times * best, times * n):
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, row[hit], value[hit])
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [key, *rest]] + sums, [key, *rest, "_best", "_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pair, times, hit, *_ = found(b)
            keys = b.column(key).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[row[~hit]]), pa.array(pair[~hit]), pa.array(times[~hit])], [key, "pair", "times"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [key, *rest])
    whole = rows.select(key, *rest, "_pairs", "_times").mapInArrow(frequent, schema + ", _best long, _sum long")
    few = rows.select(key, "_pairs", "_times").mapInArrow(rare, f"`{key}` long, pair long, times long").join(counts, "pair")
    few = few.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best2"), F.sum(F.col("times") * F.col("n")).alias("_sum2"))
    add = lambda x: F.col(x) + F.coalesce(F.col(x + "2"), F.lit(0))
    return whole.join(few, key, "left").select(*rest, add("_best").alias("n_best"), add("_sum").alias("count_sum"))


def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    return len(ByteLevel(read_file(path_a)).bytes), len(Pieces(read_file(path_b)).bytes)
