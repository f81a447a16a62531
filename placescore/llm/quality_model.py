"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts (numpy over Arrow batches).  The trees are
fitted on a bounded, hash-chosen set of labelled rows, with features binned at
quantiles, and flattened into arrays of one heap-ordered row per tree, so that
scoring walks all trees and all rows of a batch level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import text_slices, word_hashes, word_spans

#: Labelled rows that the fit takes at most, chosen by a hash of their id.
MAX_ROWS = 20_000

FEATURES = [
    "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "commas", "shouts", "other_marks", "pipes", "non_ascii",
    "newlines", "distinct_words", "same_as_last", "top_word", "long_words", "repeated_threes", "dup_lines", "end_marks",
]

_CLASS = np.zeros((256,), np.int64)
for _k, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+_\\", b".", b",;:", b"!?", b"\"'()[]{}/-`", b"|", bytes(range(128, 256)), b"\n"]):
    _CLASS[list(_set)] = _k + 1
_NL = 10


def _line_repeats(part: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of each text's non-empty lines that equal an earlier one."""
    out = np.zeros(len(offs) - 1)
    raw = part.tobytes()
    for k in range(len(out)):
        lines = [x for x in raw[offs[k]:offs[k + 1]].split(b"\n") if x]
        if len(lines) > 1:
            out[k] = 1 - len(set(lines)) / len(lines)
    return out


def statistics(col: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; null and empty texts have zeros."""
    blocks = [np.zeros((0, len(FEATURES)))]
    for _, part, offs in text_slices(col):
        n_docs, size = len(offs) - 1, np.diff(offs)
        n = int(offs[-1])
        owner = np.repeat(np.arange(n_docs), size)
        chars = np.maximum(size, 1)
        kinds = np.bincount(owner * 12 + _CLASS[part[:n]], minlength=n_docs * 12)[:n_docs * 12].reshape(n_docs, 12)
        starts, ends, first = word_spans(part, offs)
        n_words = np.diff(first)
        w = np.maximum(n_words, 1)
        h = word_hashes(part, starts, ends, lower=False)
        word_owner = np.repeat(np.arange(n_docs), n_words)
        length = ends - starts
        order = np.lexsort((h, word_owner))
        so, sh = word_owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (so[1:] != so[:-1]) | (sh[1:] != sh[:-1])
        distinct = np.bincount(so[new], minlength=n_docs)
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        top = np.zeros(n_docs)
        np.maximum.at(top, so[new], runs)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (word_owner[1:] == word_owner[:-1])
        threes = np.zeros(n_docs)
        if len(h) > 2:
            inside = word_owner[2:] == word_owner[:-2]
            t = (h[:-2] * np.uint64(3) ^ h[1:-1]) * np.uint64(5) ^ h[2:]
            t, to = t[inside], word_owner[2:][inside]
            o = np.lexsort((t, to))
            t, to = t[o], to[o]
            again = (t[1:] == t[:-1]) & (to[1:] == to[:-1])
            threes = np.bincount(to[1:][again], minlength=n_docs)
        tail = np.array([part[e - 1] in b".!?" if e > s else False for s, e in zip(offs[:-1], offs[1:])], float)
        x = np.column_stack([
            np.log1p(n_words), np.bincount(word_owner, length, n_docs) / w,
            kinds[:, 1] / chars, kinds[:, 2] / chars, kinds[:, 3] / w, kinds[:, 4] / w, kinds[:, 5] / w, kinds[:, 6] / w,
            kinds[:, 7] / w, kinds[:, 8] / w, kinds[:, 9] / chars, kinds[:, 10] / w,
            distinct / w, np.bincount(word_owner[same], minlength=n_docs) / w, top / w,
            np.bincount(word_owner[length > 20], minlength=n_docs) / w, threes / w, _line_repeats(part, offs), tail])
        blocks.append(x)
    return np.vstack(blocks)


class Trees:
    """Boosted trees as arrays: ``feature[t, i]``, ``cut[t, i]`` (children of i: 2i+1, 2i+2) and ``leaf[t, j]``."""

    def __init__(self, depth: int, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.depth, self.base, self.feature, self.cut, self.leaf = depth, base, feature, cut, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        at = np.zeros((n, trees), np.int64)
        t = np.arange(trees)
        for _ in range(self.depth):
            go = np.take_along_axis(x, self.feature[t, at], axis=1) > self.cut[t, at]
            at = 2 * at + 1 + go
        return self.base + self.leaf[t, at - (2 ** self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
              l2: float = 2.0, least: float = 4.0) -> Trees:
    """Boost ``trees`` trees on the logistic loss; each level is one histogram per node, feature and bin.

    Deterministic.  With one class, or no rows, the model is its base score.
    """
    n, n_features = x.shape
    rate_1 = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    inner = 2 ** depth - 1
    feature, cuts, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Trees(depth, base, feature, cuts, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, start = 2 ** level, 2 ** level - 1
            best_gain = np.full(width, 1e-9)
            best = [(0, np.inf, bins + 1)] * width
            for f in range(n_features):
                cells = node * bins + binned[:, f]
                gs = np.bincount(cells, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cells, h, width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                k = len(edges[f])
                if k == 0:
                    continue
                gl, hl = gs[:, :k], hs[:, :k]
                gr, hr = ga - gl, ha - hl
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - ga ** 2 / (ha + l2)
                gain[(hl < least / 4) | (hr < least / 4)] = -1
                top = gain.argmax(axis=1)
                for i in range(width):
                    if gain[i, top[i]] > best_gain[i]:
                        best_gain[i], best[i] = gain[i, top[i]], (f, edges[f][top[i]], top[i])
            for i, (f, c, _) in enumerate(best):
                feature[t, start + i], cuts[t, start + i] = f, c
            fs = np.array([b[0] for b in best])
            bs = np.array([b[2] for b in best])
            node = 2 * node + (binned[np.arange(n), fs[node]] > bs[node])
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = rate * gs / (hs + l2)
        margin += leaf[t, node]
    return Trees(depth, base, feature, cuts, leaf)


def _sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids by hash; an id with several labels counts once, with the smallest."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(F.col(label_col)).cast("double").alias("_y"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_ROWS) -> Trees:
    """Fit on the texts of at most ``max_rows`` labelled rows (an explicit bound; statistics, not texts, reach the driver)."""
    chosen = _sample(labels, id_col, label_col, max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_rows rows

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(list(x), pa.list_(pa.float64()))], ["_id", "_y", "_x"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(measured, f"_id {kind}, _y double, _x array<double>").toPandas()
    got["_x"] = [tuple(v) for v in got["_x"]]
    got = got.drop_duplicates().sort_values(["_id", "_x"])
    x = np.array(got["_x"].tolist()).reshape(len(got), len(FEATURES))
    return fit_trees(x, (got["_y"].to_numpy() > 0).astype(float))


def keep_scored(docs: DataFrame, model: Trees, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``least`` (no join, no shuffle)."""
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(place))
            good = np.concatenate([model.score(x[k:k + 4096]) for k in range(0, len(x), 4096)]) >= least if len(x) else np.zeros(0, bool)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``; 0 to 1, higher: label 1 likelier.

    Null and empty texts get the score of all-zero statistics.  Ids (null or
    repeated too) are passed on as they are; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("_text"))
            s = np.concatenate([model.score(x[k:k + 4096]) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(s, pa.float64())], ["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(scored, f"_id {kind}, score double").select(F.col("_id").alias(id_col), "score")
