"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of ASCII letters and of characters from U+0080 on, only A-Z
lower-cased.  A language keeps the terms that occur in at least ``LEAST_DOCS`` of
its rows (V of them).  For a group (lang, source), and for a whole language, a
kept term that occurs ``count`` times there has
``p = 1 + floor(10^9 * (count + 1) / (N + V))``, N the sum of the counts; the
divergence of p from another value q is ``floor((p - q)^2 / q)``.  All of it is
integer arithmetic.

* *Terms of a group* (p above the language's q): the 200 largest divergences come
  from a dominance skyband.  Divergence never falls when the group's count rises
  or the language's count falls, and equal divergences rank by UTF-8; so a term
  that k others dominate in (group count, language count, UTF-8) cannot be among
  the first k.  Each partition keeps its terms with fewer than k dominators
  (:func:`skyband`), skybands are merged in salted parts of a group, and what is
  left is ranked exactly.
* *Pairs of sources*: the sum over all V terms.  Terms that neither or only one of
  the two sources holds differ by values that depend on the count alone, so they
  are added from histograms of counts; only terms that both hold are visited, in
  blocks of terms as numpy matrices, added up before they are shuffled.

Rows count as documents (ids are not read, so they may be null or repeat).  Null
text, lang and source are ''.  Empty texts have no terms, but their group is in
the result.  A language without kept terms has pairs of value 0.  Equal values
rank by item.  Further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm.common import stored

#: A kept term occurs in so many rows of its language.
LEAST_DOCS = 3
#: Ranks of terms that are reported.
TOP = 200
#: Entries that a task counts before it hands them on, and cells of a block of terms.
ENTRIES, CELLS = 200_000, 1 << 21
#: Parts of a group whose skybands are merged apart.
MERGE_PARTS = 16

_SEPARATORS = bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))
_UNIT = 10 ** 9


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.encode().translate(_TABLE).split()


# --- exact arithmetic in Spark ---------------------------------------------------

def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 * (count + 1) / total)``, three decimal digits of the quotient at a time, so that
    longs hold every step below 9 * 10^15 occurrences."""
    total = F.greatest(total, F.lit(1))
    rest, out = count + F.lit(1), F.lit(1).cast("long")
    for unit in (10 ** 6, 10 ** 3, 1):
        out = out + _div(rest * F.lit(1000), total) * F.lit(unit)
        rest = F.pmod(rest * F.lit(1000), total)
    return out


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


# --- counting ------------------------------------------------------------------------

def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) added up within tasks; a term of a group has a row per task, or a few."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                terms = list(n)
                for k in range(0, len(terms), 50_000):
                    part = terms[k:k + 50_000]
                    yield _batch("lang source term n docs", pa.array([lang] * len(part)), pa.array([source] * len(part)),
                                 pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()),
                                 pa.array([docs[t] for t in part], pa.int64()))
            found.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang"), b.column("source"), b.column("text")):
                terms = terms_of(text.as_py())
                n, docs = found[lang.as_py(), source.as_py()]
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held > ENTRIES:
                    yield from rows()
                    held = 0
        yield from rows()

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return texts.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, lang_n, parts): a row per kept term; ``parts`` has (source, n) of the sources that hold it.

    A term's array is no longer than its language has sources, of which the
    result has the square in rows.
    """
    found = occurrences(docs, text_col, lang_col, source_col).repartition("lang", "term")
    groups = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("parts"))
    return terms.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "lang_n", "parts")


# --- terms of a group: dominance skyband ---------------------------------------------

def skyband(up: np.ndarray, down: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the points that fewer than ``k`` others dominate (``up`` no lower, ``down`` no higher, ``order`` lower; orders differ).

    Points are visited by falling ``up``, then rising ``down`` and ``order``, so that
    dominators come first; it is enough to count those that were kept themselves.
    Blocks are compared with the kept points at once, after thresholds on ``order``
    at some values of ``down`` have passed over points with k dominators for sure.
    """
    visit = np.lexsort((order, down, -up))
    down, order = down[visit], order[visit]
    kept = np.zeros(0, np.int64)
    marks, limits, built = None, None, 0
    at, width = 0, 512
    while at < len(visit):
        block = np.arange(at, min(at + width, len(visit)))
        at += width
        if marks is not None:
            j = np.searchsorted(marks, down[block], "right") - 1
            block = block[(j < 0) | (order[block] < limits[j])]
            if not len(block):
                continue
        counts = np.zeros(len(block), np.int64)
        for part in range(0, len(kept), 4096):
            near = kept[part:part + 4096]
            counts += ((down[near] <= down[block][:, None]) & (order[near] < order[block][:, None])).sum(axis=1)
        own = (down[block] <= down[block][:, None]) & (order[block] < order[block][:, None])
        counts += np.tril(own, -1).sum(axis=1)
        kept = np.concatenate([kept, block[counts < k]])
        if len(kept) >= 1.2 * built + k:
            built = len(kept)
            marks = np.unique(np.quantile(down[kept], np.linspace(0.02, 1, 64), method="higher"))
            inside = [np.sort(order[kept[down[kept] <= m]])[k - 1:k] for m in marks]
            full = np.array([len(x) > 0 for x in inside])
            marks, limits = marks[full], np.array([x[0] for x in inside if len(x)], np.int64)
            marks, limits = (marks, limits) if len(marks) else (None, None)
    return visit[kept]


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition the rows that are in the skyband of their group there."""
    names = ["lang", "source", "term", "n", "lang_n"]

    def reduced(table: pa.Table) -> pa.Table:
        codes = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "source")]
        group = codes[0].astype(np.int64) * (int(codes[1].max()) + 1) + codes[1]
        place = np.empty(len(group), np.int64)
        place[table.column("term").combine_chunks().cast(pa.binary()).to_numpy(zero_copy_only=False).argsort(kind="stable")] = np.arange(len(group))
        n, lang_n = table.column("n").to_numpy(), table.column("lang_n").to_numpy()
        by = np.argsort(group, kind="stable")
        ends = np.flatnonzero(np.diff(group[by], append=-1)) + 1
        keep = [by[a:b][skyband(n[by[a:b]], lang_n[by[a:b]], place[by[a:b]], k)] for a, b in zip(np.r_[0, ends[:-1]], ends)]
        return table.take(pa.array(np.concatenate(keep)))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least = [], 0, ENTRIES
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > least:
                held = reduced(pa.Table.from_batches(held)).to_batches()
                size = sum(x.num_rows for x in held)
                least = max(ENTRIES, 2 * size)
        if size:
            yield from reduced(pa.Table.from_batches(held)).to_batches()

    return rows.select(*names).mapInArrow(banded, "lang string, source string, term string, n long, lang_n long")


def top_terms(parts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of each group's ``top`` terms; ``parts`` has lang, source, term, n, lang_n."""
    local = _skybands(parts, top)
    salted = local.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE_PARTS)))
    band = _skybands(salted, top).join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    rows = band.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(best).cast("int"))


# --- pairs of sources ----------------------------------------------------------------

def shared_terms_sums(p: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Over the terms (rows of ``p``, 0: not held) that both sources hold, what their divergence adds to that of a term held by neither,
    less what either count alone adds; ``none`` has p of a source without the term."""
    size = p.shape[1]
    out = np.zeros((size, size), np.int64)
    f = lambda a, b: (a - b) * (a - b) // b
    for g in range(size):
        rows = p[:, g] > 0
        own, others = p[rows, g][:, None], p[rows]
        both = others > 0
        others = np.where(both, others, 1)
        step = f(own, others) - f(own, none[None, :]) - f(none[g], others) + f(none[g], none)[None, :]
        out[g] = np.where(both, step, 0).sum(axis=0)
    return out


def _shared_sums(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) from rows (lang, parts: array of source, p, none), added up within tasks."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = defaultdict(int)

        def rows() -> pa.RecordBatch:
            keys = list(sums)
            out = _batch("lang source item value", *[pa.array([x[i] for x in keys], pa.string()) for i in range(3)], pa.array([sums[x] for x in keys], pa.int64()))
            sums.clear()
            return out

        for b in batches:
            lang = b.column("lang").dictionary_encode()
            parts = b.column("parts")
            sizes = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten()
            source = flat.field("source").dictionary_encode()
            p, none = flat.field("p").to_numpy(), flat.field("none").to_numpy()
            term = np.repeat(np.arange(len(sizes)), sizes)
            code, of = source.indices.to_numpy(), np.repeat(lang.indices.to_numpy(), sizes)
            for one in range(len(lang.dictionary)):
                at = np.flatnonzero(of == one)
                if not len(at):
                    continue
                cols, col = np.unique(code[at], return_inverse=True)
                names = [source.dictionary[int(c)].as_py() for c in cols]
                base = np.ones(len(cols), np.int64)
                base[col] = none[at]
                terms_here, row = np.unique(term[at], return_inverse=True)
                step = max(1, CELLS // len(cols))
                for k in range(0, len(terms_here), step):
                    inside = (row >= k) & (row < k + step)
                    block = np.zeros((min(step, len(terms_here) - k), len(cols)), np.int64)
                    block[row[inside] - k, col[inside]] = p[at[inside]]
                    found = shared_terms_sums(block, base)
                    for g, name in enumerate(names):
                        for h, item in enumerate(names):
                            if g != h:
                                sums[lang.dictionary[one].as_py(), name, item] += int(found[g, h])
            if len(sums) > ENTRIES:
                yield rows()
        if sums:
            yield rows()

    return terms.mapInArrow(summed, "lang string, source string, item string, value long")


def source_pairs(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of all ordered pairs of sources of a language."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"), F.col("held").alias("other_held"))
    value = lambda p, q: divergence(F.col(p), F.col(q))
    neither = groups.join(others, "lang").filter("source <> item").select(
        "lang", "source", "item", ((F.col("v") - F.col("held") - F.col("other_held")) * value("none", "other_none")).alias("value"))
    same = parts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    same = same.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))
    same = same.join(others, "lang").filter("source <> item")
    either = same.select("lang", F.explode(F.array(
        F.struct("source", "item", (F.col("m") * value("p", "other_none")).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * value("other_none", "p")).alias("value")))).alias("x")).select("lang", "x.*")
    shared = parts.filter("n_sources > 1").join(groups, ["lang", "source"]).select(
        "lang", "term", "source", share(F.col("n"), F.col("total")).alias("p"), "none")
    shared = shared.repartition("lang", "term").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("parts"))
    both = _shared_sums(shared.select("lang", "parts"))
    all_of = neither.unionByName(either).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(all_of)


# --- the audit -----------------------------------------------------------------------

def audit(docs: DataFrame, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` (item: another source) and part ``term`` (item: a term)."""
    kept = stored(kept_terms(docs, text_col, lang_col, source_col))
    parts = kept.select("lang", "term", "lang_n", F.size("parts").alias("n_sources"), F.explode("parts").alias("_p")).select(
        "lang", "term", "lang_n", "n_sources", "_p.source", "_p.n")
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    own = parts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (zero("n") + zero("v")).alias("total"), (zero("lang_n") + zero("v")).alias("lang_total"), zero("v").alias("v"), zero("held").alias("held"))
    groups = stored(groups.withColumn("none", share(F.lit(0).cast("long"), F.col("total"))))
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
           for part, df in (("pair", source_pairs(parts, groups)), ("term", top_terms(parts, groups, top)))]
    return out[0].unionByName(out[1])
