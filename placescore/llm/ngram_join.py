"""N-gram Jaccard join: an exact similarity self-join on sets of word shingles.

Sets are put in one global order: frequent shingles last, else by hash.  What is
frequent is counted over the first shingles of all texts and then over all
shingles of the texts that have mostly frequent ones there (members of large
groups of copies), so that the shingles of a group's edits come first.  Two sets
that link share a shingle within their first ``n - ceil(t * n) + 1`` (prefix
filter), so the first level of the prefix tree deals those prefixes out by shingle.  Sets that are equal are one set from the start, numbered by one of
their rows; sets whose rows share an id are only linked at the end.

* In each node the set that holds the shingle earliest leads.  Every other set
  of the node is held against its leader (one pair a set, not all pairs).
* A pair is only worth verifying if, at some shared shingle, what is left of
  both sets from there on could still reach the threshold.
* What links is joined to components.  Within a node only sets of different
  components are then held against each other, whole components at a time first.

A pair is verified by walking a trie: the sets held against one leader, sorted,
share the overlap counted on their common beginning, and a branch ends as soon
as overlap and remaining length can't reach the threshold.  So no link between
different texts is lost: each is verified, or its ends are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.llm.common import cut, mix, row_key, shingles, stored, text_slices, word_hashes, word_spans

#: Shingles within this many prefixes count as frequent ...
FREQUENT = 16
#: ... but the list of them, which all executors get, holds the most frequent ones up to this many.
MAX_FREQUENT = 1 << 20
NULL_ID = -(2 ** 63)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def sets_of(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part, offs in text_slices(col):
        starts, ends, first = word_spans(part, offs)
        h = word_hashes(part, starts, ends)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(shingles(h[a:b], width))


def _prefix_counts(width: int, percent: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles within one and a half prefixes in hash order, with the texts of the batch that have them."""
        for b in batches:
            parts = [s[:(3 * (len(s) - needed(len(s), percent) + 1) + 1) // 2] for s in sets_of(b.column("_text"), width)]
            v, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int32))], ["shingle", "texts"])

    return counted


def _group_counts(width: int, percent: int, shared):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All shingles of texts that look like members of a large group: half of what was counted of them is frequent."""
        frequent = shared.value
        for b in batches:
            parts = []
            for s in sets_of(b.column("_text"), width):
                head = s[:(3 * (len(s) - needed(len(s), percent) + 1) + 1) // 2]
                if len(s) and 2 * _among(head, frequent).sum() >= len(head):
                    parts.append(s)
            v, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int32))], ["shingle", "texts"])

    return counted


def _among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``s`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


def _prefixes(width: int, percent: int, shared):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for b in batches:
            n, one, two, prefix = [], [], [], []
            for s in sets_of(b.column("_text"), width):
                n.append(len(s))
                one.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                two.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)) if len(s) else 0)
                size = len(s) - needed(len(s), percent) + 1 if len(s) else 0
                often = _among(s, frequent)
                prefix.append(np.concatenate([s[~often], s[often]])[:size].view(np.int64))
            yield pa.RecordBatch.from_arrays([
                b.column("_id"), b.column("_key"), pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                pa.array(prefix, pa.list_(pa.int64()))], ["id", "key", "n", "one", "two", "prefix"])

    return made


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = b.column("_text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array([pack.compress(t.as_buffer()) for t in texts], pa.binary())], ["key", "text"])


def trie_links(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` link with ``a`` (all sorted): a walk over the trie of the others."""
    out = np.zeros(len(others), bool)
    order = sorted(range(len(others)), key=lambda k: others[k].astype(">u8").tobytes())
    last = np.zeros(0, np.uint64)
    hits = np.zeros(1, np.int64)  # hits[k]: overlap of the first k of the last set, as far as walked
    for k in order:
        b = others[k]
        need = -(-percent * (len(a) + len(b)) // (100 + percent))
        m = min(len(last), len(b), len(hits) - 1)
        differ = np.flatnonzero(last[:m] != b[:m])
        depth = int(differ[0]) if len(differ) else m
        hits = hits[:depth + 1]
        while True:
            left = len(a) - (np.searchsorted(a, b[depth - 1], "right") if depth else 0)
            if hits[-1] + min(left, len(b) - depth) < need or depth == len(b):
                break
            step = b[depth:depth + max(64, len(b) // 4)]
            at = np.minimum(np.searchsorted(a, step), len(a) - 1)
            hits = np.concatenate([hits, hits[-1] + np.cumsum(a[at] == step)])
            depth += len(step)
        last = b
        out[k] = depth == len(b) and hits[-1] >= need
    return out


def _verified(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def sets(col: pa.Array, at: list[int]) -> list[np.ndarray]:
            return list(sets_of(pa.array([unpack.decompress(col[k].as_py()).decode() for k in at], pa.large_string()), width))

        for batch in batches:
            for start in range(0, len(batch), 2000):
                b = batch.slice(start, 2000)
                a_ids = b.column("a").to_numpy()
                b_ids = b.column("b").to_numpy()
                edges = np.flatnonzero(np.append(True, a_ids[1:] != a_ids[:-1])) if len(b) else np.zeros(0, int)
                leaders = sets(b.column("a_text"), edges.tolist())
                others = sets(b.column("b_text"), list(range(len(b))))
                keep = np.zeros(len(b), bool)
                for s, lo, hi in zip(leaders, edges, np.append(edges[1:], len(b))):
                    keep[lo:hi] = trie_links(s, others[lo:hi], percent)
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[keep]), pa.array(b_ids[keep])], ["a", "b"])

    return verify


def verify_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link.  Pairs of one a follow each other; a hot a is split by Spark's skew join."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(_verified(width, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, by large-star and small-star steps until nothing changes."""
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = cut(pairs(links.toDF("u", "v")))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = pairs(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(pairs(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.toDF("u", "v"))))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.toDF("node", "component")
        state = now


def similar_sets(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: id (null: ``NULL_ID``), key (``row_key``), n, component.

    ``component`` is a number that the rows of linked texts share, whatever their
    ids; null for texts without words.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), row_key(id_col, text_col).alias("_key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    def frequent_of(counted) -> np.ndarray:
        counts = rows.select("_text").mapInArrow(counted, "shingle long, texts int")
        often = (counts.groupBy("shingle").agg(F.sum("texts").alias("texts")).filter(F.col("texts") > FREQUENT)
                 .orderBy(F.desc("texts"), "shingle").limit(MAX_FREQUENT).select("shingle"))
        return np.array(often.toPandas()["shingle"], np.int64).view(np.uint64)  # at most 8 MB

    # The order only has to be one order for all sets; what it knows makes it good.
    first_list = np.sort(frequent_of(_prefix_counts(width, percent)))
    shared = spark.sparkContext.broadcast(first_list)
    shared = spark.sparkContext.broadcast(np.union1d(first_list, frequent_of(_group_counts(width, percent, shared))))
    sets = stored(rows.mapInArrow(_prefixes(width, percent, shared), "id long, key string, n int, one long, two long, prefix array<long>")
                  .withColumn("row", F.monotonically_increasing_id()))
    # Equal sets are one set, which has the least number of its rows (from here on: id).
    kinds = sets.filter("n > 0").groupBy("one", "two", "n").agg(F.min(F.struct("row", "prefix")).alias("_k"))
    nodes = kinds.select(F.col("_k.row").alias("id"), "n", F.posexplode("_k.prefix").alias("pos", "shingle"))
    # Shingles of one set's prefix only say nothing; a bare count finds them with the least to shuffle.
    shared_by = nodes.groupBy("shingle").agg(F.count(F.lit(1)).alias("_sets")).filter("_sets > 1").select("shingle")
    entries = stored(nodes.join(shared_by, "shingle"))
    lead = entries.groupBy("shingle").agg(F.min(F.struct("pos", "id", "n")).alias("_lead")).select(
        "shingle", F.col("_lead.id").alias("lead"), F.col("_lead.n").alias("lead_n"), F.col("_lead.pos").alias("lead_pos"))
    # The text of the row that a set is numbered by.
    packed = rows.select("_key", "_text").mapInArrow(_packed, "key string, text binary").dropDuplicates(["key"])
    keys = sets.select(F.col("row").alias("id"), "key").join(entries.select("id").distinct(), "id")
    texts = stored(packed.join(keys, "key").select("id", "text"))

    def possible(na: str, left_a: str, nb: str, left_b: str) -> str:
        """Sizes fit, and if this is the first shared shingle, what is left from it on is enough to share.

        A pair that links passes at its first shared shingle: all that it shares lies from there on.
        """
        return (f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) AND "
                f"{100 + percent} * least({left_a}, {left_b}) >= {percent} * ({na} + {nb})")

    first = cut(entries.join(lead, "shingle").filter("id <> lead").filter(possible("n", "n - pos", "lead_n", "lead_n - lead_pos"))
                .select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = stored(verify_pairs(first, texts, width, percent))
    part = components(links)
    named = entries.select("shingle", "id", "n", "pos").join(part.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    named = cut(named)
    blocks = named.groupBy("shingle", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("left"))
    x, y = (blocks.select("shingle", *[F.col(c).alias(c + k) for c in ("component", "lo", "hi", "left")]) for k in "xy")
    apart = x.join(y, "shingle").filter("componentx < componenty").filter(
        f"100 * hix >= {percent} * loy AND 100 * hiy >= {percent} * lox AND {100 + percent} * least(leftx, lefty) >= {percent} * (lox + loy)"
    ).select("shingle", "componentx", "componenty")
    ax, by = (named.select("shingle", *[F.col(c).alias(c + k) for c in ("component", "id", "n", "pos")]) for k in "xy")
    second = (apart.join(ax, ["shingle", "componentx"]).join(by, ["shingle", "componenty"]).filter(possible("nx", "nx - posx", "ny", "ny - posy"))
              .select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct())
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verify_pairs(cut(second.join(tried, ["a", "b"], "left_anti")), texts, width, percent)
    part = components(links.unionByName(more))
    # The same sets again, without their prefixes: little to shuffle.
    heads = sets.filter("n > 0").groupBy("one", "two", "n").agg(F.min("row").alias("node"))
    classes = heads.join(part, "node", "left").select(
        "one", "two", "n", F.coalesce("component", "node").alias("component"))
    return sets.select("id", "key", "n", "one", "two").join(classes, ["one", "two", "n"], "left").select("id", "key", "n", "component")


def join_similar(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id that links reach).

    Texts link if 100 * intersection >= percent * union of their sets of
    ``width``-word shingles, A-Z lower-cased; fewer words are one shingle; texts
    without words (null, empty) link with nothing, and their component is their
    own id.  Equal texts link.  Ids are whole numbers; a null id is the smallest.
    Rows that repeat an id are one node, which has the links of all their texts.
    An empty table gives no rows.
    """
    sets = stored(similar_sets(docs, width, percent, id_col, text_col).drop("key"))
    # Ids whose texts are in several components link these.
    spread = sets.filter("n > 0").groupBy("id").agg(F.min("component").alias("u"), F.max("component").alias("v")).filter("u <> v").select("id", "u")
    links = cut(sets.join(spread, "id").filter("n > 0").select("u", F.col("component").alias("v")).distinct())
    if not links.isEmpty():
        part = components(links).toDF("component", "least")
        sets = sets.join(part, "component", "left").withColumn("component", F.coalesce("least", "component")).drop("least")
    least = sets.filter("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    whole = sets.join(least, "component", "left")
    back = lambda c: F.when(c != NULL_ID, c)
    return whole.select(back(F.col("id")).alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                        back(F.coalesce("component_id", "id")).alias("component_id"))
