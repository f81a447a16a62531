"""Quality rules with thresholds learnt per language and source.

Each text gives counts (words, symbols, repeated lines, repeated three-word
windows, shouting).  Their rates are held against a threshold of the text's own
language and source, the lesser of two.  ``median + spread * (median - 5 %
quantile) + slack`` takes its spread from the lower half of a rate, so junk in
the upper half does not move it.  ``95 % quantile + tail * (95 % - 75 % quantile)
+ floor`` follows the upper tail, so a source whose texts hardly ever have
symbols, say, allows fewer than one that often does.  Quantiles come from a mergeable sketch: counts of integer rates in buckets
that are exact below 16 and 1/16 wide above (relative error up to 1/16), so that
merging is adding, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placescore.llm.common import GAP, cut, words

#: Rates per 1000 words (lines for dup_lines) and the slack that each has over its group's spread.
SLACK = {"symbols": 60, "repeats": 200, "dup_lines": 250, "shouts": 120}
SPREAD = 4
#: What each rate may have over the upper tail of its group (one repeated line in five is no sign of junk), and the multiple of that tail.
FLOOR = {"symbols": 30, "repeats": 100, "dup_lines": 200, "shouts": 60}
TAIL = 2
#: Groups with fewer texts than this also count towards, and use, all groups' sketch.
MIN_TEXTS = 30
MIN_WORDS = 50


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shouts (all over whole texts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.regexp_replace(s, GAP, "")) > 0)
    a = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)],
                    text.alias("_text"), words(text).alias("_w"), lines.alias("_lines"))
    # Three-word windows with their position, sorted: equal windows are neighbours.
    b = a.select(
        "_id", *[f"_k{k}" for k in range(len(keep))],
        F.size("_w").cast("long").alias("n_words"),
        F.expr("aggregate(_w, 0L, (n, w) -> n + length(w))").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.expr("""CASE WHEN size(_w) < 3 THEN cast(array() AS array<struct<g:string,p:int>>) ELSE
                  sort_array(transform(sequence(0, size(_w) - 3), i -> named_struct('g',
                  concat(get(_w, i), ' ', get(_w, i + 1), ' ', get(_w, i + 2)), 'p', i))) END""").alias("_s"))
    # Positions of windows that equal a neighbour; each covers three words, less what the next one covers.
    c = b.withColumn("_p", F.expr("""sort_array(transform(filter(
            arrays_zip(_s, slice(_s, 2, greatest(size(_s), 1)), concat(array(cast(null AS struct<g:string,p:int>)), _s)),
            z -> z['0'] IS NOT NULL AND (z['0'].g = z['1'].g OR z['0'].g = z['2'].g)), z -> z['0'].p))""".replace("z['0']", "z._s")
                                  .replace("z['1']", "z.`1`").replace("z['2']", "z.`2`")))
    return c.select(
        F.col("_id").alias(id_col), *[F.col(f"_k{k}").alias(c_) for k, c_ in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_shouts",
        F.expr("""CASE WHEN size(_p) = 0 THEN 0L ELSE cast(aggregate(
                  zip_with(_p, slice(_p, 2, size(_p)), (d, e) -> least(3, coalesce(e - d, 3))), 0, (n, x) -> n + x) AS bigint) END""").alias("n_repeat_words"))


def rates() -> dict[str, Column]:
    per = lambda n, d: F.floor(F.lit(1000) * F.col(n) / F.greatest(F.col(d), F.lit(1))).cast("long")
    return {"symbols": per("n_symbols", "n_words"), "repeats": per("n_repeat_words", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"), "shouts": per("n_shouts", "n_words")}


def bucket(v: Column) -> Column:
    """Exact below 16; above, the leading bit and the four bits after it."""
    e = F.length(F.bin(v)) - 5
    return F.when(v < 16, v).otherwise((e + 1) * 16 + F.expr("0") + F.call_function("shiftright", v, e) - 16).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.floor(b / 16).cast("int") - 1
    return F.when(b < 16, b).otherwise(F.call_function("shiftleft", (b % 16 + 16).cast("long"), e)).cast("long")


def sketch(rated: DataFrame, groups: list[str], rate_cols: list[str]) -> DataFrame:
    """(groups, rate, bucket, n): a sketch of each rate of each group; sketches merge by adding n."""
    long = rated.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("rate"), bucket(F.col(c)).alias("bucket")) for c in rate_cols])).alias("_x"))
    return long.groupBy(*groups, "_x.rate", "_x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sk: DataFrame, groups: list[str], probs: dict[str, int]) -> DataFrame:
    """(groups, rate, size, one column per quantile): the floor of the bucket that holds the rank; probs in per cent."""
    w = W.partitionBy(*groups, "rate")
    run = sk.withColumn("_run", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    return run.groupBy(*groups, "rate").agg(
        F.max("_all").alias("size"),
        *[F.min(F.when(F.col("_run") * 100 >= F.col("_all") * p, bucket_floor(F.col("bucket")))).alias(c) for c, p in probs.items()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, failed (rates over their threshold), kept.

    Base rules: fewer than 50 words, or more than half of the words in repeated
    three-word windows, fails.  The others are kept if no rate is over the
    threshold of the text's language and source; groups under ``MIN_TEXTS`` texts
    that passed the base rules use the thresholds over all texts.  Null language
    or source is a group of its own; null or empty texts have no words and fail.
    Repeated rows count, and are judged, each for itself.
    """
    counts = cut(text_counts(docs, id_col, text_col, keep=(lang_col, source_col)).withColumnRenamed(lang_col, "_lang").withColumnRenamed(source_col, "_source"))
    names = list(SLACK)
    rated = counts.withColumns(rates()).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    ok = rated.filter(~F.col("base_failed"))
    sk = sketch(ok, ["_lang", "_source"], names)
    probs = {"q05": 5, "q50": 50, "q75": 75, "q95": 95}
    of_rate = lambda values: F.create_map(*[x for n, s in values.items() for x in (F.lit(n), F.lit(s))])[F.col("rate")]
    limit = lambda q: q.withColumn("_max", F.least(
        F.col("q50") + SPREAD * (F.col("q50") - F.col("q05")) + of_rate(SLACK), F.col("q95") + TAIL * (F.col("q95") - F.col("q75")) + of_rate(FLOOR)))
    everyone = limit(quantiles(sk.groupBy("rate", "bucket").agg(F.sum("n").alias("n")), [], probs))
    own = limit(quantiles(sk, ["_lang", "_source"], probs)).filter(F.col("size") >= MIN_TEXTS)
    pivot = lambda q, groups, tag: q.groupBy(*groups).agg(*[F.max(F.when(F.col("rate") == n, F.col("_max"))).alias(f"_{tag}_{n}") for n in names])
    mine = pivot(own, ["_lang", "_source"], "own").withColumnsRenamed({"_lang": "_l2", "_source": "_s2"})
    all_ = pivot(everyone, [], "all")  # one row
    held = (rated.join(mine, F.col("_lang").eqNullSafe(F.col("_l2")) & F.col("_source").eqNullSafe(F.col("_s2")), "left")
            .crossJoin(F.broadcast(all_)))
    over = [F.when(F.col(n) > F.coalesce(f"_own_{n}", f"_all_{n}"), F.lit(n)) for n in names]
    held = held.withColumn("failed", F.filter(F.array(*over), lambda x: x.isNotNull()))
    return held.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "base_failed",
                       F.concat_ws(",", "failed").alias("failed"), (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
