"""Clustering operators.

Statistics that name and describe clusters come from one small table,
``cluster_stats`` (a row per label and feature); names and reports only read it.
Model fitting (J4/J5) uses Spark ML's distributed PCA and one K-means pass for all
restarts; the driver reads the explained variance to choose the components, and
moves and compares centres.
"""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from placescore.functions.expr import clip
from placescore.operators import kmeans
from placescore.operators.agg import attach_one_row, cluster_sizes, shape_stats, silhouette, wcss
from placescore.operators.quantile import null_safe, qcol, quantiles, quantiles_of_ranged, ranged, value_counts
from placescore.operators.window import one_row, top_k_per_group, union_all
from placescore.session import cut_lineage
from placescore.specs import (BALANCED_CANDIDATES, BALANCED_DESCRIPTION, CLIP_EXCESS_KURTOSIS, CLIP_PCT_BEYOND_4,
                              CLIP_SKEW_ABS, NAME_MAX_PHRASES, NAME_Z_THRESHOLD, ONE_PHRASE_TEXTS,
                              TRADEOFF_DEFAULT, TWO_PHRASE_TEXTS)


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x - median) / IQR`` with interpolated quantiles; IQR 0 -> divide by 1."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    j = df.crossJoin(F.broadcast(q))
    out = []
    for c in df.columns:
        if c in cols:
            iqr = F.col(qcol(c, 0.75)) - F.col(qcol(c, 0.25))
            den = F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
            out.append(((F.col(c) - F.col(qcol(c, 0.5))) / den).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def selective_winsorize(df: DataFrame, cols: Sequence[str], lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Clip to [5%, 95%] only the columns that still look long-tailed.

    Decision per column (|skew| > .5, excess kurtosis > .5 or > 2 % beyond |4|)
    stays a column expression: one moments aggregate + one quantile aggregate,
    both one-row, attached by broadcast.
    """
    mom = shape_stats(df, cols, tail_z=4.0)
    q = quantiles(df, cols, [lower, upper])
    j = df.crossJoin(F.broadcast(mom)).crossJoin(F.broadcast(q))
    out = []
    for c in df.columns:
        if c in cols:
            long_tailed = (F.abs(F.col(f"{c}_skew")) > CLIP_SKEW_ABS) | (F.col(f"{c}_kurt") > CLIP_EXCESS_KURTOSIS) \
                | (F.col(f"{c}_tail_pct") > CLIP_PCT_BEYOND_4)
            out.append(F.when(F.coalesce(long_tailed, F.lit(False)),
                              clip(c, F.col(qcol(c, lower)), F.col(qcol(c, upper)))).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def _feature_counts(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    return ranged(value_counts(df, features, by))


def profile_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """per (label, feature) mean and median (long form; null for a feature without values)."""
    return _profile(df, _feature_counts(df, [label], features), label, features)


def _means(counts: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    return counts.groupBy(*by).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias(out))


def _profile(df: DataFrame, counts: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    every = df.select(label).distinct().select(label, F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    medians = quantiles_of_ranged(counts, [0.5], [label]).select(label, "feature", F.col("quantile").alias("median"))
    both = null_safe(null_safe(every, _means(counts, [label, "feature"], "mean"), [label, "feature"], "left"), medians, [label, "feature"], "left")
    return both.select(label, "feature", "mean", "median")


def _overall(counts: DataFrame, features: Sequence[str]) -> DataFrame:
    q = quantiles_of_ranged(counts, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    q = q.groupBy("feature").agg(at(0.5).alias("overall_median"), F.nullif(at(0.75) - at(0.25), F.lit(0.0)).alias("overall_iqr"))
    return _means(counts, ["feature"], "overall_mean").join(q, "feature").select("feature", "overall_mean", "overall_median", "overall_iqr")


def overall_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: overall mean, median and IQR (zero IQR -> null, F13)."""
    return _overall(_feature_counts(df, [], features), features)


def cluster_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(label, feature, mean, median, overall_mean, overall_median, overall_iqr): all that names and reports need.

    ``df`` is read once for its labels and once for value counts; the result has
    a row per label and feature and a cut lineage.
    """
    counts = _feature_counts(df, [label], features)
    return cut_lineage(_profile(df, counts, label, features).join(_overall(counts, features), "feature", "left"))


def phrase_dim(spark, phrases: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Feature -> (positive, negative) phrase as a small dimension with its order."""
    rows = [(f, i, p, n) for i, (f, (p, n)) in enumerate(phrases.items())]
    return spark.createDataFrame(rows, "feature string, phrase_order int, pos string, neg string")


def _z(stats: DataFrame, what: str) -> DataFrame:
    """z = (cluster value - overall median) / overall IQR; 0 without either."""
    return stats.withColumn("z", F.coalesce((F.col(what) - F.col("overall_median")) / F.col("overall_iqr"), F.lit(0.0)))


def short_names(df: DataFrame, label: str, features: Sequence[str], phrases: Mapping[str, tuple[str, str]],
                out: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Short cluster names.

    z = (cluster median - global median) / global IQR (zero IQR -> z 0).  Up to
    two different phrases from features with |z| >= 0.35, strongest first, joined
    " / "; otherwise the strongest phrase feature; otherwise "Balanced".  Without
    any feature the name is the label as text.
    ``stats``: a ``cluster_stats`` frame of these features, if there is one.
    """
    out = out or f"{label}_name"
    if not list(features):
        return df.select(label).distinct().select(label, F.col(label).cast("string").alias(out))
    stats = cluster_stats(df, label, features) if stats is None else stats.where(F.col("feature").isin(list(features)))
    pd_ = phrase_dim(stats.sparkSession, {k: v for k, v in phrases.items() if k in features})
    zp = _z(stats, "median").join(F.broadcast(pd_), "feature")  # as many rows as features
    strongest = [F.desc(F.abs("z")), F.asc("phrase_order")]
    strong = zp.where(F.abs("z") >= NAME_Z_THRESHOLD).withColumn("__p", F.when(F.col("z") > 0, F.col("pos")).otherwise(F.col("neg")))
    strong = top_k_per_group(strong, [label, "__p"], strongest, 1, "__once")
    strong = top_k_per_group(strong, [label], strongest, NAME_MAX_PHRASES, "__rs").groupBy(label).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__rs", "__p"))), lambda s: s["__p"]), " / ").alias("__strong"))
    fb = top_k_per_group(zp, [label], strongest, 1, "__r").select(label, F.when(F.col("z") >= 0, F.col("pos")).otherwise(F.col("neg")).alias("__fb"))
    labels = stats.select(label).distinct()
    return null_safe(null_safe(labels, strong, [label], "left"), fb, [label], "left").select(
        label, F.coalesce("__strong", "__fb", F.lit("Balanced")).alias(out))


def label_report(df: DataFrame, label: str, features: Sequence[str], phrases: Mapping[str, tuple[str, str]],
                 tradeoffs: Sequence[tuple[Sequence[str], str]], top_traits: int = 5,
                 overrides: DataFrame | None = None, stats: DataFrame | None = None,
                 name_features: Sequence[str] | None = None) -> DataFrame:
    """Per label -- key traits text, three candidate names, final name,
    description and trade-offs.

    Traits: top ``top_traits`` features by |z|, z = (cluster mean - overall
    median) / overall IQR; direction printed against the overall mean (O4).
    ``overrides`` (label, final_name, candidate_name_1..3, description,
    tradeoffs; any may be null) is a user dimension joined last.
    """
    stats = cluster_stats(df, label, features) if stats is None else stats
    spark = stats.sparkSession
    top = top_k_per_group(_z(stats, "mean"), [label], [F.desc(F.abs("z")), F.asc("feature")], top_traits)
    pd_ = phrase_dim(spark, phrases)
    top = top.join(F.broadcast(pd_), "feature", "left")
    g4 = lambda c: _fmt_g4(F.col(c))
    line = F.concat(F.col("feature"), F.lit(": "),
                    F.when(F.col("mean") - F.coalesce(F.col("overall_mean"), F.lit(0.0)) >= 0, F.lit("higher")).otherwise(F.lit("lower")),
                    F.lit(" vs avg ("), g4("mean"), F.lit(" vs "), g4("overall_mean"), F.lit(")"))
    phrase = F.when(F.col("pos").isNotNull(), F.when(F.col("z") >= 0, F.col("pos")).otherwise(F.col("neg")))
    rep = top.groupBy(label).agg(
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line"), phrase.alias("phrase")))).alias("__t"))
    lines = F.transform("__t", lambda s: s["line"])
    phr = F.filter(F.transform("__t", lambda s: s["phrase"]), lambda p: p.isNotNull())
    rep = rep.select(label, F.array_join(lines, " | ").alias("key_traits"), *_report_texts(phr), _tradeoffs(phr, tradeoffs).alias("tradeoffs"))
    names = short_names(df, label, list(features if name_features is None else name_features), phrases, out="__short", stats=stats)
    rep = null_safe(rep, names, [label], "left").withColumn("final_name", F.coalesce("__short", F.lit("Balanced"))).drop("__short")
    cols = ["key_traits", "candidate_name_1", "candidate_name_2", "candidate_name_3", "final_name", "description", "tradeoffs"]
    if overrides is not None:
        o = overrides.select(label, *[F.col(c).alias(f"__o_{c}") for c in cols if c in overrides.columns])
        rep = rep.join(F.broadcast(o), label, "left")  # one row per label, written by people
        rep = rep.select(label, *[F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if f"__o_{c}" in rep.columns else F.col(c)
                                  for c in cols])
    return rep.select(label, *cols)


def _report_texts(phrases: Column) -> list[Column]:
    """Candidate names and description from the phrases, by the templates for two, one and no phrase."""
    a, b = F.try_element_at(phrases, F.lit(1)), F.try_element_at(phrases, F.lit(2))

    def filled(template: str) -> Column:
        parts: list[Column] = []
        for piece in re.split(r"(\{\w+\})", template):
            parts.append({"{a}": a, "{b}": b, "{a_lower}": F.lower(a), "{b_lower}": F.lower(b)}.get(piece, F.lit(piece)))
        return F.concat(*parts)

    none = [*BALANCED_CANDIDATES, BALANCED_DESCRIPTION]
    out = []
    for name, two, one, zero in zip(["candidate_name_1", "candidate_name_2", "candidate_name_3", "description"],
                                    TWO_PHRASE_TEXTS, ONE_PHRASE_TEXTS, none):
        out.append(F.when(F.size(phrases) >= 2, filled(two)).when(F.size(phrases) >= 1, filled(one)).otherwise(F.lit(zero)).alias(name))
    return out


def _tradeoffs(phrases: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    parts = [F.when(F.exists(phrases, lambda p: p.isin(*trig)), F.lit(text)) for trig, text in rules]
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
    return F.when(F.size(arr) > 0, F.array_join(arr, ", ")).otherwise(F.lit(TRADEOFF_DEFAULT))


def _fmt_g4(x: Column) -> Column:
    """Python-style ``%.4g``.

    Python rounds the exact binary value half-even (36.135 -> 36.13, 12345 ->
    1.234e+04); Java's formatter rounds the shortest decimal half-up.  So the
    value is first rounded to 4 significant digits with ``rint`` on the scaled
    double, then formatted, and Java's trailing zeros are stripped.
    """
    # first settle summation-order noise: round to 12 significant digits, so a
    # mean that is a decimal tie in exact arithmetic formats the same on every engine
    k = (F.lit(11) - F.floor(F.log10(F.abs(x)))).cast("int")
    x = F.when((x == 0) | x.isNull(), x).otherwise(F.rint(x * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k))
    e = F.floor(F.log10(F.abs(x)))
    m = (F.lit(3) - e).cast("int")
    sc = F.pow(F.lit(10.0), m)                    # exact power of ten for m <= 22
    prod = x * sc
    # exact rounding error of the product (Dekker two-product): decides ties
    def split(a):
        c = F.lit(134217729.0) * a
        hi = c - (c - a)
        return hi, a - hi
    xh, xl = split(x)
    sh, sl = split(sc)
    err = ((xh * sh - prod) + xh * sl + xl * sh) + xl * sl
    fl = F.floor(prod)
    tie = (prod - fl) == 0.5
    r = F.when(tie & (err > 0), fl + 1).when(tie & (err < 0), fl).otherwise(F.rint(prod))
    up = r / sc
    down = F.rint(x / F.pow(F.lit(10.0), -m)) * F.pow(F.lit(10.0), -m)
    v = F.when(x == 0, F.lit(0.0)).when(m >= 0, up).otherwise(down)
    s = F.format_string("%.4g", v)
    s = F.regexp_replace(s, r"(\.\d*?)0+(e|$)", "$1$2")
    s = F.regexp_replace(s, r"\.(e|$)", "$1")
    return F.when(x.isNull(), F.lit("nan")).otherwise(s)


# ------------------------------------------------------------------ J4, J5, J8, J9

def cluster_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """The numeric columns that clustering looks at: all but the listed ones."""
    out = set(drop)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in out]


def assign_clusters(df: DataFrame, key: str, features: Sequence[str], ks: Sequence[int] = (5, 22),
                    starts: int = 10, seed: int = 42, variance: float = 0.90, keep: int = 3) -> DataFrame:
    """Robust scale -> selective winsorise -> PCA (90 % variance, first
    ``keep`` components) -> K-means for each k, best of ``starts`` seeds, all
    of them fitted in the same passes (``operators/kmeans.py``).

    Returns ``key``, ``components`` (array) and one ``cluster_k{k}`` column per k.
    Labels are numbered by cluster size (largest first), then by centre.  A unit
    with a missing feature raises: it has no place among the others.  Jobs run
    here (scaling, fits); the result has a cut lineage.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gaps = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in features]).first()
    gaps = {c: n for c, n in gaps.asDict().items() if n}
    if gaps:
        raise ValueError(f"clustering needs every feature of every unit; missing values: {gaps}")
    x = selective_winsorize(robust_scale(df.select(key, *features), features), features)
    v = VectorAssembler(inputCols=list(features), outputCol="__v", handleInvalid="error").transform(x).select(key, "__v")
    # Spark PCA does not centre the data: centre first
    cen = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(v).transform(v)
    d = len(features)
    pca = PCA(k=d, inputCol="__c", outputCol="__pc").fit(cen)
    cum, kk = 0.0, d
    for i, ev in enumerate(pca.explainedVariance.toArray()):
        cum += float(ev)
        if cum >= variance:
            kk = i + 1
            break
    kk = min(kk, keep)
    z = cut_lineage(pca.transform(cen).select(key, F.slice(vector_to_array("__pc"), 1, kk).alias("components")))
    for k, m in kmeans.fit(z, key, "components", list(dict.fromkeys(ks)), starts, seed).items():
        centres = [tuple(float(c) for c in row) for row in m.centres]
        order = sorted(range(len(centres)), key=lambda i: (-m.sizes[i], centres[i]))
        place = F.array(*[F.lit(order.index(i)) for i in range(len(centres))])
        table = F.array(*[F.array(*[F.lit(c) for c in row]) for row in centres])
        gap = lambda c: F.aggregate(F.zip_with("components", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
        nearest = F.array_min(F.transform(table, lambda c, i: F.struct(gap(c).alias("far"), i.alias("i"))))["i"]
        z = z.withColumn(f"cluster_k{k}", F.get(place, nearest).cast("int"))
    return cut_lineage(z.select(key, "components", *[f"cluster_k{k}" for k in ks]))


def similar_units(df: DataFrame, key: str, value, label: str, vec: str, n: int = 10) -> DataFrame:
    """The ``n`` members of a unit's cluster that are closest to it, without itself.

    The unit is looked up first (an unknown key raises) and travels as one row.
    """
    probe = one_row(df.select(key, label, vec), key, value).select(F.col(label).alias("__pl"), F.col(vec).alias("__pe"))
    j = df.select(key, label, vec).where(F.col(key) != F.lit(value)).crossJoin(F.broadcast(probe)).where(F.col(label).eqNullSafe(F.col("__pl")))
    sq = F.aggregate(F.zip_with(vec, "__pe", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda acc, v: acc + v)
    top = j.select(key, sq.alias("sq_distance")).orderBy("sq_distance", key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("sq_distance", key)).cast("int"))  # over n rows


def model_metrics(labelled: DataFrame, key: str, labels: Sequence[str], vec: str = "components") -> DataFrame:
    """A row per model: sizes, silhouette (squared Euclidean) and within-cluster sum of squares."""
    rows = [attach_one_row(attach_one_row(cluster_sizes(labelled, c), silhouette(labelled, vec, c)), wcss(labelled, key, vec, c))
            .select(F.lit(c).alias("model"), "n_clusters", "cluster_min_size", "cluster_max_size",
                    F.col("silhouette").alias("silhouette_score"), "wcss") for c in labels]
    return union_all(rows)
