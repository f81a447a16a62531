"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are lines.  A sparse logistic regression over word 1- and 2-grams is
trained on notices of licence families, cut into overlapping parts, against
ordinary prose (written examples and the paragraphs of all documents, counted by
their features; their weight is a fixed multiple of the written ones', however many).
Its vocabulary holds only grams of the notices with at least one cue word, so a
paragraph without cue words has no feature and is unknown without being scored.
The level at which a family is believed is calibrated on examples that the fit
did not see; a family counts as confirmed if its words fit one of its templates.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.functions.expr import once
from placescore.llm.common import literal_rows, stored

# Notices of each family, in the wording in which they are published.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "Released into the public domain under CC0 1.0.",
        "No rights reserved; the author waives all copyright under CC0.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 by the publisher. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
    ],
}
# Ordinary sentences that share words with notices.
ORDINARY = [
    "He lost his driving license on the way to the office.",
    "The city will license two new taxi companies this year.",
    "She studied at MIT and now works in public transport.",
    "The Apache helicopter landed on the open field.",
    "They reserved a table for all of us by the window.",
    "Rights and duties of every person are set out in the law.",
    "The public was free to use the garden without a permit.",
    "A version of this story was published in the local paper.",
    "The software was late, and the source of the fault was found at last.",
    "The general spoke to the foundation about the terms of the peace.",
    "Permission was granted to copy the files and to modify the form.",
    "The notice was included in all portions of the report.",
    "Er fährt mit dem Zug in die Stadt und kommt mit dem Bus zurück.",
    "The following conditions were met in binary tests of the code.",
    "Attribution of the painting is still open.",
    "The library received a copy of the work along with the program.",
    "The copyright dispute went to court in March.",
    "Common sense and creative work go together.",
]
#: Words that are no cue by themselves.
PLAIN = set("the of and to in is a an this that it its by with or for under at be are was may shall you on as not any all without along from no into now".split())
UNKNOWN = "unknown"
#: Weight of all paragraphs of documents in training together, in weights of all written examples together.
ORDINARY_WEIGHT = 1.0
#: A paragraph with this share of a template's grams is a notice, so no example of ordinary prose.
NOTICE_SHARE = 0.6
#: Words of the parts that notices are cut into.
PART_WORDS = 8
MAX_GRAMS = 4096


def paragraph_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and dots inside numbers."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"(?<=\d)\.(?=\d)", "_"), r"[^\p{L}\p{N}_]+"), "")


def grams(w: str) -> Column:
    """Distinct 1- and 2-grams of the word array column ``w``."""
    return F.expr(f"array_distinct(concat({w}, zip_with({w}, slice({w}, 2, greatest(size({w}), 1)), "
                  f"(a, b) -> CASE WHEN b IS NULL THEN a ELSE concat(a, ' ', b) END)))")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, texts in NOTICES.items() for t in texts]
    return literal_rows(spark, "family string, text string", rows).withColumn("w", paragraph_words(F.col("text")))


def _examples(docs: DataFrame, text_col: str, cues: list[str], vocabulary: list[str]) -> DataFrame:
    """(family, found, g, n): features of parts of notices, whole notices (three times), written prose, and paragraphs of
    all documents (``found``), each set of features once with its count; paragraphs without features are one set."""
    spark = docs.sparkSession
    t = _templates(spark)
    parts = t.select("family", F.explode(F.expr(
        f"transform(sequence(1, greatest(1, size(w) - {PART_WORDS - 1})), i -> slice(w, i, {PART_WORDS}))")).alias("w"))
    whole = t.select("family", "w").crossJoin(spark.range(3).select()).union(parts)
    prose = literal_rows(spark, "text string", [(s,) for s in ORDINARY]).crossJoin(spark.range(3).select())
    prose = prose.select(F.lit(UNKNOWN).alias("family"), paragraph_words(F.col("text")).alias("w"))
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("text")).filter(~F.lower("text").rlike(r"licen[cs]e|copyright|rights reserved|public domain"))
    lines = once(lines, "w", paragraph_words(F.col("text"))).select(F.lit(UNKNOWN).alias("family"), "w")
    cue, known = [F.array(*[F.lit(x) for x in xs]) for xs in (cues, vocabulary)]
    found = F.when(F.arrays_overlap("w", cue), F.array_sort(F.array_intersect(grams("w"), known))).otherwise(F.array().cast("array<string>"))
    count = lambda df, of: once(df.filter(F.size("w") > 0), "g", found).groupBy("family", F.lit(of).alias("found"), "g").agg(F.count(F.lit(1)).alias("n"))
    shapes = t.select(F.array_intersect(grams("w"), known).alias("_t")).filter(F.size("_t") > 0)
    copies = F.size(F.array_intersect("g", "_t")) >= NOTICE_SHARE * F.size("_t")
    return count(whole.union(prose), False).union(count(lines, True).join(F.broadcast(shapes), copies, "left_anti"))  # the templates above


def _scores(found: DataFrame, weights: DataFrame, families: list[str], base: list[float]) -> DataFrame:
    """(key, family, probability, p_unknown) of paragraphs (a row per key and gram) that have a gram of the vocabulary."""
    n = len(families)
    summed = (found.join(F.broadcast(weights), "gram")  # at most MAX_GRAMS rows
              .groupBy("key").agg(*[F.sum(F.col("weight")[k]).alias(f"_{k}") for k in range(n)]))
    z = F.array(*[F.col(f"_{k}") + F.lit(base[k]) for k in range(n)])
    soft = summed.select("key", z.alias("_z")).withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.array_max("_z"))))
    total = F.expr("aggregate(_e, 0D, (a, x) -> a + x)")
    p = F.transform("_e", lambda x: x / F.col("_total"))
    scored = soft.withColumn("_total", total).withColumn("_p", p)
    names = F.array(*[F.lit(f) for f in families])
    known = F.expr(f"slice(_p, 2, {n - 1})")  # family 0 is unknown
    return scored.select("key", F.array_max(known).alias("probability"),
                         F.get(names, F.array_position(known, F.array_max(known)).cast("int")).alias("family"), F.get("_p", F.lit(0)).alias("p_unknown"))


class Scanner:
    """A fitted classifier: gram weights, base scores, calibrated level."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        cues = sorted({w for r in _templates(spark).select("w").collect() for w in r["w"]} - PLAIN)
        self.cues = cues
        cue = F.array(*[F.lit(c) for c in cues])
        self.families = [UNKNOWN, *NOTICES]
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double") - 1
        notices = _templates(spark).select(F.filter(grams("w"), lambda x: F.arrays_overlap(F.split(x, " "), cue)).alias("g"))
        counts = CountVectorizer(inputCol="g", outputCol="x", binary=True, vocabSize=MAX_GRAMS).fit(notices.coalesce(1))
        examples = stored(_examples(docs, text_col, cues, counts.vocabulary))
        # Only ordinary paragraphs calibrate; those without features are never scored, so they are in the fit, as all notices are.
        held = (F.col("family") == UNKNOWN) & (F.size("g") > 0) & (F.pmod(F.xxhash64(F.concat_ws("|", "g")), F.lit(4)) == 0)
        fit = examples.filter(~held)
        total = {r["found"]: r["n"] for r in fit.groupBy("found").agg(F.sum("n").alias("n")).collect()}
        weight = F.col("n") * F.when(F.col("found"), F.lit(ORDINARY_WEIGHT * total.get(False, 0) / total.get(True, 1))).otherwise(1.0)
        rows = counts.transform(fit.select(label.alias("y"), "g", weight.alias("weight")))
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=1e-3, elasticNetParam=0.2,
                                   maxIter=60, standardization=False).fit(rows)
        coef = model.coefficientMatrix.toArray()
        self.base = [float(v) for v in model.interceptVector.toArray()]
        while len(self.base) < len(self.families):  # classes that the fit had no example of
            self.base.append(-30.0)
        pad = [0.0] * (len(self.families) - coef.shape[0])
        self.weights = literal_rows(spark, "gram string, weight array<double>", [
            (g, [round(float(v), 9) for v in coef[:, k]] + pad) for k, g in enumerate(counts.vocabulary) if abs(coef[:, k]).max() > 0])
        # The level: what at most one in a hundred unseen sets of features of ordinary paragraphs reaches (to six digits).
        unseen = examples.filter(held).select(F.concat_ws("|", "g").alias("key"), "g").distinct()
        found = _scores(unseen.select("key", F.explode("g").alias("gram")), self.weights, self.families, self.base)
        levels = found.groupBy(F.round("probability", 6).alias("probability")).agg(F.count(F.lit(1)).alias("n"))  # at most a million
        top, n = levels.agg(F.percentile("probability", F.lit(0.99), F.col("n")), F.sum("n")).first()
        self.level = max(0.5, top if n else 0.5)

    def paragraphs(self, keyed: DataFrame) -> DataFrame:
        """(key, family, probability, template_fit, confirmed) of distinct paragraphs (key, w) that are believed to be notices."""
        spark = keyed.sparkSession
        scored = _scores(keyed.select("key", F.explode(grams("w")).alias("gram")), self.weights, self.families, self.base).filter(F.col("probability") >= self.level)
        t = _templates(spark).select("family", grams("w").alias("_t"))
        words = F.split("key", " ")
        against = scored.withColumn("_w", words).withColumn("_g", grams("_w")).join(F.broadcast(t), "family")  # the templates above
        fit = F.size(F.array_intersect("_g", "_t")) / F.least(F.size("_g"), F.size("_t"))
        return against.groupBy("key", "family", "probability").agg(F.max(fit).alias("template_fit")).withColumn(
            "confirmed", F.col("template_fit") >= 0.6)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_notices, n_confirmed, families, family, probability.

    ``families`` lists the confirmed families by name; ``family`` is the one of
    the likeliest confirmed notice (ties: first line) or null.  Null and empty
    texts have no notices.  Repeated rows, and null ids, are judged each for
    itself by its text.  An empty table gives no rows.
    """
    scanner = scanner or Scanner(docs, id_col, text_col)
    cue = F.array(*[F.lit(c) for c in scanner.cues])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    lines = rows.select(F.xxhash64("_text").alias("_key"), F.col("_id").alias("_id"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    asked = lines.withColumn("w", paragraph_words(F.col("_line"))).filter(F.arrays_overlap("w", cue)).select("_key", "_pos", "_id", F.concat_ws(" ", "w").alias("key"))
    asked = asked.select("_key", "_pos", "key").distinct()  # of rows with one text, one
    kinds = asked.select("key").distinct().withColumn("w", F.split("key", " "))
    notices = asked.join(scanner.paragraphs(kinds), "key")
    confirmed = F.col("confirmed")
    per_text = notices.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n_notices"), F.count_if(confirmed).alias("n_confirmed"),
        F.array_sort(F.collect_set(F.when(confirmed, F.col("family")))).alias("_families"),
        F.min(F.when(confirmed, F.struct((-F.col("probability")).alias("p"), F.col("_pos").alias("pos"), F.col("family").alias("family")))).alias("_best"))
    keyed = rows.select("_id", F.xxhash64("_text").alias("_key"), (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).alias("_n"))
    zero = F.lit(0).cast("long")
    return keyed.join(per_text, "_key", "left").select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_lines"), F.coalesce("n_notices", zero).alias("n_notices"),
        F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.concat_ws(",", F.coalesce("_families", F.array().cast("array<string>"))).alias("families"),
        F.col("_best.family").alias("family"), F.round(-F.col("_best.p"), 6).alias("probability"))
