from placescore.llm import license_scan as L

ROWS = [
    (1, "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "apache"),
    (2, "RELEASED UNDER THE MIT LICENSE", "mit"),
    (3, "Copyright 2019 by A. Body. All rights reserved.", "reserved"),
    (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "cc-by-nc,gpl"),
    (5, "He fährt mit dem Zug.\nThe general was free to go to the public library.", ""),
    (6, "He lost his license at the office of the city.", ""),
    (7, None, ""),
    (8, "", ""),
    (9, "word mit und der " * 30_000 + "\nReleased under the MIT License.", "mit"),
    (None, "This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    (2, "RELEASED UNDER THE MIT LICENSE", "mit"),
]


def test_families(spark):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t, _ in ROWS], "doc_id long, text string, n_lines int, family string")
    got = sorted((r["doc_id"] or 0, r["families"]) for r in L.scan(df).collect())
    assert got == sorted((i or 0, f) for i, _, f in ROWS)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_document_serves_as_ordinary_prose(spark):
    texts = ["Some public software.\nPlain words here.", "Released under the GNU GPL, version 2 or later.", "All rights reserved.", None, ""]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(2500)], "doc_id long, text string")
    words = L._templates(spark).select("w").collect()
    cues = sorted({w for r in words for w in r["w"]} - L.PLAIN)
    vocabulary = sorted({g for r in L._templates(spark).select(L.grams("w").alias("g")).collect() for g in r["g"] if set(g.split()) & set(cues)})
    got = {tuple(r["g"]): r["n"] for r in L._examples(df, "text", cues, vocabulary).filter("found").collect()}
    assert got == {("public", "software"): 500, (): 500}  # all of them, and no notice among them
