import re
from collections import Counter

from placescore.llm import quality_rules as Q

TEXTS = [
    None, "", "   \n\t ", "one", "a b c a b c", "x\nx\ny\n\n\nx", "a a a a a", "#$ & plain | < > %", "é ü\u00a0b \u2003 c", "a\x0bb\x0cc\rd",
    "word " * 3000, "w1 w2 w3 " + " ".join(f"t{k}" for k in range(20_000)) + " w1 w2 w3", "up!!! down!", "x" * 100_000,
]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    c = Counter(g)
    covered = {k + j for k, x in enumerate(g) if c[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), t.count("!"), len(covered))


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in Q.text_counts(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_bucket_is_monotone_and_tight(spark):
    df = spark.range(0, 70_000).selectExpr("id * id div 7 AS v").withColumn("b", Q.bucket(Q.F.col("v"))).withColumn("f", Q.bucket_floor(Q.F.col("b")))
    bad = df.filter("f > v OR (v >= 16 AND v - f > f / 16) OR (v < 16 AND f <> v)")
    assert bad.count() == 0


def test_thresholds_follow_the_group(spark):
    prose = lambda k: " ".join(f"{chr(97 + k % 26)}{j * (k + 1) % 97}" for j in range(80))
    rows = [(k, prose(k), "en", "a") for k in range(60)]
    # A source whose ordinary texts have a symbol every other word.
    rows += [(100 + k, " ".join(f"v{j * (k + 1) % 89} #" if j % 2 else f"u{j}" for j in range(80)), "en", "code") for k in range(60)]
    rows += [(300, prose(3) + " #" * 30 + " tail", "en", "a"), (301, rows[0][1], None, None), (302, None, "en", "a"), (303, prose(5) + "!!!" * 30, "en", "a"),
             (None, prose(9), "en", "a"), (0, rows[0][1], "en", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    got = {(r["doc_id"], r["kept"], r["base_failed"], r["failed"]) for r in Q.judge(df).collect()}
    kept = {x[0] for x in got if x[1]}
    assert {k for k in range(60)} <= kept and {100 + k for k in range(60)} <= kept and {301, None} <= kept
    assert (302, False, True, "") in got
    assert any(x[0] == 300 and "symbols" in x[3] for x in got) and any(x[0] == 303 and "shouts" in x[3] for x in got)


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_a_clean_source_allows_fewer_symbols(spark):
    plain = lambda k: " ".join(f"{chr(97 + k % 26)}{j * (k + 1) % 211}" for j in range(200))
    marked = lambda k: plain(k) + " #" * (k % 12)
    rows = [(k, plain(k), "en", "clean") for k in range(201)] + [(300 + k, marked(k), "en", "code") for k in range(201)]
    # The same text, 50 symbols per 1000 words, is far out in one source and ordinary in the other.
    probe = plain(3) + " #" * 10
    rows += [(900, probe, "en", "clean"), (901, probe, "en", "code")]
    got = {r["doc_id"]: (r["kept"], r["failed"]) for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[900] == (False, "symbols") and got[901] == (True, "")
    assert all(got[k][0] for k in range(201)) and all(got[300 + k][0] for k in range(201))


def test_limits_differ_between_groups_of_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = Q.cut(Q.text_counts(docs, keep=("lang", "source"))).withColumns(Q.rates()).filter("n_words >= 50 AND 2 * n_repeat_words <= n_words")
    sk = Q.sketch(rated, ["lang"], list(Q.SLACK))
    q = Q.quantiles(sk, ["lang"], {"q75": 75, "q95": 95}).collect()
    tails = {n: {r["q95"] + Q.TAIL * (r["q95"] - r["q75"]) for r in q if r["rate"] == n} for n in Q.SLACK}
    assert sum(len(t) > 1 for t in tails.values()) >= 2
