import re

from placescore.llm import queries, url_filter as U


def brute(url, rules):
    url_ = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url_)
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fit = [r for r in rules if r[6] == 1 and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fit:
        best = max(fit, key=lambda r: (len(r[1]) + len(r[2]), r[0]))
        return host, path, best[0], best[5], None
    hit = [r for r in rules if r[6] == 0 and re.search(r[3], url_)]
    best = max(hit, key=lambda r: r[0]) if hit else None
    return host, path, None, best[5] if best else "allow", best[0] if best else None


URLS = [
    "https://example.net/en/1", "https://EXAMPLE.net/en", "http://a.b.example.net/en/x?y#z", "https://notexample.net/en/", "net://net/",
    "http://net", "http://x.net?a=/", "https://shop.example.com/de/1", "https://example.com/DE/1", "https://m.a.org/fr/2#x", "https://org/fr/",
    "https://a.com/login", "https://a.com/login.html?x", "https://a.com/loginx", "https://a.com/en?utm_source=feed", "no scheme/net/", "", None,
    "https://a.com/calendar/2024", "https://a.com/p?page=2&ref=x", "x://y://example.net/en/", "https://[::1]:80/en/", "https://éxample.net/en/ü",
    "https://a.com/" + "x" * 200_000 + "/cart", "https://example.net/en/1",
]


def test_matches_brute_force(spark):
    rules = [U.host_rule(*r) for r in queries.HOST_RULES] + U.PATTERN_RULES
    rows = [(k if k != 3 else None, u, "clash", 1) for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = U.judge_urls(df, U.rules_frame(spark, rules)).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, *(x or "" for x in brute(r[1], rules))) for r in rows)
    assert sorted((r[0] if r[0] is not None else -1, *(x or "" for x in tuple(r)[1:])) for r in got) == want


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("https://a.com/utm/feed",)] * 3 + [("https://a.com/source/utm",)], "url string")
    rules = U.rules_frame(spark, [U.pattern_rule("r", "utm", ["utm", "source", "feed"], "block")])
    assert [(r["rule"], r["key"]) for r in U.index_rules(urls, rules).collect()] == [("r", "source")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(df, U.rules_frame(spark, U.PATTERN_RULES)).count() == 0


def test_tokens_follow_from_the_pattern(spark):
    import pytest
    assert U.pattern_tokens(r"(?i)/(login|signin)([/?#.]|$)") == [["login"], ["signin"]]
    assert U.pattern_tokens(r"[?&]page=\d+&ref=") == [["page", "ref"]]
    assert U.pattern_tokens(r"^Ads\.") == [["ads"]]
    for bad in ("/login", r"/(a|\d+)/", "/x*/", "/[ab]/", r"/lo(gin)?/", "/a/|b"):
        with pytest.raises(ValueError):
            U.pattern_rule("r", bad, None, "block")
    with pytest.raises(ValueError):
        U.host_rule("é", "/", "block")
    rule = U.pattern_rule("login-pages", r"(?i)/(login|signin)([/?#.]|$)", None, "block")
    urls = ["http://a.com/signin", "http://a.com/LOGIN.php", "http://a.com/signing", None, "http://a.com/signin"]
    got = U.judge_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), U.rules_frame(spark, [rule])).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(0, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block")]


def test_many_rules_match_brute_force(spark):
    rules = [U.host_rule(f"h{k}.com", "/", "block") for k in range(0, 400, 2)]
    rules += [U.pattern_rule(f"p{k}", f"/w{k}/(x|y)/", None, "block") for k in range(400)]
    urls = [f"http://s.h{k}.com/w{k * 7 % 900}/{'xyz'[k % 3]}/w{k % 401}/y/" for k in range(300)]
    got = U.judge_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), U.rules_frame(spark, rules)).collect()
    want = sorted((k, *(x or "" for x in brute(u, rules))) for k, u in enumerate(urls))
    assert sorted((r[0], *(x or "" for x in tuple(r)[1:])) for r in got) == want
