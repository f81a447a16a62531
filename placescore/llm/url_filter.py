"""URL filter: pattern rules indexed by their rarest literal token.

A rule is (rule, host, path, pattern, verdict).  Host rules fit their host and
its subdomains below a path; pattern rules are regular expressions.  From the
pattern follow alternatives, each with the whole tokens that a url matching that
way must hold; each alternative is filed under the one of its tokens that the
fewest urls hold (counted over all urls).  The tokens of a url fetch the candidate
rules by a hash join, and only those run their regular expression.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser as regex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.llm.common import literal_rows

#: Rules are sent to all executors; more than this many is an error.
MAX_RULES = 100_000

RULES_SCHEMA = "rule string, host string, path string, pattern string, tokens array<array<string>>, verdict string, priority int"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.array_remove(F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), ""))


def literal_tokens(text: str) -> list[str]:
    return sorted({t for t in re.split("[^a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))) if t})


#: Ways to match that a pattern is spelled out into; beyond, the rest counts as unknown text.
MAX_WAYS = 256
_UNKNOWN, _EDGE = "\0", " "


def _ways(items) -> list[str]:
    """What a parsed pattern matches, way by way: letters and digits it spells, ``_EDGE`` for what surely is neither, else ``_UNKNOWN``."""
    ways = [""]
    for op, arg in items:
        if op is C.LITERAL:
            c = chr(arg)
            more = [c.lower() if c.isascii() and c.isalnum() else _EDGE]
        elif op is C.AT and arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING):
            more = [_EDGE]
        elif op is C.IN and all(o is C.LITERAL and not (chr(v).isascii() and chr(v).isalnum()) for o, v in arg):
            more = [_EDGE]
        elif op is C.SUBPATTERN:
            more = _ways(arg[3])
        elif op is C.BRANCH:
            more = [w for branch in arg[1] for w in _ways(branch)]
        elif op is C.MAX_REPEAT and arg[0] == arg[1] == 1:
            more = _ways(arg[2])
        else:
            more = [_UNKNOWN]
        more = sorted(set(more))
        ways = [a + b for a, b in product(ways, more)] if len(ways) * len(more) <= MAX_WAYS else [w + _UNKNOWN for w in ways]
    return ways


def pattern_tokens(pattern: str) -> list[list[str]]:
    """For each way to match: the whole url tokens that every such match holds; raises where a way has none."""
    ways = [sorted(set(re.findall(f"(?<={_EDGE})[a-z0-9]+(?={_EDGE})", w))) for w in _ways(regex.parse(pattern))]
    if not all(ways):
        raise ValueError(f"not every match of {pattern!r} holds a whole literal token to be filed under")
    return [list(t) for t in sorted(set(map(tuple, ways)))]


def host_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host (in lower case), its subdomains and the paths that start with ``path``."""
    if not literal_tokens(host):
        raise ValueError(f"host {host!r} has no token to be filed under")
    return (host + path, host, path, None, [literal_tokens(host)], verdict, 1)


def pattern_rule(name: str, pattern: str, tokens: list[str] | None, verdict: str) -> tuple:
    """A regular expression on the whole url.

    The tokens follow from the pattern (``None``).  Where they cannot, the caller may
    vouch for whole url tokens that each match holds.
    """
    if tokens is not None and not tokens:
        raise ValueError(f"rule {name} has no literal token to be filed under")
    return (name, None, None, pattern, pattern_tokens(pattern) if tokens is None else [[t.lower() for t in tokens]], verdict, 0)


#: The method's own rules, used where no host rule fits.
PATTERN_RULES = [
    pattern_rule("login-pages", r"(?i)/(login|signin)([/?#.]|$)", None, "block"),
    pattern_rule("signin-pages", r"(?i)/signin([/?#.]|$)", None, "block"),
    pattern_rule("cart-pages", r"(?i)/cart([/?#.]|$)", None, "block"),
    pattern_rule("feed-links", r"(?i)[?&]utm_source=feed(&|#|$)", None, "block"),
    pattern_rule("tracked-pages", r"(?i)[?&]page=\d+&ref=", None, "block"),
    pattern_rule("calendar-pages", r"(?i)/calendar/\d{4}", None, "block"),
]


def rules_frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} is the most that is sent to all executors")
    return literal_rows(spark, RULES_SCHEMA, rules)


def index_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Rules with ``key``, a row for each different one: of the tokens of a way to match the one that the fewest urls hold (ties: first by name)."""
    ways = rules.select("rule", F.posexplode("tokens").alias("_way", "_tokens"))
    wanted = ways.select(F.explode("_tokens").alias("key")).distinct()
    seen = (urls.select(F.explode(url_tokens(F.col(url_col))).alias("key"))
            .join(F.broadcast(wanted), "key")  # at most the tokens of MAX_RULES rules
            .groupBy("key").agg(F.count(F.lit(1)).alias("urls")))
    filed = (ways.select("rule", "_way", F.explode("_tokens").alias("key"))
             .join(F.broadcast(seen), "key", "left")
             .groupBy("rule", "_way").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "key")).alias("_f"))
             .select("rule", F.col("_f.key").alias("key")).distinct())
    return rules.drop("tokens").join(F.broadcast(filed), "rule")


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule, verdict, method_rule.

    ``rule`` is the longest host rule that fits (by characters of host and path,
    then by name), else null; ``verdict`` is that rule's, else ``block`` if a
    pattern rule matches, else ``default``.  A null or empty url has an empty
    host and path, no tokens, and so the default verdict.  Repeated rows are
    judged each for itself; null ids are kept; other columns are not read.
    """
    base = urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    filed = F.broadcast(index_rules(base, rules, "_url"))  # at most the tokens of MAX_RULES rules
    parts = base.select("_id", "_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    # Rows equal in url share a verdict, which is looked up by the url's digest.
    parts = parts.withColumn("_key", F.when(F.length("_url") > 0, F.md5("_url")))
    names = ["rule", "path", "pattern", "verdict", "priority"]
    found = (parts.filter(F.col("_key").isNotNull()).withColumn("_token", F.explode(url_tokens(F.col("_url"))))
             .join(filed.select(F.col("key").alias("_token"), F.col("host").alias("_host"), *[F.col(c).alias(f"_{c}") for c in names]), "_token"))
    by_host = (((F.col("host") == F.col("_host")) | F.endswith("host", F.concat(F.lit("."), F.col("_host")))) & F.startswith("path", F.col("_path")))
    fits = F.when(F.col("_priority") == 1, by_host).otherwise(F.coalesce(F.regexp_like("_url", F.col("_pattern")), F.lit(False)))
    best = found.filter(fits).groupBy("_key").agg(F.max(F.struct(
        F.col("_priority").alias("priority"), F.coalesce(F.length("_host") + F.length("_path"), F.lit(0)).alias("size"),
        F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    # Rows without a url meet no other, so they are not sent to one task by their null key.
    judged = parts.filter(F.col("_key").isNotNull()).join(best, "_key", "left").unionByName(
        parts.filter(F.col("_key").isNull()).withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType)))
    has = F.col("_best.priority") == 1
    return judged.select(
        F.col("_id").alias(id_col), "host", "path",
        F.when(has, F.col("_best.rule")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.when(~has, F.col("_best.rule")).alias("method_rule"))
