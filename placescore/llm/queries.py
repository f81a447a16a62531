"""The registered query of each operator, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.llm import (
    chat_format,
    decontaminate,
    license_scan,
    mixing,
    ngram_join,
    quality_model,
    quality_rules,
    sharding,
    source_audit,
    suffix_dedup,
    token_alignment,
    token_counts,
    url_filter,
)
from placescore.llm.common import literal_rows, table
from placescore.llm.registry import query

# --- op10 -----------------------------------------------------------------------

HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op10_sql() -> str:
    hosts = ", ".join(f"({_sql_text(h + p)}, {_sql_text(h)}, {_sql_text(p)}, {_sql_text(v)})" for h, p, v in HOST_RULES)
    patterns = ", ".join(f"({_sql_text(r[0])}, {_sql_text(r[3])})" for r in url_filter.PATTERN_RULES)
    return f"""
WITH rules(rule, h, p, v) AS (VALUES {hosts}), patterns(name, re) AS (VALUES {patterns}),
parts AS (SELECT page_id, coalesce(url, '') AS url,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (SELECT *,
  (SELECT arg_max(struct_pack(rule := rule, v := v), length(h) + length(p)) FROM rules
   WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
  (SELECT max(name) FROM patterns WHERE regexp_matches(url, re)) AS method_rule FROM parts)
SELECT page_id, host, path, best.rule AS rule,
  CASE WHEN best.rule IS NOT NULL THEN best.v WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN best.rule IS NULL THEN method_rule END AS method_rule
FROM judged"""


@query("op10_url_filter", _op10_sql())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rules_frame(spark, [url_filter.host_rule(*r) for r in HOST_RULES] + url_filter.PATTERN_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


# --- op5 ------------------------------------------------------------------------

#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


# --- op6 ------------------------------------------------------------------------

@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


# --- op3 ------------------------------------------------------------------------

def _op3_sql() -> str:
    q = quality_rules
    slack, floor = (" ".join(f"WHEN '{n}' THEN {s}" for n, s in values.items()) for values in (q.SLACK, q.FLOOR))
    rate = ", ".join(f"('{n}', {c})" for n, c in (("symbols", "symbols"), ("repeats", "repeats"), ("dup_lines", "dup_lines"), ("shouts", "shouts")))
    e = "(length(bin(v)) - 5)"
    down = "(CASE WHEN bucket < 16 THEN bucket ELSE (bucket % 16 + 16) << (bucket // 16 - 1) END)"

    def thresholds(groups: str) -> str:
        g = groups + ", " if groups else ""
        by = f"PARTITION BY {g}rate"
        cuts = ", ".join(f"min(CASE WHEN run * 100 >= size * {p} THEN {down} END) AS q{p:02}" for p in (5, 50, 75, 95))
        return f"""SELECT {g}rate, any_value(size) AS size, {cuts}
          FROM (SELECT {g}rate, bucket, sum(n) OVER ({by} ORDER BY bucket) AS run, sum(n) OVER ({by}) AS size
                FROM (SELECT {g}rate, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {g}rate"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d)),
g AS (SELECT r, p, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY r),
counts AS (SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
  len(list_distinct(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')))) AS n_kinds,
  coalesce(covered.n, 0) AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM d LEFT JOIN (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r) USING (r) LEFT JOIN covered USING (r)),
rated AS (SELECT *, n_lines - n_kinds AS n_dup_lines, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
  1000 * (n_lines - n_kinds) // greatest(n_lines, 1) AS dup_lines, 1000 * n_shouts // greatest(n_words, 1) AS shouts FROM counts),
long AS (SELECT r, lang, source, base_failed, x.rate, x.v FROM (SELECT *, unnest([{", ".join(f"struct_pack(rate := '{n}', v := {n}::bigint)" for n in q.SLACK)}]) AS x FROM rated)),
sk AS (SELECT lang, source, rate, CASE WHEN v < 16 THEN v ELSE ({e} + 1) * 16 + (v >> {e}) - 16 END AS bucket, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
own AS ({thresholds("lang, source")}), everyone AS ({thresholds("")}),
failed AS (SELECT r, string_agg(rate, ',' ORDER BY CASE rate {" ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(q.SLACK))} END) AS failed
  FROM (SELECT l.r, l.rate, l.v, {", ".join(f"coalesce(o.{c}, e.{c}) AS {c}" for c in ("q05", "q50", "q75", "q95"))} FROM long l
        LEFT JOIN own o ON l.rate = o.rate AND l.lang IS NOT DISTINCT FROM o.lang AND l.source IS NOT DISTINCT FROM o.source AND o.size >= {q.MIN_TEXTS}
        LEFT JOIN everyone e ON l.rate = e.rate)
  WHERE v > least(q50 + {q.SPREAD} * (q50 - q05) + CASE rate {slack} END, q95 + {q.TAIL} * (q95 - q75) + CASE rate {floor} END) GROUP BY r)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
  n_repeat_words::bigint AS n_repeat_words, n_shouts::bigint AS n_shouts, base_failed, coalesce(failed, '') AS failed,
  NOT base_failed AND failed IS NULL AS kept
FROM rated LEFT JOIN failed USING (r)"""


@query("op3_quality_rules", _op3_sql())
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))

# --- op2 ------------------------------------------------------------------------

CHAT_BUDGET, CHAT_HISTORY = 1024, 128
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def _op2_sql() -> str:
    piece = "12 + length(url_encode(role)) + 1 + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + 11"
    return f"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
t1 AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat_format.TURN_TOKENS} AS tokens, {piece} AS chars,
  row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t2 AS (SELECT *, pos = 1 AND role = 'system' AS is_sys, max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER c AS sys_tokens,
  max(CASE WHEN pos = 1 AND role = 'system' THEN chars END) OVER c AS sys_chars FROM t1 WINDOW c AS (PARTITION BY conv_id)),
t3 AS (SELECT *, greatest(1, ({CHAT_BUDGET - CHAT_HISTORY} - coalesce(sys_tokens, 0)) // 2) AS half FROM t2),
t4 AS (SELECT *, tokens > half AS big, sum(tokens) OVER w AS e, sum((tokens > half)::int) OVER w AS g FROM t3
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
t5 AS (SELECT *, CASE WHEN is_sys THEN 's' WHEN big THEN 'b' || g ELSE g || '-' || ((e - 1) // half) END AS key FROM t4),
t6 AS (SELECT *, max(pos) OVER k AS last, max(e) OVER k AS e_end FROM t5 WINDOW k AS (PARTITION BY conv_id, key)),
spans AS (SELECT conv_id, count(DISTINCT key) FILTER (NOT is_sys) AS spans FROM t6 GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(sum(chars) FILTER (NOT is_sys AND last < n AND e_end - (e - tokens) <= {CHAT_HISTORY}), 0)
   + coalesce(any_value(sys_chars), 0) * greatest(any_value(spans) - 1, 0))::bigint AS formatted_chars
FROM t6 JOIN spans USING (conv_id) GROUP BY conv_id"""


@query("op2_chat_format", _op2_sql())
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = literal_rows(spark, "conv_id bigint, turn bigint, role string, text string",
                         [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)])
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.read_back(chat_format.format_chats(turns, CHAT_BUDGET, CHAT_HISTORY))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


# --- op7 ------------------------------------------------------------------------

def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


@query("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- op9 ------------------------------------------------------------------------

@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- op4 ------------------------------------------------------------------------

@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# --- op1 ------------------------------------------------------------------------

@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf_dir, "documents"), width=3, percent=90)


# --- op8 ------------------------------------------------------------------------

@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


# --- op11 -----------------------------------------------------------------------

@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = token_alignment.align_documents(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = aligned.withColumn("groups_sha256", digest).drop("groups")
    return token_alignment.count_links(aligned, *token_alignment.vocabulary_sizes(*paths)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# --- op12 -----------------------------------------------------------------------

def _op12_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {source_audit.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN held USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (s.n + l.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {source_audit.TOP}"""


@query("op12_source_audit", _op12_sql())
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


# --- op13 -----------------------------------------------------------------------

@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
