"""Chat formatting in budgeted windows.

Turns become ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts ``\\`` is
doubled and ``<|`` becomes ``<\\|``, so that no text holds a control string and
``unescape`` gives the text back; roles are url-encoded.  Prefix sums of turn
tokens cut a conversation into turn-aligned spans.  Each window holds the system
turn, a limited history from the end of the span before, and its span.  The loss
mask covers the assistant texts of the span only, so repeated turns carry no
loss and each assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placescore.llm.common import n_words

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
#: Turn numbers of a block; prefix sums run within blocks and over block sums.
BLOCK = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(turn: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(END + "\n"))


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with pos, n (turns of the conversation), is_sys, span key, and e: the prefix sum of tokens at the turn's end."""
    first = turns.groupBy("_c").agg(F.min(F.struct("_t", "_role", "_text")).alias("_f"))
    # The system turn is the first turn, if it has that role.
    head = first.select(F.col("_c").alias("_c2"), (F.col("_f._role") == "system").alias("_has_sys"),
                        (n_words(F.col("_f._text")) + TURN_TOKENS).alias("_sys_tokens"))
    t = (turns.withColumn("_tokens", n_words(F.col("_text")) + TURN_TOKENS).withColumn("_b", F.floor(F.col("_t") / BLOCK))
         .join(head, F.col("_c").eqNullSafe(F.col("_c2")), "left").drop("_c2"))
    inner = W.partitionBy("_c", "_b").orderBy("_t", "_role", "_text")
    t = t.withColumn("_rn", F.row_number().over(inner))
    # Half of what the system turn and the history leave: two halves never exceed the budget.
    half = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.when(F.col("_has_sys"), F.col("_sys_tokens")).otherwise(0)) / 2))
    t = t.withColumn("_half", half).withColumn("_big", (F.col("_tokens") > F.col("_half")).cast("long"))
    sums = t.groupBy("_c", "_b").agg(F.sum("_tokens").alias("_bt"), F.sum("_big").alias("_bb"), F.count(F.lit(1)).alias("_bn"))
    over = W.partitionBy("_c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    base = sums.select(F.col("_c").alias("_c2"), F.col("_b").alias("_b2"),
                       F.coalesce(F.sum("_bt").over(over), zero).alias("_t0"), F.coalesce(F.sum("_bb").over(over), zero).alias("_g0"),
                       F.coalesce(F.sum("_bn").over(over), zero).alias("_n0"), F.sum("_bn").over(W.partitionBy("_c")).alias("_n"))
    run = inner.rowsBetween(W.unboundedPreceding, 0)
    t = (t.withColumn("_e1", F.sum("_tokens").over(run)).withColumn("_g1", F.sum("_big").over(run))
         .join(base, F.col("_c").eqNullSafe(F.col("_c2")) & F.col("_b").eqNullSafe(F.col("_b2"))).drop("_c2", "_b2"))
    t = t.withColumns({"_pos": F.col("_n0") + F.col("_rn"), "_e": F.col("_t0") + F.col("_e1"), "_g": F.col("_g0") + F.col("_g1")})
    is_sys = F.coalesce(F.col("_has_sys"), F.lit(False)) & (F.col("_pos") == 1)
    return t.withColumn("_is_sys", is_sys).withColumn(
        "_key", F.when(is_sys, F.lit("s")).when(F.col("_big") == 1, F.concat(F.lit("b"), F.col("_g").cast("string")))
        .otherwise(F.concat_ws("-", F.col("_g").cast("string"), F.floor((F.col("_e") - 1) / F.col("_half")).cast("string")))
    ).select("_c", "_pos", "_n", "_role", "_text", "_tokens", "_e", "_is_sys", "_key")


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows: conv, window (position of its first own turn), text, n_context, n_own, loss (spans of code points), tokens.

    A window's tokens stay within ``budget`` unless one turn, or the system turn
    with it, is larger: such a turn has a window of its own and is never cut.
    ``n_context`` turns at the start (system turn, history) repeat earlier ones.
    Turns sort by number, role and text (null number first); repeated rows are
    turns of their own.  Null texts and roles are empty; rows of a null
    conversation id form one conversation.  An empty table gives no windows.
    """
    t = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = _spans(t, budget, history)
    keys = rows.filter(~F.col("_is_sys")).groupBy("_c", "_key").agg(
        F.min("_pos").alias("_first"), F.max("_pos").alias("_last"), F.max("_e").alias("_end"))
    keys = keys.withColumnsRenamed({"_c": "_c2", "_key": "_k2"})
    rows = rows.join(keys, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_key") == F.col("_k2")), "left").drop("_c2", "_k2")
    own = F.when(F.col("_is_sys"), F.least(F.lit(2), F.col("_n"))).otherwise(F.col("_first"))
    repeat = ~F.col("_is_sys") & (F.col("_last") < F.col("_n")) & (F.col("_end") - (F.col("_e") - F.col("_tokens")) <= history)
    places = F.filter(F.array(F.struct(own.alias("w"), F.lit(False).alias("old")),
                              F.when(repeat, F.struct((F.col("_last") + 1).alias("w"), F.lit(True).alias("old")))), lambda x: x.isNotNull())
    dealt = rows.withColumn("_x", F.explode(places))
    turn = F.struct(F.col("_pos").alias("pos"), F.col("_x.old").alias("old"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_tokens").alias("tokens"))
    # A window's turns are bounded by the budget.
    windows = dealt.groupBy("_c", F.col("_x.w").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    sys = rows.filter("_is_sys").select(F.col("_c").alias("_c2"), F.struct(
        F.lit(0).cast("long").alias("pos"), F.lit(True).alias("old"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_tokens").alias("tokens")).alias("_sys"))
    windows = windows.join(sys, F.col("_c").eqNullSafe(F.col("_c2")), "left")
    windows = windows.withColumn("_turns", F.when(F.col("_sys").isNotNull() & (F.col("window") > 2), F.concat(F.array("_sys"), "_turns")).otherwise(F.col("_turns")))
    pieces = windows.withColumn("_pieces", F.transform("_turns", _piece))
    ends = F.expr("transform(sequence(1, size(_pieces)), i -> aggregate(slice(_pieces, 1, i), 0, (n, s) -> n + length(s)))")
    laid = pieces.withColumn("_ends", ends)
    tail = len(END) + 1
    loss = F.expr(f"""transform(filter(arrays_zip(_turns, _ends), z -> NOT z._turns.old AND z._turns.role = 'assistant'),
        z -> named_struct('start', z._ends - {tail} - length(replace(replace(z._turns.text, '\\\\', '\\\\\\\\'), '<|', '<\\\\|')), 'end', z._ends - {tail}))""")
    return laid.select(
        F.col("_c").alias(conv_col), "window", F.concat_ws("", "_pieces").alias("text"),
        F.size(F.filter("_turns", lambda x: x["old"])).alias("n_context"), F.size(F.filter("_turns", lambda x: ~x["old"])).alias("n_own"),
        loss.alias("loss"), F.expr("aggregate(_turns, 0L, (n, x) -> n + x.tokens)").alias("tokens"))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns, loss_text, formatted_chars) parsed from the formatted texts and their loss spans."""
    own = F.expr(f"slice(filter(split(text, '{START.replace('|', '[|]')}'), s -> s != ''), n_context + 1, greatest(n_own, 1))")
    turns = F.transform(own, lambda p: F.concat(
        F.url_decode(F.substring_index(p, "\n", 1)), F.lit("\n"),
        unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)), F.lit("\n")))
    loss = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])))
    parts = windows.select(conv_col, "window", turns.alias("_turns"), F.concat_ws("", loss).alias("_loss"), F.length("text").alias("_chars"))
    # The digest of a conversation needs its whole text in one value.
    g = parts.groupBy(conv_col).agg(
        F.sort_array(F.collect_list(F.struct("window", "_turns", "_loss"))).alias("_w"), F.sum("_chars").alias("formatted_chars"))
    return g.select(
        conv_col, F.expr("aggregate(_w, 0L, (n, w) -> n + size(w._turns))").alias("n_turns"),
        F.concat_ws("", F.flatten(F.col("_w._turns"))).alias("turns"), F.concat_ws("", F.col("_w._loss")).alias("loss_text"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
