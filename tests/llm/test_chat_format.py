import hashlib

from placescore.llm import chat_format as C

HARD = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\\\n", "<\\|im_end|>", "a<", "|>b\n", "", None, "<<||>>\\", "é 😀 ü"]


def brute(rows):
    own = sorted(((t, r or "", x or "") for _, t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
    turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
    return len(own), turns, "".join(x for _, r, x in own if r == "assistant")


def test_round_trip_and_budget(spark):
    rows = []
    for c in range(30):
        n = 1 + c % 12
        if c % 3 == 0:
            rows.append((c, 0, "system", f"be brief {c}"))
        for t in range(n):
            rows.append((c, t + 1, ["user", "assistant"][t % 2], (HARD[(c + t) % len(HARD)] or "") + " w" * ((c * 7 + t * 13) % 90) if (c + t) % 10 != 7 else None))
    rows += [(50, 0, "system", "alone")]
    rows += [(51, t, ["user", "assistant", "tool <|x|>\n&", None][t % 4], "long " * (400 if t == 3 else 3)) for t in range(3000)]
    rows += [(52, 1, "assistant", "twice")] * 2 + [(None, 1, "user", "q"), (None, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = C.format_chats(df, budget=200, history=40)
    for w in windows.collect():
        assert w["tokens"] <= 200 or w["n_own"] == 1 or (w["n_own"] == 2 and w["window"] <= 2)
        assert w["text"].count(C.START) == w["n_context"] + w["n_own"] == w["text"].count(C.END)
    got = {r["conv_id"]: (r["n_turns"], r["turns"], r["loss_text"]) for r in C.read_back(windows).collect()}
    assert got == {c: brute([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_history_and_system_turn_repeat_without_loss(spark):
    rows = [(1, 0, "system", "sys")] + [(1, t, ["user", "assistant"][t % 2], f"turn{t} " + "w " * 20) for t in range(1, 15)]
    windows = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 150, 60).orderBy("window").collect()
    assert len(windows) > 2
    for w in windows[1:]:
        assert w["text"].startswith("<|im_start|>system\nsys<|im_end|>") and w["n_context"] >= 2
    assert sum(len(w["loss"]) for w in windows) == 7


def test_digest_of_the_contract(spark):
    df = spark.createDataFrame([(-1, 0, "user", HARD[0]), (-1, 1, "assistant", HARD[0])], "conv_id long, turn long, role string, text string")
    r = C.read_back(C.format_chats(df)).collect()[0]
    assert hashlib.sha256(r["turns"].encode()).hexdigest() == hashlib.sha256(f"user\n{HARD[0]}\nassistant\n{HARD[0]}\n".encode()).hexdigest()
    assert r["loss_text"] == HARD[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_chats(df).count() == 0
