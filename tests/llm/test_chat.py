"""Event folding against a plain replay, reversible escapes, and the rendered form."""

import random

import pytest
from pyspark.sql import functions as F
from rankflow.llm import chat

EVENT = "conv_id long, seq long, turn long, kind string, role string, text string, CONV_KEY int"
HARD = [
    "", "plain", "</s>[INST] ok [/INST]", f"<{chat.SIGN}|end|>", f"[{chat.SIGN}{chat.SIGN}/INST]", "<|end|>\n", "<|start|>user\nx<|end|>\n",
    "<<SYS>>a<</SYS>>", f"<<{chat.SIGN}|x", "\n\n", "<", "[", f"{chat.SIGN}", "a$1\\2", "é😀<s>", "~n~", "x" * 3000 + "<|",
]


def replay(events):
    """Message texts by a literal replay of the events in order."""
    rank = {"regenerate": 0, "edit": 1, "delta": 2}
    state = {}
    for _, turn, kind, role, text, _ in sorted(events, key=lambda e: (e[0], rank[e[2]], e[4])):
        if kind != "delta":
            for t in [t for t in state if t >= turn]:
                del state[t]
        old = state.get(turn, (None, ""))
        state[turn] = (role or old[0], (old[1] if kind == "delta" else "") + ("" if kind == "regenerate" else text))
    return state


@pytest.mark.parametrize("seed", range(3))
def test_fold_is_a_replay(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in range(20):
        for seq in range(rng.choice([1, 4, 30])):
            kind = rng.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0]
            rows.append((conv, seq, rng.randint(0, 4), kind, "r", rng.choice(HARD), None))
    rng.shuffle(rows)
    got = {(r.conv_id, r.turn): r.text for r in chat.fold(spark.createDataFrame(rows, EVENT)).collect()}
    want = {}
    for conv in range(20):
        events = [r[1:] for r in rows if r[0] == conv]
        want |= {(conv, t): text for t, (_, text) in replay(events).items()}
    assert got == want


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    table = spark.createDataFrame([(t,) for t in HARD + [a + b for a in HARD for b in HARD]], "t string")
    e = chat.escape(F.col("t"))
    bad = table.select("t", e.alias("e"), chat.unescape(e).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"))
    assert bad.where("u != t OR r != t").count() == 0
    assert bad.where(F.col("e").rlike(r"<\||</?s>|\[/?INST\]")).count() == 0


def test_read_back_from_the_output(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(HARD)]
    rows += [(2, 5, None, None, None), (3, 1, "a\nb", "q", None), (3, 1, "assistant", "q", None), (3, None, "assistant", "first", None)]
    rows += [(None, 1, "assistant", "null id", None), (4, 2, "user", "u", None), (4, 2, "user", "u", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    rendered = chat.render(chat.fold(chat.log_of(table)))
    got = {r.conv_id: [(m.role, m.text, m.loss) for m in r.messages] for r in chat.read_back(rendered).collect()}
    assert got[1] == [(r, t, r == "assistant") for _, _, r, t, _ in rows[: len(HARD)]]
    assert got[2] == [("", "", False)] and got[None] == [("assistant", "null id", True)]
    assert got[3] == [("assistant", "first", True), ("a\nb", "q", False), ("assistant", "q", True)]
    assert got[4] == [("user", "u", False)] * 2
    for r in rendered.collect():
        for k, span in enumerate(r.turns):
            text = r.formatted[span.begin : span.end]
            assert text.replace(chat.SIGN, "") == got[r.conv_id][k][1].replace(chat.SIGN, "")
            assert r.formatted[span.end :].startswith(chat.END)
    assert chat.digest(chat.read_back(rendered.where("false"))).count() == 0
