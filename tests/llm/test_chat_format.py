import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_format

HARD = ["</turn>\n", "<turn user>\nx</turn>\n", r"<\turn", r"<\\/turn \</turn>", "<", "<\\", "", None, "a\nb", "é🙂</turn", chat_format.PLANTED_TEXT]


def brute(turns):
    """turns: (role, text) in order -> the digest row without the length of the formatted text."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digest_equals_brute_force(spark):
    conversations = {
        1: [("user", t) for t in HARD] + [("assistant", t) for t in HARD],
        2: [("assistant", HARD[i]) for i in (3, 1, 2)],
        3: [("user", "only a question")],
        4: [(None, "no role"), ("a>b%3E<\n", "odd role"), ("assistant", "x"), ("user", "tail")],
        5: [("assistant", "r")] * 700,
    }
    rows = [(c, i, r, t, "clash") for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, whole string").repartition(5)
    got = {r.conv_id: r for r in chat_format.digest(chat_format.expand_examples(df)).collect()}
    for c, turns in conversations.items():
        assert tuple(got[c])[1:5] == brute(turns), c


def test_examples_train_on_one_reply_each(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "A </turn>"), (1, 3, "user", "q2"), (1, 4, "assistant", "B"), (1, 5, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(chat_format.expand_examples(df).collect(), key=lambda r: r.example)
    assert [r.n_turns for r in found] == [3, 5, 6] and [r.covers_all for r in found] == [False, False, True]
    assert found[1].formatted.startswith(found[0].formatted) and found[2].loss_start is None
    spans = [r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in found[:2]]
    assert spans == [r"A <\/turn>", "B"]


@pytest.mark.parametrize("text", [t for t in HARD if t is not None])
def test_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    coded = df.select(chat_format.escape_text(F.col("t")).alias("c"), "t")
    row = coded.select("c", chat_format.unescape_text(F.col("c")).alias("back"), "t").first()
    assert row.back == row.t and "</turn" not in row.c and "<turn" not in row.c


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x"), (7, 1, "user", "b"), (7, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.expand_examples(df)).collect()}
    assert tuple(got[None])[1:5] == brute([(None, None), ("assistant", "x")]) and got[7].n_turns == 2
    assert chat_format.expand_examples(df.limit(0)).count() == 0
