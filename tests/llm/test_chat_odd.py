"""Conversations without an id, long ones, empty tables and columns with clashing names."""

import hashlib

from tidemark.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, own string, target int, starts string"


def run(spark, rows):
    return chat.read_back(chat.expand(spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA))).collect()


def test_rows_without_a_conversation_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "assistant", "<turn>b#"), (None, None, None, None), (1, 1, "assistant", "d"), (1, 0, "user", "c"), (1, 0, "user", "c")]
    got = run(spark, rows)
    assert sorted(([tuple(t) for t in r.turns] for r in got if r.conv_id is None), key=str) == [[("", "")], [("assistant", "<turn>b#")], [("user", "a")]]
    (one,) = [r for r in got if r.conv_id == 1]
    assert [tuple(t) for t in one.turns] == [("user", "c"), ("user", "c"), ("assistant", "d")] and one.loss == "d"


def test_a_long_conversation_comes_back_whole(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} <b># \\ " + "x" * (i % 7)) for i in range(600)] + [(6, 0, "user", "é🙂" * 50_000)]
    got = {r.conv_id: r for r in run(spark, rows)}
    assert [tuple(t) for t in got[5].turns] == [(r, t) for _, _, r, t in rows[:-1]]
    assert got[5].loss == "".join(t for _, _, r, t in rows if r == "assistant") and got[5].n_examples == 300
    assert hashlib.md5(got[6].turns[0].text.encode()).hexdigest() == hashlib.md5(("é🙂" * 50_000).encode()).hexdigest()


def test_an_empty_table_gives_no_examples(spark):
    assert chat.expand(spark.createDataFrame([], SCHEMA)).collect() == []
