"""Quoted conversations against a plain walk through the thread."""

from __future__ import annotations

import random

from ledgerscope.llm.queries import QUERIES
from ledgerscope.llm.quotes import reply_order

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def walk(parents: dict) -> list:
    """Depth first, answers by turn."""
    children, order = {}, []
    for turn, parent in sorted(parents.items()):
        children.setdefault(parent, []).append(turn)
    stack = [t for t in reversed(children.get(None, []))]
    while stack:
        turn = stack.pop()
        order.append(turn)
        stack += reversed(children.get(turn, []))
    return order


def test_nested_quotes_link_to_their_authors(spark):
    data = [
        (1, 0, "user", "Where do we meet on Friday?\n\nAnd when exactly is it?"),
        (1, 1, "a", "At the old mill."),
        (1, 2, "b", "> At the old   MILL!\n\nFine by me then"),
        (1, 3, "c", "> > Where do we meet\n> > on Friday?\n> At the old mill.\nI prefer the new one"),
        (1, 4, "d", ">> At the old mill.\n> Fine by me then\n>>> nobody wrote this line\nGood"),
        (1, 5, "e", "> And when exactly is it?\nAt noon"),
        (2, 0, "user", None), (2, 3, "x", ">short\n"), (2, 7, "y", "\n> Where do we meet on Friday?\nok"),
    ]
    got = rows_of(reply_order(spark.createDataFrame(data, SCHEMA)))
    assert {k[1]: r.reply_to for k, r in got.items() if k[0] == 1} == {0: None, 1: 0, 2: 1, 3: 1, 4: 2, 5: 0}
    assert got[1, 2].text == "Fine by me then" and got[1, 3].text == "I prefer the new one"
    assert got[1, 4].n_quotes == 3 and got[1, 4].by_quote
    assert {k[1]: r.reply_to for k, r in got.items() if k[0] == 2} == {0: None, 3: 0, 7: 3}
    assert got[2, 3].text == "" and got[2, 0].text == "" and not got[2, 7].by_quote
    order = [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position) if k[0] == 1]
    assert order == walk({k[1]: r.reply_to for k, r in got.items() if k[0] == 1}) == [0, 1, 2, 4, 3, 5]


def test_random_threads(spark):
    rng = random.Random(4)
    data, parents = [], {}
    for conv in range(12):
        for turn in range(rng.choice((1, 5, 40))):
            text = f"message number {turn} of talk {conv}"
            parent = turn - 1 if turn else None
            if turn and rng.random() < 0.5:
                parent = rng.randrange(turn)
                text = f"> Message  number {parent} of talk {conv}\n{text}"
            parents[conv, turn] = parent
            data.append((conv, turn, "r", text))
    rng.shuffle(data)
    got = rows_of(reply_order(spark.createDataFrame(data, SCHEMA)))
    assert {k: r.reply_to for k, r in got.items()} == parents
    for conv in range(12):
        mine = {t: p for (c, t), p in parents.items() if c == conv}
        found = sorted((r.position, t) for (c, t), r in got.items() if c == conv)
        assert [p for p, _ in found] == list(range(1, len(mine) + 1))
        assert [t for _, t in found] == walk(mine)


def test_given_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = rows_of(QUERIES["op5_chat_formatting"](spark, SF))
    want = {(r.conv_id, r.turn): r for r in table.collect()}
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key].text == row.text.strip() and got[key].role == row.role


def test_odd_rows(spark):
    data = [(None, 1, "a", "x"), (1, None, "a", "x"), (1, 1, "a", "b"), (1, 1, "a", "b"), (1, 1, None, "a"), (3, 1, "z", "> " + "w " * 40_000 + "\nown")]
    frame = spark.createDataFrame([(*r, 1) for r in data], SCHEMA + ", rank int")
    got = rows_of(reply_order(frame))
    assert {k: r.text for k, r in got.items()} == {(1, 1): "a", (3, 1): "own"}
    assert reply_order(frame.limit(0)).count() == 0


def test_quotes_of_several_paragraphs_and_short_ones(spark):
    data = [
        (1, 0, "u", "The first thing is this.\n\nThe second thing is that."),
        (1, 1, "a", "No, never."), (1, 2, "b", "Some other words here"), (1, 3, "u", "Good point"), (1, 4, "a", "Good point"),
        (1, 5, "c", "> The first thing is this.\n>\n> The second thing is that.\nWhole"),
        (1, 6, "c", "> The second thing is that.\n>\n> nobody wrote this one\nOne of two"),
        (1, 7, "d", "> No, never.\nShort and written once"),
        (1, 8, "e", "> Good point\nShort and written twice"),
        (1, 9, "f", "> nobody\n>\n> wrote\n\nSome other end"),
    ]
    got = rows_of(reply_order(spark.createDataFrame(data, SCHEMA)))
    replies = {k[1]: r.reply_to for k, r in got.items()}
    assert replies == {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 7: 1, 8: 7, 9: 8}
    assert got[1, 5].n_quotes == got[1, 6].n_quotes == 1 and not got[1, 8].by_quote
    order = [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position)]
    assert order == walk(replies)
