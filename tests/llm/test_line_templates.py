"""Repeated lines on small tables."""

from __future__ import annotations

from ledgerscope.llm.line_templates import TemplateParams, drop_repeated_lines, line_report

LONG = " ".join(f"t{chr(97 + i)}" for i in range(20))


def test_templates(spark):
    varied = LONG.replace("tk", "other")  # one word differs
    rows = [
        (1, f"own line one two three four\nJob 17 took 20 ms at host a1\n{LONG}", 1, "x"),
        (2, f"Job 99 took 3 ms at host b2\nshort one\nown words of the second text\n{varied}", 2, None),
        (3, "short one\nJob 5 took 6 ms at\nJob 5 took 6 ms at", 3, "x"),
        (4, f"{LONG}\n  ", 4, "x"),
        (5, None, None, "x"), (6, "", 0, "x"), (None, LONG, 1, "x"), (None, LONG, 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, dropped string")
    left = {r.doc_id: (r.text, r.n_chars) for r in drop_repeated_lines(docs).collect()}
    second = "short one\nown words of the second text"
    assert left == {
        1: (rows[0][1], 1), 2: (second, len(second)), 3: (rows[2][1], 3), 5: (None, None), 6: ("", 0),
    }
    report = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_report(docs).where("doc_id is not null").collect()}
    assert report == {1: (3, 0), 2: (4, 2), 3: (3, 0), 4: (2, 1), 5: (0, 0), 6: (1, 0)}
    assert line_report(docs).count() == len(rows)
    assert drop_repeated_lines(docs).schema == docs.schema


def test_thresholds(spark):
    docs = spark.createDataFrame([(i, "a b c d e f") for i in (1, 1, 2)], "doc_id long, text string")
    assert drop_repeated_lines(docs).count() == 2
    assert drop_repeated_lines(docs, TemplateParams(documents=3)).count() == 3
    assert drop_repeated_lines(docs, TemplateParams(keep_first=False)).count() == 0
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_long_text(spark):
    lines = [f"line of word{chr(97 + i % 26)} number x{'y' * (i % 997)} end" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::-1]) + "\nmine")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    assert left == {1: "\n".join(lines), 2: "mine"}


def test_numbers_alone_are_no_template(spark):
    labels = [f"l{chr(97 + i)}" for i in range(10)]
    other = [f"m{chr(97 + i)}" for i in range(7)]

    def row(words, start):
        return " ".join(f"{w} {start + i}" for i, w in enumerate(words))

    texts = [
        "1 2 3 4 5\n2.5 3 4.1 9 7\n| 1 | 2 | 3 |",
        "6 7 8 9 10\n0.5 1 2.2 8 6\n| 4 | 5 | 6 |",
        f"2024-01-02 1 2 3 kg 4\n{row(labels, 1)}",
        f"2023-07-08 5 6 7 kg 8\n{row(labels[:3] + other, 50)}",  # the same numbers and first three tokens only
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()} == dict(enumerate(texts))
    again = spark.createDataFrame([*enumerate(texts), (9, f"{texts[0]}\nmine")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(again).collect()}[9] == "mine"
