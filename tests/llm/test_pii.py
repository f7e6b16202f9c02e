"""Personal data: base spans against plain patterns, added spans, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time

from ledgerscope.llm.pii import KINDS, base_spans, luhn, personal_data, redact, redacted
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                16 <= len(digits) <= 19 and luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("ab@.1 ", "0123456789 -", "+1(2).- 3", "1.2.3.25", "a@b.c-_%+é٣", "4 2-@+.(1)a"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert base_spans(text) == brute(text), text
    for text in ("4539 1488 0343 6467 x 4539148803436467", "a@b.c.d@e.f", "9.1.2.3.4 +1 (555) 555-1234)"):
        assert base_spans(text) == brute(text)


def test_hostile_texts_take_linear_time():
    began = time.time()
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "1 -" * 100_000, "(at)" * 50_000, "a@" * 100_000):
        base_spans(text)
    assert time.time() - began < 20


def test_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    found = added = 0
    for r in rows:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, joined(base).split(","))) <= set(spans)
        found += len(base)
        added += len(spans) - len(base)
    assert found > 20 and added <= 0.2 * found


def test_written_out_addresses_are_added(spark):
    rows = [(i, f"mail joe{i}@site{i}.example.com or call +1 (555) 555-{1000 + i} at 10.0.0.{i}") for i in range(200)]
    rows += [(i, f"version 1.2.3.999 and {i} 12 34 pages 2001-2004 (at) home 77.{i}") for i in range(200, 400)]
    rows.append((400, "write to ann (at) mail.example.com please"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data(docs).collect()}
    assert got[400] == "email:9:34"
    assert all(got[i] == "" for i in range(200, 400))
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[3] == "mail <email> or call <phone> at <ip>"
    assert clean[400] == "write to <email> please"


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "é 😀 a@b.co"), (2, "x" * 200_000 + " 1.2.3.4"), (2, "none")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = sorted((str(r.doc_id), r.spans) for r in personal_data(docs).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("2", "ip:200001:200008"), ("None", "email:4:10")]
    assert personal_data(docs.limit(0)).count() == 0
    assert redact(docs).schema == docs.schema
    assert redacted("ab cd ef", [(0, 0, 5), (3, 3, 8)]) == "<email>"


def test_common_loose_spans_are_added(spark):
    def card(start):
        return next(start + c for c in "0123456789" if luhn(start + c))

    mails = [(i, "write to ", f"ann{i} (at) mail.example.com", rest) for i, rest in enumerate([" please", ". Thanks"] * 150)]
    phones = [(1000 + i, "call me on ", f"(555) 555-{1000 + i}", " today") for i in range(300)]
    cards = [(2000 + i, "pay by card ", card(f"{37_828_224_000 + i * 7919}" + "00" + "1" * (i % 3 - 1)), " now") for i in range(300)]
    plain = [(3000 + i, "", f"order {10_000_000 + i}, pages {1900 + i % 90}-2004, id x{7 * i:011}y", "") for i in range(300)]
    rows = [(i, a + found + b) for i, a, found, b in mails + phones + cards + plain]
    for more in ([], [(5000 + i, f"mail joe{i}@site.example.com or call +1 (555) 555-{1000 + i}") for i in range(200)]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        clean = {r.doc_id: r.text for r in redact(docs).collect()}
        for kind, group in (("email", mails), ("phone", phones)):
            lost = [i for i, a, _, b in group if clean[i] != f"{a}<{kind}>{b}"]
            assert not lost, (kind, len(lost), clean[lost[0]])
        assert all(re.fullmatch("pay by card <(card|phone)> now", clean[i]) for i, *_ in cards)
        assert all(clean[i] == found for i, _, found, _ in plain)
        kinds = {r.doc_id: r.spans for r in personal_data(docs).collect()}
        assert all("card:" in kinds[i] for i, *_ in cards)
        if more:
            assert all(clean[i] == "mail <email> or call <phone>" for i, _ in more)
