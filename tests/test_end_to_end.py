"""Bank files in, result files out, compared line by line with plain Python.

Random transactions around the period borders, in all currencies, with padded
bank ids, mixed case and unknown banks; lines are compared as sorted text.
"""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from bank_files import at, brute_converted, brute_pairs, btc_table, write

from ledgerscope import RiskParams, plans, sinks
from ledgerscope.functions import CURRENCY_ISO
from ledgerscope.operators.projections import normalize_transactions
from ledgerscope.sources import land_ledger, read_accounts, read_fx_rates, read_transactions

FORMATS = ["Wire", "ACH", "Cheque", "Credit Card", "Bitcoin", "wire", "Ach"]
ROWS = 6000


def make_transactions(rng):
    currencies = [*CURRENCY_ISO, "US Dollar", "US Dollar", "us dollar", "US Dollar", "Florin"]
    start, rows = datetime(2022, 8, 31, 23, 50), []
    for _ in range(ROWS):
        moment = start + timedelta(minutes=rng.randrange(16 * 24 * 60 + 20))
        a, b = rng.randrange(60), rng.randrange(60)
        bank_a, bank_b = f"{a % 9:0{rng.choice([3, 3, 3])}d}", f"{b % 9:03d}"
        amount = rng.choice(
            [rng.randrange(1, 300) / 100, rng.randrange(1, 10**6) / 100, 0.995, 50.0, 12345678.9]
        )
        rows.append(
            (moment.strftime("%Y/%m/%d %H:%M"), bank_a, f"A{a}", bank_b, f"A{b}", amount,
             rng.choice(currencies), rng.choice(FORMATS))
        )
    return rows


def make_rates(rng):
    return {
        (date(2022, 9, day), iso): rng.uniform(0.2, 150.0)
        for day in (1, 2, 5)
        for iso in CURRENCY_ISO.values()
        if iso != "BTC"
    }


def golden(rows, names, rates, k):
    parsed = [(at(r[0]), *r[1:]) for r in rows]
    usd = [r for r in parsed if r[6].lower() == "us dollar"]
    p1 = (at("2022/09/01 00:00"), at("2022/09/05 23:59"))
    p2 = (at("2022/09/06 00:00"), at("2022/09/15 23:59"))
    low = [f"{r[1]},{r[2]},{r[3]},{r[4]},{r[5]!r}" for r in usd if r[5] < 50.0]

    best = {}
    for r in usd:
        bank = int(r[1])
        best[bank] = min(best.get(bank, (0.0, "~")), (-r[5], r[2]))
    largest = [f"{names.get(b, 'Unknown')},{acc},{-a!r}" for b, (a, acc) in best.items()]

    sums = defaultdict(list)
    for r in usd:
        if p1[0] <= r[0] <= p1[1]:
            sums[r[7].lower()].append(r[5])
    averages = {f: sum(v) / len(v) for f, v in sums.items()}
    odd = [
        f"{r[1]},{r[2]},{r[5]!r}"
        for r in usd
        if p2[0] <= r[0] <= p2[1] and r[5] < 0.01 * averages.get(r[7].lower(), 0.0)
    ]

    edges = [((r[1], r[2]), (r[3], r[4])) for r in usd if p1[0] <= r[0] <= p1[1]]
    ends = {end for pair in brute_pairs(edges, k) for end in pair}
    accounts = [f"{bank},{account}" for bank, account in ends]

    count = sum(
        p1[0] <= r[0] <= p1[1]
        and r[7].lower() in ("wire", "ach")
        and brute_converted(r[5], r[6], r[0].date(), rates) < 1.0
        for r in parsed
    )
    return {1: low, 2: largest, 3: odd, 4: accounts, 5: [str(count)]}


@pytest.mark.parametrize(("seed", "through_ledger"), [(1, False), (2, True)])
def test_five_result_files(spark, tmp_path, seed, through_ledger):
    rng = random.Random(seed)
    rows, quoted = make_transactions(rng), make_rates(rng)
    header = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency," \
        "Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    text = "".join(
        f"{t},{fb},{fa},{tb},{ta},{amount!r},{cur},{amount!r},{cur},{fmt},0\n"
        for t, fb, fa, tb, ta, amount, cur, fmt in rows
    )
    banks = {bank: f"Bank {bank}" for bank in range(8)}
    accounts = "Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n" + "".join(
        f"{banks[a % 9]},{a % 9},A{a},E{a},Corp\n" for a in range(60) if a % 9 in banks
    )
    entries = ",\n".join(
        f'{{"date":"{day}","base":"USD","quote":"{iso}","rate":{rate!r}}}'
        for (day, iso), rate in quoted.items()
    )
    tx = normalize_transactions(read_transactions(spark, write(tmp_path, "t.csv", header + text)))
    if through_ledger:
        tx = land_ledger(tx, str(tmp_path / "ledger"))
    results = plans.run_all(
        tx,
        read_accounts(spark, write(tmp_path, "a.csv", accounts)),
        read_fx_rates(spark, write(tmp_path, "r.json", f"[{entries}]")),
        RiskParams(hub_paths=300 if through_ledger else 1_000_000),
    )
    expected = golden(rows, banks, quoted | btc_table(), 5)
    for query_id, result in results.items():
        path = sinks.write_query_csv(result, query_id, "t", str(tmp_path / "out"))
        lines = [r["value"] for r in spark.read.text(path).collect()]
        assert sorted(lines) == sorted(expected[query_id]), query_id
        assert lines
