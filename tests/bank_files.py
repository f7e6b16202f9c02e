"""The small bank files of the tests and a plain Python statement of the five questions."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from pathlib import Path

from ledgerscope.functions import BTC_RATES, CURRENCY_ISO

TRANSACTIONS = """\
Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering
2022/09/01 00:00,010,A1,020,B1,49.99,US Dollar,49.99,US Dollar,Wire,0
2022/09/05 23:59,010,A0,020,B1,50.0,US Dollar,50.0,US Dollar,ACH,0
2022/09/05 23:59,10,A2,020,B2,50.0,US Dollar,50.0,us dollar,ach,0

2022/09/06 00:00,030,A3,020,B2,0.3,US Dollar,0.3,US Dollar,ACH,0
2022/09/15 23:59,030,A3,020,B2,0.5,US Dollar,0.5,US Dollar,ACH,0
2022/09/16 00:00,030,A3,020,B2,0.1,US Dollar,0.1,US Dollar,ACH,0
2022/09/02 10:00,030,A3,020,B2,0.995,US Dollar,0.995,US Dollar,Wire,0
2022/09/02 10:00,030,A3,020,B2,0.0001,Bitcoin,0.0001,Bitcoin,Wire,0
"""

ACCOUNTS = """\
Bank Name,Bank ID,Account Number,Entity ID,Entity Name
First Bank,10,A1,E1,Corp 1
First Bank,010,A2,E2,Corp 2
"Second, Bank",20,B1,E3,Corp 3
Second Bank,020,B2,E4,Corp 4
"""


def write(folder: Path, name: str, text: str) -> str:
    path = folder / name
    path.write_text(text)
    return str(path)


def scatter_gather_edges() -> list[tuple[str, str]]:
    edges = [("S", f"M{i}") for i in range(1, 6)] + [(f"M{i}", "G") for i in range(1, 6)]
    edges += [("S", f"N{i}") for i in range(1, 5)] + [(f"N{i}", "H") for i in range(1, 5)]
    edges += [("S", "M1")] + [(f"M{i}", "S") for i in range(1, 6)]
    edges += [("P", f"L{i}") for i in range(1, 5)] + [(f"L{i}", "Q") for i in range(1, 5)]
    return edges + [("P", "P"), ("P", "Q")]


def brute_counts(edges) -> dict:
    out = defaultdict(set)
    for source, target in edges:
        out[source].add(target)
    mids = defaultdict(set)
    for source, targets in list(out.items()):
        for mid in targets:
            for target in out.get(mid, ()):
                if target != source:
                    mids[source, target].add(mid)
    return {pair: len(between) for pair, between in mids.items()}


def brute_pairs(edges, k: int) -> set:
    return {pair for pair, mids in brute_counts(edges).items() if mids >= k}


def brute_converted(amount: float, currency: str, day, rates: dict) -> float:
    iso = CURRENCY_ISO.get(currency.lower())
    rate = rates.get((day, iso), 1.0) if iso else 1.0
    return round(amount * (1.0 / rate), 2)


def btc_table() -> dict:
    return {(day, "BTC"): rate for day, rate in BTC_RATES.items()}


def at(text: str) -> datetime:
    return datetime.strptime(text, "%Y/%m/%d %H:%M")
