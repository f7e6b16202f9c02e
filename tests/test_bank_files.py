"""The five questions over bank files with the default parameters."""

from __future__ import annotations

from dataclasses import replace

import pytest
from bank_files import ACCOUNTS, TRANSACTIONS, btc_table, brute_converted, write

from ledgerscope import RiskParams, plans, sinks
from ledgerscope.operators import aggregates
from ledgerscope.operators.projections import (
    bank_catalog,
    normalize_transactions,
    normalize_valid_transactions,
    rejected_transactions,
)
from ledgerscope.schemas import FX_RATE, RAW_TRANSACTION, TRANSACTION
from ledgerscope.sources import (
    land_ledger,
    read_accounts,
    read_fx_rates,
    read_transactions,
    with_btc_rates,
)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    return read_transactions(spark, write(folder, "trans.csv", TRANSACTIONS))


@pytest.fixture(scope="module")
def tx(raw):
    return normalize_transactions(raw)


@pytest.fixture(scope="module")
def accounts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    return read_accounts(spark, write(folder, "accounts.csv", ACCOUNTS))


@pytest.fixture(scope="module")
def rates(spark):
    return with_btc_rates(spark.createDataFrame([], FX_RATE))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scan(raw, accounts):
    assert raw.columns == [*RAW_TRANSACTION.names, "bad_line"]
    assert raw.where("bad_line is not null").isEmpty()
    assert raw.count() == 8
    first = raw.orderBy("timestamp", "from_account").first()
    assert (first["from_bank"], first["from_account"], first["to_account"]) == ("010", "A1", "B1")
    assert [r["bank_name"] for r in accounts.where("account_number = 'B1'").collect()] == [
        "Second, Bank"
    ]


def test_count_alone(tx, raw):
    assert tx.count() == 8 and raw.where("bad_line is null").count() == 8


def test_normalised_types(tx):
    assert [(f.name, f.dataType) for f in tx.schema] == [
        (f.name, f.dataType) for f in TRANSACTION
    ]


def test_question_1(tx):
    assert sorted(r["amount_paid"] for r in plans.low_usd_transfers(tx).collect()) == [
        0.1, 0.3, 0.5, 0.995, 49.99,
    ]


def test_question_2(tx, accounts):
    assert rows(plans.largest_per_bank(tx, accounts)) == [
        ("First Bank", "A0", 50.0), ("Unknown", "A3", 0.995),
    ]
    assert rows(plans.largest_per_bank(tx, accounts, unmatched="drop")) == [
        ("First Bank", "A0", 50.0)
    ]


def test_question_3(tx):
    assert rows(plans.anomalous_transfers(tx)) == [("030", "A3", 0.3)]


def test_question_3_without_broadcast(tx):
    shuffled = plans.anomalous_transfers(tx, RiskParams(side_rows=0))
    assert rows(shuffled) == [("030", "A3", 0.3)]


def test_question_5(tx, rates):
    assert rows(plans.low_converted_count(tx, rates)) == [(1,)]
    assert rows(plans.low_converted_count(tx.where("false"), rates)) == [(0,)]


def test_question_5_without_broadcast(tx, rates):
    assert rows(plans.low_converted_count(tx, rates, RiskParams(side_rows=0))) == [(1,)]


def test_question_5_like_plain_python(spark, tx, rates):
    expected = sum(
        brute_converted(r["amount"], r["currency"], r["ts"].date(), btc_table()) < 30.0
        for r in tx.collect()
        if r["payment_format"].lower() in ("wire", "ach") and r["ts"].day <= 5
    )
    params = RiskParams(low_converted_amount=30.0)
    assert rows(plans.low_converted_count(tx, rates, params)) == [(expected,)] == [(2,)]


@pytest.mark.parametrize("grain", ["day", "month"])
def test_ledger_gives_the_same_answers(spark, tx, accounts, rates, tmp_path, grain):
    ledger = land_ledger(tx, str(tmp_path / "ledger"), grain=grain)
    from_ledger = plans.run_all(ledger, accounts, rates)
    for query_id, result in plans.run_all(tx, accounts, rates).items():
        assert rows(from_ledger[query_id]) == rows(result)
    plan = from_ledger[3]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(currency_key,us dollar)" in plan
    assert "PartitionFilters: [isnotnull(tx_" in plan


def test_ledger_of_clients_keeps_their_names(spark, tx, tmp_path):
    from pyspark.sql import functions as F

    clients = tx.withColumn("client_id", F.when(F.col("amount") < 1, "007").otherwise("8"))
    ledger = land_ledger(clients, str(tmp_path / "ledger"), by=["client_id"])
    assert rows(ledger.select(*clients.columns)) == rows(clients)
    low = plans.low_usd_transfers(ledger).groupBy("client_id").count()
    assert rows(low) == [("007", 4), ("8", 1)]


def test_results_by_client(spark, tx, tmp_path):
    from pyspark.sql import functions as F

    low = plans.low_usd_transfers(tx.withColumn("client_id", F.lit("1")))
    one = sinks.write_by_client({1: low, 3: low.limit(0)}, str(tmp_path / "out"))
    got = spark.read.schema("line string, client_id string, query_id int").text(one)
    assert got.count() == 5
    assert got.select("client_id", "query_id").distinct().count() == 1
    assert ("010,A1,020,B1,49.99", "1", 1) in rows(got)


def test_name_conflicts(accounts):
    conflicts = aggregates.bank_name_conflicts(bank_catalog(accounts))
    assert rows(conflicts) == [("20", 2, "Second Bank")]


def test_rejects(spark):
    good = ("2022/09/01 00:00", "1", "A", "2", "B", "1", "Euro", "1.5", "Euro", "ACH", "0")
    bad = [
        ("2022-09-01", *good[1:]),
        (*good[:7], "much", *good[8:]),
        (good[0], "one", *good[2:]),
    ]
    raw = spark.createDataFrame([good, *bad], RAW_TRANSACTION)
    reasons = rejected_transactions(raw).select("reject_reason")
    assert rows(reasons) == [("amount",), ("from_bank",), ("timestamp",)]
    assert normalize_valid_transactions(raw).count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        normalize_transactions(raw.where("amount_paid = 'much'")).collect()


def test_rates_formats(spark, tmp_path):
    array = '[{"date":"2022-09-01","base":"USD","quote":"EUR","rate":0.99},\n' \
        '{"date":"2022-09-01","base":"USD","quote":"BTC","rate":9.0}]'
    expected = read_fx_rates(spark, write(tmp_path, "r.json", array), btc=False)
    assert expected.count() == 2
    lines = array.strip("[]").replace("},\n", "}\n")
    assert rows(read_fx_rates(spark, write(tmp_path, "r.jsonl", lines), "jsonl", False)) == rows(
        expected
    )
    table = "date,base,quote,rate\n2022-09-01,USD,EUR,0.99\n2022-09-01,USD,BTC,9.0\n"
    assert rows(read_fx_rates(spark, write(tmp_path, "r.csv", table), "csv", False)) == rows(
        expected
    )
    parquet = str(tmp_path / "r.parquet")
    expected.toDF("date", "quote", "rate").write.parquet(parquet)
    with_btc = read_fx_rates(spark, parquet, "parquet")
    assert with_btc.where("iso = 'BTC'").count() == 5
    assert with_btc.where("rate = 9.0").count() == 0


def test_csv_output_text(spark, tmp_path):
    schema = "from_bank string, from_account string, to_bank string, to_account string, " \
        "amount_paid double"
    data = [("1", 'a"b', "x,y", "", 12345678.9), ("2", " c ", "d", "e", 1e-5)]
    df = spark.createDataFrame(data, schema).coalesce(1)
    path = sinks.write_query_csv(df, 1, "me", str(tmp_path))
    assert path.endswith("q1_client_me.csv")
    text = spark.read.text(path, wholetext=True).first()["value"]
    assert sorted(text.split("\r\n")) == ["", '1,"a""b","x,y",,12345678.9', "2, c ,d,e,1e-05"]
    assert [r["line"] for r in sinks.csv_lines(df).collect()] == text.split("\r\n")[:2]


def test_multiset_diff(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    assert rows(sinks.multiset_diff(a, b)) == [("x", 1.0, 1), ("z", 3.0, -1)]
    assert sinks.multiset_diff(a, a).isEmpty()


def test_clients_do_not_mix(spark, tx, accounts, rates):
    from pyspark.sql import functions as F

    one = tx.withColumn("client_id", F.lit("one"))
    two = tx.withColumn("client_id", F.lit("two")).where("amount < 50")
    both = one.unionByName(two)
    catalog = accounts.withColumn("client_id", F.explode(F.array(F.lit("one"), F.lit("two"))))
    together = plans.run_all(both, catalog, rates, by=["client_id"])
    for name, part in (("one", one), ("two", two)):
        alone = plans.run_all(part.drop("client_id"), accounts, rates)
        for query_id, result in together.items():
            mine = result.where(F.col("client_id") == name).drop("client_id")
            assert rows(mine) == rows(alone[query_id]), (name, query_id)


def test_ties_go_to_the_smallest_account(spark):
    import random

    rng = random.Random(5)
    data = [
        (f"{rng.randrange(4):03d}", rng.choice("abAB") + str(rng.randrange(3)), rng.randrange(3) / 2)
        for _ in range(400)
    ]
    tx = spark.createDataFrame(data, "from_bank string, from_account string, amount double")
    best = {}
    for bank, account, amount in data:
        key = str(int(bank))
        if key not in best or (-amount, account) < best[key]:
            best[key] = (-amount, account)
    expected = sorted((bank, account, -amount) for bank, (amount, account) in best.items())
    assert rows(aggregates.bank_max(tx)) == expected
    assert rows(aggregates.bank_max_window(tx)) == expected
    partial = aggregates.bank_max(tx.withColumn("part", tx.from_account), ["part"])
    assert rows(aggregates.merge_bank_max(partial)) == expected
    assert rows(aggregates.bank_max(replace_nan(tx))) == expected


def replace_nan(tx):
    """The same rows and one without a number for every account."""
    from pyspark.sql import functions as F

    return tx.unionByName(tx.withColumn("amount", F.lit(float("nan"))))


def test_params_are_values():
    assert replace(RiskParams(), low_usd_amount=1.0).low_usd_amount == 1.0
    assert RiskParams().scatter_period == RiskParams().period_1
