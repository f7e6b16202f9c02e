"""Lines that do not fit, empty fields, and text that only looks like a number or a time."""

from __future__ import annotations

import pytest
from bank_files import TRANSACTIONS, write
from pyspark.sql import functions as F

from ledgerscope import functions as fn
from ledgerscope import plans
from ledgerscope.operators.joins import with_bank_name
from ledgerscope.operators.projections import (
    normalize_transactions,
    normalize_valid_transactions,
    rejected_transactions,
)
from ledgerscope.params import RiskParams
from ledgerscope.sources import read_transactions

HEADER = TRANSACTIONS.splitlines()[0]
WHOLE = "2022/09/01 00:00,1,A,2,B,6.0,US Dollar,6.0,US Dollar,Wire,0"
EMPTY = WHOLE.replace(",B,", ",,")
SHORT = ",".join(WHOLE.split(",")[:9])
LONG = WHOLE + ",more"


def read(spark, tmp_path, *lines):
    write(tmp_path, "t.csv", "\n".join([HEADER, *lines]) + "\n")
    return read_transactions(spark, str(tmp_path / "t.csv"))


def test_empty_field_stays(spark, tmp_path):
    tx = normalize_transactions(read(spark, tmp_path, WHOLE, EMPTY))
    low = plans.low_usd_transfers(tx).collect()
    assert sorted(r.to_account for r in low) == ["", "B"]


@pytest.mark.parametrize("line", [SHORT, LONG])
def test_bad_line_is_an_error_or_rejected(spark, tmp_path, line):
    raw = read(spark, tmp_path, WHOLE, line)
    for result in (normalize_transactions(raw), plans.low_usd_transfers(normalize_transactions(raw))):
        with pytest.raises(Exception, match="has not the fields"):
            result.collect()
    assert normalize_valid_transactions(raw).select("from_account").count() == 1
    (rejected,) = rejected_transactions(raw).collect()
    assert rejected.reject_reason == "fields" and rejected.bad_line == line


def test_type_letters_are_no_numbers(spark):
    texts = ["9.0d", "9F", "1e3", " 2.5 ", "inf", "-INF", "NaN", "1e3d", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in frame.select(fn.float_parse("t", strict=False)).collect()]
    assert got == ["None", "None", "1000.0", "2.5", "inf", "-inf", "nan", "None", "None", "None"]
    with pytest.raises(Exception, match="not a number"):
        frame.where("t = '9.0d'").select(fn.float_parse("t")).collect()


def test_time_without_a_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2022/03/13 02:30", "2022/13/01 00:00", "2022-03-13 02:30", "2022/3/13 02:30", "x", None]
        frame = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [str(r[0]) for r in frame.select(fn.parse_ts("t", strict=False)).collect()]
        assert got == ["2022-03-13 02:30:00", *["None"] * 5]
        strict = frame.where("t = '2022/03/13 02:30'").select(fn.parse_ts("t")).first()[0]
        assert str(strict) == "2022-03-13 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bank_without_a_name_is_not_an_unknown_bank(spark):
    maxima = spark.createDataFrame([("1", 2.0), ("2", 3.0)], "bank_id string, amount double")
    names = spark.createDataFrame([("1", None)], "bank_id string, bank_name string")
    both = with_bank_name(maxima, names, RiskParams()).orderBy("bank_id").collect()
    assert [r.bank_name for r in both] == [None, "Unknown"]
    known = with_bank_name(maxima, names, RiskParams(), unmatched="drop").collect()
    assert [(r.bank_id, r.bank_name) for r in known] == [("1", None)]


def test_second_day_leaves_the_first_days_files(spark, tmp_path):
    from ledgerscope.sources import land_ledger

    later = WHOLE.replace("09/01", "09/02")
    path = str(tmp_path / "ledger")
    tx = normalize_transactions(read(spark, tmp_path, WHOLE))
    land_ledger(tx, path)
    files = sorted(p.name for p in (tmp_path / "ledger" / "tx_date=2022-09-01").glob("*.parquet"))
    more = normalize_transactions(read(spark, tmp_path, later))
    assert land_ledger(more, path, mode="parts").count() == 2
    assert land_ledger(more, path, mode="parts").count() == 2
    assert land_ledger(more, path, mode="append").count() == 3
    assert sorted(p.name for p in (tmp_path / "ledger" / "tx_date=2022-09-01").glob("*.parquet")) == files
    assert land_ledger(more, path).where(F.col("amount") == 6.0).count() == 1
