"""Wall time of the five questions; prints one JSON line.

``direct`` runs read the source tables, ``ledger`` runs the Parquet ledger
written from them once (``ledger_landing``). Every query is run once to warm up
and then timed ``BENCH_RUNS`` times; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ledgerscope import plans
from ledgerscope.session import RECOMMENDED, scratch_path
from ledgerscope.sources import land_ledger
from ledgerscope.sources import order_tables as tables
from ledgerscope.sources.order_tables import PARAMS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# So low that most accounts of the test tables are hubs and the search around hubs is timed too.
HUB_PATHS = 1_000
NAMES = {
    1: "q1_low_usd",
    2: "q2_bank_name_join",
    3: "q3_anomaly_join",
    4: "q4_scatter_gather",
    5: "q5_count",
}


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ledgerscope-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS if CPUS.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(make: Callable[[], DataFrame]) -> float:
    """Planning, side tables and all rows of the result, which go nowhere."""
    seconds = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def questions(tx: DataFrame, accounts: DataFrame, rates: DataFrame):
    return {
        1: lambda: plans.low_usd_transfers(tx, PARAMS),
        2: lambda: plans.largest_per_bank(tx, accounts, PARAMS),
        3: lambda: plans.anomalous_transfers(tx, PARAMS),
        4: lambda: plans.scatter_gather_accounts(tx, PARAMS),
        5: lambda: plans.low_converted_count(tx, rates, PARAMS),
    }


def main() -> None:
    spark = session()
    tx = tables.transactions(spark, SF_DIR)
    accounts = tables.accounts(spark, SF_DIR)
    rates = tables.fx_rates(spark, SF_DIR)

    seconds = {}
    for number, make in questions(tx, accounts, rates).items():
        seconds[NAMES[number]] = timed(make)
    headline = round(sum(seconds.values()), 3)

    start = time.perf_counter()
    ledger = land_ledger(tx, scratch_path(spark, "ledger"), grain="month")
    seconds["ledger_landing"] = round(time.perf_counter() - start, 3)
    for number, make in questions(ledger, accounts, rates).items():
        seconds[f"ledger_{NAMES[number]}"] = timed(make)

    hubs = replace(PARAMS, hub_paths=HUB_PATHS)
    seconds["ledger_q4_many_hubs"] = timed(lambda: plans.scatter_gather_accounts(ledger, hubs))

    print(
        json.dumps(
            {
                "metric": "five questions, read from the source tables",
                "value": headline,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
