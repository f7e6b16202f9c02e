"""One query per operator. Each reads the tables of ``sf_dir`` whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import functions as fn
from ledgerscope import fingerprints, plans, sinks, streaming
from ledgerscope.operators import aggregates, filters, graph, joins
from ledgerscope.operators import projections as proj
from ledgerscope.session import land, remove, scratch_path, shuffles_removed
from ledgerscope.sources import (
    WHOLE,
    delivered_lines,
    land_ledger,
    numbered_transactions,
    read_accounts,
    read_fx_rates,
    read_transactions,
    stream_lines,
)
from ledgerscope.sources import order_tables as tables
from ledgerscope.sources.order_tables import PARAMS, STREAM_PARAMS

Query = Callable[[SparkSession, str], DataFrame]

K = PARAMS.min_intermediaries
SHARDS = 7
BY_CLIENT = ["client_id"]


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return tables.transactions(spark, sf)


def _client_tx(spark: SparkSession, sf: str) -> DataFrame:
    return tables.with_client(_tx(spark, sf))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return proj.bank_catalog(tables.accounts(spark, sf))


def _usd(spark: SparkSession, sf: str) -> DataFrame:
    return filters.usd_only(_tx(spark, sf), PARAMS)


def _usd_period_1(spark: SparkSession, sf: str) -> DataFrame:
    usd = _usd(spark, sf)
    return usd.where(filters.in_period(usd, PARAMS.period_1))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return joins.conversion_rates(tables.fx_rates(spark, sf), PARAMS.period_1, PARAMS)


def _conversion_rows(spark: SparkSession, sf: str) -> DataFrame:
    tx = _tx(spark, sf)
    rows = filters.require_fields(tx.where(filters.in_period(tx, PARAMS.period_1)), "conversion")
    return filters.with_payment_format(rows, PARAMS.conversion_formats)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.distinct_edges(graph.transfers(_tx(spark, sf), PARAMS))


def _flat(rows: DataFrame, *nodes: str, keep: tuple[str, ...] = ()) -> DataFrame:
    columns = [
        F.col(f"{node}.{field}").alias(f"{node}_{field}")
        for node in nodes
        for field in ("bank", "account")
    ]
    return rows.select(*columns, *keep)


# --- sources and sinks ---------------------------------------------------------


def scan_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The transactions written as a bank file and read back."""
    path = scratch_path(spark, "transactions-csv")
    tables.raw_transactions(_tx(spark, sf)).write.option("header", True).csv(path)
    raw = proj.whole_lines(read_transactions(spark, path)).drop("bad_line")
    amounts = {name: fn.float_parse(name) for name in ("amount_received", "amount_paid")}
    return raw.withColumns(amounts)


def damaged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A bank file with short lines, long lines and lines with empty fields: what is kept, and what is not."""
    path = scratch_path(spark, "damaged-csv")
    raw = tables.raw_transactions(_tx(spark, sf))
    kind = F.pmod(F.col("from_account").cast("long"), F.lit(4))
    fields = [F.col(c) for c in raw.columns]
    whole = F.concat_ws(",", *fields)
    raw.select(
        F.when(kind == 0, F.concat_ws(",", *fields[:9]))
        .when(kind == 1, F.concat(whole, F.lit(",more")))
        .when(kind == 2, F.concat_ws(",", *fields[:4], F.lit(""), *fields[5:]))
        .otherwise(whole)
    ).write.text(path)
    read = read_transactions(spark, path, header=False)
    kept = proj.normalize_valid_transactions(read).select("from_account", "to_account", F.lit("").alias("reason"))
    rejected = proj.rejected_transactions(read).select(
        F.split("bad_line", ",")[2].alias("from_account"), F.lit("").alias("to_account"),
        F.col("reject_reason").alias("reason"),
    )
    return kept.unionByName(rejected).groupBy("from_account", "to_account", "reason").agg(F.count("*").alias("tx_count"))


def scan_accounts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "accounts-csv")
    tables.accounts(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return proj.whole_lines(read_accounts(spark, path)).drop("bad_line")


def scan_fx_rates(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "rates-json")
    rates = tables.fx_rates(spark, sf)
    rates.select(
        F.col("rate_date").alias("date"), F.lit("USD").alias("base"),
        F.col("iso").alias("quote"), "rate",
    ).write.json(path)
    return read_fx_rates(spark, path, fmt="jsonl")


def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.run_appending(tables.event_stream(spark, sf), "stream-scan")


def stream_scan_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Bank files in two deliveries, read in byte ranges; all lines arrive twice and are kept once, by file and byte.

    What is done with is deleted at once: shuffles, and files whose lines are in the table.
    """
    files, table = scratch_path(spark, "numbered-csv"), scratch_path(spark, "numbered")
    tx = _tx(spark, sf)
    odd = F.pmod(F.col("from_account").cast("long"), F.lit(2)) == 1
    with shuffles_removed(spark):
        for rows in (tx.where(odd), tx.where(~odd)):
            tables.raw_transactions(rows).write.option("header", True).mode("append").csv(files)
            once, again = (delivered_lines(stream_lines(spark, files, split=1 << 20)) for _ in range(2))
            kept = streaming.drop_seen(once.unionByName(again), ["file", "line_start"], place="line_start")
            result = streaming.run_appending(numbered_transactions(kept, WHOLE), "numbered", table)
            remove(spark, files)
    return proj.normalize_transactions(result.drop("message_id"))


def sink_query_csv(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "out")
    path = sinks.write_query_csv(plans.low_usd_transfers(_tx(spark, sf), PARAMS), 1, "a", out)
    return spark.read.text(path).select(F.col("value").alias("line"))


def sink_by_client(spark: SparkSession, sf: str) -> DataFrame:
    """All five results of every client; three accounts between are enough."""
    tx, out = _client_tx(spark, sf), scratch_path(spark, "out")
    results = plans.run_all(
        tx,
        _accounts_of_clients(spark, sf, tx),
        tables.fx_rates(spark, sf),
        replace(PARAMS, min_intermediaries=3),
        BY_CLIENT,
    )
    sinks.write_by_client(results, out)
    return spark.read.schema("line string, client_id string, query_id int").text(out)


def verify_result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two questions against files of which one question has another limit."""
    tx, out, expected = _client_tx(spark, sf), scratch_path(spark, "out"), scratch_path(spark, "expected")
    anomalies = plans.anomalous_transfers(tx, PARAMS, BY_CLIENT)
    sinks.write_by_client({1: plans.low_usd_transfers(tx, PARAMS), 3: anomalies}, out)
    higher = replace(PARAMS, low_usd_amount=2 * PARAMS.low_usd_amount)
    sinks.write_by_client({1: plans.low_usd_transfers(tx, higher), 3: anomalies}, expected)
    return sinks.verify_by_client(spark, out, expected)


def _accounts_of_clients(spark: SparkSession, sf: str, tx: DataFrame) -> DataFrame:
    """Every client brings the same accounts file."""
    names = F.array(*[
        F.lit(f"client-{name}") for name in ("wire", "ach", "cheque", "credit card", "bitcoin")
    ])
    return tables.accounts(spark, sf).select("*", F.explode(names).alias("client_id"))


def verify_multiset(spark: SparkSession, sf: str) -> DataFrame:
    """Low transfers up to 10 against those up to 12."""
    tx = _tx(spark, sf)
    wider = replace(PARAMS, low_usd_amount=12.0)
    return sinks.multiset_diff(
        plans.low_usd_transfers(tx, PARAMS), plans.low_usd_transfers(tx, wider)
    )


def verify_multiset_quick(spark: SparkSession, sf: str) -> DataFrame:
    """All transfers against those where wires below 12 are missing: by fingerprints, then by rows of changed buckets."""
    tx = _tx(spark, sf)
    cut = tx.where((F.col("amount") >= 12) | (F.lower("payment_format") != "wire"))
    return fingerprints.quick_multiset_diff(proj.as_result(cut, 1), proj.as_result(tx, 1))


# --- projections ---------------------------------------------------------------


def tx_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return proj.normalize_transactions(tables.raw_transactions(_tx(spark, sf)))


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows where cheques have no readable amount and cards no readable time."""
    fmt = F.col("payment_format")
    return tables.raw_transactions(_tx(spark, sf)).withColumns(
        {
            "amount_paid": F.when(fmt == "Cheque", "n/a").otherwise(F.col("amount_paid")),
            "timestamp": F.when(fmt == "Credit Card", "?").otherwise(F.col("timestamp")),
        }
    )


def tx_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rejected = proj.rejected_transactions(_damaged(spark, sf))
    return rejected.groupBy("payment_format", "from_bank", "reject_reason").agg(
        F.count("*").alias("tx_count")
    )


def tx_normalize_valid(spark: SparkSession, sf: str) -> DataFrame:
    return proj.normalize_valid_transactions(_damaged(spark, sf))


def bank_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf)


def tx_for_conversion(spark: SparkSession, sf: str) -> DataFrame:
    return proj.for_conversion(_conversion_rows(spark, sf))


def usd_amount(spark: SparkSession, sf: str) -> DataFrame:
    return proj.usd_amounts(joins.with_usd_value(_conversion_rows(spark, sf), _rates(spark, sf)))


def project_results(spark: SparkSession, sf: str) -> DataFrame:
    """All USD rows in the shape of result 3."""
    return proj.as_result(_usd(spark, sf), 3)


def route_usd_all(spark: SparkSession, sf: str) -> DataFrame:
    return filters.route_usd_all(_tx(spark, sf), PARAMS)


# --- filters -------------------------------------------------------------------


def classify_period(spark: SparkSession, sf: str) -> DataFrame:
    return filters.classify_period(_tx(spark, sf), PARAMS)


def filter_payment_format(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_payment_format(_tx(spark, sf), PARAMS.conversion_formats)


def filter_required(spark: SparkSession, sf: str) -> DataFrame:
    tx = _tx(spark, sf)
    gaps = tx.withColumns(
        {
            "payment_format": F.nullif("payment_format", F.lit("Bitcoin")),
            "from_bank": F.nullif("from_bank", F.lit("005")),
            "to_bank": F.nullif("to_bank", F.lit("007")),
        }
    )
    steps = [
        filters.require_fields(gaps, step).withColumn("step", F.lit(step))
        for step in filters.REQUIRED_FIELDS
    ]
    return reduce(DataFrame.unionByName, steps)


def anomaly_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """How many USD rows of each format are anomalous; formats of period 1 only have averages."""
    averages = aggregates.format_averages(
        _usd_period_1(spark, sf).where("payment_format <> 'Cheque'")
    )
    side = joins.small_side(averages, PARAMS)
    keyed = _usd(spark, sf).withColumn("format_key", fn.format_key("payment_format"))
    flag = filters.is_anomalous("amount", "average_amount", PARAMS.anomaly_fraction)
    return (
        keyed.join(side, "format_key", "left")
        .groupBy("format_key", flag.alias("anomalous"))
        .agg(F.count("*").alias("tx_count"))
    )


def low_amount_predicate(spark: SparkSession, sf: str) -> DataFrame:
    priced = joins.with_usd_value(_tx(spark, sf), _rates(spark, sf))
    flag = filters.is_low_converted("converted", PARAMS.low_converted_amount)
    return priced.groupBy("currency", flag.alias("low")).agg(F.count("*").alias("tx_count"))


def degree_threshold(spark: SparkSession, sf: str) -> DataFrame:
    frequent = graph.frequent_accounts(graph.account_degrees(_edges(spark, sf)), K)
    return _flat(frequent, "node", keep=("in_degree", "out_degree"))


def path_endpoints_differ(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with different ends per account between."""
    return _flat(graph.paths_per_account(_edges(spark, sf), K), "mid", keep=("paths",))


def path_threshold(spark: SparkSession, sf: str) -> DataFrame:
    counts = graph.scatter_gather_counts(_edges(spark, sf), PARAMS)
    return _flat(counts, "src", "dst", keep=("mids",))


def path_threshold_hubs(spark: SparkSession, sf: str) -> DataFrame:
    counts = graph.scatter_gather_counts(_edges(spark, sf), replace(PARAMS, hub_paths=100))
    return _flat(counts, "src", "dst", keep=("mids",))


# --- joins ---------------------------------------------------------------------


def q2_bank_name_join(spark: SparkSession, sf: str) -> DataFrame:
    return plans.largest_per_bank(_tx(spark, sf), tables.accounts(spark, sf), PARAMS)


def q2_bank_name_join_drop(spark: SparkSession, sf: str) -> DataFrame:
    return plans.largest_per_bank(
        _tx(spark, sf), tables.accounts(spark, sf), PARAMS, unmatched="drop"
    )


def q3_anomaly_join(spark: SparkSession, sf: str) -> DataFrame:
    return plans.anomalous_transfers(_tx(spark, sf), PARAMS)


def fx_rate_join(spark: SparkSession, sf: str) -> DataFrame:
    priced = joins.with_usd_value(_conversion_rows(spark, sf), _rates(spark, sf))
    return priced.select("ts", "currency", "amount", "rate", "converted")


def fx_unmatched_rates(spark: SparkSession, sf: str) -> DataFrame:
    return joins.unmatched_rates(_conversion_rows(spark, sf), _rates(spark, sf))


def two_hop_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = graph.two_hop_paths(_edges(spark, sf), K, PARAMS.hub_paths)
    return _flat(paths, "src", "mid", "dst")


def frequent_edge_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(graph.frequent_edges(_edges(spark, sf), K), "src", "dst", keep=("is_scatter",))


# --- aggregates ----------------------------------------------------------------


def bank_max_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Partial maxima per payment format, as if each were one worker's share."""
    return aggregates.bank_max(_usd(spark, sf), ["payment_format"])


def q2_bank_max(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.bank_max(_usd(spark, sf))


def q2_bank_max_merged(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.merge_bank_max(bank_max_partial(spark, sf))


def q2_bank_max_window(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.bank_max_window(_usd(spark, sf))


def format_sum_count(spark: SparkSession, sf: str) -> DataFrame:
    totals = aggregates.format_totals(_usd_period_1(spark, sf))
    return totals.withColumn("total_amount", F.round("total_amount", 4))


def q3_format_average(spark: SparkSession, sf: str) -> DataFrame:
    averages = aggregates.format_averages(_usd_period_1(spark, sf))
    return averages.withColumn("average_amount", F.round("average_amount", 6))


def low_amount_count(spark: SparkSession, sf: str) -> DataFrame:
    """Low amounts of all dates per payment format."""
    priced = joins.with_usd_value(_tx(spark, sf), _rates(spark, sf))
    return aggregates.low_amount_count(priced, PARAMS.low_converted_amount, ["payment_format"])


def q5_count(spark: SparkSession, sf: str) -> DataFrame:
    return plans.low_converted_count(_tx(spark, sf), tables.fx_rates(spark, sf), PARAMS)


def q5_count_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return plans.low_converted_count(
        _client_tx(spark, sf), tables.fx_rates(spark, sf), PARAMS, BY_CLIENT
    )


def q3_anomaly_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return plans.anomalous_transfers(_client_tx(spark, sf), PARAMS, BY_CLIENT)


def account_degrees(spark: SparkSession, sf: str) -> DataFrame:
    degrees = graph.account_degrees(_edges(spark, sf))
    return _flat(degrees, "node", keep=("in_degree", "out_degree"))


def path_mid_count(spark: SparkSession, sf: str) -> DataFrame:
    counts = graph.path_counts(graph.two_hop_paths(_edges(spark, sf), K, PARAMS.hub_paths, together=True))
    return _flat(counts, "src", "dst", keep=("mids",))


# --- sets ----------------------------------------------------------------------


def bidirectional_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.bidirectional_edges(graph.transfers(_tx(spark, sf), PARAMS))
    return _flat(edges, "node", "other", keep=("is_sender",))


def distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_edges(spark, sf), "src", "dst")


def path_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return graph.path_endpoints(graph.scatter_gather_pairs(_edges(spark, sf), PARAMS))


def distinct_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """All accounts which take part in a transfer."""
    return graph.distinct_accounts(graph.path_endpoints(_edges(spark, sf)))


def bank_name_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.bank_name_conflicts(_catalog(spark, sf))


# --- scatter-gather ------------------------------------------------------------


def q4_scatter_gather(spark: SparkSession, sf: str) -> DataFrame:
    return plans.scatter_gather_accounts(_tx(spark, sf), PARAMS)


def q4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return plans.scatter_gather_account_pairs(_tx(spark, sf), PARAMS)


def q4_pairs_no_prune(spark: SparkSession, sf: str) -> DataFrame:
    return plans.scatter_gather_account_pairs(_tx(spark, sf), PARAMS, prune=False)


def q4_pairs_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs with the limit so low that nearly every account between is a hub."""
    low = replace(PARAMS, hub_paths=100)
    return plans.scatter_gather_account_pairs(_tx(spark, sf), low)


def q4_scatter_gather_hubs(spark: SparkSession, sf: str) -> DataFrame:
    low = replace(PARAMS, hub_paths=100)
    return plans.scatter_gather_accounts(_tx(spark, sf), low)


def q4_by_client(spark: SparkSession, sf: str) -> DataFrame:
    """Per payment format as client; three accounts between are enough."""
    fewer = replace(PARAMS, min_intermediaries=3)
    return plans.scatter_gather_accounts(_client_tx(spark, sf), fewer, BY_CLIENT)


# --- scalar functions ----------------------------------------------------------


def normalize_bank_id(spark: SparkSession, sf: str) -> DataFrame:
    bank_id = fn.normalize_bank_id("from_bank").alias("bank_id")
    return _tx(spark, sf).groupBy("from_bank", bank_id).agg(F.count("*").alias("tx_count"))


def format_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    padded = F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("\n "))
    return orders.groupBy(fn.format_key(padded).alias("format_key")).agg(
        F.count("*").alias("tx_count")
    )


def parse_ts(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")
    return orders.select("o_orderkey", fn.parse_ts(text).alias("ts"))


def rate_date(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", fn.rate_date("ts").alias("rate_date"))


def currency_iso(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _tx(spark, sf)
        .groupBy("currency", fn.currency_iso("currency").alias("iso"))
        .agg(F.count("*").alias("tx_count"))
    )


def convert_usd(spark: SparkSession, sf: str) -> DataFrame:
    """Every line's price at a rate taken from its discount, no discount meaning no rate."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    rate = F.nullif("l_discount", F.lit(0.0)) * 140.0
    value = fn.usd_value("l_extendedprice", rate)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", fn.round_cents(value).alias("usd")
    )


def stable_shard(spark: SparkSession, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    return customers.select("c_custkey", fn.stable_shard("c_custkey", SHARDS).alias("shard"))


def float_parse(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(
        "o_orderkey", fn.float_parse(fn.float_text("o_totalprice")).alias("amount")
    )


def float_text(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", fn.float_text("o_totalprice").alias("amount_text"))


# --- ledger --------------------------------------------------------------------


def ledger_q1(spark: SparkSession, sf: str) -> DataFrame:
    ledger = land_ledger(_tx(spark, sf), scratch_path(spark, "ledger"), grain="month")
    return plans.low_usd_transfers(ledger, PARAMS)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger brought in by two halves, the second one appended, the first one's months written anew."""
    path, tx = scratch_path(spark, "ledger"), land(_tx(spark, sf), "transactions")
    odd = F.pmod(F.col("from_account").cast("long"), F.lit(2)) == 1
    land_ledger(tx.where(~odd), path, grain="month")
    land_ledger(tx.where(~odd), path, grain="month", mode="parts")
    return land_ledger(tx.where(odd), path, grain="month", mode="append")


def ledger_q2(spark: SparkSession, sf: str) -> DataFrame:
    return plans.largest_per_bank(_ledger(spark, sf), tables.accounts(spark, sf), PARAMS)


def ledger_q4(spark: SparkSession, sf: str) -> DataFrame:
    return plans.scatter_gather_accounts(_ledger(spark, sf), PARAMS)


def ledger_q5(spark: SparkSession, sf: str) -> DataFrame:
    return plans.low_converted_count(_ledger(spark, sf), tables.fx_rates(spark, sf), PARAMS)


def ledger_q3(spark: SparkSession, sf: str) -> DataFrame:
    ledger = land_ledger(_tx(spark, sf), scratch_path(spark, "ledger"), grain="month")
    return plans.anomalous_transfers(ledger, PARAMS)


def _summaries(spark: SparkSession, sf: str, by: list[str] | None = None) -> plans.Summaries:
    """Ledger and states brought in together: one half, its parts once more, and the other half on top."""
    by = by or []
    path, tx = scratch_path(spark, "ledger"), land(_client_tx(spark, sf), "transactions")
    rates = tables.fx_rates(spark, sf)
    odd = F.pmod(F.col("from_account").cast("long"), F.lit(2)) == 1
    for rows, mode in ((tx.where(~odd), "replace"), (tx.where(~odd), "parts"), (tx.where(odd), "append")):
        ledger = land_ledger(rows, f"{path}/rows", by, "month", mode)
        summaries = plans.land_summaries(rows, ledger, rates, f"{path}/states", PARAMS, by, "month", mode)
    return summaries


def summary_q2(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf).largest_per_bank(tables.accounts(spark, sf))


def summary_q3(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf).anomalous_transfers()


def summary_q5(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf).low_converted_count()


def summary_q5_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf, BY_CLIENT).low_converted_count()


# --- streaming -----------------------------------------------------------------


def stream_q1(spark: SparkSession, sf: str) -> DataFrame:
    rows = plans.low_usd_transfers(tables.event_stream(spark, sf), STREAM_PARAMS)
    return streaming.run_appending(rows, "stream-q1")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event arrives twice and is kept once."""
    twice = tables.event_stream(spark, sf).unionByName(tables.event_stream(spark, sf))
    return streaming.run_appending(streaming.drop_seen(twice), "stream-dedup")


def stream_dedup_watermark(spark: SparkSession, sf: str) -> DataFrame:
    twice = tables.event_stream(spark, sf).unionByName(tables.event_stream(spark, sf))
    return streaming.run_appending(
        streaming.drop_seen(twice, event_time="ts", delay="40 days"), "stream-dedup"
    )


def stream_dedup_evicting(spark: SparkSession, sf: str) -> DataFrame:
    """The month in six deliveries, each of them twice, with a delay that lets ids of earlier deliveries go."""
    path = scratch_path(spark, "deliveries")
    events = tables.batch_events(spark, sf)
    sixth = F.floor((F.dayofmonth("ts") - 1) / 6)
    for number in range(6):
        for _ in range(2):
            events.where(sixth == number).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return streaming.run_appending(
        streaming.drop_seen(stream, event_time="ts", delay="7 days"), "stream-dedup"
    )


def stream_bank_max(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.running_bank_max(tables.event_stream(spark, sf), STREAM_PARAMS)


def stream_format_avg(spark: SparkSession, sf: str) -> DataFrame:
    averages = streaming.running_format_averages(tables.event_stream(spark, sf), STREAM_PARAMS)
    return averages.select(
        "format_key",
        F.round("total_amount", 4).alias("total_amount"),
        "tx_count",
        F.round("average_amount", 6).alias("average_amount"),
    )


def stream_low_count(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.running_low_count(
        tables.event_stream(spark, sf), tables.event_rates(spark, sf), STREAM_PARAMS
    )


def stream_low_count_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.running_low_count(
        tables.event_stream(spark, sf), tables.event_rates(spark, sf), STREAM_PARAMS, BY_CLIENT
    )


def stream_side_input(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.staged_anomalies(tables.event_stream(spark, sf), STREAM_PARAMS, BY_CLIENT)


def stream_side_input_held(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the later period first, then the earlier ones with marks of two of the three clients; the third waits on."""
    path = scratch_path(spark, "held")
    events = tables.batch_events(spark, sf)
    later = F.col("ts") >= F.lit(STREAM_PARAMS.period_2.start)
    marks = spark.createDataFrame([("client-0", "end"), ("client-1", "side")], "client_id string, mark string")
    for rows, said in ((events.where(later), marks.limit(0)), (events.where(~later), marks)):
        rows.write.mode("append").parquet(f"{path}/rows")
        said.write.mode("append").parquet(f"{path}/marks")
        result = streaming.held_anomalies(
            spark.readStream.schema(events.schema).parquet(f"{path}/rows"),
            spark.readStream.schema(marks.schema).parquet(f"{path}/marks"),
            STREAM_PARAMS,
            f"{path}/kept",
            BY_CLIENT,
        )
    return result


def stream_edges(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.staged_scatter_gather(tables.event_stream(spark, sf), STREAM_PARAMS, BY_CLIENT)


def stream_edges_growing(spark: SparkSession, sf: str) -> DataFrame:
    """All edges in four batches, each joined with the state that those before it left."""
    path = scratch_path(spark, "edge-files")
    events = tables.batch_events(spark, sf)
    events.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return streaming.growing_scatter_gather(stream, STREAM_PARAMS, BY_CLIENT, buckets=8)


def stream_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.running_bank_max(tables.event_stream(spark, sf), STREAM_PARAMS, BY_CLIENT)


QUERIES: dict[str, Query] = {
    "scan_transactions": scan_transactions,
    "damaged_lines": damaged_lines,
    "scan_accounts": scan_accounts,
    "scan_fx_rates": scan_fx_rates,
    "stream_scan": stream_scan,
    "stream_scan_numbered": stream_scan_numbered,
    "sink_query_csv": sink_query_csv,
    "sink_by_client": sink_by_client,
    "verify_multiset": verify_multiset,
    "verify_multiset_quick": verify_multiset_quick,
    "verify_result_files": verify_result_files,
    "tx_normalize": tx_normalize,
    "tx_normalize_valid": tx_normalize_valid,
    "tx_rejected": tx_rejected,
    "bank_catalog": bank_catalog,
    "tx_for_conversion": tx_for_conversion,
    "usd_amount": usd_amount,
    "project_results": project_results,
    "route_usd_all": route_usd_all,
    "filter_usd": _usd,
    "q1_low_usd": lambda spark, sf: plans.low_usd_transfers(_tx(spark, sf), PARAMS),
    "classify_period": classify_period,
    "filter_payment_format": filter_payment_format,
    "filter_required": filter_required,
    "anomaly_predicate": anomaly_predicate,
    "low_amount_predicate": low_amount_predicate,
    "degree_threshold": degree_threshold,
    "path_endpoints_differ": path_endpoints_differ,
    "path_threshold": path_threshold,
    "path_threshold_hubs": path_threshold_hubs,
    "q2_bank_name_join": q2_bank_name_join,
    "q2_bank_name_join_drop": q2_bank_name_join_drop,
    "q3_anomaly_join": q3_anomaly_join,
    "q3_anomaly_by_client": q3_anomaly_by_client,
    "fx_rate_join": fx_rate_join,
    "fx_unmatched_rates": fx_unmatched_rates,
    "two_hop_paths": two_hop_paths,
    "frequent_edge_semijoin": frequent_edge_semijoin,
    "bank_max_partial": bank_max_partial,
    "q2_bank_max": q2_bank_max,
    "q2_bank_max_merged": q2_bank_max_merged,
    "q2_bank_max_window": q2_bank_max_window,
    "format_sum_count": format_sum_count,
    "format_sum_exact": lambda spark, sf: aggregates.exact_format_totals(_usd_period_1(spark, sf)),
    "q3_format_average": q3_format_average,
    "low_amount_count": low_amount_count,
    "q5_count": q5_count,
    "q5_count_by_client": q5_count_by_client,
    "account_degrees": account_degrees,
    "path_mid_count": path_mid_count,
    "bidirectional_edges": bidirectional_edges,
    "distinct_edges": distinct_edges,
    "path_endpoints": path_endpoints,
    "distinct_accounts": distinct_accounts,
    "bank_name_conflicts": bank_name_conflicts,
    "q4_scatter_gather": q4_scatter_gather,
    "q4_scatter_gather_hubs": q4_scatter_gather_hubs,
    "q4_pairs": q4_pairs,
    "q4_pairs_no_prune": q4_pairs_no_prune,
    "q4_pairs_hubs": q4_pairs_hubs,
    "q4_by_client": q4_by_client,
    "normalize_bank_id": normalize_bank_id,
    "format_key": format_key,
    "parse_ts": parse_ts,
    "rate_date": rate_date,
    "currency_iso": currency_iso,
    "convert_usd": convert_usd,
    "stable_shard": stable_shard,
    "float_parse": float_parse,
    "float_text": float_text,
    "ledger_q1": ledger_q1,
    "ledger_q2": ledger_q2,
    "ledger_q3": ledger_q3,
    "ledger_q4": ledger_q4,
    "ledger_q5": ledger_q5,
    "summary_q2": summary_q2,
    "summary_q3": summary_q3,
    "summary_q5": summary_q5,
    "summary_q5_by_client": summary_q5_by_client,
    "stream_q1": stream_q1,
    "stream_dedup": stream_dedup,
    "stream_dedup_watermark": stream_dedup_watermark,
    "stream_dedup_evicting": stream_dedup_evicting,
    "stream_bank_max": stream_bank_max,
    "stream_format_avg": stream_format_avg,
    "stream_low_count": stream_low_count,
    "stream_low_count_by_client": stream_low_count_by_client,
    "stream_side_input": stream_side_input,
    "stream_side_input_held": stream_side_input_held,
    "stream_edges": stream_edges,
    "stream_edges_growing": stream_edges_growing,
    "stream_by_client": stream_by_client,
}
