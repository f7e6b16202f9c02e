"""Rows that wait in keyed state until their client's side table is complete.

A client says by a mark when its rows of period 1 are all sent (``side``) and when all its rows are (``end``, which says
the first as well). Until then its rows of period 2 are held in state; after it they come out once and are judged, and later
ones pass without a stop. ``end`` also takes the client out of the state. Held rows are spread over ``spread`` keys
per client, so that a client with a third of all rows is held and released by many tasks, and are kept as a list
that is added to, not written anew, in each batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ledgerscope.operators import filters, joins
from ledgerscope.operators.projections import as_result
from ledgerscope.params import RiskParams
from ledgerscope.session import ship_package
from ledgerscope.streaming.running import running_format_averages
from ledgerscope.streaming.tables import run_appending

SIDE, END = "side", "end"
SPREAD = 16
PIECE = 10_000  # rows handed back to Spark at once
_ROW, _RELEASE, _DROP = 0, 1, 2
# Text forms that give back the same values, down to the microsecond.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # With timers a run that ends would otherwise go on with empty batches for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class _Hold(StatefulProcessor):
    """State of a key: the rows held, and whether the key has been released."""

    def __init__(self, patience: int | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "row string")
        self.released = handle.getValueState("released", "released boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passing, release, drop = self.released.exists(), False, False
        for batch in rows:
            release = release or bool((batch["kind"] == _RELEASE).any())
            drop = drop or bool((batch["kind"] == _DROP).any())
            arrived = batch.loc[batch["kind"] == _ROW, "row"]
            if passing and len(arrived):
                yield pd.DataFrame({"row": arrived})
            elif len(arrived):
                self.held.appendList([(row,) for row in arrived])
        if not passing and (release or drop):
            yield from self._flush()
            self.released.update((True,))
        if drop:
            self.released.clear()
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not drop:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(now + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.released.clear()
        yield from ()

    def _flush(self) -> Iterator[pd.DataFrame]:
        held = (row for (row,) in self.held.get())
        while piece := list(islice(held, PIECE)):
            yield pd.DataFrame({"row": piece})
        self.held.clear()

    def close(self) -> None:
        """Nothing is open besides the state."""


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _signals(spark: SparkSession, path: str, schema: StructType, by: Sequence[str], kind: int, spread: int) -> DataFrame:
    """A folder of marks as a stream, one signal for each key of the client."""
    marks = spark.readStream.schema(schema).parquet(path)
    places = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_place")
    return marks.select(*by, places, F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("row"))


def _held(rows: DataFrame, signals: Sequence[DataFrame], by: Sequence[str], patience: int | None) -> DataFrame:
    held = [c for c in rows.columns if c != "_place"]
    text = F.to_json(F.struct(*held), _JSON).alias("row")
    keyed = rows.select(*by, "_place", F.lit(_ROW).alias("kind"), text)
    for signal in signals:
        keyed = keyed.unionByName(signal)
    return keyed.groupBy(*by, "_place").transformWithStateInPandas(
        _Hold(patience), outputStructType="row string", outputMode="append", timeMode="processingTime"
    )


def held_anomalies(
    stream: DataFrame,
    marks: DataFrame,
    params: RiskParams,
    path: str,
    by: Sequence[str] = ("client_id",),
    spread: int = SPREAD,
    patience_ms: int | None = None,
) -> DataFrame:
    """Anomalous rows of period 2 of the clients whose averages are complete: what has come out so far.

    ``marks`` is a stream of the columns ``by`` and ``mark`` (``side`` or ``end``; other values are ignored). ``path`` keeps state and
    results between runs: each run reads only what came in since, and each row is judged once, by averages that are final. The
    marks of a run are taken first, so all rows sent before a mark are there when it takes effect.

    A mark delivered twice is to be dropped beforehand, by ``drop_seen``. A row of period 2 that comes after its client's ``end`` belongs to a
    new transmission: it waits for the next mark. Rows of a client without a mark are held for as long as it takes; with ``patience_ms`` a
    client that has sent nothing for so long is forgotten with the rows it has in state. Rows without a client match no average, as
    in batch. A run killed at any place is made good by the next one: batches are written under their number.
    """
    spark = stream.sparkSession
    ship_package(spark)
    known = marks.where(F.col("mark").isin(SIDE, END)).select(*by, "mark")
    run_appending(known, "marks", f"{path}/marks")
    averages = running_format_averages(stream, params, by, f"{path}/averages")
    side = joins.small_side(averages.select(*by, "format_key", "average_amount"), params)

    later = filters.usd_only(stream.where(filters.in_period(stream, params.period_2)), params)
    # By all columns of the stream, so that transfers alike in what is kept of them still go to several keys.
    place = F.pmod(F.xxhash64(*stream.columns), F.lit(spread)).cast("int").alias("_place")
    placed = filters.require_fields(later, "anomaly").select(
        *by, "from_bank", "from_account", "amount", "payment_format", place
    )
    rows = placed.drop("_place")
    ends = f"{path}/ends/table"
    spark.createDataFrame([], known.schema).write.mode("ignore").parquet(ends)
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/out/none")

    def write(released: DataFrame, batch_id: int) -> None:
        parsed = released.select(F.from_json("row", rows.schema, _JSON).alias("row")).select("row.*")
        judged = joins.anomalies(parsed, side, params, by)
        judged.write.mode("overwrite").parquet(f"{path}/out/{batch_id:012d}")

    def run() -> None:
        signals = [
            _signals(spark, f"{path}/marks/table", known.schema, by, _RELEASE, spread),
            _signals(spark, ends, known.schema, by, _DROP, spread),
        ]
        query = (
            _held(placed, signals, by, patience_ms)
            .writeStream.outputMode("append")
            .foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    with _settings(spark):
        run()
        # Only now that all rows sent before them are through do the ends take effect.
        before = spark.read.schema(known.schema).parquet(ends).count()
        done = spark.readStream.schema(known.schema).parquet(f"{path}/marks/table")
        if run_appending(done.where(F.col("mark") == END), "ends", f"{path}/ends").count() > before:
            run()
    out = spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
    return as_result(out, 3)


def held_counts(spark: SparkSession, path: str, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """How many rows each client has in the state that ``held_anomalies`` keeps below ``path``."""
    with _settings(spark):
        state = (
            spark.read.format("statestore")
            .option("stateVarName", "held")
            .option("path", f"{path}/checkpoint")
            .load()
        )
    return state.groupBy(*[F.col(f"key.{c}").alias(c) for c in by]).agg(F.count("*").alias("held"))
