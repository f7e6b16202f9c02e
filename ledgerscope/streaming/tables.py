"""Running a stream into a table of files, and dropping repeated messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerscope.session import scratch_path
from ledgerscope.streaming.places import drop_seen_places


def run_appending(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run a stream whose rows are final once written; give the table it wrote.

    ``path`` names a folder kept between runs: the next run then takes up only
    what came in since.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    # A stream without input writes nothing; the table is then there and empty.
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/table")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("compression", "zstd")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_updating(
    stream: DataFrame, keys: Sequence[str], label: str, path: str | None = None
) -> DataFrame:
    """Run a streaming aggregate; give its newest row of every key.

    There are two folders, and a batch writes the state of all keys into the one that the batch before it
    did not write, from that one and the keys it changed. So a repeated batch starts from the same state,
    nothing is counted twice after a failure, and the history does not grow with the batches. The
    state has one row per key, which is little beside the rows that are read.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    schema = stream.schema

    versions = StructType([*schema.fields, StructField("row_batch", LongType()), StructField("batch", LongType())])

    def slot(number: int) -> str:
        return f"{path}/state/slot={number % 2}"

    def newest(rows: DataFrame) -> DataFrame:
        picked = F.max_by(F.struct(*schema.names, "row_batch"), "row_batch").alias("newest")
        return rows.groupBy(*keys).agg(picked).where(F.col("newest").isNotNull()).select("newest.*")

    def write(changed: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(versions).parquet(slot(batch_id + 1)).drop("batch")
        now = before.unionByName(changed.withColumn("row_batch", F.lit(batch_id).cast("long")))
        state = newest(now).withColumn("batch", F.lit(batch_id).cast("long"))
        state.write.mode("overwrite").parquet(slot(batch_id))

    for number in (0, 1):
        spark.createDataFrame([], versions).write.mode("ignore").parquet(slot(number))
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    states = spark.read.schema(versions).parquet(slot(0), slot(1))
    last = states.agg(F.max("batch").alias("batch")).first()["batch"]
    return states.where(F.col("batch") == F.lit(last)).select(*schema.names)


def drop_seen(
    stream: DataFrame,
    keys: Sequence[str] = ("client_id", "message_id"),
    event_time: str | None = None,
    delay: str = "1 hour",
    place: str | None = None,
) -> DataFrame:
    """Drop messages delivered again, by client and message id.

    Without ``event_time`` every id is remembered, exactly but without end. With
    it an id is forgotten once ``delay`` has passed behind the newest event
    time, for systems which deliver again within that delay. ``place`` names a key that is
    a place in a file: neighbours are then shuffled and remembered together, in much less space.
    """
    if place is not None:
        if event_time is not None or place not in keys:
            raise ValueError("place is one of the keys, and places are remembered without end")
        return drop_seen_places(stream, keys, place)
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    columns = stream.columns
    return (
        stream.withColumn("_watermark", F.col(event_time).cast("timestamp"))
        .withWatermark("_watermark", delay)
        .dropDuplicatesWithinWatermark(list(keys))
        .select(*columns)
    )
