"""Scatter-gather kept up to date while edges arrive.

The state is a folder of tables to which every batch adds a part of its own; nothing is rewritten:

* ``out_edges`` and ``in_edges``: the distinct edges, stored by sender and by receiver;
* ``degrees``: what each batch added to the in- and out-degrees;
* ``first`` and ``second``: edges that may be the first half of a path (their sender pays k accounts) and the second half
  (their receiver is paid by k), stored by the account between. Degrees only grow, so an edge enters once: when
  it arrives, or when its account gets its k-th partner;
* ``pairs``: how many accounts between each batch added to a pair (src, dst);
* ``found``: accounts at either end of a pair that has reached k.

With F and S the halves before a batch and dF and dS those it adds, new paths are dF x S, F x dS and dF x dS, each
found exactly once. A batch reads of the stored tables only the buckets (a hash of the key) that its own keys fall
in, and joins on these keys. A batch that is repeated after a failure overwrites its own part, and reads
only parts of batches before it, so nothing counts twice.

Paths over an account with more than ``hub_paths`` pairs are not counted one by one. From the batch that brings such a hub
on, only edges are kept, and the accounts come from the search over all edges, which leaves hubs out and is as exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ledgerscope.operators import graph
from ledgerscope.operators.projections import as_result
from ledgerscope.params import RiskParams
from ledgerscope.session import land, scratch_path


class GrowingGraph:
    """The state below ``path``; made there if the folder is new."""

    def __init__(self, spark: SparkSession, path: str, params: RiskParams, by: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.params, self.buckets = spark, path, params, buckets
        node = StructType([StructField(name, StringType()) for name in (*by, "bank", "account")])

        def layout(nodes: Sequence[str], numbers: Sequence[str] = ()) -> StructType:
            fields = [StructField(n, node) for n in nodes] + [StructField(n, LongType()) for n in numbers]
            return StructType([*fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])

        self.tables = {
            "out_edges": ("src", layout(("src", "dst"))),
            "in_edges": ("dst", layout(("src", "dst"))),
            "degrees": ("node", layout(("node",), ("into", "out"))),
            "first": ("mid", layout(("src", "mid"))),
            "second": ("mid", layout(("mid", "dst"))),
            "pairs": ("src", layout(("src", "dst"), ("mids",))),
            "found": ("node", layout(("node",))),
            "hubs": ("node", layout(("node",))),
        }
        for name, (_, schema) in self.tables.items():
            columns = StructType([f for f in schema if f.name not in ("batch", "bucket")])
            spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{path}/{name}/batch=-1/bucket=0")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        key, schema = self.tables[name]
        columns = [f.name for f in schema if f.name not in ("batch", "bucket")]
        part = rows.select(*columns).withColumn("bucket", self._bucket(key))
        part.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table of the state, or what batches before one added."""
        _, schema = self.tables[name]
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def touched(self, name: str, keys: DataFrame, before: int) -> DataFrame:
        """Rows of earlier batches whose key is in ``keys`` (one column, named as the key of the table)."""
        key, schema = self.tables[name]
        parts = [r[0] for r in keys.select(self._bucket(key)).distinct().collect()]  # at most ``buckets`` numbers
        rows = self.read(name, before).where(F.col("bucket").isin(parts))
        return rows.join(keys.distinct(), key, "left_semi").select(*[f.name for f in schema if f.name not in ("batch", "bucket")])

    def add(self, edges: DataFrame, batch: int) -> None:
        """Take up a batch of edges (src, dst), new or known ones."""
        k = self.params.min_intermediaries
        given = land(edges.select("src", "dst").distinct(), "batch-edges")
        known = self.touched("out_edges", given.select("src"), batch)
        new = land(given.join(known, ["src", "dst"], "left_anti"), "new-edges")
        self._write("out_edges", new, batch)
        self._write("in_edges", new, batch)
        if not self.read("hubs", batch).isEmpty():
            return

        ends = F.array(
            F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")),
            F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")),
        )
        added = land(
            new.select(F.inline(ends)).groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")), "degrees"
        )
        before = (
            self.touched("degrees", added.select("node"), batch)
            .groupBy("node").agg(F.sum("into").alias("into_before"), F.sum("out").alias("out_before"))
        )
        now = land(
            added.join(before, "node", "left").fillna(0, ["into_before", "out_before"])
            .withColumn("into_now", F.col("into") + F.col("into_before")).withColumn("out_now", F.col("out") + F.col("out_before")),
            "now",
        )
        self._write("degrees", added, batch)

        def halves(end: str, table: str, count: str) -> DataFrame:
            """Edges that become halves: new ones of accounts with k partners, and all earlier ones of those that have k since now."""
            enough = now.where(F.col(f"{count}_now") >= k).select(F.col("node").alias(end), (F.col(f"{count}_before") < k).alias("since_now"))
            fresh = new.join(enough.select(end), end, "left_semi")
            earlier = self.touched(table, enough.where("since_now").select(end), batch)
            return fresh.select("src", "dst").unionByName(earlier.select("src", "dst"))

        first = land(halves("src", "out_edges", "out").withColumnRenamed("dst", "mid"), "first")
        second = land(halves("dst", "in_edges", "into").withColumnRenamed("src", "mid"), "second")
        self._write("first", first, batch)
        self._write("second", second, batch)

        first_before = land(self.touched("first", second.select("mid"), batch), "first-before")
        second_before = land(self.touched("second", first.select("mid"), batch), "second-before")
        if self._meets_hub(first, second, first_before, second_before, batch):
            return
        different = F.col("src") != F.col("dst")
        paths = (
            first.join(second_before, "mid").where(different).select("src", "dst")
            .unionByName(first_before.join(second, "mid").where(different).select("src", "dst"))
            .unionByName(first.join(second, "mid").where(different).select("src", "dst"))
        )
        counted = land(paths.groupBy("src", "dst").agg(F.count("*").alias("mids")), "counted")
        self._write("pairs", counted, batch)
        keys = counted.select("src", "dst")
        earlier = self.touched("pairs", counted.select("src"), batch).join(keys, ["src", "dst"], "left_semi")
        reached = (
            counted.unionByName(earlier).groupBy("src", "dst").agg(F.sum("mids").alias("mids")).where(F.col("mids") >= k)
        )
        nodes = land(reached.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "reached")
        self._write("found", nodes.join(self.touched("found", nodes, batch), "node", "left_anti"), batch)

    def _meets_hub(self, first: DataFrame, second: DataFrame, first_before: DataFrame, second_before: DataFrame, batch: int) -> bool:
        """Whether this batch would count more paths over one account than ``hub_paths``; noted in the state."""
        limit = self.params.hub_paths
        if limit is None:
            return False
        sizes = [
            rows.groupBy("mid").agg(F.count("*").alias(name))
            for name, rows in (("f", first), ("s", second), ("fb", first_before), ("sb", second_before))
        ]
        every = sizes[0].join(sizes[1], "mid", "full").join(sizes[2], "mid", "full").join(sizes[3], "mid", "full").fillna(0, ["f", "s", "fb", "sb"])
        load = (F.col("f") + F.col("fb")).cast("double") * (F.col("s") + F.col("sb"))
        hubs = land(every.where(load > limit).select(F.col("mid").alias("node")), "hubs")
        if hubs.isEmpty():
            return False
        self._write("hubs", hubs, batch)
        return True

    def accounts(self) -> DataFrame:
        """The accounts found so far, as nodes (columns of the struct)."""
        if self.read("hubs").isEmpty():
            return self.read("found").select("node.*").distinct()
        return graph.scatter_gather_nodes(self.read("out_edges").select("src", "dst"), self.params)


def growing_scatter_gather(
    stream: DataFrame, params: RiskParams, by: Sequence[str] = (), path: str | None = None, buckets: int = 64
) -> DataFrame:
    """Accounts of question 4 from the edges of a stream; each batch costs what its new edges touch.

    ``path`` names a folder kept between runs: the next run takes up new files only.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "growing-graph")
    state = GrowingGraph(spark, f"{path}/state", params, by, buckets)
    edges = graph.transfers(stream, params).select(*by, "from_bank", "from_account", "to_bank", "to_account")
    query = (
        edges.writeStream.foreachBatch(lambda rows, batch: state.add(graph.distinct_edges(rows, by), batch))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return as_result(state.accounts(), 4)
