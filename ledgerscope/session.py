"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: list[str] = []
_SHIPPED: set[str] = set()

# Settings for a session of one's own; a session handed in is used as it is.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a
    cluster session without it is an error, as a folder of one machine is lost
    with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="ledgerscope-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    inside = "/".join(["ledgerscope", *_SCOPES])
    return f"{shared_dir(spark)}/{inside}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless the environment lets them find it already.

    Only functions that run inside tasks need it. Once per application; like ``--py-files`` of spark-submit.
    """
    package = Path(__file__).resolve().parent
    found = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(package.parent) in found or app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="ledgerscope-code-")) / "ledgerscope_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


@contextmanager
def scratch_scope(spark: SparkSession, label: str = "run") -> Iterator[str]:
    """Intermediate tables written inside go to one folder, which is deleted at the end.

    Results are lazy: write them before the scope ends. Scopes may be nested, not used by several threads.
    """
    _SCOPES.append(f"{label}-{uuid.uuid4().hex}")
    folder = f"{shared_dir(spark)}/" + "/".join(["ledgerscope", *_SCOPES])
    try:
        yield folder
    finally:
        _SCOPES.pop()
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of one's own with all that is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Plans and streams run inside delete their shuffle files at their end, not when the driver's heap is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def land(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Used where several consumers need the same intermediate table: it is
    computed once, survives lost executors and keeps column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
