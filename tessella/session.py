"""Session factory, table loading and the few session-level helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows up to which a dimension table may be broadcast; beyond it the join is left to the planner.
BROADCAST_ROWS = 200_000


def get_spark(app: str = "tessella", cpus: int | str = "*", partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark use. Written intermediate tables go to checkpoint_dir; without it, to a temporary folder that is deleted when Python ends."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    spark = (builder.config(CHECKPOINT_DIR, checkpoint_dir) if checkpoint_dir else builder).getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of every executor, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    home = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scan_tasks: dict[str, int] = {}


def tasks_missing(spark: SparkSession, path: str) -> int:
    """0 if a table's scan keeps every core busy, else the number of tasks that would: a file of one row group is read by one task, whatever its texts cost."""
    cores = spark.sparkContext.defaultParallelism
    if path not in _scan_tasks:
        _scan_tasks[path] = spark.read.parquet(path).rdd.getNumPartitions()
    return cores if _scan_tasks[path] < cores else 0


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`table` for work that costs much more than reading: its rows are dealt out to all cores if the scan has fewer tasks; filters and column choices still reach the scan."""
    df = table(spark, sf_dir, name)
    n = tasks_missing(spark, f"{sf_dir}/{name}.parquet")
    return df.repartition(n) if n else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it is counted to hold at most `rows` rows, otherwise `df` itself.

    The count stops after rows + 1 rows, so the check stays cheap on large inputs."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session, whose executors are this machine, may go without; on a cluster a missing folder is an error,
    since a folder of one machine would lose or split the data."""
    said = spark.conf.get(CHECKPOINT_DIR, None)
    if said:
        return said
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if (app := spark.sparkContext.applicationId) not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str = "tessella") -> str:
    """A new path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again, which ends its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables this application wrote to the shared folder and drops what `keep` holds; results that still read them must be consumed before."""
    spark.catalog.clearCache()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    if paths:
        context = spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path
        for p in map(hadoop, paths):
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame) -> DataFrame:
    """`df` kept while a query uses it more than once; spills to disk, is recomputed if an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
