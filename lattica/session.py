"""Session helpers: building a local session, reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | None = None, app: str = "lattica") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(8, n)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LATTICA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """The folder that all executors share, spark.checkpoint.dir, or one of the given name below it.

    Only where that is unset and the master is local, as in tests, a folder of this machine is taken;
    on a cluster that would lose data, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lattica-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    root = context.getCheckpointDir().rstrip("/")
    return f"{root}/{name}" if name else root


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage through a reliable checkpoint in shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """df, settled, with a dense number from 0 in a column of its own. Only the partitions' sizes reach the driver; numbers are unique whatever the rows' number, as no hash is."""
    rows = settle(df)
    place = F.monotonically_increasing_id()
    placed = rows.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    sizes = {r["_part"]: r["c"] for r in placed.groupBy("_part").agg(F.count("*").alias("c")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append((p, at))
        at += sizes.get(p, 0)
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start long"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def dealt(df: DataFrame, key: str, folders: list[str] = ()) -> DataFrame:
    """df written once as a table of the shared folder, its rows dealt into buckets by key, and into folders by other columns.

    Joins and groups by key over the result need no shuffle, and a filter on a folder's column reads only that
    folder. The number of buckets is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"dealt_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).option("path", shared_folder(spark, name))
    (writer.partitionBy(*folders) if folders else writer).saveAsTable(name)
    return spark.table(name)


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most max_rows rows, else as it is.

    Beyond the bound the join stays a shuffled one, so no growing table is ever broadcast unchecked.
    The count stops at max_rows + 1 rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
