"""Session helpers shared by all operators.

``ship(spark)`` sends this package to the executors (once per SparkContext), so Arrow-batched functions can import it
wherever they run.  ``cut(df)`` ends a lineage with a checkpoint in the folder that the cluster names in
``spark.checkpoint.dir``; a local folder is set only where the session names none and its master is local (tests, local
runs), elsewhere that is an error.
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quire", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the executors' Python path, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._quire_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; where a local session has none, a temporary one is set."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what no frame refers to any more: shuffle files and checkpoints of finished rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: str = "16m") -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes for what is computed within: for rows that are large themselves."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in now}
    for key, value in now.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to four tasks for each core: for small files whose rows are much work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
