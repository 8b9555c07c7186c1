"""Job life cycle over a table of jobs, and ingestion of dropped files as a stream.

The table: id, status (queued, running, succeeded, failed), created_at, updated_at and whatever else.  Claims and sweeps
are relational; on a cluster a micro-batch's offsets take the place of claims, and its checkpoint that of recovery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import opc

TTL = 86_400
#: Which status may follow which.
FOLLOWS = {"queued": ("running",), "running": ("succeeded", "failed", "queued"), "succeeded": (), "failed": ()}

#: Options of jobs, with their types and defaults.
OPTIONS = {"granularity": ("string", "char"), "format": ("string", "json"), "classify": ("boolean", False), "pages": ("string", None)}


def migrate(jobs: DataFrame) -> DataFrame:
    """A job table of any age with all columns of options, those that it lacks at their defaults."""
    for name, (kind, value) in OPTIONS.items():
        if name not in jobs.columns:
            jobs = jobs.withColumn(name, F.lit(value).cast(kind))
    return jobs


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart: jobs that were running are queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def oldest_queued(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The next jobs to run: a bounded top-n, ties by id."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(n)


def claim(jobs: DataFrame, now, n: int = 1) -> DataFrame:
    """The table after claiming the oldest queued jobs."""
    got = F.broadcast(oldest_queued(jobs, n).select(F.col("id").alias("claimed")))  # n rows
    mark = F.col("claimed").isNotNull()
    return jobs.join(got, F.col("id") == F.col("claimed"), "left").withColumn("status", F.when(mark, "running").otherwise(F.col("status"))).withColumn("updated_at", F.when(mark, F.lit(now)).otherwise(F.col("updated_at"))).drop("claimed")


def expired(jobs: DataFrame, now, ttl: int = TTL) -> DataFrame:
    """Ended jobs that were not touched for ``ttl`` seconds."""
    return jobs.filter(F.col("status").isin("succeeded", "failed") & (F.col("updated_at") < F.lit(now) - F.expr(f"interval {int(ttl)} seconds")))


def sweep(jobs: DataFrame, now, kept_files: DataFrame | None = None, ttl: int = TTL) -> DataFrame:
    """The table without expired jobs; a job whose files are still there (``kept_files``: id) stays for a later sweep."""
    gone = expired(jobs, now, ttl).select("id")
    gone = gone if kept_files is None else gone.join(kept_files.select("id"), "id", "left_anti")
    return jobs.join(gone, "id", "left_anti")


def transition(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after changes (id, to): only allowed ones take effect."""
    allowed = F.lit(False)
    for status, following in FOLLOWS.items():
        allowed = allowed | ((F.col("status") == status) & F.col("to").isin(*following)) if following else allowed
    joined = jobs.join(changes.select(F.col("id").alias("c_id"), "to"), F.col("id") == F.col("c_id"), "left")
    return joined.withColumn("status", F.when(F.coalesce(allowed, F.lit(False)), F.col("to")).otherwise(F.col("status"))).drop("c_id", "to")


def result_state(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """What a lookup answers for each asked id: not_found, not_ready, failed or ready."""
    got = asked.join(jobs.select("id", "status"), "id", "left")
    said = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "succeeded", "ready").when(F.col("status") == "failed", "failed").otherwise("not_ready")
    return got.select("id", said.alias("answer"))


def dropped_files(spark: SparkSession, folder: str, most_per_batch: int = 64) -> DataFrame:
    """A stream of the files dropped into a folder, with provenance and format; the batch limit bounds concurrent work."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", most_per_batch).load(folder)
    return opc.provenance(files)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Ingest what is in the folder now: provenance rows as Parquet, each file once, however often it runs."""
    rows = dropped_files(spark, folder).drop("content")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, streaming or not; rows later than ``late`` are left out of a stream's windows."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
