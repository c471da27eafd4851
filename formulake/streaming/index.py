"""An index that follows a stream of changed rows (survey X10), and run times in windows (A22, F13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..operators.search import text_postings


def latest(rows: DataFrame, id_col: str, version: str) -> DataFrame:
    """The newest row of each id."""
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


def follow_index(changes: DataFrame, fields: dict[str, str], path: str, checkpoint: str, id_col: str = "id", version: str = "version") -> StreamingQuery:
    """Keeps postings of the newest version of each row under ``path``, one folder a batch; a repeated batch overwrites its own folder.

    Older versions stay in the log and are skipped by ``read_index``, so nothing
    is rewritten for each batch; compact by writing what ``read_index`` gives.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = latest(batch, id_col, version)
        postings = text_postings(new, fields, id_col).join(new.select(F.col(id_col).alias("id"), F.col(version).alias("version")), "id")
        postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        new.select(F.col(id_col).alias("id"), F.col(version).alias("version")).write.mode("overwrite").parquet(f"{path}/versions/batch={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark, path: str) -> DataFrame:
    """(token, id, field, weight) of the newest versions."""
    newest = spark.read.parquet(f"{path}/versions").groupBy("id").agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{path}/postings").join(newest, ["id", "version"], "left_semi").select("token", "id", "field", "weight").distinct()


def follow_changes(own: index.Index, changes: DataFrame, checkpoint: str, version: str = "version", operation: str = "op") -> StreamingQuery:
    """Keeps ``own`` at the newest version of each row of a stream; rows whose ``operation`` is ``delete`` remove their id.

    The stream's batch number is the index's, so a batch that is run again after
    a failure is applied once. A row older than what the index has is ignored,
    in whatever batch it comes. ``index.compact`` may run between two runs.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = latest(batch, own.id_col, version)
        gone = F.col(operation) == "delete"
        index.apply_batch(own, new.filter(F.col(operation).isNull() | ~gone), new.filter(gone), number, version)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(events: DataFrame, time: str, operation: str, seconds: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes for each operation and window; rows later than the watermark are dropped, as streams need."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, window), operation)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
        .select(F.col("window.start").alias("start"), operation, "n", "mean", "least", "most")
    )
