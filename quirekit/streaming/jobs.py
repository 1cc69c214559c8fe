"""Job logs as streams: last status of every job, costs added up, an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quirekit.operators.records import upsert


def last_status(events: DataFrame) -> DataFrame:
    """Streaming: (job, status, seq) with the highest seq of every job so far (update or complete mode)."""
    return events.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def costs(events: DataFrame) -> DataFrame:
    """Streaming: calls and cost of every job so far, unknown costs as 0."""
    return events.groupBy("job").agg(F.count("*").alias("calls"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Streaming, an addition of this library: events and value by window and type, late rows dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def into_snapshot(events: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch's upsert as a new snapshot folder path/batch=N; a batch run again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), "seq").alias("r")).select(*keys, "r.*")
        old = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}") if number else spark.createDataFrame([], batch.schema)
        upsert(old, newest, keys, created="").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends log rows as they come."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
