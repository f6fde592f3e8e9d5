"""Items taken in from a stream of NDJSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolattice.operators.catalog import Catalog, Mode


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).filter(F.trim("value") != "").select(F.col("value").alias("doc"))


def ingest_stream(catalog: Catalog, docs: DataFrame, checkpoint: str, mode: Mode = Mode.upsert, once: bool = True) -> StreamingQuery:
    """Each micro-batch is one load; upserts make a batch that is run again harmless."""
    def load(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            catalog.load_items(batch, mode)

    writer = docs.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_within(events: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Repeats of a key dropped, as long as they come within the delay; state is bounded by the watermark."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(events: DataFrame, time_col: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of time, late ones up to the delay."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
