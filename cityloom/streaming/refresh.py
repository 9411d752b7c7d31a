"""Incremental refresh: new source files are folded into grid statistics and de-duplicated features as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def feature_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Rows a window and key; rows later than `late` don't count, and closed windows are final."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_seen(features: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Each key's first row within the watermark; state is dropped as the watermark passes."""
    return features.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def upsert(features: DataFrame, target: str, checkpoint: str, key: str, newest: str) -> StreamingQuery:
    """Keeps `target` (Parquet, a version a batch) as the newest row of each key. A batch that is run again writes the same version."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.parquet(f"{target}/v{number - 1}").unionByName(batch)
        best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), newest).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{target}/v{number}")

    return features.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
