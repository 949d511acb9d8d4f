"""An extension for running evaluations: a folder of predictions as a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def prediction_stream(spark: SparkSession, folder: str, key: str = "pdf") -> DataFrame:
    """(key, text, at) of JSON lines as they arrive."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.get_json_object("value", f"$.{key}").alias("key"), F.col("value").alias("text"), F.current_timestamp().alias("at")).where("key IS NOT NULL AND key <> ''")


def keep_last(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert the last record of each key into a Parquet table, batch by batch: a version for each batch, written whole, so a repeated batch changes nothing."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("key").agg(F.max_by("text", "at").alias("text"))
        before = number - 1
        try:
            old = spark.read.parquet(f"{table}/version={before}") if before >= 0 else None
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        merged = new if old is None else new.unionByName(old.join(new, "key", "left_anti"))
        merged.write.mode("overwrite").parquet(f"{table}/version={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
