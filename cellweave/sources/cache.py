"""Results kept by the hash of what they are made of, so that a second run makes only what is new.

A cache is two Parquet folders: rows, in buckets by the hash, and keys, which name what a finished run has made, with nothing to show for it or not. A key is written after its
rows, so a run that ends halfway leaves rows that nobody sees. If two runs make the same, one of them counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.shared import cut

#: Buckets by the first digits of a hash.
DIGITS = 2


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _bucket(key: str):
    return F.substring(key, 1, DIGITS)


def through_cache(wanted: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "sha256", keep: Column | None = None) -> tuple[DataFrame, int]:
    """compute(wanted), and for how many keys it was computed now. The key of a result's rows, which wanted has too, decides; rows of wanted that share one are computed once.

    compute gets the rows of wanted that the cache lacks and keeps their key; a key may have any number of rows, or none. keep: which of its rows are kept; a key is
    computed again next time if it has rows and none of them is."""
    spark = wanted.sparkSession
    done = _read(spark, f"{path}/keys", f"`{key}` string, run string, bucket string")
    named = wanted.withColumn("bucket", _bucket(key))
    todo = cut(named.dropDuplicates([key]).join(done.select(key, "bucket"), [key, "bucket"], "left_anti"))
    run = uuid.uuid4().hex
    made = compute(todo.drop("bucket"))
    schema = made.schema
    new = todo.count()
    finished = todo
    if keep is not None:
        lost = made.groupBy(key).agg(F.bool_or(keep).alias("any")).where("NOT any").select(key)
        finished, made = todo.join(lost, key, "left_anti"), made.where(keep)
    if new:
        out = made.withColumn("run", F.lit(run)).withColumn("bucket", _bucket(key))
        out.write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")
        finished.select(key, F.lit(run).alias("run"), "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/keys")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    first = _read(spark, f"{path}/keys", f"`{key}` string, run string, bucket string").groupBy(key, "bucket").agg(F.min("run").alias("run"))
    kept = first.join(named.select(key, "bucket").distinct(), [key, "bucket"], "left_semi")
    rows = _read(spark, f"{path}/rows", f"{fields}, run string, bucket string").join(kept, [key, "bucket", "run"], "left_semi")
    return rows.select(*(F.col(f"`{f.name}`") for f in schema)), new
