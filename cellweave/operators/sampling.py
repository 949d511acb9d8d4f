"""Splits and samples that are the same in every run."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import squeeze, told
from cellweave.sources.shared import cut


def check_ratio(ratio: float) -> float:
    if not 0 < ratio < 1:
        raise ValueError("a ratio lies between 0 and 1")
    return ratio


def cut_of(n: int, ratio: float) -> int:
    """How many of n rows the first part gets: at least one, and not all."""
    return min(max(int(n * check_ratio(ratio)), 1), n - 1)


def numbered(rows: DataFrame, order: Sequence[str | Column], by: str = "__cw_n") -> DataFrame:
    """rows with their place in a total order, from 1.

    The rows are dealt by ranges of the order, numbered within each range, and each range starts after the
    counts of those before it; only these counts, one for each task, meet in one place. The ranges are drawn once and
    kept, as drawing them again could give others."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("__cw_part", F.spark_partition_id()))
    counts = dealt.groupBy("__cw_part").agg(F.count("*").alias("__cw_size"))
    before = counts.withColumn("__cw_before", F.coalesce(F.sum("__cw_size").over(Window.orderBy("__cw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn(by, F.row_number().over(Window.partitionBy("__cw_part").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__cw_part").withColumn(by, F.col(by) + F.col("__cw_before")).drop("__cw_part", "__cw_size", "__cw_before")


def split(rows: DataFrame, ratio: float, order: Sequence[str | Column]) -> DataFrame:
    """rows with ``part`` train or test: the first in order, exactly cut_of of them, are train. The order decides ties, so it should be a total one."""
    n = rows.count()
    first = cut_of(n, ratio) if n > 1 else n
    return numbered(rows, order).withColumn("part", F.when(F.col("__cw_n") <= first, "train").otherwise("test")).drop("__cw_n")


def split_like_shuffle(rows: DataFrame, ratio: float, order: str, seed: int) -> DataFrame:
    """The split that shuffling a list in order with Python's generator gives, for small tables: the permutation is made on the driver."""
    n = rows.count()
    places = list(range(n))
    random.Random(seed).shuffle(places)
    cut = cut_of(n, ratio) if n > 1 else n
    named = rows.sparkSession.createDataFrame([(p + 1, i + 1, "train" if i < cut else "test") for i, p in enumerate(places)], "__cw_n long, place long, part string")
    return numbered(rows, [order]).join(named, "__cw_n").drop("__cw_n")


def stratum(value: Column) -> Column:
    """A record's stratum by a variant: its text in lower case with single blanks, a list's items joined by commas, ``unknown`` for nothing, blank, zero or false."""
    kind = F.schema_of_variant(value)
    listed = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), told), ", ")
    nothing = value.isNull() | (kind == "VOID") | F.to_json(value).isin("false", "0", "0.0", "{}")
    text = F.when(nothing, "").when(kind.startswith("ARRAY"), listed).otherwise(told(value))
    return F.coalesce(F.nullif(squeeze(F.lower(text)), F.lit("")), F.lit("unknown"))


def round_robin(rows: DataFrame, stratum: Column, n: int, order: Column) -> DataFrame:
    """n rows, one of each stratum before any second one, the largest strata first; within a stratum, and between equally large ones, by order.

    Only the first n rows of a stratum can be chosen: a limit within each stratum comes before the one over all."""
    if n < 0:
        raise ValueError("a count is not negative")
    named = rows.withColumn("__cw_s", F.coalesce(stratum.cast("string"), F.lit(""))).withColumn("__cw_o", order)
    sizes = named.groupBy("__cw_s").agg(F.count("*").alias("__cw_size"), F.min("__cw_o").alias("__cw_first"))
    turn = named.withColumn("__cw_turn", F.row_number().over(Window.partitionBy("__cw_s").orderBy("__cw_o"))).where(F.col("__cw_turn") <= n)
    ordered = turn.join(sizes, "__cw_s").orderBy("__cw_turn", F.desc("__cw_size"), "__cw_first", "__cw_o").limit(n)
    return ordered.select(*rows.columns)


def chosen(rows: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """The named rows, in the order named; an error if one isn't there."""
    named = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"__cw_n int, {key} string")
    found = rows.join(F.broadcast(named), key)
    missing = [r[0] for r in named.join(rows, key, "left_anti").orderBy("__cw_n").select(key).collect()]
    if missing:
        raise ValueError("not among the rows: " + ", ".join(missing))
    return found.orderBy("__cw_n").select(*rows.columns)
