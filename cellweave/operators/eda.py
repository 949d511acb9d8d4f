"""Descriptions of tables: frequencies, missing values, summaries and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import constant_map, split_labels, told
from cellweave.operators.sampling import numbered


def label_counts(rows: DataFrame, labels: Column, order: Column) -> DataFrame:
    """(label, count), most frequent first, ties by where a label comes first. labels is an array; order numbers rows."""
    each = rows.select(order.alias("o"), F.posexplode(labels).alias("i", "label"))
    return each.groupBy("label").agg(F.count("*").alias("count"), F.min(F.struct("o", "i")).alias("first")).orderBy(F.desc("count"), "first").select("label", "count")


def value_counts(rows: DataFrame, columns: Sequence[str], missing: str = "Missing") -> DataFrame:
    """(column, value, count) of several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("count"))


def is_missing(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def missing_keys(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key) of rows without a value."""
    return rows.where(is_missing(F.col(f"`{column}`"))).select(key)


def null_ratios(rows: DataFrame, top: int = 8) -> DataFrame:
    """(column, ratio) of the columns that miss most values, in one pass over all columns."""
    one = rows.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in rows.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("ratio")) for c in rows.columns)))
    return one.select(pairs.alias("p")).select("p.*").orderBy(F.desc("ratio"), "column").limit(top)


def group_summary(rows: DataFrame, by: str, distinct: str, number: str) -> DataFrame:
    """(by, n, mean, min, max): different values of one column and a summary of another."""
    value = F.col(number).try_cast("double")
    return rows.groupBy(by).agg(F.countDistinct(distinct).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def top_groups(rows: DataFrame, by: str, number: str, top: int = 6) -> DataFrame:
    """(by, n, mean) of the largest groups, ties by name."""
    return rows.groupBy(by).agg(F.count(F.col(number).try_cast("double")).alias("n"), F.avg(F.col(number).try_cast("double")).alias("mean")).orderBy(F.desc("n"), by).limit(top)


def describe(rows: DataFrame, number: str) -> DataFrame:
    """(n, mean, median, min, max), the median exact: the values are numbered in order over all tasks, and the middle ones are looked up."""
    values = rows.select(F.col(number).try_cast("double").alias("x")).where("x IS NOT NULL")
    stats = values.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    middle = numbered(values, ["x"]).crossJoin(F.broadcast(stats.select("n"))).where(F.col("__cw_n").between(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))
    return stats.crossJoin(F.broadcast(middle.agg(F.avg("x").alias("median")))).select("n", "mean", "median", "min", "max")


def majority_share(rows: DataFrame, column: str) -> DataFrame:
    """(value, share): the most frequent value's share of the rows that have one; ties by value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    best = counts.agg(F.max_by("value", F.struct("n")).alias("any"), F.max("n").alias("n"), F.sum("n").alias("total"))
    first = counts.join(F.broadcast(best.select("n", "total")), "n").groupBy("total", "n").agg(F.min("value").alias("value"))
    return first.select("value", (F.col("n") / F.col("total")).alias("share"))


def histogram(rows: DataFrame, number: str, bins: int = 15) -> DataFrame:
    """(bin, low, high, n) of equal widths between the least and the largest value, which is in the last bin; empty bins, too."""
    x = F.col(number).try_cast("double")
    ends = rows.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    placed = rows.select(x.alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(ends))
    width = (F.col("b") - F.col("a")) / bins
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = placed.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends)).where("a IS NOT NULL")
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def mapped(value: Column, table: Mapping[str, str]) -> Column:
    """A category's name by a table, or the value itself."""
    return F.coalesce(F.try_element_at(constant_map(table), value), value) if table else value


def first_present(names: Column, values: Column, wanted: Sequence[str]) -> Column:
    """The value of the first wanted name that is there, null or not. names and values are arrays side by side."""
    out = F.lit(None)
    for name in reversed(wanted):
        out = F.when(F.array_contains(names, name), F.element_at(values, F.array_position(names, F.lit(name)).cast("int"))).otherwise(out)
    return out


def collapsed(values: Column) -> Column:
    """A list's different values in order as JSON: null for none, one for itself, several as a list. values: ARRAY<STRING> of JSON texts, so 1, 1.0 and "1" differ."""
    kept = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "null")))
    return F.when(F.size(kept) == 0, F.lit(None)).when(F.size(kept) == 1, F.element_at(kept, 1)).otherwise(F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")))


def missing_and_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def _items(value: Column) -> Column:
    """A variant's items if it is a list, else itself alone."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def label_list(value: Column) -> Column:
    """The texts of a variant: of a list's items, or of the value; blank ones are left out, null has none."""
    there = value.isNotNull() & (F.schema_of_variant(value) != "VOID")
    return F.when(there, F.filter(F.transform(_items(value), told), lambda t: t != "")).otherwise(F.array().cast("array<string>"))


def split_list(value: Column, depth: int = 3) -> Column:
    """label_list with each text split into labels. Lists within lists count as one list, so many deep."""
    inner = value
    there = F.filter(_items(inner), lambda v: v.isNotNull())
    for _ in range(depth - 1):
        there = F.flatten(F.transform(there, _items))
    kept = F.filter(there, lambda v: F.schema_of_variant(v) != "VOID")
    return F.when(value.isNotNull(), F.flatten(F.transform(kept, lambda v: split_labels(told(v))))).otherwise(F.array().cast("array<string>"))


def flattened(value: Column) -> Column:
    """Labels of a variant: an object's as name:value, an item for each of a list's items, blank values left out; of other things label_list.

    An object's names come in order, as a variant keeps them."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    # a null in an object is a value of its own
    each = lambda e: F.transform(F.filter(F.transform(_items(F.coalesce(e["value"], F.parse_json(F.lit("null")))), told), lambda t: t != ""), lambda t: F.concat(e["key"], F.lit(":"), t))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.flatten(F.transform(entries, each))).otherwise(label_list(value))
