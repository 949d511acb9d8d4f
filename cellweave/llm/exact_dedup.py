"""Exact deduplication by progressive refinement.

Texts are grouped by length, then by a hash of their first characters, then by the hash of
the whole text, which only texts of surviving groups get. What survives a step is kept as a
bitmap of fixed size, the only thing that is broadcast: a text whose group alone is in its bit
goes no further, one that shares a bit goes on, and the last step compares exactly. So no text
is shuffled, and the whole job is built-in expressions.

Edge cases: a null text counts as empty. A null doc_id ranks below all others. Rows that repeat both
doc_id and text share one fate: all stay or all go. An empty table gives an empty table. Extra columns
pass through ``filter_duplicates`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import attach, bits_of, cut, with_hit, without


def _twice(values: DataFrame) -> DataFrame:
    """The bits of the numbers in column v that occur twice or more."""
    return bits_of(values.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"))


def refine(docs: DataFrame, text: str = "text", prefix: int = 64, bits: int = 26) -> DataFrame:
    """docs with __cw_len and __cw_hash: the SHA-256 of texts whose length and prefix others share, else null.

    bits: the two bitmaps that are broadcast have 2**bits bits, at most 8 MB by default, whatever the input.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    mask = (1 << bits) - 1
    by_length = F.xxhash64(F.col("__cw_len")).bitwiseAND(mask)
    by_prefix = F.xxhash64(F.col("__cw_len"), F.substring(whole, 1, prefix)).bitwiseAND(mask)
    sized = docs.withColumn("__cw_len", F.octet_length(whole))
    first = _twice(sized.select(by_length.alias("v")))
    second = _twice(with_hit(sized, by_length, first, "__cw_go").where("__cw_go").select(by_prefix.alias("v")))
    left = with_hit(sized, by_prefix, second, "__cw_go")
    return left.withColumn("__cw_hash", F.when(F.col("__cw_go"), F.unhex(F.sha2(whole, 256)))).drop("__cw_go")


def _grouped(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...], options: dict) -> DataFrame:
    """What exact_groups gives, and __cw_hash, which rows of groups have."""
    narrow = cut(refine(docs, text, **options).select(F.col(doc_id).alias("doc_id"), *carry, "__cw_len", "__cw_hash"))
    keys = ["__cw_len", "__cw_hash"]
    groups = narrow.where("__cw_hash IS NOT NULL").groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # rows that no group awaits get a key of their own
    single = narrow.withColumn("__cw_len", F.when(F.col("__cw_hash").isNull(), -1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("int")).otherwise(F.col("__cw_len")))
    out = attach(single, groups, keys, "group_size", narrow.count(), ["doc_id"])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), *carry, "__cw_hash")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """A row for each document: doc_id, keep_id (the largest doc_id with that text), group_size, kept, and the columns in carry."""
    return _grouped(docs, doc_id, text, carry, options).drop("__cw_hash")


def filter_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns. A null doc_id stays only if its group has no other.

    Rows are told apart by doc_id and the hash of their text, so one with the doc_id of a copy stays if its text is another.
    """
    gone = _grouped(docs, doc_id, text, (), options).where("NOT kept").select(F.col("doc_id").alias("__cw_id"), "__cw_hash").distinct()
    return without(docs, doc_id, cut(gone), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
