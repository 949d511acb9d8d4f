"""Values checked against their source: quotes, verdicts, and verdicts against agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.text import for_quotes


def quote_matched(verdict: Column, quote: Column, source: Column) -> Column:
    """Whether the source has the quote, for verdicts that rest on one; else null."""
    plain = for_quotes(F.coalesce(quote, F.lit("")))
    return F.when(verdict.isin("supported", "contradicted") & (plain != ""), F.contains(for_quotes(source), plain))


def annotate_quotes(verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """verdicts (key, field, verdict, quote) with quote_matched; texts: (key, text), one for each key."""
    out = verdicts.join(texts.select("key", F.col("text").alias("__cw_text")), "key", "left")
    return out.withColumn("quote_matched", quote_matched(F.col("verdict"), F.col("quote"), F.col("__cw_text"))).drop("__cw_text")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """(key, supported, contradicted, not_in_text, inferred, quote_unmatched)."""
    return verdicts.groupBy("key").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in fields.VERDICTS), F.count_if(~F.col("quote_matched")).alias("quote_unmatched"))


def coverage(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row (covered, gold_suspect, both_suspect): scored documents that have any verdict, and how many suspects there are."""
    covered = scored.select("key").distinct().join(verdicts.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("covered"))
    counts = suspects(scored, verdicts).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("gold_suspect", "both_suspect")))
    return covered.crossJoin(F.broadcast(counts))


def crosstab(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(verdict, agree, disagree): all four verdicts, whether or not they occur. scored: (key, field, score)."""
    good = (F.col("score.fp") == 0) & (F.col("score.fn") == 0)
    rows = scored.where(~F.col("field").isin(*fields.NOT_CROSSED)).select("key", "field", good.alias("good")).join(verdicts, ["key", "field"])
    counted = rows.groupBy("verdict").agg(F.count_if("good").alias("agree"), F.count_if(~F.col("good")).alias("disagree"))
    domain = scored.sparkSession.createDataFrame([(v,) for v in fields.VERDICTS], "verdict string")
    return domain.join(counted, "verdict", "left").select("verdict", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("agree", "disagree")))


def suspects(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(kind, key, field, predicted, gold, verdict, quote): gold_suspect where the source supports a value that gold lacks, both_suspect where it contradicts one that gold has."""
    good = (F.col("score.fp") == 0) & (F.col("score.fn") == 0)
    kind = F.when(~good & (F.col("verdict") == "supported"), "gold_suspect").when(good & (F.col("verdict") == "contradicted"), "both_suspect")
    rows = scored.where(~F.col("field").isin(*fields.NOT_CROSSED)).join(verdicts, ["key", "field"])
    join = lambda c: F.array_join(c, "; ").alias(c)
    return rows.select(kind.alias("kind"), "key", "field", join("predicted"), join("gold"), "verdict", "quote").where("kind IS NOT NULL")
