"""Sets compared with sets, and what follows from it: counts, precision, recall and F1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.normalize import Aliases, value_set
from cellweave.functions.similarity import likeness, read_likeness, read_value
from cellweave.functions.text import let
from cellweave.sources.shared import cut


#: Characters of different values, and their sets, that every executor may hold.
SMALL = 32 << 20

MATCHES = "array<struct<predicted:string,gold:string,similarity:double>>"


def exact_counts(predicted: Column, gold: Column) -> Column:
    """STRUCT(tp, fp, fn) of two sets."""
    n = lambda x: F.size(x).cast("long")
    return F.struct(n(F.array_intersect(predicted, gold)).alias("tp"), n(F.array_except(predicted, gold)).alias("fp"), n(F.array_except(gold, predicted)).alias("fn"))


def greedy_match(predicted: Column, gold: Column, field: Column, least: float = fields.SIMILAR_VALUE) -> Column:
    """ARRAY(STRUCT(predicted, gold, similarity)): the most similar pair first, each value once; ties by the values."""
    return _greedy(predicted, gold, lambda p, g: likeness(p, g, field), lambda x: x, least)


def _greedy(predicted: Column, gold: Column, alike: Callable[[Column, Column], Column], value: Callable[[Column], Column], least: float) -> Column:
    pairs = F.flatten(F.transform(predicted, lambda p: F.transform(gold, lambda g: F.struct((-alike(p, g)).alias("cost"), value(p).alias("predicted"), value(g).alias("gold")))))
    ranked = F.array_sort(F.filter(pairs, lambda x: -x["cost"] >= least))
    return F.aggregate(
        ranked,
        F.coalesce(F.lit(None).cast(MATCHES), F.array().cast(MATCHES)),
        lambda held, x: F.when(F.exists(held, lambda h: (h["predicted"] == x["predicted"]) | (h["gold"] == x["gold"])), held).otherwise(
            F.concat(held, F.array(F.struct(x["predicted"].alias("predicted"), x["gold"].alias("gold"), (-x["cost"]).alias("similarity"))))
        ),
    )


def score(predicted: Column, gold: Column, field: Column, least: float = fields.SIMILAR_VALUE) -> Column:
    """STRUCT(tp, fp, fn, soft_tp, soft_fp, soft_fn, matches): exact counts, and soft ones in which a pair counts by its similarity.

    Soft counts are rounded to six places, half to even, before they are added up. matches are the pairs that differ."""
    return _scored(predicted, gold, greedy_match(predicted, gold, field, least))


def _scored(predicted: Column, gold: Column, matched: Column) -> Column:
    def tell(found: Column) -> Column:
        soft = F.aggregate(found["m"], F.lit(0.0), lambda s, x: s + x["similarity"])
        part = lambda x: F.bround(x, 6)
        differ = F.transform(F.filter(found["m"], lambda x: x["similarity"] < 1), lambda x: F.struct(x["predicted"].alias("predicted"), x["gold"].alias("gold"), F.bround(x["similarity"], 4).alias("similarity")))
        c = found["c"]
        return F.struct(c["tp"].alias("tp"), c["fp"].alias("fp"), c["fn"].alias("fn"), part(soft).alias("soft_tp"), part(F.size(found["p"]) - soft).alias("soft_fp"), part(F.size(found["g"]) - soft).alias("soft_fn"), differ.alias("matches"))

    return let(F.struct(predicted.alias("p"), gold.alias("g"), exact_counts(predicted, gold).alias("c"), matched.alias("m")), tell)


def read_sets(values: Column, field: Column) -> Column:
    """A set whose values are read once for with_scores."""
    return F.transform(values, lambda v: read_value(v, field))


def with_scores(cells: DataFrame, least: float = fields.SIMILAR_VALUE) -> DataFrame:
    """(key, field, predicted, gold, score) of cells with sets as read_sets gives them: what score gives. Most sets have one value or none, and need no choice of pairs."""
    n_p, n_g = F.size("predicted"), F.size("gold")
    first = lambda c: F.element_at(c, 1)
    alike = F.when((n_p == 1) & (n_g == 1), read_likeness(first("predicted"), first("gold")))
    # columns of their own, so that what is used twice is computed once, without an array around it
    told = cells.withColumn("alike", alike)
    soft = F.when(F.col("alike") >= least, F.col("alike")).otherwise(0.0)
    p, g = first("predicted")["value"], first("gold")["value"]
    pair = F.array(F.struct(p.alias("predicted"), g.alias("gold"), F.bround("alike", 4).alias("similarity")))
    matches = F.when((F.col("alike") >= least) & (F.col("alike") < 1), pair).otherwise(F.array().cast(MATCHES))
    names = ("tp", "fp", "fn", "soft_tp", "soft_fp", "soft_fn", "matches")
    struct = lambda *parts: F.struct(*(x.alias(n) for x, n in zip(parts, names, strict=True)))
    one = struct((p == g).cast("long"), (p != g).cast("long"), (p != g).cast("long"), F.bround(soft, 6), F.bround(1 - soft, 6), F.bround(1 - soft, 6), matches)
    none = struct(F.lit(0).cast("long"), n_p.cast("long"), n_g.cast("long"), F.lit(0.0), n_p.cast("double"), n_g.cast("double"), F.array().cast(MATCHES))
    many = _scored(F.col("predicted")["value"], F.col("gold")["value"], _greedy(F.col("predicted"), F.col("gold"), read_likeness, lambda x: x["value"], least))
    scored = F.when((n_p == 0) | (n_g == 0), none).when(F.col("alike").isNotNull(), one).otherwise(many)
    return told.withColumn("score", scored).select("key", "field", F.col("predicted")["value"].alias("predicted"), F.col("gold")["value"].alias("gold"), "score")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and zero when b is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_metrics(counts: DataFrame, prefix: str = "") -> DataFrame:
    """counts with precision, recall and f1 of tp, fp and fn."""
    tp, fp, fn = (F.col(f"{prefix}{c}") for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": ratio(2 * p * r, p + r)})


def scored_fields(include_excluded: bool = False, excluded: Sequence[str] = fields.NOT_SCORED) -> list[str]:
    return [f for f in fields.FIELDS if include_excluded or f not in excluded]


def compare_keys(predicted: DataFrame, gold: DataFrame, key: str = "key") -> DataFrame:
    """(key, side): both, missing (gold only) or extra (predicted only), by one join."""
    p, g = predicted.select(key).distinct().withColumn("p", F.lit(True)), gold.select(key).distinct().withColumn("g", F.lit(True))
    side = F.when(F.col("p") & F.col("g"), "both").when(F.col("g"), "missing").otherwise("extra")
    return p.join(g, key, "full_outer").select(key, side.alias("side"))


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """rows by columns in all of the session's partitions, for work that is much for few bytes: those of other shuffles are put together by their bytes, and may be fewer than there are cores."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def value_sets(texts: DataFrame, aliases: Aliases | None = None, parse: Callable[[Column], Column] = F.parse_json) -> DataFrame:
    """(field, text, values): the set of each different JSON text of a field (field, text), null for no text.

    It is kept, so a value is made a set once, and the large expression is no part of the plans that use it. If it is small, cells are not dealt out to be joined with it."""
    known, small = known_sets(texts, aliases, parse)
    return known.hint("broadcast") if small else known


def known_sets(texts: DataFrame, aliases: Aliases | None = None, parse: Callable[[Column], Column] = F.parse_json) -> tuple[DataFrame, bool]:
    """value_sets without the hint, and whether they are few enough for every executor."""
    # so many partitions, as values are short and sets are much work
    told = dealt(texts.where("text IS NOT NULL").select("field", "text").distinct(), "field", "text")
    known = cut(told.select("field", "text", value_set(parse(F.col("text")), F.col("field"), aliases).alias("values")))
    size = known.agg(F.sum(F.length("text") + F.length(F.array_join("values", "")) + 64)).first()[0] or 0
    return known, size <= SMALL


def score_cells(predicted: DataFrame, gold: DataFrame, wanted: Sequence[str], aliases: Aliases | None = None, least: float = fields.SIMILAR_VALUE) -> DataFrame:
    """(key, field, predicted, gold, score) for documents on both sides, by cells (key, field, value).

    A document that a side lacks isn't counted. One shuffle brings the cells of a document and field together: both sides
    are stacked and grouped, so absent cells need no further join.
    """
    side = lambda df, name: df.where(F.col("field").isin(*wanted)).select("key", "field", F.lit(name).alias("side"), value_set(F.col("value"), F.col("field"), aliases).alias("values"))
    stacked = side(predicted, "p").unionByName(side(gold, "g"))
    empty = F.array().cast("array<string>")
    pick = lambda name: F.coalesce(F.max(F.when(F.col("side") == name, F.col("values"))), empty)
    both = compare_keys(predicted, gold).where("side = 'both'").select("key")
    cells = stacked.groupBy("key", "field").agg(pick("p").alias("predicted"), pick("g").alias("gold")).join(both, "key", "left_semi")
    return cells.withColumn("score", score(F.col("predicted"), F.col("gold"), F.col("field"), least))


def field_metrics(scored: DataFrame) -> DataFrame:
    """(field, exact and soft counts and metrics); the row of a null field is for all fields."""
    flat = scored.select("field", "score.*")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "soft_tp", "soft_fp", "soft_fn")]
    return with_metrics(with_metrics(flat.rollup("field").agg(*sums)), "soft_")


def document_exactness(scored: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(documents, exact, rate): documents without any wrong or missing value. keys: those of compare_keys, so that documents without any cell count, too."""
    good = scored.groupBy("key").agg(F.bool_and((F.col("score.fp") == 0) & (F.col("score.fn") == 0)).alias("exact"))
    if keys is not None:
        good = keys.where("side = 'both'").join(good, "key", "left").select("key", F.coalesce("exact", F.lit(True)).alias("exact"))
    return good.agg(F.count("*").alias("documents"), F.count_if("exact").alias("exact"), F.coalesce(F.avg(F.col("exact").cast("double")), F.lit(0.0)).alias("rate"))
