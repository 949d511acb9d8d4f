"""What filters remove in every order of applying them, from one aggregation over the edges of their lattice.

A document's outcome at a step depends on two things alone: the set of filters applied before and the filter that is next.
Of n filters there are n * 2**(n - 1) such edges (80 of five), where orders and steps are n! * n (600). So documents are counted by
what they fail, these classes contribute to the edges, and an order's steps are the edges along its path through the lattice.

Built-in functions only. Documents shuffle as narrow facts (a digest, an id, a few bits) and are summed before the last shuffle. Copies and ids are joined by
``attach``, so that a text or a null id of a third of all rows doesn't meet in one task.

Edge cases: a null text is empty. A null part counts as the empty string, together with it. A null doc_id is neither smaller nor larger than another one, so
it makes no copy, and has no labels. Rows that repeat doc_id and text aren't copies of each other. Labels that repeat a doc_id: any of them
counts. An empty table has no part and so no rows. Extra columns are ignored. Texts are compared by SHA-256.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm._common import attach, cut

#: White space between words.
SPACE = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Of a text that isn't null: A too few words, B too few different ones, C too many capitals, D signs of markup."""
    split = F.array_remove(F.split(text, SPACE, -1), "")
    words, different = F.size(split).cast("long"), F.size(F.array_distinct(split)).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": words < 200,
        "B": 100 * different < 50 * words,
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def facts(docs: DataFrame, failing: Mapping[str, Column], part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, part, digest, fails): a row for each document; fails has bit k if the k-th condition holds. Null conditions don't."""
    fails = F.lit(0)
    for k, (_, condition) in enumerate(sorted(failing.items())):
        fails = fails + F.when(condition, F.lit(1 << k)).otherwise(0)
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), fails.alias("fails"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """facts whose fails has one bit more: whether a smaller id has the same text."""
    total = rows.count()
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = attach(rows, groups, ["digest"], "n", total, ["id", "digest"])
    return found.select("id", "part", (F.col("fails") + F.when(F.col("id") > F.col("first"), F.lit(1 << bit)).otherwise(0)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """facts with good and toxic, by the labels of an id."""
    own = labels.select(F.col(doc_id).cast(rows.schema["id"].dataType).alias("id"), "quality", "toxic").where("id IS NOT NULL")
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    found = own.groupBy("id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"), F.lit(1).alias("n"))
    named = attach(rows, found, ["id"], "n", HOT_NEVER, ["part", "fails"])
    return named.select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


#: So many rows that no id, which has one row of labels, is hot among them; null ids are dealt all the same.
HOT_NEVER = 1 << 40


def edges(classes: DataFrame, n: int) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost): classes (part, fails, good, toxic, docs) summed by the lattice's edges.

    applied is a set of filters as bits, next the number of another one. Every part has every edge."""
    all_edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in all_edges))).alias("e")
    rows = classes.select("*", edge).select("part", "fails", "good", "toxic", "docs", "e.applied", "e.next")
    bit = F.expr("shiftleft(1, next)")
    before, here = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(bit) != 0
    total = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0)).cast("long")
    lost = ~before & here
    return rows.groupBy("part", "applied", "next").agg(
        total(~before & ~here).alias("kept"),
        total(lost).alias("removed"),
        total(before & here).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"),
        total(lost & (F.col("good") == 1)).alias("good_lost"),
        total(lost & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def paths(summed: DataFrame, names: str) -> DataFrame:
    """The steps of all orders of the named filters: each is an edge. shapley is what its filter removes over all orders."""
    n = len(names)
    # an edge lies on as many paths as there are orders of what is before and of what is after it
    through = [factorial(k) * factorial(n - 1 - k) for k in range(n)]
    weight = F.element_at(F.array(*map(F.lit, through)), F.bit_count("applied").cast("int") + 1)
    own = summed.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "next")).cast("long"))
    steps = [("".join(p), k + 1, sum(1 << names.index(x) for x in p[:k]), names.index(p[k])) for p in permutations(names) for k in range(n)]
    table = summed.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    return own.join(F.broadcast(table), ["applied", "next"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, failing: Mapping[str, Column], copies: str | None, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each part, order and step. failing: conditions by one-letter names; copies: the name of the filter of repeated texts, which comes last in the alphabet, or none."""
    names = "".join(sorted(failing)) + (copies or "")
    if "".join(sorted(set(names))) != names:
        raise ValueError("filters need different names, that of copies last")
    rows = cut(facts(docs, failing, part, doc_id, text))
    known = with_copies(rows, len(names) - 1) if copies else rows
    classes = with_labels(known, labels, doc_id).groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("docs"))
    return paths(edges(classes, len(names)), names)
