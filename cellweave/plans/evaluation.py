"""Whole evaluations from files to one document of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.normalize import Aliases
from cellweave.operators import matching, reconcile, verify
from cellweave.sources import records
from cellweave.sources.shared import cut


SCORE = f"tp long, fp long, fn long, soft_tp double, soft_fp double, soft_fn double, matches {matching.MATCHES}"


def _nothing() -> Column:
    """The score of a field that is empty on both sides, as most of a document's fields are."""
    return F.from_json(F.lit('{"tp":0,"fp":0,"fn":0,"soft_tp":0,"soft_fp":0,"soft_fn":0,"matches":[]}'), SCORE)


def paired(predicted: DataFrame, gold: DataFrame, wanted: list[str]) -> DataFrame:
    """(key, predicted, gold, cells) of records (key, record), kept: a row for each document of either side; cells maps a field that either has to STRUCT(p, g), its JSON texts, for documents of both.

    Records are dealt by document once, as one row each."""
    side = lambda df, name: df.select("key", F.lit(name).alias("side"), records.texts_by_field(F.col("record"), wanted).alias("texts"))
    stacked = matching.dealt(side(predicted, "p").unionByName(side(gold, "g")), "key")
    empty = F.create_map().cast("map<string,string>")

    def merged(parts: Column) -> Column:
        # a key is for one record as a rule; further ones add their fields
        more = F.aggregate(parts, empty, lambda held, x: F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(x, k)), x))
        return F.when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(more)

    held = stacked.groupBy("key").agg(*(F.collect_list(F.when(F.col("side") == n, F.col("texts"))).alias(n) for n in ("p", "g")))
    both = (F.size("p") > 0) & (F.size("g") > 0)
    cells = F.when(both, F.map_zip_with(merged(F.col("p")), merged(F.col("g")), lambda _, p, g: F.struct(p.alias("p"), g.alias("g"))))
    return cut(held.select("key", (F.size("p") > 0).alias("predicted"), (F.size("g") > 0).alias("gold"), cells.alias("cells")))


def scored_cells(pairs: DataFrame, aliases: Aliases | None = None, least: float = fields.SIMILAR_VALUE) -> DataFrame:
    """(key, field, predicted, gold, score), kept, of paired's documents of both sides: a row for each field that either has. Each different value of a field is made a set once."""
    cells = pairs.select("key", F.explode("cells").alias("field", "x")).select("key", "field", "x.p", "x.g")
    known, small = matching.known_sets(cells.select("field", F.explode(F.array("p", "g")).alias("text")), aliases)
    read = known.select("field", "text", matching.read_sets(F.col("values"), F.col("field")).alias("read"))
    for side, name in (("p", "predicted"), ("g", "gold")):
        sets = read.select("field", F.col("text").alias(side), F.col("read").alias(name))
        cells = cells.join(sets.hint("broadcast") if small else sets, ["field", side], "left").drop(side)
    empty = F.from_json(F.lit("[]"), read.schema["read"].dataType)
    told = cells.select("key", "field", F.coalesce("predicted", empty).alias("predicted"), F.coalesce("gold", empty).alias("gold"))
    return cut(matching.with_scores(told if small else matching.dealt(told, "key"), least))


def by_document(pairs: DataFrame, scored: DataFrame, wanted: list[str]) -> DataFrame:
    """(key, predicted, gold, exact, fields) of paired and scored_cells."""
    told = F.struct("predicted", "gold", "score")
    held = scored.groupBy(F.col("key").alias("of")).agg(F.bool_and((F.col("score.fp") == 0) & (F.col("score.fn") == 0)).alias("right"), F.map_from_entries(F.collect_list(F.struct("field", told))).alias("told"))
    empty = F.array().cast("array<string>")
    nothing = F.struct(empty.alias("predicted"), empty.alias("gold"), _nothing().alias("score"))
    each = F.transform(F.array(*map(F.lit, wanted)), lambda f: F.struct(f, F.coalesce(F.try_element_at("told", f), nothing)))
    both = F.col("predicted") & F.col("gold")
    return pairs.drop("cells").join(held, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "predicted", "gold", F.when(both, F.coalesce("right", F.lit(True))).alias("exact"), F.when(both, F.map_from_entries(each)).alias("fields"))


def documents(predicted: DataFrame, gold: DataFrame, wanted: list[str], aliases: Aliases | None = None, least: float = fields.SIMILAR_VALUE) -> DataFrame:
    """(key, predicted, gold, exact, fields) of records (key, record): a row for each document of either side. predicted and gold say whether a side has it; fields maps
    each wanted field to STRUCT(predicted, gold, score), null for documents of one side only."""
    pairs = paired(predicted, gold, wanted)
    return by_document(pairs, scored_cells(pairs, aliases, least), wanted)


def evaluate(predicted: DataFrame, gold: DataFrame, aliases: Aliases | None = None, include_excluded: bool = False, least: float = fields.SIMILAR_VALUE) -> dict[str, DataFrame]:
    """Of records (key, record): documents, scored cells, metrics by field and over all, exact documents, keys by side, and the document of results.

    Kept are the documents' pairs of records and the scores of fields that either side has; all else follows from these when it is asked for. Metrics are a wanted field's even if no document has it."""
    wanted = matching.scored_fields(include_excluded)
    pairs = paired(predicted, gold, wanted)
    cells = scored_cells(pairs, aliases, least)
    each = by_document(pairs, cells, wanted)
    scored = each.where("fields IS NOT NULL").select("key", F.explode("fields").alias("field", "x")).select("key", "field", "x.predicted", "x.gold", "x.score")
    side = F.when(F.col("predicted") & F.col("gold"), "both").when(F.col("gold"), "missing").otherwise("extra")
    grid = pairs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("field"), _nothing().alias("score"))
    metrics = matching.field_metrics(cells.select("field", "score").unionByName(grid))
    counts = _counts(pairs, cells)
    exactness = counts.select(F.col("matched_file_count").alias("documents"), "exact", F.col("exact_match_rate").alias("rate"))
    out = {"by_document": each, "scored": scored, "metrics": metrics, "documents": exactness, "keys": pairs.select("key", side.alias("side"))}
    return out | {"summary": summary(counts.drop("exact"), metrics, wanted, least)}


def _counts(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: documents by side, and how many of both are exact, which are all but those with a wrong or missing value."""
    files = pairs.agg(
        F.count_if("predicted").alias("predictions_file_count"), F.count_if("gold").alias("gold_file_count"), F.count_if(F.col("predicted") & F.col("gold")).alias("matched_file_count"),
        F.count_if(F.col("gold") & ~F.col("predicted")).alias("missing_prediction_count"), F.count_if(F.col("predicted") & ~F.col("gold")).alias("extra_prediction_count"),
    )
    wrong = cells.where("score.fp > 0 OR score.fn > 0").select("key").distinct().agg(F.count("*").alias("wrong"))
    exact = F.col("matched_file_count") - F.col("wrong")
    return files.crossJoin(F.broadcast(wrong)).select(*files.columns, exact.alias("exact"), matching.ratio(exact, F.col("matched_file_count")).alias("exact_match_rate"))


#: A field's metrics in a document of results.
METRICS = ("tp", "fp", "fn", "precision", "recall", "f1")


def summary(counts: DataFrame, metrics: DataFrame, wanted: list[str], least: float = fields.SIMILAR_VALUE) -> DataFrame:
    """One row, the document of results: counts of files, fields left out and why, metrics over all and by field. Lists of documents are ``missing_and_extra``'s and ``by_document``'s,
    which are as long as the corpus."""
    one = F.struct(*METRICS, F.struct(*(F.col(f"soft_{c}").alias(c) for c in METRICS)).alias("partial"))
    row = metrics.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", one.alias("m")))))).alias("per_field"),
        F.max(F.when(F.col("field").isNull(), one)).alias("overall"),
    )
    excluded = [f for f in fields.FIELDS if f not in wanted]
    reasons = F.map_from_arrays(F.array(*map(F.lit, excluded)), F.array(*(F.lit(fields.WHY_NOT_SCORED.get(f, "excluded")) for f in excluded))) if excluded else F.create_map().cast("map<string,string>")
    return counts.crossJoin(F.broadcast(row)).select(
        *counts.columns[:-1], F.lit(len(wanted)).alias("scored_field_count"), reasons.alias("excluded_fields"), F.lit(least).alias("partial_similarity_threshold"),
        F.col("overall").withField("exact_match_rate", F.col("exact_match_rate")).alias("overall"), "per_field",
    )


def listed(out: dict[str, DataFrame]) -> DataFrame:
    """The summary with the lists of documents of one side and with every document's fields, in order of their keys: one record, for evaluations that one file is to hold."""
    both, empty = F.col("fields").isNotNull(), F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.array_sort(F.collect_list(F.when(c, F.col("key")))), empty)
    each = F.when(both, F.struct("key", F.col("exact").alias("exact_match"), "fields"))
    lists = out["by_document"].agg(names(F.col("gold") & ~F.col("predicted")).alias("missing_predictions"), names(F.col("predicted") & ~F.col("gold")).alias("extra_predictions"), F.collect_list(each).alias("d"))
    # maps have no order, so documents are sorted by their keys alone
    ordered = F.array_sort("d", lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return out["summary"].crossJoin(F.broadcast(lists.select("missing_predictions", "extra_predictions", ordered.alias("per_document"))))


def evaluate_files(spark: SparkSession, predictions: str, gold: str, verification: str | None = None, aliases: str | None = None, **options) -> dict[str, DataFrame]:
    """evaluate of two files of JSON lines; with a verification file also the crosstab, its coverage and the suspects."""
    load = lambda path: records.records_by_key(records.json_lines(spark, path))
    out = evaluate(load(predictions), load(gold), records.alias_sections(spark, aliases) if aliases else None, **options)
    if verification:
        told = records.verdicts(records.json_lines(spark, verification))
        out |= {"crosstab": verify.crosstab(out["scored"], told), "suspects": verify.suspects(out["scored"], told), "coverage": verify.coverage(out["scored"], told)}
    return out


def review(legacy: DataFrame, llm_a: DataFrame, llm_b: DataFrame, issues: DataFrame | None = None, aliases: Aliases | None = None) -> dict[str, DataFrame]:
    """silver, rows for review with suggestions, their worklist, counts by status and the summary, of records (key, record) of three sources."""
    sources = dict(zip(reconcile.SOURCES, (legacy, llm_a, llm_b), strict=True))
    cells = reconcile.three_way({n: records.cells(r) for n, r in sources.items()}, aliases=aliases)
    suggested = reconcile.suggest(reconcile.for_review(cells))
    if issues is not None:
        suggested = reconcile.annotate(suggested, issues)
    suggested = reconcile.auto_confirm(suggested)
    keys = [F.col(c) for c in ("alignment_issue", "status", "suggestion_confidence")]
    ordered = suggested.orderBy(*reconcile.priority(*keys), "field", "key")
    return {
        "silver": reconcile.silver(cells), "review": ordered, "worklist": reconcile.worklist(suggested), "counts": reconcile.status_counts(cells),
        "coverage": reconcile.coverage(sources), "summary": reconcile.review_summary(cells, reconcile.coverage(sources)),
    }
