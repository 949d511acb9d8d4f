"""Three sources of the same cells: agreement, silver and reviewed gold, suggestions and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.normalize import Aliases
from cellweave.operators.matching import exact_counts, value_sets, with_metrics
from cellweave.sources.shared import cut

SOURCES = ("legacy", "llm_a", "llm_b")


def agreement(legacy: Column, a: Column, b: Column) -> Column:
    """STRUCT(status, priority, pattern) of three sets; the first that fits."""
    has = {n: F.size(c) > 0 for n, c in zip(SOURCES, (legacy, a, b), strict=True)}
    n = sum((h.cast("int") for h in has.values()), F.lit(0))
    told = lambda s, p, x: F.struct(F.lit(s).alias("status"), F.lit(p).alias("priority"), F.lit(x).alias("pattern"))
    return (
        F.when(n == 0, told("all_missing", "low", "legacy=missing; llm_a=missing; llm_b=missing"))
        .when((legacy == a) & (a == b), told("silver_auto", "low", "legacy=llm_a=llm_b"))
        .when((a == b) & has["llm_a"], told("two_llms_agree_legacy_diff", "high", "llm_a=llm_b; legacy differs"))
        .when((legacy == a) & has["legacy"], told("legacy_llm_a_agree", "medium", "legacy=llm_a; llm_b differs"))
        .when((legacy == b) & has["legacy"], told("legacy_llm_b_agree", "medium", "legacy=llm_b; llm_a differs"))
        .when(n == 1, told("one_source_only", "medium", "only one source has a non-empty value"))
        .otherwise(told("all_different", "high", "all available non-empty values differ"))
    )


def unwrapped(value: Column) -> Column:
    """STRUCT(raw, evidence_quote, page) of a variant: what an object with a key ``value`` holds, or the value itself."""
    wrapped = F.schema_of_variant(value).startswith("OBJECT") & F.schema_of_variant(value).rlike("OBJECT<(.*, )?value: ")
    get = lambda path, kind: F.when(wrapped, F.try_variant_get(value, path, kind))
    return F.struct(F.when(wrapped, F.try_variant_get(value, "$.value", "variant")).otherwise(value).alias("raw"), get("$.evidence_quote", "string").alias("evidence_quote"), get("$.page", "string").alias("page"))


def json_cell(value: Column) -> Column:
    """A variant as the JSON text of a sheet's cell; null as null."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def from_json_cell(cell: Column) -> Column:
    """A sheet's cell as a variant: blank is null, what is no JSON is a string."""
    text = F.trim(cell)
    told = F.try_variant_get(F.parse_json(F.to_json(F.struct(text.alias("s")))), "$.s", "variant")
    return F.when(text != "", F.coalesce(F.try_parse_json(text), told))


def three_way(sources: dict[str, DataFrame], wanted: list[str] | None = None, aliases: Aliases | None = None) -> DataFrame:
    """(key, study, field, legacy, llm_a, llm_b, status, priority, pattern): every document with every field, by cells (key, field, value).

    Each source is a STRUCT(raw, evidence_quote, page, norm). Each different value of a field is made a set once; the sources are stacked and dealt by key once, where the cells of
    a document and field come together, and then a document's fields.
    """
    wanted = wanted or [f for f in fields.FIELDS if f not in fields.NOT_REVIEWED]
    stacked = None
    for name in SOURCES:
        part = sources[name].select("key", "field", F.lit(name).alias("source"), unwrapped(F.col("value")).alias("u"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = stacked.select("key", "field", "source", F.to_json("u.raw").alias("text"), F.col("u.evidence_quote").alias("evidence_quote"), F.col("u.page").alias("page"))
    known = value_sets(stacked.where(F.col("field").isin(*wanted)), aliases)
    none = F.array().cast("array<string>")
    valued = stacked.join(known, ["field", "text"], "left").repartition("key")
    s = F.struct(F.col("text").alias("raw"), "evidence_quote", "page", F.coalesce("values", none).alias("norm"))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    name = F.when(F.col("field") == "Study", F.trim(F.get_json_object(F.concat(F.lit('{"v":'), F.col("text"), F.lit("}")), "$.v")))
    study = F.min(F.when(name != "", F.struct(rank.alias("rank"), name.alias("name")))).alias("study")
    held = valued.groupBy("key", "field").agg(*(F.max(F.when(F.col("source") == n, s)).alias(n) for n in SOURCES), study)
    cell = F.when(F.col("field").isin(*wanted), F.struct("field", F.struct(*SOURCES).alias("of")))
    documents = held.groupBy("key").agg(F.max("study.name").alias("study"), F.map_from_entries(F.collect_list(cell)).alias("cells"))
    each = documents.select("key", F.coalesce("study", F.lit("")).alias("study"), F.explode(F.array(*map(F.lit, wanted))).alias("field"), "cells")
    of = each.select("key", "study", "field", F.try_element_at("cells", F.col("field")).alias("of"))
    empty = F.struct(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("evidence_quote"), F.lit(None).cast("string").alias("page"), none.alias("norm"))
    full = of.select("key", "study", "field", *(F.coalesce(f"of.{n}", empty).alias(n) for n in SOURCES))
    return full.withColumn("a", agreement(*(F.col(f"{n}.norm") for n in SOURCES))).select("*", "a.*").drop("a")


def silver(cells: DataFrame) -> DataFrame:
    """Cells that need no review, with the legacy value, or else A's or B's, and why."""
    agree_b = F.col("status") == "legacy_llm_b_agree"
    reason = F.when(agree_b, "Normalized legacy/full-PDF agreement; accepted as silver despite block-text extraction differing.").otherwise("Normalized three-way agreement; accepted as silver.")
    value = F.coalesce(*(F.when(F.col(f"{n}.raw") != "null", F.col(f"{n}.raw")) for n in SOURCES), F.lit("null"))
    kept = cells.where(F.col("status").isin("silver_auto", "legacy_llm_b_agree"))
    return kept.select("key", "study", "field", "status", value.alias("silver_value_json"), F.to_json("legacy.norm").alias("normalized_value_json"), *(F.coalesce(f"{n}.raw", F.lit("null")).alias(f"{n}_value_json") for n in SOURCES), reason.alias("decision_reason"))


def for_review(cells: DataFrame) -> DataFrame:
    """Cells for people to decide, with empty columns for their decision. Quote and page are A's, or where A has none B's."""
    kept = cells.where(~F.col("status").isin("silver_auto", "legacy_llm_b_agree", "all_missing"))
    shown = [c for n in SOURCES for c in (F.coalesce(f"{n}.raw", F.lit("null")).alias(f"{n}_value_json"), F.to_json(f"{n}.norm").alias(f"{n}_normalized_json"))]
    blank = [F.lit("").alias(c) for c in ("reviewed_value_json", "decision_status", "reviewer", "decision_reason")]
    quote, page = (F.coalesce(*(F.nullif(F.col(f"{n}.{c}"), F.lit("")) for n in SOURCES[1:]), F.lit("")).alias(c) for c in ("evidence_quote", "page"))
    return kept.select("key", "study", "field", "status", "priority", *shown, F.col("pattern").alias("agreement_pattern"), *blank, quote, page, F.lit("").alias("notes"))


def status_counts(cells: DataFrame) -> DataFrame:
    """(field, status, n); a null field for all fields."""
    return cells.groupingSets([("field", "status"), ("status",)], "field", "status").agg(F.count("*").alias("n"))


def coverage(sources: dict[str, DataFrame]) -> DataFrame:
    """(key, legacy, llm_a, llm_b): every document, and whether a source has it; of sources (key, ...), dealt by key once."""
    stacked = None
    for name in SOURCES:
        part = sources[name].select("key", F.lit(name).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("key").agg(*(F.bool_or(F.col("source") == n).alias(n) for n in SOURCES))


def review_summary(cells: DataFrame, covered: DataFrame) -> DataFrame:
    """One row, the summary of a review: records by source and in all, fields, rows of either kind, counts by status, by field and status, and documents that a source lacks by number.
    Which ones these are is ``coverage``'s, a row for each."""
    files = covered.agg(*(F.count_if(n).alias(f"{n}_records") for n in SOURCES), F.count("*").alias("matched_or_union"), F.struct(*(F.count_if(~F.col(n)).alias(f"missing_from_{n}") for n in SOURCES)).alias("input_coverage"))
    counts = status_counts(cells)
    by_field = counts.where("field IS NOT NULL").groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("m"))
    by_field = by_field.agg(F.count("*").alias("fields_per_document"), F.map_from_entries(F.collect_list(F.struct("field", "m"))).alias("field_status_counts"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    settled = F.col("status").isin("silver_auto", "legacy_llm_b_agree")
    total = counts.where("field IS NULL").agg(
        F.coalesce(F.sum(F.when(settled, F.col("n"))), F.lit(0)).alias("silver_rows"), F.coalesce(F.sum(F.when(~settled & (F.col("status") != "all_missing"), F.col("n"))), F.lit(0)).alias("review_rows"), entries.alias("status_counts")
    )
    return files.crossJoin(F.broadcast(by_field)).crossJoin(F.broadcast(total))


def assert_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows; computing them fails if a key repeats. The check is one aggregate, joined by its only row."""
    twice = rows.groupBy(*keys).count().where("count > 1").agg(F.max(F.to_json(F.struct(*keys))).alias("__cw_twice"))
    checked = rows.crossJoin(F.broadcast(twice))
    return checked.where(F.coalesce(F.when(F.col("__cw_twice").isNotNull(), F.raise_error(F.concat(F.lit("repeated key "), F.col("__cw_twice"))).cast("boolean")), F.lit(True))).drop("__cw_twice")


def usable_review(value: Column, status: Column, decision: Column) -> Column:
    """Whether a reviewed value counts: it's there, and its decision, or without one the row's status, is of a known kind."""
    by_decision = F.trim(decision).isin(*fields.REVIEWED)
    by_status = F.trim(status).isin(*fields.OPEN, *fields.REVIEWED)
    return (F.trim(F.coalesce(value, F.lit(""))) != "") & F.when(F.trim(F.coalesce(decision, F.lit(""))) != "", by_decision).otherwise(F.coalesce(by_status, F.lit(False)))


def gold(legacy: DataFrame, silver_rows: DataFrame, review_rows: DataFrame, partial: bool = False) -> DataFrame:
    """(key, field, value_json, origin): silver, else a usable reviewed value, else the legacy one. A cell that waits for review is ``missing`` unless partial.

    legacy: (key, field, value_json)."""
    s = assert_unique(silver_rows, "key", "field").select("key", "field", F.col("silver_value_json").alias("s"))
    good = usable_review(F.col("reviewed_value_json"), F.col("status"), F.col("decision_status"))
    r = assert_unique(review_rows, "key", "field").select("key", "field", F.when(good, F.col("reviewed_value_json")).alias("r"), F.lit(True).alias("waits"))
    old = legacy.select("key", "field", F.col("value_json").alias("l"))
    keys = s.select("key").union(r.select("key")).union(old.select("key")).distinct()
    grid = keys.crossJoin(F.broadcast(legacy.sparkSession.createDataFrame([(f,) for f in fields.FIELDS], "field string")))
    joined = grid.join(s, ["key", "field"], "left").join(r, ["key", "field"], "left").join(old, ["key", "field"], "left")
    origin = F.when(F.col("s").isNotNull(), "silver").when(F.col("r").isNotNull(), "reviewed").when(F.col("waits") & F.lit(not partial), "missing").otherwise("legacy")
    return joined.select("key", "field", F.when(origin != "missing", F.coalesce("s", "r", "l")).alias("value_json"), origin.alias("origin"))


def require_complete(gold_cells: DataFrame, shown: int = 20) -> DataFrame:
    """gold_cells, or an error that lists the first cells which wait for review."""
    waiting = gold_cells.where("origin = 'missing'")
    first = [f"{r['key']} :: {r['field']}" for r in waiting.orderBy("key", "field").limit(shown).collect()]
    if first:
        raise ValueError(f"{waiting.count()} cells have no reviewed value: " + "; ".join(first))
    return gold_cells


def _filled(cell: str) -> Column:
    return ~F.trim(F.coalesce(cell, F.lit(""))).isin("", "[]")


# For each status the source shown, who agrees, the confidence, the decision, the action and the reason.
RULES = {
    "two_llms_agree_legacy_diff": ("llm_b", "llm_a+llm_b", "high", "candidate_legacy_error", "check_pdf_llm_consensus_against_legacy", "Both independent LLM extractions agree after normalization and differ from legacy coding."),
    "legacy_llm_b_agree": ("legacy", "legacy+llm_b", "medium_high", "llm_b_confirmed", "auto_accept_legacy_llm_b", "Legacy coding and full-PDF extraction agree after normalization; auto-confirm unless there is a PDF alignment issue."),
    "legacy_llm_a_agree": ("legacy", "legacy+llm_a", "medium", "candidate_gold_reviewed", "check_pdf_llm_b_disagreement", "Legacy coding and block-text extraction agree after normalization."),
    "all_different": (None, "", "none", "", "manual_pdf_review", "All available source values differ; source PDF review required before choosing a value."),
}
STATUS_RANK = ("two_llms_agree_legacy_diff", "all_different", "legacy_llm_b_agree", "legacy_llm_a_agree", "one_source_only")
CONFIDENCE_RANK = ("high", "medium_high", "medium", "low", "none")
ONLY_ONE = "Only one source has a non-empty value; source PDF must be checked."
ALIGN_FIRST = "PDF alignment issue: fix file mapping or extracted text before field-level review."
ACCEPTED = "Accepted by LLM-B-first workflow: legacy coding and full-PDF extraction agree after normalization."


def suggest(review_rows: DataFrame) -> DataFrame:
    """review_rows with a suggested value, its source and confidence, what to do and why."""
    status = F.col("status")
    filled = F.filter(F.array(*(F.when(_filled(f"{n}_normalized_json"), F.lit(n)) for n in SOURCES)), F.isnotnull)
    only = F.when((status == "one_source_only") & (F.size(filled) == 1), F.element_at(filled, 1))
    names = ("suggested_value_json", "suggested_source", "suggestion_confidence", "suggested_decision_status", "review_action", "suggestion_reason")
    by_source = lambda of: F.coalesce(*(F.when(of == n, F.col(f"{n}_value_json")) for n in SOURCES))
    single = (by_source(only), only, F.lit("low"), F.concat(F.lit("candidate_"), only, F.lit("_only")), F.lit("check_pdf_one_source_only"), F.lit(ONLY_ONE))
    out = {}
    for i, name in enumerate(names):
        value = F.when(only.isNotNull(), single[i])
        for what, rule in RULES.items():
            told = (F.col(f"{rule[0]}_value_json") if rule[0] else F.lit("")) if i == 0 else F.lit(rule[i])
            value = value.when(status == what, told)
        out[name] = F.coalesce(value, F.lit(""))
    return review_rows.withColumns({**out, "needs_pdf_check": F.lit("yes"), "alignment_issue": F.lit(""), "alignment_evidence": F.lit("")})


def annotate(suggested: DataFrame, issues: DataFrame) -> DataFrame:
    """suggested with the alignment issues of each document, which come before everything else; issues: (key, issue_type, related, evidence).

    Kinds are in order of name, evidence in that of a column ``line`` of the issues, or without one in its own. Keys are trimmed, blank ones left out."""
    detail = F.when(F.coalesce("related", F.lit("")) != "", F.concat(F.coalesce("evidence", F.lit("")), F.lit(" Related: "), F.col("related"))).otherwise(F.coalesce("evidence", F.lit("")))
    place = F.col("line") if "line" in issues.columns else F.lit(0)
    found = issues.withColumn("key", F.trim(F.col("key").cast("string"))).where("key <> ''").groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("issue_type") != "", F.col("issue_type")))), "; ").alias("types"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(place.alias("at"), detail.alias("told")))), lambda x: x["told"] != ""), lambda x: x["told"]), " | ").alias("told"),
    )
    has, note = F.col("types").isNotNull(), F.concat(F.lit("PDF alignment issue: "), F.col("types"), F.lit("; see the alignment report."))
    change = {
        "alignment_issue": F.col("types"),
        "alignment_evidence": F.col("told"),
        "needs_pdf_check": F.lit("alignment_issue"),
        "review_action": F.lit("fix_pdf_alignment_first"),
        "suggestion_reason": F.trim(F.concat_ws(" ", F.lit(ALIGN_FIRST), F.col("suggestion_reason"))),
        "notes": F.trim(F.concat_ws(" ", F.when(F.trim("notes") != "", F.trim("notes")), note)),
    }
    return suggested.join(found, "key", "left").withColumns({c: F.when(has, v).otherwise(F.col(c)) for c, v in change.items()}).drop("types", "told")


def auto_confirm(suggested: DataFrame) -> DataFrame:
    """Rows where legacy and B agree, confirmed unless their document has an alignment issue."""
    good = (F.col("status") == "legacy_llm_b_agree") & (F.col("alignment_issue") == "")
    change = {"reviewed_value_json": F.col("legacy_value_json"), "decision_status": F.lit("llm_b_confirmed"), "reviewer": F.lit("auto_llm_b_workflow"), "decision_reason": F.lit(ACCEPTED), "needs_pdf_check": F.lit("no")}
    return suggested.withColumns({c: F.when(good, v).otherwise(F.col(c)) for c, v in change.items()})


def priority(alignment: Column, status: Column, confidence: Column) -> list[Column]:
    """Sort keys: alignment issues first, then by status and confidence."""
    place = lambda names, c, last: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)), F.lit(last))
    return [F.when(alignment != "", 0).otherwise(1), place(STATUS_RANK, status, 99), place(CONFIDENCE_RANK, confidence, 99)]


def worklist(suggested: DataFrame, n: int = 100, statuses: tuple[str, ...] = ("two_llms_agree_legacy_diff", "all_different")) -> DataFrame:
    """The first n rows of the statuses by priority, field and document: a top-k, no full sort."""
    keys = priority(F.col("alignment_issue"), F.col("status"), F.col("suggestion_confidence"))
    return suggested.where(F.col("status").isin(*statuses)).orderBy(*keys, "field", "key").limit(n)


def suggestion_counts(suggested: DataFrame) -> DataFrame:
    """(suggestion_confidence, n, confirmed): suggestions by confidence, and how many were confirmed without a person."""
    return suggested.groupBy("suggestion_confidence").agg(F.count("*").alias("n"), F.count_if(F.col("reviewer") == "auto_llm_b_workflow").alias("confirmed"))


def disagreement_scores(review_rows: DataFrame, reference: str = "reviewed", aliases: Aliases | None = None) -> DataFrame:
    """(source, field, rows, exact, tp, fp, fn, precision, recall, f1): each source against the reviewed or the legacy value; a null field for all fields.

    Rows without a reviewed value are left out, those without a legacy one count as empty."""
    column = "reviewed_value_json" if reference == "reviewed" else "legacy_value_json"
    rows = review_rows.where(F.trim(F.coalesce(column, F.lit(""))) != "") if reference == "reviewed" else review_rows
    sources = [n for n in SOURCES if not (reference == "legacy" and n == "legacy")]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.col(f"{n}_value_json").alias("cell")) for n in sources)))
    # equal comparisons are counted together, and each different cell of a field is made a set once
    pairs = rows.select("field", F.coalesce(column, F.lit("")).alias("ref"), each.alias("s")).groupBy("field", "s.source", F.coalesce("s.cell", F.lit("")).alias("cell"), "ref").agg(F.count("*").alias("n"))
    pairs = cut(pairs)
    known = value_sets(pairs.select("field", F.explode(F.array("cell", "ref")).alias("text")), aliases, from_json_cell)
    sets = pairs
    for name, to in (("cell", "x"), ("ref", "y")):
        sets = sets.join(known.withColumnsRenamed({"text": name, "values": to}), ["field", name])
    counted = sets.select("source", "field", "n", (F.col("x") == F.col("y")).alias("exact"), exact_counts(F.col("x"), F.col("y")).alias("c")).select("source", "field", "n", "exact", "c.*")
    sums = [F.sum("n").alias("rows"), F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("exact"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in ("tp", "fp", "fn"))]
    return with_metrics(counted.groupingSets([("source", "field"), ("source",)], "source", "field").agg(*sums))
