"""A query for each operator over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import fields, text
from cellweave.functions.normalize import age, alias, atom, gender_counts, nearest_label, value_set, with_units
from cellweave.functions.similarity import cosine, interval, interval_overlap, value_tokens
from cellweave.operators import alignment, eda, layout, matching, reconcile, sampling, verify
from cellweave.plans import evaluation, extraction
from cellweave.sources import records, sinks
from cellweave.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """(key, field, predicted, gold): supplier numbers of an order's odd and of its even lines, by the order's priority."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).cast("string").alias("v"), (F.col("l_linenumber") % 2 == 1).alias("odd"))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("v"))))
    sets = lines.groupBy("l_orderkey").agg(pick(F.col("odd")).alias("predicted"), pick(~F.col("odd")).alias("gold")).where((F.size("predicted") > 0) & (F.size("gold") > 0))
    return sets.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("field"), "predicted", "gold")


@query("""
    WITH s AS (
        SELECT l_orderkey, list(DISTINCT l_suppkey % 10) FILTER (l_linenumber % 2 = 1) AS p, list(DISTINCT l_suppkey % 10) FILTER (l_linenumber % 2 = 0) AS g
        FROM lineitem GROUP BY l_orderkey
    ), c AS (
        SELECT o_orderpriority AS field, len(list_intersect(p, g)) AS tp, len(p) - len(list_intersect(p, g)) AS fp, len(g) - len(list_intersect(p, g)) AS fn
        FROM s JOIN orders ON l_orderkey = o_orderkey WHERE len(p) > 0 AND len(g) > 0
    ), t AS (SELECT coalesce(field, 'ALL') AS field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (field))
    SELECT field, tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""")
def set_score_micro(spark: SparkSession, d: str) -> DataFrame:
    counted = _sides(spark, d).select("field", matching.exact_counts(F.col("predicted"), F.col("gold")).alias("c")).select("field", "c.*")
    sums = counted.rollup("field").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    out = matching.with_metrics(sums)
    return out.select(F.coalesce("field", F.lit("ALL")).alias("field"), "tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query("""
    WITH s AS (
        SELECT l_orderkey, list(DISTINCT l_suppkey % 10) FILTER (l_linenumber % 2 = 1) AS p, list(DISTINCT l_suppkey % 10) FILTER (l_linenumber % 2 = 0) AS g FROM lineitem GROUP BY l_orderkey
    )
    SELECT count(*)::BIGINT AS documents, (count(*) FILTER (len(list_intersect(p, g)) = len(p) AND len(p) = len(g)))::BIGINT AS exact, round(avg((len(list_intersect(p, g)) = len(p) AND len(p) = len(g))::INT), 6) AS rate
    FROM s WHERE len(p) > 0 AND len(g) > 0""")
def document_exactness(spark: SparkSession, d: str) -> DataFrame:
    scored = _sides(spark, d).withColumn("score", matching.exact_counts(F.col("predicted"), F.col("gold")))
    return matching.document_exactness(scored).withColumn("rate", r6(F.col("rate")))


@query("""
    SELECT doc_id, md5(trim(regexp_replace(replace(translate(strip_accents(lower(text)), '–—‐', '---'), 'behaviour', 'behavior'), '\\s+', ' ', 'g'))) AS plain,
           md5(trim(regexp_replace(text, '\\s*\\([^)]*\\)', '', 'g'))) AS bare FROM documents""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.basic(F.col("text"))).alias("plain"), F.md5(text.without_parentheses(F.col("text"))).alias("bare"))


@query("""
    SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS name, regexp_replace(lower(c_mktsegment || '-' || c_name), '[^a-z0-9]+', '', 'g') AS both FROM customer""")
def slug_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("name"), text.slug(F.concat_ws("-", "c_mktsegment", "c_name")).alias("both"))


@query("""
    SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'construction' WHEN 'machinery' THEN 'industry' ELSE lower(c_mktsegment) || ' (segment)' END AS segment,
           CASE c_custkey % 4 WHEN 0 THEN 'united states' WHEN 1 THEN 'female' WHEN 2 THEN 'school' ELSE 'elsewhere' END AS value FROM customer""")
def alias_chain(spark: SparkSession, d: str) -> DataFrame:
    own = {"Segment": {"building": "construction"}, "global": {"machinery": "industry"}}
    code = F.element_at(F.array(*map(F.lit, ("usa", "girls", "s", "elsewhere"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", alias(F.concat(F.lower("c_mktsegment"), F.lit(" (segment)")), F.lit("Segment"), own).alias("segment"), alias(code, F.lit("Setting")).alias("value"))


NULL_CASES = ("n/a", " NA ", "None", "null", "", "  ", "NR", "not reported", "x", "0")


@query("""
    SELECT o_orderkey, field, CASE WHEN lower(trim(v)) IN ('', 'n/a', 'na', 'none', 'null') THEN NULL WHEN field = 'Drop-outs' AND lower(v) IN ('nr', 'not reported') THEN NULL
           WHEN lower(v) = 'nr' AND field = 'Setting' THEN 'not reported' ELSE lower(v) END AS value
    FROM (SELECT o_orderkey, ['n/a', ' NA ', 'None', 'null', '', '  ', 'NR', 'not reported', 'x', '0'][o_orderkey % 10 + 1] AS v FROM orders), (VALUES ('Drop-outs'), ('Setting')) AS f(field)""")
def null_policy(spark: SparkSession, d: str) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, NULL_CASES)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", value.alias("v"), F.explode(F.array(F.lit("Drop-outs"), F.lit("Setting"))).alias("field"))
    return rows.select("o_orderkey", "field", atom(F.col("v"), F.col("field")).alias("value"))


@query("""
    SELECT p_partkey, p_size::VARCHAR AS weeks, p_size || '-' || (p_size + 2) AS span, printf('%.12g', p_retailprice) AS price, p_size || '-' || (p_size + 1) AS age FROM part""")
def units_and_ranges(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    more = (F.col("p_size") + 2).cast("string")
    return table(spark, d, "part").select(
        "p_partkey",
        with_units(F.concat(F.lit("about "), size, F.lit(" weeks")), F.lit("Treatment length")).alias("weeks"),
        with_units(F.concat(size, F.lit(" to "), more, F.lit(" sessions")), F.lit("Number of sessions")).alias("span"),
        text.general(F.col("p_retailprice")).alias("price"),
        age(F.concat(F.lit("aged "), size, F.lit(" to "), (F.col("p_size") + 1).cast("string"), F.lit(" years"))).alias("age"),
    )


@query("""
    SELECT c_custkey, 'female:' || (c_custkey % 5 + 1) || '|male:' || (c_custkey % 3 + 1) AS counts, 'female:' || (c_custkey % 7) AS girls FROM customer""")
def gender_count_texts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k, add: (F.col("c_custkey") % k + add).cast("string")
    return table(spark, d, "customer").select("c_custkey", gender_counts(F.concat(n(5, 1), F.lit("F/"), n(3, 1), F.lit("M"))).alias("counts"), gender_counts(F.concat(n(7, 0), F.lit(" girls in school"))).alias("girls"))


@query("""
    SELECT label, count(*)::BIGINT AS count FROM (SELECT unnest(string_split(p_brand || '|' || replace(p_type, ' ', '|'), '|')) AS label FROM part) WHERE label <> '' GROUP BY label""")
def split_explode_freq(spark: SparkSession, d: str) -> DataFrame:
    labels = text.split_labels(F.concat(F.col("p_brand"), F.lit(";"), F.replace("p_type", F.lit(" "), F.lit("|"))))
    return eda.label_counts(table(spark, d, "part"), labels, F.col("p_partkey"))


@query("""
    WITH p AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_quantity > 25), g AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT side, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p.key IS NULL THEN 'missing' WHEN g.key IS NULL THEN 'extra' ELSE 'both' END AS side FROM p FULL JOIN g ON p.key = g.key) GROUP BY side""")
def missing_extra_keys(spark: SparkSession, d: str) -> DataFrame:
    predicted = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("key"))
    gold = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"))
    return matching.compare_keys(predicted, gold).groupBy("side").agg(F.count("*").alias("n"))


@query("""
    WITH s AS (
        SELECT l_orderkey, min(l_quantity) FILTER (l_linenumber % 2 = 1) AS a, max(l_quantity) FILTER (l_linenumber % 2 = 1) AS b, min(l_quantity) FILTER (l_linenumber % 2 = 0) AS c, max(l_quantity) FILTER (l_linenumber % 2 = 0) AS d
        FROM lineitem GROUP BY l_orderkey
    ), t AS (SELECT *, greatest(least(b, d) - greatest(a, c) + 1, 0) AS n FROM s)
    SELECT l_orderkey, CASE WHEN c IS NOT NULL AND a IS NOT NULL THEN round(n / ((b - a + 1) + (d - c + 1) - n), 6) END AS similarity FROM t""")
def interval_similarity(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    q = lambda odd: F.when(F.col("l_linenumber") % 2 == odd, F.col("l_quantity"))
    ends = lines.groupBy("l_orderkey").agg(*(f(q(odd)).alias(f"{n}{odd}") for odd in (0, 1) for n, f in (("low", F.min), ("high", F.max))))
    spell = lambda odd: F.concat(text.general(F.col(f"low{odd}")), F.lit("-"), text.general(F.col(f"high{odd}")))
    return ends.select("l_orderkey", r6(interval_overlap(interval(spell(1)), interval(spell(0)))).alias("similarity"))


TOKENS_SQL = """list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: x NOT IN ('a', 'an', 'the', 'of', 'and', 'or', 'for', 'with', 'in', 'on', 'to', 'by', 'at', 'is', 'as', 'per', 'vs', 'via')), lambda x: CASE WHEN len(x) > 3 AND x LIKE '%s' THEN x[:-2] ELSE x END)"""
COSINE_SQL = """CASE WHEN len(a) > 0 AND len(b) > 0 THEN list_sum(list_transform(list_distinct(a), lambda t: len(list_filter(a, lambda x: x = t)) * len(list_filter(b, lambda x: x = t))))
    / (sqrt(list_sum(list_transform(list_distinct(a), lambda t: len(list_filter(a, lambda x: x = t)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(b), lambda t: len(list_filter(b, lambda x: x = t)) ** 2)))) ELSE 0 END"""


@query(f"""
    WITH t AS (SELECT p_partkey, {TOKENS_SQL.format("p_name || ' of ' || p_type")} AS a, {TOKENS_SQL.format("p_type || ' ' || p_type || ' ' || p_brand")} AS b FROM part)
    SELECT p_partkey, round({COSINE_SQL}, 6) AS similarity FROM t""")
def token_cosine(spark: SparkSession, d: str) -> DataFrame:
    left, right = F.concat_ws(" of ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_type", "p_brand")
    pair = F.struct(value_tokens(left).alias("a"), value_tokens(right).alias("b"))
    return table(spark, d, "part").select("p_partkey", r6(text.let(pair, lambda x: cosine(x["a"], x["b"]))).alias("similarity"))


LABELS = ("economy anodized", "large polished", "medium brushed", "promo plated", "standard burnished")


@query(f"""
    WITH t AS (SELECT p_partkey, lower(p_type) AS text, label, {TOKENS_SQL.format("p_type")} AS a, {TOKENS_SQL.format("label")} AS b
               FROM part, (VALUES {", ".join(f"('{x}')" for x in LABELS)}) AS v(label)),
    s AS (SELECT p_partkey, text, label, {COSINE_SQL} AS score FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, label) AS n FROM s)
    SELECT p_partkey, CASE WHEN score >= 0.5 THEN label ELSE text END AS label FROM r WHERE n = 1""")
def nearest_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", nearest_label(F.lower("p_type"), LABELS, 0.5).alias("label"))


@query()
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    spans = _sides(spark, d).select("key", *(F.transform(c, lambda v: F.concat(v, F.lit("-"), (v.cast("int") + F.col("key") % 5).cast("int").cast("string"))).alias(c) for c in ("predicted", "gold")))
    scored = spans.withColumn("s", matching.score(F.col("predicted"), F.col("gold"), F.lit("Age")))
    return scored.select("key", "s.tp", "s.fp", "s.fn", "s.soft_tp", "s.soft_fp", "s.soft_fn", F.size("s.matches").alias("n_soft"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "contradicted").otherwise("supported")).otherwise(F.when(F.col("toxic") == 1, "inferred").otherwise("not_in_text"))
    return table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit("text").alias("field"), kind.alias("verdict"))


VERDICT_SQL = "CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'contradicted' ELSE 'supported' END ELSE CASE WHEN toxic = 1 THEN 'inferred' ELSE 'not_in_text' END END"


@query(f"""
    WITH v AS (SELECT doc_id AS key, {VERDICT_SQL} AS verdict, CASE WHEN doc_id % 2 = 0 THEN replace(substring(text, 11, 30), ' ', '   ') ELSE 'no such passage ' || doc_id END AS quote, text FROM labels JOIN documents USING (doc_id))
    SELECT key, verdict, CASE WHEN verdict IN ('supported', 'contradicted') AND trim(quote) <> '' THEN contains(trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))), trim(lower(regexp_replace(quote, '\\s+', ' ', 'g')))) END AS quote_matched FROM v""")
def quote_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    quote = F.when(F.col("key") % 2 == 0, F.replace(F.substring("text", 11, 30), F.lit(" "), F.lit("   "))).otherwise(F.concat(F.lit("no such passage "), F.col("key")))
    told = _verdicts(spark, d).join(docs, "key").select("key", "field", "verdict", quote.alias("quote"))
    return verify.annotate_quotes(told, docs).select("key", "verdict", "quote_matched")


@query(f"""
    SELECT verdict, coalesce(agree, 0)::BIGINT AS agree, coalesce(disagree, 0)::BIGINT AS disagree FROM (VALUES ('supported'), ('contradicted'), ('not_in_text'), ('inferred')) AS d(verdict) LEFT JOIN (
        SELECT {VERDICT_SQL} AS verdict, count(*) FILTER (n_chars % 3 = 0) AS agree, count(*) FILTER (n_chars % 3 <> 0) AS disagree FROM labels JOIN documents USING (doc_id) GROUP BY 1) USING (verdict)""")
def verdict_crosstab(spark: SparkSession, d: str) -> DataFrame:
    wrong = (F.col("n_chars") % 3).cast("long")
    scored = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("text").alias("field"), F.struct(wrong.alias("fp"), F.lit(0).alias("fn")).alias("score"))
    return verify.crosstab(scored, _verdicts(spark, d))


@query(f"""
    SELECT key, (verdict = 'supported')::BIGINT AS supported, (verdict = 'contradicted')::BIGINT AS contradicted, (verdict = 'not_in_text')::BIGINT AS not_in_text, (verdict = 'inferred')::BIGINT AS inferred,
           (verdict IN ('supported', 'contradicted') AND key % 2 = 1)::BIGINT AS quote_unmatched FROM (SELECT doc_id AS key, {VERDICT_SQL} AS verdict FROM labels)""")
def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    matched = F.when(F.col("verdict").isin("supported", "contradicted"), F.col("key") % 2 == 0)
    return verify.verdict_summary(_verdicts(spark, d).withColumn("quote_matched", matched))


def _three(spark: SparkSession, d: str) -> DataFrame:
    """(key, field, status, ...) of three sets of supplier numbers in each order."""
    lines = table(spark, d, "lineitem")
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 3 == k, (F.col("l_suppkey") % 2).cast("string"))))
    sets = lines.groupBy(F.col("l_orderkey").alias("key")).agg(*(pick(k).alias(n) for k, n in enumerate(reconcile.SOURCES)))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("field"))
    none = F.array().cast("array<string>")
    joined = orders.join(sets, "key", "left").select("key", "field", *(F.coalesce(n, none).alias(n) for n in reconcile.SOURCES))
    return joined.withColumn("a", reconcile.agreement(*(F.col(n) for n in reconcile.SOURCES))).select("*", "a.*").drop("a")


THREE_SQL = """
    WITH sets AS (
        SELECT o_orderkey AS key, o_orderpriority AS field, coalesce(list_sort(list(DISTINCT l_suppkey % 2) FILTER (l_linenumber % 3 = 0)), []) AS l,
               coalesce(list_sort(list(DISTINCT l_suppkey % 2) FILTER (l_linenumber % 3 = 1)), []) AS a, coalesce(list_sort(list(DISTINCT l_suppkey % 2) FILTER (l_linenumber % 3 = 2)), []) AS b
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
    ), three AS (
        SELECT *, CASE WHEN len(l) + len(a) + len(b) = 0 THEN 'all_missing' WHEN l = a AND a = b THEN 'silver_auto' WHEN a = b AND len(a) > 0 THEN 'two_llms_agree_legacy_diff'
            WHEN l = a AND len(l) > 0 THEN 'legacy_llm_a_agree' WHEN l = b AND len(l) > 0 THEN 'legacy_llm_b_agree'
            WHEN (len(l) > 0)::INT + (len(a) > 0)::INT + (len(b) > 0)::INT = 1 THEN 'one_source_only' ELSE 'all_different' END AS status FROM sets
    )"""


@query(THREE_SQL + " SELECT key, status, CASE WHEN status IN ('all_missing', 'silver_auto') THEN 'low' WHEN status IN ('two_llms_agree_legacy_diff', 'all_different') THEN 'high' ELSE 'medium' END AS priority FROM three")
def three_way_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _three(spark, d).select("key", "status", "priority")


@query(THREE_SQL + " SELECT coalesce(field, 'ALL') AS field, status, count(*)::BIGINT AS n FROM three GROUP BY GROUPING SETS ((field, status), (status))")
def field_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.status_counts(_three(spark, d)).withColumn("field", F.coalesce("field", F.lit("ALL")))


def _review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Review rows with a reviewed value for every fourth order."""
    cell = lambda n: F.concat(F.lit("["), F.array_join(n, ","), F.lit("]"))
    cols = [c for n in reconcile.SOURCES for c in (cell(n).alias(f"{n}_value_json"), cell(n).alias(f"{n}_normalized_json"))]
    done = F.col("key") % 4 == 0
    return _three(spark, d).select("key", "field", "status", *cols, F.when(done, F.concat(F.lit("["), (F.col("key") % 2).cast("string"), F.lit("]"))).otherwise("").alias("reviewed_value_json"), F.when(F.col("key") % 8 == 0, "gold_reviewed").otherwise("").alias("decision_status"), F.lit("").alias("reviewer"), F.lit("").alias("decision_reason"), F.lit("").alias("notes"))


@query(THREE_SQL + """ SELECT origin, count(*)::BIGINT AS n FROM (
        SELECT CASE WHEN status IN ('silver_auto', 'legacy_llm_b_agree') THEN 'silver' WHEN status <> 'all_missing' AND key % 4 = 0 THEN 'reviewed' WHEN status <> 'all_missing' THEN 'missing' ELSE 'legacy' END AS origin FROM three) GROUP BY origin""")
def gold_precedence(spark: SparkSession, d: str) -> DataFrame:
    rows = _review_rows(spark, d)
    settled = F.col("status").isin("silver_auto", "legacy_llm_b_agree")
    # the fields of the registry are the grid, so the orders' cells stand for one of them
    as_field = F.lit("Age").alias("field")
    silver = rows.where(settled).select("key", as_field, F.col("legacy_value_json").alias("silver_value_json"))
    review = rows.where(~settled & (F.col("status") != "all_missing")).select("key", as_field, "status", "reviewed_value_json", "decision_status")
    legacy = rows.select("key", as_field, F.col("legacy_value_json").alias("value_json"))
    return reconcile.gold(legacy, silver, review).where("field = 'Age'").groupBy("origin").agg(F.count("*").alias("n"))


@query(THREE_SQL + """, r AS (
        SELECT key, field, status, key % 50 = 0 AS issue, CASE status WHEN 'two_llms_agree_legacy_diff' THEN 0 ELSE 4 END AS confidence FROM three WHERE status IN ('two_llms_agree_legacy_diff', 'all_different'))
    SELECT key, field, status, CASE WHEN issue THEN 'fix_pdf_alignment_first' WHEN confidence = 0 THEN 'check_pdf_llm_consensus_against_legacy' ELSE 'manual_pdf_review' END AS review_action
    FROM r ORDER BY NOT issue, status <> 'two_llms_agree_legacy_diff', confidence, field, key LIMIT 100""")
def suggest_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("key"), F.lit("missing_input_pdf").alias("issue_type"), F.lit("").alias("related"), F.lit("none").alias("evidence"))
    suggested = reconcile.auto_confirm(reconcile.annotate(reconcile.suggest(_review_rows(spark, d)), issues))
    return reconcile.worklist(suggested).select("key", "field", "status", "review_action")


@query(THREE_SQL + """ SELECT CASE status WHEN 'two_llms_agree_legacy_diff' THEN 'high' WHEN 'legacy_llm_b_agree' THEN 'medium_high' WHEN 'legacy_llm_a_agree' THEN 'medium' WHEN 'one_source_only' THEN 'low' WHEN 'all_different' THEN 'none' ELSE '' END AS suggestion_confidence,
        count(*)::BIGINT AS n, (count(*) FILTER (status = 'legacy_llm_b_agree' AND key % 50 <> 0))::BIGINT AS confirmed FROM three GROUP BY 1""")
def suggestion_counts(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("key"), F.lit("missing_input_pdf").alias("issue_type"), F.lit("").alias("related"), F.lit("none").alias("evidence"))
    return reconcile.suggestion_counts(reconcile.auto_confirm(reconcile.annotate(reconcile.suggest(_review_rows(spark, d)), issues)))


@query(THREE_SQL + """, e AS (
        SELECT source, field, x, [key % 2] AS y FROM (SELECT key, field, unnest(['legacy', 'llm_a', 'llm_b']) AS source, unnest([l, a, b]) AS x FROM three WHERE key % 4 = 0)
    ), c AS (SELECT source, field, (x = y)::INT AS exact, len(list_intersect(x, y)) AS tp, len(x) - len(list_intersect(x, y)) AS fp, len(y) - len(list_intersect(x, y)) AS fn FROM e
    ), t AS (SELECT source, coalesce(field, 'ALL') AS field, count(*)::BIGINT AS rows, sum(exact)::BIGINT AS exact, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((source, field), (source)))
    SELECT source, field, rows, exact, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM t""")
def disagreement_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = reconcile.disagreement_scores(_review_rows(spark, d))
    return scores.select("source", F.coalesce("field", F.lit("ALL")).alias("field"), "rows", "exact", "tp", "fp", "fn", r6("f1").alias("f1"))


@query("""
    SELECT doc_id::VARCHAR AS file, sha256(text) AS sha256, min(doc_id::VARCHAR) OVER w AS first, count(*) OVER w AS n FROM documents
    WINDOW w AS (PARTITION BY sha256(text)) QUALIFY n > 1""")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("sha256"))
    return alignment.duplicate_members(files)


AUTHORS = {"en": "The, 2001", "fr": "Les 2002"}


@query("""
    WITH s AS (SELECT doc_id::VARCHAR AS key, CASE lang WHEN 'en' THEN 'the' WHEN 'fr' THEN 'les' ELSE 'und' END AS author, doc_id % 10 = 0 AS gone, regexp_replace(lower(substring(text, 1, 500)), '[^a-z0-9]+', ' ', 'g') AS head FROM documents)
    SELECT key, CASE WHEN gone THEN 'missing_input_pdf' WHEN trim(head) = '' THEN 'empty_extracted_blocks' ELSE 'legacy_author_not_in_first_pages' END AS issue_type FROM s WHERE gone OR trim(head) = '' OR NOT contains(head, author)""")
def author_absent(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("key", F.col("doc_id").cast("string"))
    studies = docs.select("key", F.coalesce(eda.mapped(F.col("lang"), AUTHORS), F.lit("")).alias("study")).withColumn("study", F.when(F.col("study").isin(*AUTHORS.values()), F.col("study")).otherwise("Und 2003"))
    files = docs.where("doc_id % 10 <> 0").select(F.col("key").alias("file"), F.sha2("text", 256).alias("sha256"))
    pages = docs.select("key", F.col("key").alias("name"), F.substring("text", 1, 500).alias("text"))
    return alignment.author_absent(studies, files, pages).select("key", "issue_type")


@query("""
    SELECT s_name AS study, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '.pdf' WHEN s_suppkey % 3 = 1 THEN replace(s_name, '#', '_') || '.PDF' END AS file, CASE s_suppkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'slug' END AS tier FROM supplier""")
def theta_match_tiers(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(".pdf"))).otherwise(F.concat(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(".PDF")))
    files = suppliers.where("s_suppkey % 3 <> 2").select(name.alias("file"))
    return alignment.match_studies(suppliers.select(F.col("s_name").alias("study")), files, ("exact", "slug", "author_year"))


@query("""
    SELECT translate(lpad(c_custkey::VARCHAR, 8, '0'), '0123456789', 'abcdefghij') || ' Smith, 2001' AS study, 'final ' || translate(lpad(c_custkey::VARCHAR, 8, '0'), '0123456789', 'abcdefghij') || ' 2001.pdf' AS file FROM customer WHERE c_custkey % 2 = 0""")
def author_year_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers as authors: letters of their number make a name of its own."""
    letters = F.translate(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), "0123456789", "abcdefghij")
    people = table(spark, d, "customer").select("c_custkey", letters.alias("w"))
    files = people.where("c_custkey % 2 = 0").select(F.concat(F.lit("final "), "w", F.lit(" 2001.pdf")).alias("file"))
    return alignment.by_author_and_year(people.select(F.concat("w", F.lit(" Smith, 2001")).alias("study")), files)


@query("""
    SELECT o_custkey AS sheet, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS study, o_orderstatus FROM orders QUALIFY study IS NOT NULL""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("study"), "o_orderstatus")
    return records.spreadsheet_records(rows, "o_orderkey", "study", ["o_orderstatus"]).select("sheet", "o_orderkey", "study", "o_orderstatus")


@query("""
    WITH v AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY ALL), l AS (SELECT o_custkey, list('"' || o_orderstatus || '"' ORDER BY first) AS s FROM v GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN len(s) = 1 THEN s[1] ELSE '[' || array_to_string(s, ', ') || ']' END AS value FROM l""")
def collapse_values(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("v")))), lambda x: x["v"])
    return table(spark, d, "orders").groupBy("o_custkey").agg(eda.collapsed(values).alias("value"))


@query("""
    SELECT 'quality' AS "column", round(avg((quality IS NULL)::INT), 6) AS ratio FROM documents LEFT JOIN labels USING (doc_id) UNION ALL
    SELECT 'toxic', round(avg((toxic IS NULL)::INT), 6) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'doc_id', 0 UNION ALL SELECT 'lang', round(avg((lang IS NULL)::INT), 6) FROM documents""")
def null_ratio_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return eda.null_ratios(rows, 8).select("column", r6("ratio").alias("ratio"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return eda.missing_keys(rows, "doc_id", "toxic")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY o_orderstatus")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return eda.group_summary(table(spark, d, "orders"), "o_orderstatus", "o_custkey", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("""
    SELECT 'o_orderstatus' AS "column", coalesce(o_orderstatus, 'Missing') AS value, count(*)::BIGINT AS count FROM orders GROUP BY ALL
    UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, 'Missing'), count(*)::BIGINT FROM orders GROUP BY ALL""")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return eda.value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
    WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), p AS (SELECT least(floor((c_acctbal - a) / ((b - a) / 15)), 14)::INT AS bin FROM customer, e)
    SELECT g.bin, count(p.bin)::BIGINT AS n FROM (SELECT unnest(range(15))::INT AS bin) g LEFT JOIN p ON g.bin = p.bin GROUP BY g.bin""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(table(spark, d, "customer"), "c_acctbal").select("bin", "n")


@query("SELECT c_mktsegment AS value, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1")
def majority_share(spark: SparkSession, d: str) -> DataFrame:
    return eda.majority_share(table(spark, d, "customer"), "c_mktsegment").withColumn("share", r6(F.col("share")))


@query("SELECT count(c_acctbal)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer")
def describe_numbers(spark: SparkSession, d: str) -> DataFrame:
    return eda.describe(table(spark, d, "customer"), "c_acctbal").withColumns({c: F.round(c, 4) for c in ("mean", "median")})


@query("SELECT c_nationkey, count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 6")
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return eda.top_groups(table(spark, d, "customer"), "c_nationkey", "c_acctbal").withColumn("mean", F.round("mean", 4))


@query("""
    WITH e AS (SELECT user_id AS doc, epoch(ts) / 3600.0 AS y, value AS x, event_id FROM events),
    m AS (SELECT *, CASE WHEN y - lag(y) OVER w <= 10 AND abs(x - lag(x) OVER w) <= 24 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY doc ORDER BY y, x, event_id)),
    b AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY y, x, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM m)
    SELECT doc, block, count(*)::INT AS line_count FROM b GROUP BY doc, block""")
def islands_merge(spark: SparkSession, d: str) -> DataFrame:
    y = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0
    lines = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("column"), F.col("event_id").alias("ord"), y.alias("y0"), y.alias("y1"), F.col("value").alias("x0"), F.col("value").alias("x1"), F.col("event_type").alias("text"), F.lit(0.0).alias("font_size"))
    return layout.paragraphs(lines).select("doc", "block", "line_count")


@query("""
    SELECT page_id, (page_id % 100 <= 6 AND len(url) <= 80) OR (page_id % 100 >= 94 AND len(url) <= 140) AS noise,
           page_id % 70 >= 60 OR page_id % 5 >= 2 OR (page_id % 5 = 1 AND page_id % 70 >= 15) OR ((contains(lower(url), 'graph') OR contains(lower(url), 'chart') OR contains(lower(url), 'figure') OR contains(lower(url), 'fig.') OR contains(lower(url), 'fig ')) AND (page_id % 5 >= 1 OR page_id % 70 >= 15)) AS figure
    FROM pages""")
def page_rules(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("page_id") % 100).cast("double")
    images = F.array_repeat(F.struct(F.lit(300).alias("width"), F.lit(200).alias("height")), (F.col("page_id") % 5).cast("int"))
    noise = layout.margin_noise(F.col("url"), y, y, F.lit(10.0), F.lit(100.0))
    return table(spark, d, "pages").select("page_id", noise.alias("noise"), layout.shows_figure(F.col("page_id") % 70, images, F.col("url")).alias("figure"))


@query("SELECT doc_id, ceil(len(text) / 1000)::INT AS n, md5(substring(text, (ceil(len(text) / 1000)::BIGINT - 1) * 1000 + 1, 1000)) AS last FROM documents WHERE len(text) > 0")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", text.chunks(F.col("text"), 1000).alias("c")).where(F.size("c") > 0)
    return cut.select("doc_id", F.size("c").alias("n"), F.md5(F.element_at("c", -1)).alias("last"))


@query("""
    SELECT conv_id::VARCHAR AS file, md5(substring(string_agg('[p' || turn || ' bbox{1.0, 2.0}] ' || text, chr(10) ORDER BY turn), 1, 8000)) AS prompt FROM conversations GROUP BY conv_id""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("ord"), F.col("turn").alias("page"), F.array(F.lit(1.0), F.lit(2.0)).alias("bbox"), "text")
    return extraction.block_prompts(blocks).select("file", F.md5("prompt").alias("prompt"))


@query("""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS turn, count(*) OVER (PARTITION BY lang) AS size, min(md5(doc_id::VARCHAR)) OVER (PARTITION BY lang) AS first FROM documents)
    SELECT doc_id, lang FROM r ORDER BY turn, size DESC, first, md5(doc_id::VARCHAR) LIMIT 50""")
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.round_robin(docs, F.col("lang"), 50, F.md5(F.col("doc_id").cast("string")))


@query("""
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) <= least(greatest(floor(0.8 * (SELECT count(*) FROM documents)), 1), (SELECT count(*) FROM documents) - 1) THEN 'train' ELSE 'test' END AS part FROM documents""")
def exact_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    return sampling.split(docs, 0.8, ["h", "doc_id"]).select("doc_id", "part")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), F.parse_json("props").alias("record"))
    found = records.cells(rows).where("field = 'k'")
    k = F.try_variant_get("value", "$", "int")
    return found.select(F.col("key").alias("event_id"), k.cast("string").alias("k"), F.when(k % 2 == 0, "even").otherwise("odd").alias("parity"))


@query("""
    WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM pages)
    SELECT page_id, (i - 1)::INT AS ord, t[i] AS text FROM p, unnest(generate_series(1, len(t))) AS s(i)""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return records.html_blocks(table(spark, d, "pages"))


def _evaluated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    lines = table(spark, d, "lineitem")

    def side(odd: int) -> DataFrame:
        part = lines.where(F.col("l_linenumber") % 2 == odd)
        held = part.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_set(F.col("l_quantity"))).alias("Age"), F.max(F.concat((F.col("l_suppkey") % 4 + 1).cast("string"), F.lit(" sessions"))).alias("Number of sessions"), F.min(F.element_at(F.array(*map(F.lit, ("UC", "S", "NR", "OTH"))), (F.col("l_partkey") % 4 + 1).cast("int"))).alias("Setting"))
        return held.select("key", F.parse_json(F.to_json(F.struct("Age", "`Number of sessions`", "Setting"))).alias("record"))

    return evaluation.evaluate(side(1), side(0))


EVALUATED = """
    WITH l AS (SELECT l_orderkey AS key, l_linenumber % 2 AS odd, l_quantity AS q, (l_suppkey % 4 + 1)::INT AS n, ['UC', 'S', 'NR', 'OTH'][(l_partkey % 4 + 1)::INT] AS c FROM lineitem),
    side AS (SELECT key, odd, min(q) AS lo, max(q) AS hi, max(n) AS n, min(c) AS c FROM l GROUP BY key, odd),
    pair AS (SELECT p.key, p.lo AS pl, p.hi AS ph, g.lo AS gl, g.hi AS gh, p.n AS pn, g.n AS gn, p.c AS pc, g.c AS gc FROM side p JOIN side g ON p.key = g.key AND p.odd = 1 AND g.odd = 0),
    pairs AS (
        SELECT key, 'Age' AS field, pl = gl AND ph = gh AS same, greatest(least(ph, gh) - greatest(pl, gl) + 1, 0) AS n, (ph - pl + 1) + (gh - gl + 1) AS m FROM pair
        UNION ALL SELECT key, 'Number of sessions', pn = gn, (pn = gn)::INT, 2 FROM pair UNION ALL SELECT key, 'Setting', pc = gc, (pc = gc)::INT, 2 FROM pair),
    scored AS (SELECT key, field, same::INT AS tp, (NOT same)::INT AS wrong, CASE WHEN n / (m - n) >= 0.5 THEN round_even(n / (m - n), 6) ELSE 0 END AS soft FROM pairs)"""


@query(EVALUATED + """, names AS (SELECT unnest(['Study', 'Type of publication', 'Country', 'Number of Cases', 'Drop-outs', 'Sample type', 'Setting', 'Gender', 'Age', 'Ethnicity / Race', 'Primary diagnosis',
        'Diagnosis screening or diagnostic interview?', 'Comorbid diagnosis / problems', 'Type of treatments', 'Treatment protocol', 'Treatment length', 'Number of sessions', 'Treatment directed at', 'Type of SCED design',
        'Data availability', 'Frequent assessment variable broad category', 'Frequent assessment specific symptom']) AS field),
    sums AS (SELECT coalesce(field, 'ALL') AS field, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(wrong), 0)::BIGINT AS fp, coalesce(sum(soft), 0)::DOUBLE AS soft_tp, coalesce(sum(1 - soft), 0)::DOUBLE AS soft_fp
             FROM names LEFT JOIN scored USING (field) GROUP BY ROLLUP (field))
    SELECT field, tp, fp, fp AS fn, round(soft_tp, 4) AS soft_tp, round(CASE WHEN tp + fp > 0 THEN soft_fp ELSE 0 END, 4) AS soft_fp, round(CASE WHEN tp + fp > 0 THEN soft_fp ELSE 0 END, 4) AS soft_fn,
           round(CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS "precision", round(CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS f1,
           round(CASE WHEN soft_tp > 0 THEN soft_tp / (soft_tp + soft_fp) ELSE 0 END, 4) AS soft_precision, round(CASE WHEN soft_tp > 0 THEN soft_tp / (soft_tp + soft_fp) ELSE 0 END, 4) AS soft_recall,
           round(CASE WHEN soft_tp > 0 THEN soft_tp / (soft_tp + soft_fp) ELSE 0 END, 4) AS soft_f1 FROM sums""")
def evaluate_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records: lines' quantities as ages, ship years as sessions; odd lines against even ones, through normalization, matching and metrics."""
    out = _evaluated(spark, d)["metrics"]
    return out.select(F.coalesce("field", F.lit("ALL")).alias("field"), *(F.round(c, 4).alias(c) for c in out.columns[1:]))


@query("""
    SELECT substring(md5(c_custkey::VARCHAR), 1, 8) || 'x' || substring(md5(c_custkey::VARCHAR), 9, 7) || ' y' AS study,
           CASE WHEN c_custkey % 4 < 3 THEN upper(substring(md5(c_custkey::VARCHAR), 1, 16)) || '.pdf' END AS file, CASE WHEN c_custkey % 4 < 3 THEN 'likeness' END AS tier FROM customer""")
def likeness_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers' digests with a letter more in the middle and another one at the end, matched with files of the digests of three quarters of them: alike by 0.91."""
    names = table(spark, d, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("m"))
    studies = names.select(F.concat(F.substring("m", 1, 8), F.lit("x"), F.substring("m", 9, 7), F.lit(" y")).alias("study"))
    files = names.where("c_custkey % 4 < 3").select(F.concat(F.upper(F.substring("m", 1, 16)), F.lit(".pdf")).alias("file"))
    return alignment.match_studies(studies, files, ("exact", "slug", "likeness"))


SLUG_SQL = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
STEM_SQL = "regexp_replace({0}, '\\.[^.]*$', '')"


@query(f"""
    WITH s AS (SELECT DISTINCT study, {SLUG_SQL.format("study")} AS a FROM (SELECT n_name AS study FROM nation UNION ALL SELECT substring(n_name, 1, 3) FROM nation)),
    f AS (SELECT file, {SLUG_SQL.format(STEM_SQL.format("file"))} AS b FROM (SELECT n_name || ' in ' || r_name || '.pdf' AS file FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 UNION ALL SELECT substring(r_name, 1, 2) || '.pdf' FROM region))
    SELECT study, arg_min(file, (len(file), file)) AS file FROM s JOIN f ON contains(a, b) OR contains(b, a) GROUP BY study""")
def containment_match(spark: SparkSession, d: str) -> DataFrame:
    """Whole and clipped names of nations, looked for in names of files that are longer or shorter."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    studies = nation.select(F.explode(F.array("n_name", F.substring("n_name", 1, 3))).alias("study")).distinct()
    long = nation.where("n_nationkey % 3 <> 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(" in "), "r_name", F.lit(".pdf")).alias("file"))
    return alignment.by_containment(studies, long.union(region.select(F.concat(F.substring("r_name", 1, 2), F.lit(".pdf")))))


@query(f"""
    WITH k AS (SELECT DISTINCT key, {SLUG_SQL.format(STEM_SQL.format("key"))} AS a FROM (SELECT n_name || '.pdf' AS key FROM nation UNION ALL SELECT substring(n_name, 1, 2) || '.pdf' FROM nation)),
    f AS (SELECT file, {SLUG_SQL.format("regexp_replace(file, '_blocks\\.json$', '')")} AS b FROM (
        SELECT lower(n_name) || '_blocks.json' AS file FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name || ' 2001_blocks.json' FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT substring(n_name, 1, 5) || '_blocks.json' FROM nation WHERE n_nationkey % 3 = 2)),
    m AS (SELECT key, file, CASE WHEN a = b THEN 0 ELSE 1 END AS rank FROM k JOIN f ON starts_with(a, b[1:50]) OR starts_with(b, a[1:50]))
    SELECT k.key, arg_min(m.file, (m.rank, m.file)) AS file FROM k LEFT JOIN m USING (key) GROUP BY k.key""")
def blocks_lookup(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    keys = nation.select(F.explode(F.array("n_name", F.substring("n_name", 1, 2))).alias("key")).distinct().select(F.concat("key", F.lit(".pdf")).alias("key"))
    kind = F.col("n_nationkey") % 3
    name = F.when(kind == 0, F.lower("n_name")).when(kind == 1, F.concat("n_name", F.lit(" 2001"))).otherwise(F.substring("n_name", 1, 5))
    return alignment.blocks_for(keys, nation.select(F.concat(name, F.lit("_blocks.json")).alias("file")))


@query("""
    WITH c AS (SELECT c_custkey AS k, c_name || ', A. (' || (1990 + c_custkey % 30) || '). A title, (2001)' AS citation FROM customer), f AS (
        SELECT lower(c_name) || '_' || (1990 + c_custkey % 30) || '7.pdf' AS file FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name || ' (2001).pdf' FROM customer)
    SELECT citation, min(file) AS file FROM c LEFT JOIN f ON contains(lower(file), lower(split_part(citation, ',', 1))) AND contains(file, (1990 + k % 30)::VARCHAR) GROUP BY citation""")
def cited_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers as authors; half of them have a file with their year within a longer number, all one with the title's year."""
    customers, year = table(spark, d, "customer"), (F.col("c_custkey") % 30 + 1990).cast("string")
    dated = customers.where("c_custkey % 2 = 0").select(F.concat(F.lower("c_name"), F.lit("_"), year, F.lit("7.pdf")).alias("file"))
    citations = customers.select(F.concat("c_name", F.lit(", A. ("), year, F.lit("). A title, (2001)")).alias("citation"))
    return alignment.cited(citations, dated.union(customers.select(F.concat("c_name", F.lit(" (2001).pdf")))))


@query(f"""
    WITH k AS (SELECT DISTINCT n_regionkey || CASE n_nationkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '' END AS key FROM nation), f AS (SELECT r_regionkey || '.pdf' AS file FROM region WHERE r_regionkey <> 3),
    s AS (SELECT {STEM_SQL.format("file")} AS stem, min(file) AS file FROM f GROUP BY 1)
    SELECT k.key, coalesce(f.file, s.file) AS file FROM k LEFT JOIN f ON k.key = f.file LEFT JOIN s ON {STEM_SQL.format("k.key")} = s.stem""")
def record_files(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".txt", ""))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    keys = table(spark, d, "nation").select(F.concat(F.col("n_regionkey").cast("string"), ending).alias("key")).distinct()
    files = table(spark, d, "region").where("r_regionkey <> 3").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".pdf")).alias("file"))
    return records.resolve_files(keys, files).select("key", "file")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_of_each(spark: SparkSession, d: str) -> DataFrame:
    return alignment.last_of_each(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""
    WITH v AS (SELECT doc_id AS key, {VERDICT_SQL} AS verdict, coalesce(lang, '') AS predicted, coalesce(source, '') AS gold, n_chars % 3 = 0 AS good FROM labels JOIN documents USING (doc_id))
    SELECT CASE WHEN good THEN 'both_suspect' ELSE 'gold_suspect' END AS kind, key, 'text' AS field, predicted, gold, verdict, 'q' || key AS quote FROM v WHERE (good AND verdict = 'contradicted') OR (NOT good AND verdict = 'supported')""")
def suspect_cells(spark: SparkSession, d: str) -> DataFrame:
    wrong = (F.col("n_chars") % 3).cast("long")
    scored = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("text").alias("field"), F.array("lang").alias("predicted"), F.array("source").alias("gold"), F.struct(wrong.alias("fp"), F.lit(0).alias("fn")).alias("score"))
    return verify.suspects(scored, _verdicts(spark, d).withColumn("quote", F.concat(F.lit("q"), "key")))


SETTINGS = {"UC": "university clinic", "S": "school", "NR": "not reported", "OTH": "other"}


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """three_way over orders: three sources' settings, as codes, in wrapped values and in words, and numbers of cases, some of them left out."""
    k = F.col("o_orderkey")
    nth = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % 4 + 1).cast("int"))
    cases = F.to_json(F.struct((k % 3).alias("v")))
    number = F.get_json_object(cases, "$.v")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    wrapped = F.concat(F.lit('{"value": '), quoted(nth(SETTINGS.values(), k)), F.lit(', "evidence_quote": "q", "page": 3}'))
    told = {
        "legacy": [("Study", quoted(F.col("o_orderpriority"))), ("Setting", quoted(nth(SETTINGS, k))), ("Number of Cases", number)],
        "llm_a": [("Setting", wrapped), ("Number of Cases", F.when(k % 5 != 0, quoted(number)))],
        "llm_b": [("Setting", F.when(k % 2 == 0, quoted(nth(SETTINGS.values(), k + (k % 7 == 0).cast("int"))))), ("Number of Cases", F.when(k % 2 == 0, number))],
    }
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows = {n: orders.select(k.alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("v")) for f, v in fs))).alias("c")).select("key", "c.field", F.parse_json("c.v").alias("value")).where("value IS NOT NULL") for n, fs in told.items()}
    return reconcile.three_way(rows, ["Setting", "Number of Cases"])


SOURCES_SQL = """
    WITH o AS (SELECT o_orderkey AS k, trim(o_orderpriority) AS study, ['university clinic', 'school', 'not reported', 'other'] AS w, ['UC', 'S', 'NR', 'OTH'] AS c FROM orders),
    sets AS (
        SELECT k AS key, study, 'Setting' AS field, '"' || c[k % 4 + 1] || '"' AS raw, [w[k % 4 + 1]] AS l, [w[k % 4 + 1]] AS a, CASE WHEN k % 2 = 0 THEN [w[(k + (k % 7 = 0)::INT) % 4 + 1]] ELSE [] END AS b, 3 AS page FROM o
        UNION ALL SELECT k, study, 'Number of Cases', (k % 3)::VARCHAR, [(k % 3)::VARCHAR], CASE WHEN k % 5 <> 0 THEN [(k % 3)::VARCHAR] ELSE [] END, CASE WHEN k % 2 = 0 THEN [(k % 3)::VARCHAR] ELSE [] END, NULL FROM o
    ), three AS (
        SELECT *, CASE WHEN l = a AND a = b THEN 'silver_auto' WHEN a = b AND len(a) > 0 THEN 'two_llms_agree_legacy_diff' WHEN l = a THEN 'legacy_llm_a_agree' WHEN l = b THEN 'legacy_llm_b_agree'
            WHEN len(a) + len(b) = 0 THEN 'one_source_only' ELSE 'all_different' END AS status FROM sets
    )"""


@query(SOURCES_SQL + " SELECT key, study, field, l[1] AS legacy, coalesce(a[1], '') AS llm_a, coalesce(b[1], '') AS llm_b, page::VARCHAR AS page, status FROM three")
def three_way_cells(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("key", "study", "field", *(F.array_join(f"{n}.norm", ";").alias(n) for n in reconcile.SOURCES), "llm_a.page", "status")


@query(SOURCES_SQL + """ SELECT key, field, raw AS silver_value_json, '["' || l[1] || '"]' AS normalized_value_json, status FROM three WHERE status IN ('silver_auto', 'legacy_llm_b_agree')""")
def silver_cells(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.silver(_sources(spark, d)).select("key", "field", "silver_value_json", "normalized_value_json", "status")


@query(SOURCES_SQL + " SELECT key, field, status, raw AS legacy_value_json, CASE WHEN page IS NULL THEN '' ELSE 'q' END AS evidence_quote FROM three WHERE status NOT IN ('silver_auto', 'legacy_llm_b_agree')")
def review_cells(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.for_review(_sources(spark, d)).select("key", "field", "status", "legacy_value_json", "evidence_quote")


#: (field, value as JSON, its set): hand-worked cases of all kinds of fields.
VALUE_CASES = (
    ("Country", '"USA and UK"', "united kingdom;united states"),
    ("Country", '["The Netherlands", "España"]', "netherlands;spain"),
    ("Setting", '"UC, S"', "school;university clinic"),
    ("Setting", '["OPC", null, "UC"]', "outpatient psychiatric center;university clinic"),
    ("Sample type", '"Ref"', "referred"),
    ("Primary diagnosis", '"Depression; Specific phobias"', "depression;specific phobia"),
    ("Comorbid diagnosis / problems", '["n/a", "Enuresis"]', "enuresis"),
    ("Ethnicity / Race", '"White 3; Asian"', "asian;white"),
    ("Data availability", '"Diagnosis/ F.A."', "diagnosis;frequent assessment"),
    ("Type of treatments", '"CBT + parent training"', "behavioral parent training;cognitive behavioral therapy"),
    ("Treatment directed at", '"Parents"', "parent"),
    ("Age", '["8", "10.5"]', "8-11"),
    ("Age", '"8 to 10 years"', "8-10"),
    ("Gender", '"2 girls and 1 boy"', "female:2|male:1"),
    ("Number of Cases", "3.50", "3.5"),
    ("Drop-outs", '"NR"', ""),
    ("Treatment length", '"about 12 weeks"', "12"),
    ("Number of sessions", '"8 to 10 sessions"', "8-10"),
    ("Type of publication", "null", ""),
    ("Type of SCED design", "true", "true"),
)


@query(f"""
    WITH c AS (SELECT (row_number() OVER ()) - 1 AS i, field, want FROM (VALUES {", ".join(f"('{f}', '{w}')" for f, _, w in VALUE_CASES)}) AS v(field, want))
    SELECT c_custkey, field, want AS value FROM customer JOIN c ON c_custkey % {len(VALUE_CASES)} = i""")
def value_sets(spark: SparkSession, d: str) -> DataFrame:
    case = F.element_at(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(j).alias("json")) for f, j, _ in VALUE_CASES)), (F.col("c_custkey") % len(VALUE_CASES) + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", case.alias("c")).select("c_custkey", "c.field", F.parse_json("c.json").alias("v"))
    return rows.select("c_custkey", "field", F.array_join(value_set(F.col("v"), F.col("field")), ";").alias("value"))


@query("SELECT c_custkey, ['school refusal', 'school refusal', 'tic', 'enuresis'][c_custkey % 4 + 1] AS label FROM customer")
def own_labels(spark: SparkSession, d: str) -> DataFrame:
    """One's own diagnoses as aliases and as labels that others can be taken for."""
    own = {"Primary diagnosis": {"sr": "school refusal"}}
    value = F.element_at(F.array(*map(F.lit, ("SR", "School refusals", "Tic", "Enuresis problems"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", atom(value, F.lit("Primary diagnosis"), own).alias("label"))


@query("SELECT c_custkey, lower(c_mktsegment) AS author, (1950 + c_custkey % 80)::VARCHAR AS year FROM customer")
def citation_parts(spark: SparkSession, d: str) -> DataFrame:
    author, year = text.author_year(F.concat(F.lit("  "), "c_mktsegment", F.lit(" & Co ("), (F.col("c_custkey") % 80 + 1950).cast("string"), F.lit(")")))
    return table(spark, d, "customer").select("c_custkey", author.alias("author"), year.alias("year"))


@query("SELECT c_custkey, '{\"n\": ' || c_custkey || '}' AS answer, 'soft ' || c_name || ' x' AS line FROM customer")
def answers_and_lines(spark: SparkSession, d: str) -> DataFrame:
    bare = F.concat(F.lit('{"n": '), F.col("c_custkey").cast("string"), F.lit("}"))
    fenced = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), bare, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", text.without_fence(fenced).alias("answer"), layout.plain_line(F.concat(F.lit("so­ft \t"), "c_name", F.lit("  x "))).alias("line"))


@query("SELECT conv_id::VARCHAR AS file, md5(string_agg(text, chr(10) ORDER BY turn)) AS head FROM conversations WHERE turn // 2 <= 1 GROUP BY conv_id")
def first_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks, two to a page; the text of the first pages."""
    blocks = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("ord"), F.floor(F.col("turn") / 2).alias("page"), "text")
    return records.document_text(blocks, last_page=1).select("file", F.md5("text").alias("head"))


@query("""
    WITH e AS (SELECT user_id AS doc, (event_id % 2)::INT AS page, event_id AS ord, (event_id * 37) % 500 AS x0, (event_id * 37) % 500 + (event_id * 53) % 250 + 20 AS x1 FROM events),
    k AS (SELECT *, CASE WHEN (x0 < 270 AND x1 > 330) OR x1 - x0 >= 270 THEN 0 WHEN x0 < 270 THEN 1 ELSE 2 END AS kind FROM e),
    n AS (SELECT *, count(*) OVER w >= 6 AND count(*) FILTER (kind = 1) OVER w > 0 AND count(*) FILTER (kind = 2) OVER w > 0 AS two, count(*) FILTER (kind = 0) OVER w = 0 AS plain FROM k WINDOW w AS (PARTITION BY doc, page))
    SELECT doc, page, ord, (CASE WHEN two THEN kind - plain::INT ELSE 0 END)::INT AS "column" FROM n""")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    x0 = (e * 37 % 500).cast("double")
    lines = table(spark, d, "events").select(F.col("user_id").alias("doc"), (e % 2).cast("int").alias("page"), e.alias("ord"), x0.alias("x0"), (x0 + e * 53 % 250 + 20).alias("x1"), F.lit(600.0).alias("page_width"))
    return layout.columns_of(lines).select("doc", "page", "ord", "column")


@query("""
    WITH l AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 <> 0)
    SELECT key, 'left' AS side FROM l ANTI JOIN r USING (key) UNION ALL SELECT key, 'right' FROM r ANTI JOIN l USING (key)""")
def one_side_keys(spark: SparkSession, d: str) -> DataFrame:
    return eda.missing_and_extra(table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("key")), table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders")
def present_values(spark: SparkSession, d: str) -> DataFrame:
    """The first name that is there counts, even if its value is null."""
    even = F.col("o_orderkey") % 2 == 0
    names = F.when(even, F.array(F.lit("priority"), F.lit("status"))).otherwise(F.array(F.lit("priority")))
    held = lambda c: F.when(F.col("o_orderkey") % 3 != 0, F.col(c))
    return table(spark, d, "orders").select("o_orderkey", eda.first_present(names, F.array(held("o_orderpriority"), held("o_orderstatus")), ("status", "priority")).alias("value"))


@query("""
    SELECT c_custkey || '.pdf' AS key, 'Number of Cases' AS field, (c_custkey % 4)::VARCHAR AS value FROM customer
    UNION ALL SELECT c_custkey || '.pdf', 'Setting', '"' || c_mktsegment || '"' FROM customer""")
def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and scanned again, by key, their headers as fields."""
    rows = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("pdf"), (F.col("c_custkey") % 4).alias("N cases"), F.col("c_mktsegment").alias("Setting"))
    path = new_folder(spark)
    sinks.write_json_lines(rows, path)
    return records.cells(records.records_by_key(records.json_lines(spark, path))).select("key", "field", F.to_json("value").alias("value"))


@query("""SELECT n_name || ', "' || n_regionkey || '"' || chr(10) || 'x' AS name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_nationkey::VARCHAR END AS number FROM nation""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows with quotes, commas, line ends and absent values written as a sheet and scanned again."""
    name = F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"\nx'))
    rows = table(spark, d, "nation").select(name.alias("name"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey").cast("string")).alias("number"))
    path = new_folder(spark)
    sinks.write_csv(rows, path, ["name", "number"])
    return records.csv_rows(spark, path, ["name", "number"])


from cellweave.plans import catalog_more  # noqa: E402, F401  registers its queries
