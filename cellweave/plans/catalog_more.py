"""More queries: values of JSON documents, review evidence, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.normalize import country
from cellweave.operators import alignment, eda, reconcile, sampling
from cellweave.plans import extraction
from cellweave.plans.catalog import EVALUATED, SOURCES_SQL, _evaluated, _sources, query, table
from cellweave.sources import records, workbook
from cellweave.sources.shared import new_folder


@query("""
    SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'A' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'B' || o_orderkey ELSE '' END AS evidence_quote,
           CASE WHEN o_orderkey % 4 = 0 THEN '4' WHEN o_orderkey % 2 = 0 THEN '2' ELSE '' END AS page FROM orders""")
def review_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Quotes and pages of orders' cells, of which legacy has always some, A every third and B every second, the others blank or none."""
    k = F.col("o_orderkey")
    part = lambda quote, page: F.struct(F.lit("1").alias("raw"), quote.alias("evidence_quote"), page.alias("page"), F.array(F.lit("1")).alias("norm"))
    told = lambda n, letter: F.when(k % n == 0, F.concat(F.lit(letter), k)).otherwise("")
    cells = table(spark, d, "orders").select(
        k.alias("key"), F.lit("").alias("study"), F.lit("Age").alias("field"), part(F.lit("L"), F.lit("9")).alias("legacy"), part(told(3, "A"), F.when(k % 4 == 0, "4")).alias("llm_a"),
        part(told(2, "B"), F.when(k % 2 == 0, "2").otherwise("")).alias("llm_b"), F.lit("all_different").alias("status"), F.lit("high").alias("priority"), F.lit("").alias("pattern"),
    )
    return reconcile.for_review(cells).select("key", "evidence_quote", "page")


@query("""
    SELECT conv_id::VARCHAR AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, turn::INT AS turn, role FROM conversations WHERE turn % 3 <> 1""")
def study_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON documents: a list, or an object with a list, of objects and, every third, a text that is no item."""
    item = F.when(F.col("turn") % 3 == 1, F.to_json(F.array("role"))).otherwise(F.to_json(F.struct("turn", "role")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("j")))), lambda x: x["j"]), ","), F.lit("]"))
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("j"))
    value = F.when(F.col("conv_id") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"studies": '), F.col("j"), F.lit(', "n": 1}')))
    items = records.study_items(texts.select(F.col("conv_id").cast("string").alias("file"), value.alias("value")))
    return items.select("file", "ord", F.try_variant_get("study", "$.turn", "int").alias("turn"), F.try_variant_get("study", "$.role", "string").alias("role"))


@query("""
    WITH v AS (SELECT c_custkey AS k, trim(c_mktsegment) AS s FROM customer), l AS (
        SELECT 'segment:' || s AS label FROM v UNION ALL SELECT 'nothing:None' FROM v WHERE k % 3 < 2 UNION ALL SELECT unnest(['list:' || (k % 4), 'list:x']) FROM v WHERE k % 3 < 2
        UNION ALL SELECT 'odd:' || CASE WHEN k % 2 = 1 THEN 'True' ELSE 'False' END FROM v WHERE k % 3 < 2)
    SELECT 'flattened' AS way, label, count(*)::BIGINT AS count FROM (
        SELECT label FROM l WHERE label NOT LIKE 'segment:%' UNION ALL SELECT 'segment:' || s FROM v WHERE k % 3 < 2 UNION ALL SELECT s FROM v WHERE k % 3 = 2) GROUP BY label
    UNION ALL SELECT 'split', label, count(*)::BIGINT FROM (SELECT unnest([s, 'a', 'b', 'c', (k % 4)::VARCHAR]) AS label FROM v) GROUP BY label""")
def flattened_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of values of all kinds: objects and plain texts flattened, lists within lists split."""
    k, s = F.col("c_custkey"), F.trim("c_mktsegment")
    customers = table(spark, d, "customer")
    whole = F.to_json(F.struct(s.alias("segment"), F.lit("").alias("blank"), F.lit(None).cast("string").alias("nothing"), F.array((k % 4).cast("string"), F.lit(" "), F.lit("x ")).alias("list"), (k % 2 == 1).alias("odd")), {"ignoreNullFields": "false"})
    nested = F.concat(F.lit("["), F.to_json(F.array(F.concat(s, F.lit("; a, ")), F.lit("b/c|"))), F.lit(", [["), k % 4, F.lit("]], null]"))
    told = customers.select(k.alias("k"), F.parse_json(F.when(k % 3 < 2, whole).otherwise(F.to_json(F.array(s, F.lit(""))))).alias("v"), F.parse_json(nested).alias("n"))
    count = lambda way, labels: eda.label_counts(told, labels, F.col("k")).select(F.lit(way).alias("way"), "label", "count")
    return count("flattened", eda.flattened(F.col("v"))).union(count("split", eda.split_list(F.col("n"))))


@query("""
    WITH f AS (SELECT doc_id, text FROM documents), p AS (SELECT DISTINCT substring(text, 1, 12) AS pattern FROM benchmark WHERE len(text) > 0)
    SELECT doc_id AS id, pattern FROM f JOIN p ON contains(text, pattern)""")
def patterns_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the beginning of a benchmark text."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return alignment.contain.found_in(texts, table(spark, d, "benchmark").select(F.substring("text", 1, 12).alias("pattern")))


@query(EVALUATED + """, d AS (SELECT key, bool_or(odd = 1) AS p, bool_or(odd = 0) AS g FROM side GROUP BY key), x AS (SELECT key, sum(wrong) = 0 AS exact FROM scored GROUP BY key)
    SELECT (count(*) FILTER (p))::BIGINT AS predictions, (count(*) FILTER (g))::BIGINT AS gold, (count(*) FILTER (p AND g))::BIGINT AS matched, (count(*) FILTER (g AND NOT p))::BIGINT AS missing, (count(*) FILTER (p AND NOT g))::BIGINT AS extra,
           22 AS fields, 'figure-dependent' AS why, round((SELECT avg(exact::INT) FROM x), 6) AS rate, (SELECT sum(tp) FROM scored)::BIGINT AS tp, (SELECT sum(tp) FROM scored WHERE field = 'Age')::BIGINT AS age FROM d""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The document of results: files, fields left out and why, metrics over all and of a field."""
    s = _evaluated(spark, d)["summary"]
    return s.select(
        F.col("predictions_file_count").alias("predictions"), F.col("gold_file_count").alias("gold"), F.col("matched_file_count").alias("matched"), F.col("missing_prediction_count").alias("missing"), F.col("extra_prediction_count").alias("extra"),
        F.col("scored_field_count").alias("fields"), F.col("excluded_fields")["Total Number of Observations"].alias("why"), F.round("overall.exact_match_rate", 6).alias("rate"), F.col("overall.tp").alias("tp"), F.col("per_field")["Age"]["tp"].alias("age"),
    )


@query(SOURCES_SQL + """ SELECT (SELECT count(*) FROM orders)::BIGINT AS legacy_records, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0)::BIGINT AS llm_b_records, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1)::BIGINT AS missing_from_llm_b,
        2 AS fields_per_document, (count(*) FILTER (status IN ('silver_auto', 'legacy_llm_b_agree')))::BIGINT AS silver_rows, (count(*) FILTER (status NOT IN ('silver_auto', 'legacy_llm_b_agree')))::BIGINT AS review_rows,
        (count(*) FILTER (status = 'legacy_llm_a_agree'))::BIGINT AS a_agrees, (count(*) FILTER (status = 'one_source_only' AND field = 'Number of Cases'))::BIGINT AS only_cases FROM three""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """A review's counts, of which B knows every second document."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    covered = reconcile.coverage({"legacy": keys, "llm_a": keys, "llm_b": keys.where("key % 2 = 0")})
    s = reconcile.review_summary(_sources(spark, d), covered)
    return s.select("legacy_records", "llm_b_records", "input_coverage.missing_from_llm_b", F.col("fields_per_document").cast("int").alias("fields_per_document"), "silver_rows", "review_rows", F.col("status_counts")["legacy_llm_a_agree"].alias("a_agrees"), F.col("field_status_counts")["Number of Cases"]["one_source_only"].alias("only_cases"))


@query("SELECT doc_id AS key, (len(regexp_replace(text, '[^0-9]', '', 'g')))::INT AS digits FROM documents WHERE trim(text) <> ''")
def chunk_answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents of any length in chunks of 2,000 characters, each told how many digits it has by a function that plays the model, put together level by level."""

    def make():
        import json

        def call(system: str, prompt: str) -> str:
            part = prompt.split("TEXT:\n", 1)
            found = sum(c in "0123456789" for c in part[1]) if len(part) == 2 else sum(json.loads(x)["n"] for x in json.loads(prompt.split("ANSWERS:\n", 1)[1]))
            return json.dumps({"n": found})

        return call

    told = extraction.synthesised(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), make, "digits", "played", size=2000, most_characters=40)
    return told.select("key", F.get_json_object("answer", "$.n").cast("int").alias("digits"))


@query("""
    SELECT page_id AS key, CASE WHEN n = 0 THEN 'no_pages' WHEN n % 11 = 3 THEN 'failed' WHEN n <= 75 OR least(n, 40) * 2 <= 150 THEN 'verified' ELSE 'too_long' END AS state,
           CASE WHEN n = 0 OR n % 11 = 3 OR n * 2 <= 50 THEN 0 WHEN n * 2 <= 100 THEN 1 WHEN n * 2 <= 104 THEN 2 ELSE 3 END AS rung FROM (SELECT page_id, page_id % 90 AS n FROM pages)""")
def verification_states(spark: SparkSession, d: str) -> DataFrame:
    """Pages as documents of up to 89 images, checked by a function that plays the model and takes so many characters: at smaller resolutions, and then by fewer pages."""

    def make():
        def call(system: str, instruction: str, images) -> str:
            if int(instruction.rsplit("\n", 1)[1]) % 11 == 3:
                raise RuntimeError("no network")
            if sum(map(len, images)) > 7500:
                raise RuntimeError("maximum context length")
            return '{"Age": {"verdict": "supported", "quote": "q"}}'

        return call

    n = F.col("page_id") % 90
    docs = table(spark, d, "pages").select(F.col("page_id").alias("key"), n.cast("string").alias("record"), n.alias("n"))
    render = lambda df, dpi, most: df.select("key", "record", F.array_repeat(F.repeat(F.lit("x"), dpi * 2), (F.least("n", F.lit(most)) if most else F.col("n")).cast("int")).alias("images"))
    return extraction.verified(docs, render, make).select("key", "state", "rung")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 THEN lang || ', ' || source WHEN doc_id % 5 = 2 THEN lang ELSE lang || ' x' END AS stratum FROM documents")
def strata_of_values(spark: SparkSession, d: str) -> DataFrame:
    """Strata of lists, texts in any case with blanks, and blank ones."""
    k, lang = F.col("doc_id") % 5, F.col("lang")
    told = F.when(k == 0, F.to_json(F.array(F.lit(" ")))).when(k == 1, F.to_json(F.array(F.upper(lang), F.col("source")))).when(k == 2, F.to_json(F.array(lang))).otherwise(F.concat(F.lit('" '), lang, F.lit('  X "')))
    return table(spark, d, "documents").select("doc_id", sampling.stratum(F.parse_json(told)).alias("stratum"))


@query("""
    SELECT s_suppkey, CASE n_name WHEN 'IRAN' THEN 'iran, islamic republic of' WHEN 'VIETNAM' THEN 'viet nam' ELSE lower(n_name) END AS country,
           ['united kingdom', 'germany', 'korea, republic of', 'nowhere'][(s_suppkey % 4 + 1)::INT] AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def country_names(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations and codes of countries as ISO 3166 names."""
    code = F.element_at(F.array(*map(F.lit, ("gb", "deu", "south korea", "nowhere"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", country(F.lower("n_name")).alias("country"), country(code).alias("code"))


@query("""
    SELECT r_regionkey || '.xlsx' AS file, n_name AS sheet, (2 * row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey))::INT AS row, s_name || '|' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey || '|' END || '<&' || s_suppkey || '>' AS cells
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def workbook_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in every second row of a sheet for their nation, a workbook for each region, written and read again; some cells are left out."""
    nations = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")) * 2
    cells = F.array("s_name", F.lit(None).cast("string"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string")), F.concat(F.lit("<&"), "s_suppkey", F.lit(">")))
    rows = nations.select(F.concat(F.col("n_regionkey"), F.lit(".xlsx")).alias("file"), F.col("n_name").alias("sheet"), place.alias("row"), cells.alias("cells"))
    read = workbook.workbook_rows(spark, workbook.write_workbooks(rows, new_folder(spark)))
    return read.where(F.size("cells") > 0).select("file", "sheet", "row", F.array_join("cells", "|").alias("cells"))
