"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import byte_bpe, context_mixing, decontaminate, exact_dedup, filter_audit, forced_bpe, langid, product_codes, simhash, toxicity, url_filter, warc, wavelet
from cellweave.llm._common import crc_mod, tables


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), field, carry=("held_out",))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tables(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(tables(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact_dedup.exact_groups(docs.select("doc_id", "text", digest.alias("text_sha256")), carry=("text_sha256",))


#: (verdict, host and path) of the URL rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(tables(spark, sf_dir, "pages"), RULES)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """Categories of the labels table: of low quality, toxic, and both at once."""
    low = F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0)
    named = labels.select("doc_id", low.alias("low_quality"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    named = named.withColumn("toxic_low_quality", F.col("low_quality") * F.col("toxic"))
    return toxicity.fit(docs, named, ["low_quality", "toxic", "toxic_low_quality"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return toxicity.probabilities(docs, toxicity_chain(docs, tables(spark, sf_dir, "labels")))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(tables(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    return filter_audit.audit(docs, labels, filter_audit.failures(F.coalesce("text", F.lit(""))), copies="E")


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.quantize(tables(spark, sf_dir, "embeddings"))


def op13_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.encode(tables(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), ids=False)


QUERIES = {
    "op1_langid": op1_langid,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_wavelet": op5_wavelet,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_context_mixing": op10_context_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_product_codes": op12_product_codes,
    "op13_forced_bpe": op13_forced_bpe,
}

def _lloyd_sql() -> str:
    """Two rounds and the last assignment over 16 parts of 64 entries, all distances computed."""

    def assigned(k: int) -> str:  # the least distance, then the least index
        return f"""a{k} AS (
            SELECT rid, p, v, (m % 64)::INT AS e, m // 64 AS d FROM (
                SELECT rid, p, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS m
                FROM parts JOIN c{k} USING (p) GROUP BY rid, p))"""

    def moved(k: int) -> str:  # sums are divided downwards
        return f"""c{k + 1} AS (
            SELECT p, e, coalesce(u.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
                SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
                    SELECT p, e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{k}, unnest(generate_series(1, len(v))) AS g(j) GROUP BY p, e, j)
                GROUP BY p, e) u USING (p, e))"""

    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT rid, p::INT AS p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM kept, unnest(generate_series(0, 15)) AS s(p)
        ), c0 AS (
            SELECT p, (rid - 1)::INT AS e, v AS c FROM parts WHERE rid <= 64
        ), {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)}, codes AS (
            SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid
        ), books AS (
            SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (rid), books"""


ORACLES = {
    "op4_decontaminate": """
        WITH items AS (
            SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
            FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0
        ), docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), grams AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
            FROM docs, (SELECT DISTINCT k FROM windows), unnest(generate_series(1, len(w) - k + 1)) AS s(i)
        ), found AS (
            SELECT DISTINCT doc_id, item_id, i, k FROM grams JOIN windows USING (k, gram)
        ), hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
        ), pairs AS (  -- whole windows at the same distance, one after the other, make a match
            SELECT doc_id, item_id, t, i, j, i - row_number() OVER (PARTITION BY doc_id, t, j - i ORDER BY i) AS run
            FROM (SELECT doc_id, i, gram FROM grams WHERE k = 10) JOIN (
                SELECT item_id, w AS t, j, array_to_string(w[j:j + 9], ' ') AS gram FROM items, unnest(generate_series(1, len(w) - 9)) AS s(j)) USING (gram)
        ), matches AS (
            SELECT doc_id, item_id, i - 1 AS doc_at, j - 1 AS item_at, max(i) OVER (PARTITION BY doc_id, item_id, t, j - i, run) - i + 10 AS n FROM pairs
        ), longest AS (
            SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, doc_at, item_id, item_at) = 1
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               coalesce(n, 0)::BIGINT AS longest, longest.item_id AS longest_item, doc_at::BIGINT AS longest_at, item_at::BIGINT AS longest_item_at
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), firsts AS (
            SELECT text, min(doc_id) AS first FROM texts GROUP BY text
        ), marks AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), failed AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
                   || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END)
                   || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
            FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
        ), classes AS (
            SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL
        ), f AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
            WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
        ), steps AS (
            SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS done FROM orders, unnest([1, 2, 3, 4, 5]) AS s(k)
        ), seen AS (
            SELECT part, filter_order, step, own, fails, good, toxic, n, contains(fails, own) AS here,
                   length(translate(fails, done, '')) < length(fails) AS before
            FROM classes, steps
        ), summed AS (
            SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT before), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (here AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (here AND NOT before AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND NOT before AND toxic = 1), 0)::BIGINT AS toxic_lost
            FROM seen GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed""",
    "op12_product_codes": _lloyd_sql(),
}
