"""Scans: JSON lines, CSV, block files, spreadsheets, TEI and binary files as DataFrames.

Records become cells (key, field, value): one row for each document and field, the value a VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.text import constant_map, let, squeeze
from cellweave.sources.shared import cut

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "inferSchema": False}


def json_lines(spark: SparkSession, path: str, empty: str = "allow") -> DataFrame:
    """(file, line, record): blank lines are skipped; of repeated keys in an object the last one counts; a line that is no object fails the scan.

    A file is read in splits. line is STRUCT(split, nth): where a line's split begins, and a number that rises within it, so lines of a file are in order by it
    although no task sees the file as a whole. empty: ``error`` fails where there is no record. The session keeps the setting that lets objects repeat keys."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth")).alias("line"), F.col("value").alias("text"))
    parsed = text.where(F.trim("text") != "").withColumn("record", F.try_parse_json("text"))
    told = F.concat(F.lit("in the split at byte "), F.col("line.split"), F.lit(" of "), F.col("file"), F.lit(" this is no JSON object: "), F.substring("text", 1, 100))
    out = parsed.select("file", "line", F.when(F.schema_of_variant("record").startswith("OBJECT"), F.col("record")).otherwise(F.raise_error(told)).alias("record"))
    if empty == "error" and text.where(F.trim("text") != "").isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def records_by_key(lines: DataFrame, key: str = "pdf", blank: str = "error") -> DataFrame:
    """(key, line, record): the last record of each key. A blank key fails (``error``) or is left out (``drop``)."""
    named = lines.withColumn("key", F.try_variant_get("record", f"$.{key}", "string"))
    missing = F.col("key").isNull() | (F.trim("key") == "")
    if blank == "drop":
        named = named.where(~missing)
    else:
        told = F.concat(F.lit(f"no {key} in the split at byte "), F.col("line.split"), F.lit(" of "), F.col("file"), F.lit(": "), F.substring(F.to_json("record"), 1, 100))
        named = named.withColumn("key", F.when(missing, F.raise_error(told)).otherwise(F.col("key")))
    last = F.max_by("record", F.struct("file", "line")).alias("record")
    return named.groupBy("key").agg(F.count("*").alias("seen"), last, F.max(F.struct("file", "line"))["line"].alias("line"))


def canonical_field(name: Column, headers: Mapping[str, str] = fields.HEADERS) -> Column:
    """A field's name for its header; other names as they are."""
    return F.coalesce(F.try_element_at(constant_map(headers), name), name) if headers else name


def cells(records: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """(key, field, value) of records (key, record); of headers that name one field, the last one in order of name counts.

    wanted prunes fields before anything is normalized."""
    each = records.sparkSession.tvf.variant_explode(F.col("record").outer()).toDF("pos", "name", "value")
    exploded = records.select("key", "record").lateralJoin(each).select("key", "pos", "name", "value")
    out = exploded.withColumn("field", canonical_field(F.col("name"))).groupBy("key", "field").agg(F.max_by("value", "pos").alias("value"))
    return out.where(F.col("field").isin(*wanted)) if wanted is not None else out.where("field <> 'pdf'")


def texts_by_field(record: Column, wanted: Sequence[str]) -> Column:
    """MAP(field, JSON text) of a record's wanted fields, without a row for each; of headers that name one field, the last one in order of name counts. No object has none."""
    none = F.create_map().cast("map<string,variant>")

    def renamed(values: Column) -> Column:
        # a variant's names are in order
        named = F.filter(F.transform(F.map_entries(values), lambda e: F.struct(canonical_field(e["key"]).alias("field"), e["value"].alias("value"))), lambda x: x["field"].isin(*wanted))

        def last(x: Column) -> Column:
            return F.filter(x["named"], lambda e, i: F.array_position(x["backwards"], e["field"]) == F.size(x["named"]) - i)

        return F.map_from_entries(let(let(named, lambda n: F.struct(n.alias("named"), F.reverse(F.transform(n, lambda e: e["field"])).alias("backwards"))), last))

    def read(values: Column) -> Column:
        # most records have fields' own names only
        kept = F.when(F.exists(F.map_keys(values), lambda k: k.isin(*fields.HEADERS)), renamed(values)).otherwise(F.map_filter(values, lambda k, _: k.isin(*wanted)))
        return F.transform_values(kept, lambda _, v: F.to_json(v))

    return let(F.coalesce(F.try_variant_get(record, "$", "map<string,variant>"), none), read)


def verdicts(lines: DataFrame) -> DataFrame:
    """(key, field, verdict, quote): the last verification of each document."""
    found = records_by_key(lines)
    typed = found.select("key", F.from_json(F.to_json(F.try_variant_get("record", "$.verdicts", "variant")), "map<string,struct<verdict:string,quote:string>>").alias("told"))
    out = typed.select("key", F.explode("told").alias("name", "v"))
    return out.select("key", canonical_field(F.col("name")).alias("field"), F.lower(F.trim("v.verdict")).alias("verdict"), F.coalesce("v.quote", F.lit("")).alias("quote"))


def csv_rows(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings, absent ones empty; an explicit schema when columns are given."""
    reader = spark.read.options(**CSV_OPTIONS)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path).na.fill("")


def rows_if_there(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """csv_rows with the columns and ``line``, their order; none without a file."""
    try:
        rows = csv_rows(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", line long")
    have = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    return rows.select(*have, F.monotonically_increasing_id().alias("line"))


def alignment_issues(spark: SparkSession, path: str) -> DataFrame:
    """(key, issue_type, related, evidence, line) of a report of alignment issues, as operators.reconcile.annotate takes them; none without a file. Rows without a document are left out."""
    found = rows_if_there(spark, path, ("pdf", "issue_type", "related_pdf", "evidence"))
    return found.select(F.trim("pdf").alias("key"), "issue_type", F.col("related_pdf").alias("related"), "evidence", "line").where("key <> ''")


def csv_row_count(spark: SparkSession, path: str) -> int:
    """Lines after the header; zero without a file."""
    try:
        return max(0, spark.read.text(path).count() - 1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def alias_sections(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """An alias file's sections; none without a file. A dictionary is small by its nature and becomes part of expressions."""
    import json

    from cellweave.functions.normalize import plain_keys

    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return plain_keys(json.loads(text))


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", name: str | None = None) -> DataFrame:
    """(file, path, content, sha256), one file or all that match; contents aren't sorted, names are by who needs them in order. A named file that isn't there fails."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name or pattern).load(folder)
    out = found.select(F.col("_metadata.file_name").alias("file"), "path", "content", F.sha2("content", 256).alias("sha256"))
    if name is not None and out.select("file").isEmpty():
        raise FileNotFoundError(f"{folder}/{name}")
    return out


def file_names(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(file, path, length) in order of name, without reading any content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("_metadata.file_name").alias("file"), "path", "length").orderBy("file")


def blocks(spark: SparkSession, folder: str, pattern: str = "*_blocks.json") -> DataFrame:
    """(file, ord, page, bbox, text) of block files, each an array of blocks."""
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    typed = F.from_json("value", "array<struct<page:int,bbox:array<double>,text:string>>")
    return whole.select("file", F.posexplode(typed).alias("ord", "b")).select("file", "ord", "b.page", "b.bbox", "b.text")


def document_text(blocks: DataFrame, key: str = "file", last_page: int | None = None, separator: str = "\n") -> DataFrame:
    """(key, text): a document's blocks in reading order; all pages or the first ones."""
    kept = blocks if last_page is None else blocks.where(F.coalesce("page", F.lit(0)) <= last_page)
    parts = F.array_sort(F.collect_list(F.struct("page", "ord", "text")))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda b: b["text"]), separator).alias("text"))


def parsed_blocks(files: DataFrame, parser: Callable[[bytes], Sequence[tuple[int, Sequence[float], str]]]) -> DataFrame:
    """(file, ord, page, bbox, text) by a parser of one's own that gives (page, bbox, text) for a file's bytes; blank blocks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(p, list(map(float, b)), t.strip()) for p, b, t in parser(content.as_py()) if t.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.string())], names=["file", "ord", "page", "bbox", "text"])

    return files.select("file", "content").mapInArrow(run, "file string, ord int, page int, bbox array<double>, text string")


def missing_from_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content isn't cached yet, by sha256."""
    return files.join(cache.select("sha256").distinct(), "sha256", "left_anti")


def resolve_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (key) with the file of that name, or else of that stem."""
    stem = lambda c: F.regexp_replace(c, "\\.[^.]*$", "")
    exact = files.select(F.col("file").alias("by_name"))
    stems = files.groupBy(stem(F.col("file")).alias("stem")).agg(F.min("file").alias("by_stem"))
    out = records.join(exact, records["key"] == exact["by_name"], "left").join(stems, stem(F.col("key")) == F.col("stem"), "left")
    return out.withColumn("file", F.coalesce("by_name", "by_stem")).drop("by_name", "by_stem", "stem")


def spreadsheet_records(rows: DataFrame, order: str, study: str, values: Sequence[str], empty_run: int = 50) -> DataFrame:
    """(study, ord, values...) of a sheet's rows: blank and NA are absent, a study's name holds for the rows below it, rows before the first study are left out,
    and the sheet ends where so many empty rows follow each other. With several sheets in a column ``sheet``, each is one of its own.

    A sheet is dealt by ranges of its rows over all tasks. A range looks up and down its own rows only; what holds from the ranges before it is a row for each range, their
    places, last full row and last study, and joined to it.
    """
    spark = rows.sparkSession
    clean = lambda c: F.when(F.trim(c).isin("", "NA"), F.lit(None)).otherwise(F.trim(c))
    sheet = F.coalesce(F.col("sheet").cast("string"), F.lit("")) if "sheet" in rows.columns else F.lit("")
    tidy = rows.select(*(["sheet"] if "sheet" in rows.columns else []), sheet.alias("__cw_sheet"), order, *(clean(F.col(f"`{c}`").cast("string")).alias(c) for c in (study, *values)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(tidy.repartitionByRange(parts, "__cw_sheet", order).withColumn("__cw_part", F.spark_partition_id()))
    within = Window.partitionBy("__cw_sheet", "__cw_part").orderBy(order)
    full = F.coalesce(*(F.col(f"`{c}`") for c in (study, *values))).isNotNull()
    placed = dealt.withColumn("__cw_n", F.row_number().over(within)).withColumn("__cw_full", full)
    last = F.max_by(F.col(f"`{study}`"), F.when(F.col(f"`{study}`").isNotNull(), F.col("__cw_n")))
    ranges = placed.groupBy("__cw_sheet", "__cw_part").agg(F.count("*").alias("size"), F.max(F.when(F.col("__cw_full"), F.col("__cw_n"))).alias("seen"), last.alias("held"))
    before = Window.partitionBy("__cw_sheet").orderBy("__cw_part").rowsBetween(Window.unboundedPreceding, -1)
    started = ranges.withColumn("__cw_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    carried = started.select("__cw_sheet", "__cw_part", "__cw_start", F.max(F.col("__cw_start") + F.col("seen")).over(before).alias("__cw_seen"), F.last("held", ignorenulls=True).over(before).alias("__cw_held"))
    filled = placed.where("__cw_full").withColumn("__cw_up", F.lag("__cw_n").over(within)).withColumn(study, F.last(F.col(f"`{study}`"), ignorenulls=True).over(within))
    joined = filled.join(carried, ["__cw_sheet", "__cw_part"])
    at = F.col("__cw_n") + F.col("__cw_start")
    gap = at - F.coalesce(F.col("__cw_up") + F.col("__cw_start"), F.col("__cw_seen"), F.lit(0)) - 1
    told = joined.withColumn("__cw_at", at).withColumn("__cw_gap", gap).withColumn(study, F.coalesce(F.col(f"`{study}`"), "__cw_held"))
    ends = told.where(F.col("__cw_gap") >= empty_run).groupBy("__cw_sheet").agg(F.min("__cw_at").alias("__cw_end"))
    kept = told.join(ends, "__cw_sheet", "left").where((F.col("__cw_end").isNull() | (F.col("__cw_at") < F.col("__cw_end"))) & F.col(f"`{study}`").isNotNull())
    return kept.select(*(c for c in tidy.columns if c != "__cw_sheet"))


def drop_empty(rows: DataFrame) -> DataFrame:
    """Rows and columns that hold anything."""
    counts = rows.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in rows.columns)).first().asDict()
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if counts[c])).dropna("all")


def study_items(texts: DataFrame) -> DataFrame:
    """(file, ord, study) of JSON documents (file, value): the objects of a list, of an object's list ``studies``, or one object itself. What doesn't parse, or is no object, is left out."""
    parsed = texts.withColumn("v", F.try_parse_json("value")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    inner = F.try_variant_get("v", "$.studies", "array<variant>")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(inner.isNotNull(), inner).when(kind.startswith("OBJECT"), F.array("v"))
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return parsed.select("file", F.posexplode(objects).alias("ord", "study"))


def tei_blocks(documents: DataFrame) -> DataFrame:
    """(key, part, block_type, section, text, ord) of TEI documents (key, xml), by an XML parser in Arrow batches, as paragraphs mix text and elements.

    part is title, author, keyword, abstract, body or reference. Abstract and reference numbers count empty paragraphs, those of the body don't.
    """
    import xml.etree.ElementTree as ET

    ns = {"t": "http://www.tei-c.org/ns/1.0"}

    def text_of(node) -> str:
        return " ".join(" ".join(node.itertext()).split()) if node is not None else ""

    def rows_of(xml: str) -> list[tuple]:
        root = ET.fromstring(xml)
        out: list[tuple] = []

        def listed(part: str, kind: str, path: str) -> None:
            out.extend((part, kind, None, text_of(n), i) for i, n in enumerate(root.findall(path, ns), 1) if text_of(n))

        title = root.find(".//t:titleStmt/t:title", ns)
        if text_of(title):
            out.append(("title", "title", None, text_of(title), 1))
        listed("author", "author", ".//t:titleStmt//t:author")
        listed("keyword", "keyword", ".//t:profileDesc//t:keywords//t:term")
        listed("abstract", "abstract", ".//t:profileDesc/t:abstract//t:p")
        body: list[tuple[str, str | None, str]] = []
        for div in root.findall(".//t:text/t:body//t:div", ns):
            head = text_of(div.find("./t:head", ns)) or None
            if head:
                body.append(("section_heading", head, head))
            for kind, path in (("paragraph", "./t:p"), ("figure_or_table", "./t:figure")):
                body += [(kind, head, text_of(n)) for n in div.findall(path, ns) if text_of(n)]
        out += [("body", kind, head, text, i) for i, (kind, head, text) in enumerate(body, 1)]
        if not body:
            listed("body", "paragraph", ".//t:text/t:body//t:p")
        listed("reference", "reference", ".//t:listBibl/t:biblStruct")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(x)]
            kinds = (pa.string(),) * 5 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "part", "block_type", "section", "text", "ord"])

    return documents.select("key", "xml").mapInArrow(run, "key string, part string, block_type string, section string, text string, ord int")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, text): the paragraphs of web pages, without scripts, styles and tags; blank ones are left out."""
    plain = F.regexp_replace(F.col(html), "(?is)<(script|style)\\b.*?</\\1>", " ")
    parts = F.transform(F.regexp_extract_all(plain, F.lit("(?is)<p\\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: squeeze(F.regexp_replace(p, "<[^>]*>", " ")))
    return pages.select(F.col(key), F.posexplode(F.filter(parts, lambda p: p != "")).alias("ord", "text"))
