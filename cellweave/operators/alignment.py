"""Documents matched with files and names, and what is wrong with the matching.

No tier compares all with all: a match by name goes by equal slugs, one by author and year by equal years and words, one by
containment by an automaton of all patterns, one by likeness by sets of rare characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import slug, unicode_slug
from cellweave.operators import contain, likeness
from cellweave.sources.shared import cut

YEAR = "((?:19|20)\\d{2})"


def years(text: Column) -> Column:
    """All different years in a text, those within longer numbers, too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?={YEAR})"), F.lit(1)))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]*$", "")


def duplicate_files(files: DataFrame, studies: DataFrame) -> DataFrame:
    """Files that share their content: (issue_type, key, study, related, sha256, evidence). files: (file, sha256); studies: (key, study).

    Each group is listed in each of its rows, so its size is that of the report; the groups are copies of source files."""
    named = files.join(studies.select(F.col("key").alias("file"), "study"), "file", "left").withColumn("study", F.coalesce("study", F.lit("")))
    label = F.concat(F.col("file"), F.lit(" ("), F.col("study"), F.lit(")"))
    groups = named.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("file", "study", label.alias("label")))).alias("all")).where(F.size("all") > 1)
    rows = groups.select("sha256", "all", F.explode("all").alias("one"))
    related = F.array_join(F.transform(F.filter("all", lambda x: x["file"] != F.col("one.file")), lambda x: x["label"]), "; ")
    return rows.select(F.lit("duplicate_pdf_file").alias("issue_type"), F.col("one.file").alias("key"), F.col("one.study").alias("study"), related.alias("related"), "sha256", F.lit("Same SHA-256 hash as another input PDF filename.").alias("evidence"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """(file, sha256, first, n) of files whose content others have, too: without the lists of a report, for groups of any size."""
    groups = files.groupBy("sha256").agg(F.min("file").alias("first"), F.count("*").alias("n")).where("n > 1")
    return files.join(groups, "sha256").select("file", "sha256", "first", "n")


def author_absent(studies: DataFrame, files: DataFrame, first_pages: DataFrame) -> DataFrame:
    """Studies whose file is missing, has no text on its first pages, or lacks the author's name there: (issue_type, key, study, related, sha256, evidence).

    studies: (key, study); files: (file, sha256); first_pages: (key, name, text), none for a document without blocks."""
    author = slug(F.regexp_extract(F.coalesce("study", F.lit("")), "^\\s*(\\S+)", 1))
    joined = studies.join(files.select(F.col("file").alias("key"), "sha256"), "key", "left").join(first_pages.select("key", "name", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ").alias("text")), "key", "left").withColumn("author", author)
    issue = (
        F.when(F.col("sha256").isNull(), "missing_input_pdf")
        .when((F.col("author") == "") | F.col("name").isNull(), F.lit(None))
        .when(F.trim("text") == "", "empty_extracted_blocks")
        .when(~F.contains("text", F.col("author")), "legacy_author_not_in_first_pages")
    )
    evidence = (
        F.when(issue == "missing_input_pdf", "No matching PDF file found in input directory.")
        .when(issue == "empty_extracted_blocks", F.concat(F.lit("No text found in the first two pages of "), F.col("name"), F.lit(".")))
        .otherwise(F.concat(F.lit("Legacy study author token '"), F.col("author"), F.lit("' was not found in the first two pages of "), F.col("name"), F.lit(".")))
    )
    return joined.where(issue.isNotNull()).select(issue.alias("issue_type"), "key", "study", F.lit("").alias("related"), F.coalesce("sha256", F.lit("")).alias("sha256"), evidence.alias("evidence"))


def by_author_and_year(studies: DataFrame, files: DataFrame) -> DataFrame:
    """(study, file): the file with a study's year and most of its authors' names as whole words, if there is one such. studies: (study); files: (file).

    A file's years are all places of four digits that can be one, over each other or not. Names are ASCII letters, a file's words those of any script.
    Both sides are cut into (year, word) and joined on them."""
    author = F.element_at(F.split("study", YEAR, 2), 1)
    names = F.transform(F.filter(F.regexp_extract_all(author, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) > 2), F.lower)
    left = studies.withColumn("year", F.regexp_extract("study", YEAR, 1)).where("year <> ''").select("study", "year", F.posexplode(names).alias("i", "word"))
    name = F.lower(stem(F.col("file")))
    right = files.select("file", F.explode(years(name)).alias("year"), name.alias("name"))
    right = right.select("file", "year", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit("(?U)\\w+"), F.lit(0)))).alias("word"))
    counted = left.join(right, ["year", "word"]).groupBy("study", "file").agg(F.count("*").alias("n"))
    best = counted.groupBy("study").agg(F.max("n").alias("n"))
    ties = counted.join(best, ["study", "n"]).groupBy("study").agg(F.count("*").alias("k"), F.min("file").alias("file"))
    return ties.where("k = 1").select("study", "file")


def by_containment(studies: DataFrame, files: DataFrame) -> DataFrame:
    """(study, file): the file with the shortest name of those whose slug contains the study's, or the other way; ties by name.

    Each side's slugs are patterns that are looked for in the other side's, so no side is compared with all of the other."""
    s = studies.select("study", slug(F.col("study")).alias("a")).where("a <> ''").distinct()
    f = files.select("file", slug(stem(F.col("file"))).alias("b"), F.length("file").alias("rank")).where("b <> ''")
    inside = contain.first_holder(f.select(F.col("file").alias("id"), F.col("b").alias("text"), "rank"), s.select(F.col("a").alias("pattern")))
    best = f.groupBy("b").agg(F.min(F.struct("rank", F.col("file").alias("id"))).alias("m"))
    around = contain.found_in(s.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("text")), f.select(F.col("b").alias("pattern")))
    outer = around.join(best, around["pattern"] == best["b"]).select(F.col("id").alias("a"), "m.rank", F.col("m.id").alias("file"))
    both = inside.select(F.col("pattern").alias("a"), "rank", F.col("id").alias("file")).unionByName(outer)
    found = both.groupBy("a").agg(F.min(F.struct("rank", "file"))["file"].alias("file"))
    return s.join(found, "a").select("study", "file")


def by_likeness(studies: DataFrame, files: DataFrame, least: float = 0.8) -> DataFrame:
    """(study, file): the file whose slug is most like the study's by matching blocks (difflib's ratio), if it's alike enough; ties by file."""
    s = studies.select("study", unicode_slug(F.col("study")).alias("name")).distinct()
    f = files.select("file", unicode_slug(stem(F.col("file"))).alias("name"))
    return s.join(likeness.most_alike(s, f, least), "name").select("study", "file")


def match_studies(studies: DataFrame, files: DataFrame, tiers: tuple[str, ...] = ("exact", "slug", "author_year", "likeness")) -> DataFrame:
    """(study, file, tier): the first tier that finds a file; null if none does. Of equally good files the first by name.

    A tier sees only what those before it have left; what each has found is kept. A study whose slug is empty has no file."""
    first = lambda df: df.groupBy("study").agg(F.min("file").alias("file"))
    ways = {
        "exact": lambda s: first(s.join(files, F.lower("study") == F.lower(stem(F.col("file")))).select("study", "file")),
        "slug": lambda s: first(s.join(files, unicode_slug(F.col("study")) == unicode_slug(stem(F.col("file")))).select("study", "file")),
        "containment": lambda s: by_containment(s, files),
        "author_year": lambda s: by_author_and_year(s, files),
        "likeness": lambda s: by_likeness(s, files),
    }
    names = studies.select("study").distinct()
    left, found = cut(names.where(unicode_slug(F.col("study")) != "")), None
    for tier in tiers:
        part = cut(ways[tier](left).withColumn("tier", F.lit(tier)))
        found = part if found is None else found.unionByName(part)
        if tier != tiers[-1]:
            left = cut(left.join(part, "study", "left_anti"))
    return names.join(found, "study", "left").select("study", "file", "tier")


def blocks_for(keys: DataFrame, block_files: DataFrame, prefix: int = 50) -> DataFrame:
    """(key, file): the block file of a key by equal slug, or by its first characters; the first by name. keys: (key); block_files: (file)."""
    k = keys.select("key", slug(stem(F.col("key"))).alias("a"))
    f = block_files.select("file", slug(F.regexp_replace("file", "_blocks\\.json$", "")).alias("b"))
    full = k.join(f, k["a"] == f["b"]).select("key", "file", F.lit(0).alias("rank"))
    # the shorter one's first eight characters, or all of it, are a beginning of the longer one
    begins = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda w: F.substring(F.col(c), F.lit(1), w)))).alias("head")
    cut = lambda c: F.substring(c, 1, 8).alias("head")
    one = k.where("a <> ''").select("*", cut("a")).join(f.select("*", begins("b")), "head").where(F.startswith("b", F.substring("a", 1, prefix)))
    other = f.where("b <> ''").select("*", cut("b")).join(k.select("*", begins("a")), "head").where(F.startswith("a", F.substring("b", 1, prefix)))
    near = one.select("key", "file", F.lit(1).alias("rank")).union(other.select("key", "file", F.lit(1).alias("rank")))
    best = full.union(near).groupBy("key").agg(F.min(F.struct("rank", "file"))["file"].alias("file"))
    return keys.select("key").join(best, "key", "left")


#: A citation begins with its author, up to a comma, and then has a year in parentheses.
CITATION = "^([^,]+),.*?\\((\\d{4})\\)"


def cited(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(citation, file): the first file by name whose name holds the citation's author, in any case, and its year. citations: (citation); files: (file).

    The authors are patterns that are looked for in the files' names; an author in a name and the name's runs of four digits meet the citation's."""
    author = F.lower(F.trim(F.regexp_extract("citation", CITATION, 1)))
    left = citations.select("citation", author.alias("author"), F.regexp_extract("citation", CITATION, 2).alias("year")).where("author <> ''")
    held = contain.found_in(files.select(F.col("file").alias("id"), F.lower("file").alias("text")), left.select(F.col("author").alias("pattern")))
    four = F.array_distinct(F.regexp_extract_all("id", F.lit("(?=(\\d{4}))"), F.lit(1)))
    dated = held.select(F.col("pattern").alias("author"), F.col("id").alias("file"), F.explode(four).alias("year"))
    # the first file of an author and year is one row, however many files or citations have them
    firsts = dated.groupBy("author", "year").agg(F.min("file").alias("file"))
    hits = left.distinct().join(firsts, ["author", "year"]).select("citation", "file")
    return citations.select("citation").join(hits, "citation", "left")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order."""
    ranked = rows.withColumn("__cw_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where("__cw_n = 1").drop("__cw_n")
