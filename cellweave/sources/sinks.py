"""Sinks. Spark's committer publishes a finished write as a whole; an old result isn't replaced by an empty one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _files(df: DataFrame, path: str):
    """Hadoop's file system of a path, and its paths."""
    context = df.sparkSession.sparkContext
    to_path = context._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(context._jsc.hadoopConfiguration()), to_path


def write_json_lines(records: DataFrame, path: str, keep_old_if_empty: bool = False) -> bool:
    """A JSON object in a line for each row; whether anything was written.

    With keep_old_if_empty the rows go to a folder beside the old one, are counted on their way, and take its place if there are any; the rows are computed once."""
    lines = records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    if not keep_old_if_empty:
        lines.write.mode("overwrite").text(path)
        return True
    seen, mark = Observation(), uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}._new-{mark}", f"{path.rstrip('/')}._old-{mark}"
    files, to_path = _files(records, path)
    try:
        lines.observe(seen, F.count(F.lit(1)).alias("n")).write.text(staged)
        if not seen.get["n"]:
            return False
        replaced = files.exists(to_path(path)) and files.rename(to_path(path), to_path(old))
        if not files.rename(to_path(staged), to_path(path)):
            if replaced:
                files.rename(to_path(old), to_path(path))
            raise OSError(f"{staged} can't take the place of {path}")
        files.delete(to_path(old), True)
        return True
    finally:
        files.delete(to_path(staged), True)


def append_json_lines(records: DataFrame, path: str) -> None:
    """Rows added to what a folder of JSON lines has; a write that fails adds none."""
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], single_file: bool = True) -> None:
    """Columns in the given order, under a header. A sheet for people is one file."""
    chosen = rows.select(*(F.col(f"`{c}`") for c in columns))
    (chosen.coalesce(1) if single_file else chosen).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_json(document: DataFrame, path: str) -> None:
    """One document: the only row of a DataFrame."""
    document.select(F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str, label: str = "label", count: str = "count") -> None:
    """Lines label,count under a header, without quotes, in order."""
    lines = counts.select(F.concat_ws(",", F.col(label), F.col(count)).alias("value"))
    counts.sparkSession.createDataFrame([(f"{label},{count}",)], "value string").union(lines).coalesce(1).write.mode("overwrite").text(path)


def missing_report(found: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(ord, text), the lines of a report: for each wanted field how many records miss it and which, or that none does. found: (field, record), a row for each missing value."""
    order = found.sparkSession.createDataFrame(list(enumerate(wanted)), "i int, field string")
    counts = found.groupBy("field").agg(F.count("*").alias("n"))
    head = F.when(F.col("n") > 0, F.concat("field", F.lit(": missing in "), F.col("n"), F.lit(" records"))).otherwise(F.concat("field", F.lit(": no missing values detected")))
    heads = order.join(counts, "field", "left").select("i", F.lit(0).alias("k"), F.lit("").alias("record"), head.alias("text"))
    names = found.join(order, "field").select("i", F.lit(1).alias("k"), "record", F.concat(F.lit("  - "), "record").alias("text"))
    return heads.unionByName(names).orderBy("i", "k", "record").select("i", "text")


def write_report(lines: DataFrame, path: str) -> None:
    """Lines (text, ...) in their order as one text file for people."""
    lines.select("text").coalesce(1).write.mode("overwrite").text(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as Parquet, by document; nothing else in the folder is touched."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)


def result_path(folder: str, name: str, mode: str = "", setup: str = "", ending: str = ".jsonl") -> str:
    """folder/name_mode_setup.jsonl; empty parts are left out."""
    return f"{folder}/{'_'.join(x for x in (name, mode, setup) if x)}{ending}"
