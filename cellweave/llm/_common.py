"""Shared pieces of the training-data operators.

Names that start with ``__cw_`` are reserved for these operators, so that extra
columns of an input can have any other name.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Hot rows are dealt over so many salts.
HOT_SALTS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master a new one of this machine where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, spread: Sequence[str]) -> DataFrame:
    """rows LEFT JOIN groups USING (keys), safe for hot keys.

    groups has one row per key and in ``size`` that key's number of rows; total is the number
    of all rows. Keys with more than total/HOT_SHARE rows are fewer than HOT_SHARE, so they
    are broadcast; the rows that they resolve are dealt over salts of ``spread`` instead of
    meeting in one task. The other keys have at most total/HOT_SHARE rows each and are shuffled.
    """
    keys = list(keys)
    values = [c for c in groups.columns if c not in keys]
    limit = max(total // HOT_SHARE, 1)
    hot = groups.where(F.col(size) > limit).select(*keys, *(F.col(c).alias(f"__cw_hot_{c}") for c in values))
    # zero, but not as a literal: the optimizer would drop that from the join's keys
    cold = groups.where(F.col(size) <= limit).withColumn("__cw_salt", F.pmod(F.col(size), F.lit(1)).cast("int"))
    found = F.col(f"__cw_hot_{size}").isNotNull()
    loose = found
    for k in keys:
        loose = loose | F.col(k).isNull()
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__cw_salt", F.when(loose, 1 + F.pmod(F.xxhash64(*spread), F.lit(HOT_SALTS)).cast("int")).otherwise(0)
    )
    joined = dealt.join(cold, [*keys, "__cw_salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"__cw_hot_{c}"), F.col(c)).alias(c) for c in values))


#: Bits of a bitmap are kept in rows of so many, the size that bitmap_construct_agg fills.
ROW_BITS = 15
#: A bitmap has two to the power of so many bits, at most 8 MB, whatever goes into it.
BITMAP_BITS = 26


def bits_of(values: DataFrame) -> DataFrame:
    """(__cw_slot, __cw_bits): a bitmap of the different numbers in column v, which are below two to the power of BITMAP_BITS."""
    return values.groupBy(F.shiftright("v", ROW_BITS).alias("__cw_slot")).agg(F.bitmap_construct_agg(F.col("v").bitwiseAND((1 << ROW_BITS) - 1)).alias("__cw_bits"))


def with_hit(rows: DataFrame, value: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """rows with a boolean: whether the bit of value is set. The bitmap is broadcast; its size is fixed."""
    rows = rows.withColumn("__cw_v", value).withColumn("__cw_slot", F.shiftright("__cw_v", ROW_BITS))
    byte = "conv(hex(substring(__cw_bits, cast(shiftright(__cw_v & 32767, 3) as int) + 1, 1)), 16, 10)"
    hit = F.expr(f"(shiftright(cast({byte} as int), cast(__cw_v & 7 as int)) & 1) = 1")
    return rows.join(F.broadcast(bitmap), "__cw_slot", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("__cw_v", "__cw_slot", "__cw_bits")


def _place(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << BITMAP_BITS) - 1)


def among(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose key is in wanted (__cw_id): a bitmap drops most of the others before the exact join shuffles."""
    own = F.col(key).cast(wanted.schema["__cw_id"].dataType)  # equal values of two types hash differently
    near = with_hit(docs, _place(own), bits_of(wanted.select(_place(F.col("__cw_id")).alias("v"))), "__cw_near").where("__cw_near").drop("__cw_near")
    return near.join(wanted, own.eqNullSafe(wanted["__cw_id"]), "left_semi")


def without(docs: DataFrame, key: str, gone: DataFrame, hash_of: Column | None = None) -> DataFrame:
    """The rows of docs whose key isn't in gone (__cw_id). Only rows whose bit is set are shuffled; the others stay for sure.
    With hash_of, a row goes only if gone has its key with that hash (__cw_hash).

    docs is read twice, once for either kind of rows."""
    own = F.col(key).cast(gone.schema["__cw_id"].dataType)
    marked = with_hit(docs, _place(own), bits_of(gone.select(_place(F.col("__cw_id")).alias("v"))), "__cw_near")
    sure, near = marked.where("NOT __cw_near").drop("__cw_near"), marked.where("__cw_near").drop("__cw_near")
    same = own.eqNullSafe(gone["__cw_id"])
    if hash_of is not None:
        near, same = near.withColumn("__cw_own", hash_of), same & (F.col("__cw_own") == gone["__cw_hash"])
    return sure.union(near.join(gone, same, "left_anti").drop("__cw_own"))


#: Rows of an Arrow batch where these are texts, which can be long.
ROWS_AT_A_TIME = 1000


def small_batches(spark: SparkSession) -> None:
    """Give Python at most ROWS_AT_A_TIME rows at a time from now on, which bounds what a task holds outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_A_TIME:
        spark.conf.set(key, str(ROWS_AT_A_TIME))


def large_batches(batches: Iterator[pa.RecordBatch], column: str, least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have about so many bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if size >= least_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Counts by slot are told and added up by chunks of two to the power of so many slots.
CHUNK_BITS = 16


def _planes(numbers: np.ndarray) -> bytes:
    """All low bytes first, the high ones last."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def count_parts(slots: np.ndarray, counts: np.ndarray, table: int = 0) -> pa.RecordBatch:
    """(chunk, part): counts of a table's slots, which are in order, compressed by chunks. A chunk's name holds the table's number above its own 16 bits."""
    pack = zstandard.ZstdCompressor(level=1)
    names, starts = np.unique(slots >> CHUNK_BITS, return_index=True)
    pairs = zip(np.split(slots & ((1 << CHUNK_BITS) - 1), starts[1:]), np.split(counts, starts[1:]), strict=True) if len(slots) else ()
    blobs = [pack.compress(_planes(np.diff(x, prepend=0).astype("<u2")) + _planes(y.astype("<u4"))) for x, y in pairs]  # steps and counts are small
    return pa.RecordBatch.from_arrays([pa.array(names + (table << 16), pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "part"])


def sum_parts(rows: DataFrame) -> DataFrame:
    """(chunk, part): the sums of what count_parts told, a compressed byte for each slot of a chunk: eight times the binary logarithm of one more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = unpack.decompress(part.as_py())
                n = len(raw) // 6
                sums.setdefault(name, np.zeros(1 << CHUNK_BITS, np.int64))[np.cumsum(_from_planes(raw, "<u2", n, 0), dtype=np.int64)] += _from_planes(raw, "<u4", n, 2 * n)
        blobs = [pack.compress(np.minimum(np.round(8 * np.log2(1 + x)), 255).astype(np.uint8).tobytes()) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "part"])

    return rows.repartition("chunk").mapInArrow(add, "chunk long, part binary")


def unpacked(rows: DataFrame, slots: int) -> np.ndarray:
    """The one table of so many slots whose sums are in rows, by bytes."""
    table, unpack = np.zeros((slots >> CHUNK_BITS, 1 << CHUNK_BITS), np.uint8), zstandard.ZstdDecompressor()
    for r in rows.toLocalIterator():
        table[r.chunk] = np.frombuffer(unpack.decompress(bytes(r.part)), np.uint8)
    return table.ravel()


def give_back() -> None:
    """Return what this worker has freed to the system; its next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


#: Py4J tells the driver once a second what Python has let go of.
TOLD_AFTER = 1.5


def tidy(spark: SparkSession, again: float = 0) -> None:
    """Have the driver find what nothing refers to any more: only then do spent shuffles, broadcasts and checkpoints go, on its heap, in its native memory and on disk.

    A step of many small jobs hardly fills the heap, so this would come late or never by itself. What Python lets go of just now
    may stay until the next time; again: do that too, after so many seconds, TOLD_AFTER or more."""
    for seconds in (0, again)[: 2 if again else 1]:
        time.sleep(seconds)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    give_back()


def text_batches(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about most_bytes of text each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of edges (a, b), the smallest node that it reaches.

    Hooks and pointer jumps on tables that each round writes to the shared folder; the number
    of rounds follows the logarithm of the longest path. Nothing is gathered on the driver but
    one count for each round. A root that many nodes share is joined as a hot key.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    total = label.count()
    for _ in range(most_rounds if total else 0):
        seen = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = label.join(seen, "node").select("node", "root", F.least("root", "near").alias("near"))
        hook = near.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        hooked = near.join(hook, "node", "left").select("node", F.col("root").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("root"))
        hooked = cut(hooked)
        sizes = hooked.groupBy("root").agg(F.count("*").alias("__cw_n"))
        targets = sizes.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
        jumped = attach(hooked, targets, ["root"], "__cw_n", total, ["node"])
        now = cut(jumped.select("node", "old", F.coalesce("next", "root").alias("root")))
        changed = now.where("old <> root").count()
        label = now.select("node", "root")
        if not changed:
            return label
    if total:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return label


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n)).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
