"""Vectors as codes of a product quantizer, whose codebooks Lloyd's rounds refine with Elkan's bounds.

A vector is cut into parts, and a part's code is its nearest entry of that part's codebook. Blocks of vectors keep, part by part, the entry assigned, an
upper bound of the distance to it and a lower bound of the distance to each entry. When the entries have moved, the bounds are shifted by what they moved,
and only what a bound or half the distance between two entries doesn't exclude strictly is looked at. Everything that decides is computed in integers; bounds
are rounded outwards, so equal distances are never pruned and go to the lower index.

Each round is a pass over blocks in the shared folder, and a small sum by entry: codebooks alone reach the driver. A block's state is
16 + 64 + 1,024 bytes a vector with 16 parts of 64 entries before it is compressed, as a lower bound takes a byte. A state goes once the next one is written.

Edge cases: rows whose vector is null, empty, or holds a null, NaN or infinite component are left out. A null vec_id ranks after all others; rows that repeat a vec_id rank
by their vectors. Fewer vectors than entries make smaller codebooks, none an empty table. Null labels count as one label. Vectors of different lengths, or not of whole parts, and components
whose distances don't fit 64 bits raise a ValueError. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import attach, cut, shared_folder

#: Vectors of a block, at most: its working arrays take some 10 MB.
BLOCK = 4096
#: A component is this many steps to one.
STEPS = 256
#: What floating-point bounds are widened by.
OUT, IN = 1 + 1e-6, 1 - 1e-6


@dataclass
class Block:
    """Vectors by parts, int64 of shape (n, parts, width), and what is known of them."""

    vectors: np.ndarray
    assigned: np.ndarray | None = None  # (n, parts)
    upper: np.ndarray | None = None  # (n, parts): at least the distance to the assigned entry
    lower: np.ndarray | None = None  # (parts, n, entries): at most the distance to each
    computed: int = 0

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, (n, parts)."""
        return ((self.vectors - books[np.arange(books.shape[0])[None, :], self.assigned]) ** 2).sum(2)

    def first(self, books: np.ndarray) -> None:
        """Assign by all distances, which are the first bounds."""
        n, (parts, entries, width) = len(self.vectors), books.shape
        self.assigned, self.upper, self.lower = np.empty((n, parts), np.int64), np.empty((n, parts)), np.empty((parts, n, entries))
        for p in range(parts):
            squared = np.zeros((n, entries), np.int64)
            for j in range(width):
                step = self.vectors[:, p, j, None] - books[p, None, :, j]
                squared += step * step
            self.assigned[:, p] = squared.argmin(1)  # the first of equal ones
            self.upper[:, p] = np.sqrt(squared.min(1)) * OUT
            self.lower[p] = np.sqrt(squared) * IN
        self.computed += n * parts * entries

    def again(self, before: np.ndarray, books: np.ndarray) -> None:
        """Assign anew after the codebooks moved."""
        parts, entries, _ = books.shape
        moved = np.sqrt(((books - before) ** 2).sum(2)) * OUT
        for p in range(parts):
            half = np.sqrt(((books[p, :, None] - books[p, None]) ** 2).sum(2)) / 2 * IN
            lower = np.maximum(self.lower[p] - moved[p], 0)
            was, all_upper = self.assigned[:, p], self.upper[:, p] + moved[p][self.assigned[:, p]]
            apart = half + np.where(np.eye(entries, dtype=bool), np.inf, 0)
            rows = np.flatnonzero(all_upper >= apart.min(1)[was])
            if len(rows):
                own, at = was[rows], np.arange(len(rows))
                maybe = self._maybe(all_upper[rows], lower[rows], apart[own], own)
                some = maybe.any(1)
                rows, own, maybe, at = rows[some], own[some], maybe[some], at[: some.sum()]
                squared = np.full((len(rows), entries), np.iinfo(np.int64).max)
                squared[at, own] = ((self.vectors[rows, p] - books[p][own]) ** 2).sum(1)
                exact = np.sqrt(squared[at, own])
                lower[rows, own] = exact * IN
                maybe &= self._maybe(exact * OUT, lower[rows], apart[own], own)
                r, c = np.nonzero(maybe)
                squared[r, c] = ((self.vectors[rows[r], p] - books[p][c]) ** 2).sum(1)
                lower[rows[r], c] = np.sqrt(squared[r, c]) * IN
                now = squared.argmin(1)
                self.assigned[rows, p], all_upper[rows] = now, np.sqrt(squared[at, now]) * OUT
                self.computed += len(rows) + len(r)
            self.upper[:, p], self.lower[p] = all_upper, lower

    @staticmethod
    def _maybe(upper: np.ndarray, lower: np.ndarray, apart: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Other entries that may be as near as the assigned one or nearer."""
        maybe = (upper[:, None] >= lower) & (upper[:, None] >= apart)
        maybe[np.arange(len(own)), own] = False
        return maybe

    def sums(self, entries: int) -> np.ndarray:
        """(parts, entries, 1 + width): how many vectors an entry has, and their sums."""
        _, parts, width = self.vectors.shape
        out = np.zeros((parts, entries, 1 + width), np.int64)
        for p in range(parts):
            out[p, :, 0] = np.bincount(self.assigned[:, p], minlength=entries)
            for j in range(width):  # sums of a block stay under 2**53
                out[p, :, 1 + j] = np.bincount(self.assigned[:, p], weights=self.vectors[:, p, j], minlength=entries)
        return out


_STATE = "vectors binary, assigned binary, upper binary, lower binary, scale binary, sums binary, computed long"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _dump(block: Block, entries: int) -> list[pa.Array]:
    pack = zstandard.ZstdCompressor(level=1)
    most = block.lower.max((1, 2), initial=0) / 255 * OUT + 1e-30
    codes = np.floor(block.lower / most[:, None, None]).astype(np.uint8)
    # a float of 32 bits may be below its bound of 64
    upper = np.nextafter(block.upper.astype(np.float32), np.float32(np.inf))
    kind = next(k for k in ("<i2", "<i4") if abs(block.vectors).max(initial=0) <= np.iinfo(k).max)
    blobs = (block.vectors.astype(kind), block.assigned.astype("<u2"), upper, codes, most, block.sums(entries))
    return [*(pa.array([pack.compress(np.ascontiguousarray(b).tobytes())], pa.binary()) for b in blobs), pa.array([block.computed], pa.int64())]


def _blobs(batch: pa.RecordBatch, i: int) -> dict[str, bytes]:
    return {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in _NAMES[:5]}


def _load(n: int, parts: int, entries: int, width: int, row: dict[str, bytes]) -> Block:
    unpack = zstandard.ZstdDecompressor()
    raw = {c: unpack.decompress(row[c]) for c in ("vectors", "assigned", "upper", "lower", "scale")}
    vectors = np.frombuffer(raw["vectors"], f"<i{len(raw['vectors']) // (n * parts * width)}").astype(np.int64).reshape(n, parts, -1)
    scale = np.frombuffer(raw["scale"], np.float64)
    lower = np.frombuffer(raw["lower"], np.uint8).reshape(parts, n, entries) * (scale * IN)[:, None, None]
    assigned = np.frombuffer(raw["assigned"], "<u2").astype(np.int64).reshape(n, parts)
    return Block(vectors, assigned, np.frombuffer(raw["upper"], np.float32).astype(np.float64).reshape(n, parts), lower)


def _integers(lists: pa.Array, length: int, parts: int) -> np.ndarray:
    """floor(STEPS * x) of vectors of one length."""
    if length % parts or set(lists.value_lengths().to_pylist()) - {length}:
        raise ValueError(f"vectors aren't all of {length} components, or these aren't {parts} equal parts")
    scaled = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
    if abs(scaled).max(initial=0) >= (1 << 30) / np.sqrt(length):
        raise ValueError("squared distances don't fit 64 bits")
    return scaled.astype(np.int64).reshape(-1, parts, length // parts)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together and cut to so many rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            whole = pa.Table.from_batches(held)
            full = rows - rows % most
            for at in range(0, full, most):
                yield whole.slice(at, most).combine_chunks().to_batches()[0]
            held, rows = whole.slice(full).to_batches(), rows - full
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector): rows whose vector is whole."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("vector"))


def _published(df: DataFrame) -> tuple[DataFrame, str]:
    path = shared_folder(df.sparkSession, "codes")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _remove(df: DataFrame, path: str) -> None:
    """Delete a state that a later one has replaced."""
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after each entry became the mean of its vectors, rounded down; unused ones stay."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros((parts * entries, 1 + width), np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(unpack.decompress(blob), np.int64).reshape(total.shape)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["entry", "sums"])

    sums = state.select("sums").mapInArrow(add, "entry long, sums array<long>")
    found = sums.groupBy("entry").agg(*(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(1 + width))).collect()  # a row for each entry, at most
    out = books.reshape(-1, width).copy()
    for r in found:
        out[r.entry] = [r[2 + j] // r[1] for j in range(width)]
    return out.reshape(books.shape)


def _pass(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, most: int = BLOCK) -> DataFrame:
    """The state after an assignment: of usable vectors, or with the codebooks before it, of a state."""
    parts, entries, width = books.shape
    ids, labels = (t.dataType.simpleString() for t in rows.schema.fields[:2])
    if before is None:
        ids, labels = f"array<{ids}>", f"array<{labels}>"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, most):
            block = Block(_integers(batch.column(2), parts * width, parts))
            block.first(books)
            whole = pa.array([0, batch.num_rows], pa.int32())
            yield _row(pa.ListArray.from_arrays(whole, batch.column(0)), pa.ListArray.from_arrays(whole, batch.column(1)), block, entries)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _load(len(batch.column(0)[i]), parts, entries, width, _blobs(batch, i))
                block.again(before, books)
                yield _row(batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), block, entries)

    kept = rows if before is None else rows.drop("sums", "computed")
    return kept.mapInArrow(start if before is None else go_on, f"ids {ids}, labels {labels}, {_STATE}")


def _row(ids: pa.Array, labels: pa.Array, block: Block, entries: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, labels, *_dump(block, entries)], names=["ids", "labels", *_NAMES])


def _coded(state: DataFrame, books: np.ndarray, before: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) after the last assignment."""
    parts, entries, width = books.shape
    digits = 2 if entries <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                block = _load(len(ids), parts, entries, width, _blobs(batch, i))
                block.again(before, books)
                raw = block.assigned.astype(f">u{digits // 2}").tobytes().hex()
                size = digits * parts
                codes = [raw[a : a + size] for a in range(0, len(raw), size)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(block.errors(books).sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])

    ids, labels = (state.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    return state.drop("sums", "computed").mapInArrow(run, f"vec_id {ids}, label {labels}, code string, error long")


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids; None without any vector."""
    found = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not found:
        return None
    lists = pa.array([r.vector for r in found], pa.list_(pa.float64()))
    return np.ascontiguousarray(_integers(lists, len(found[0].vector), parts).transpose(1, 0, 2))


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray] | None:
    """(vec_id, label, code, error), kept in the shared folder, and the codebooks of shape (parts, entries, width)."""
    books = first_books(vectors, parts, entries)
    if books is None:
        return None
    state, path = _published(_pass(vectors, books, None))
    before = books
    for k in range(rounds):
        before, books = books, moved(state, books)
        if k + 1 < rounds:
            now, at = _published(_pass(state, books, before))
            _remove(state, path)
            state, path = now, at
    codes = cut(_coded(state, books, before))
    _remove(state, path)
    return codes, books


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and place."""
    return ",".join(map(str, books.ravel().tolist()))


def quantize(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, **columns: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable vector. code: indexes in two hex digits each, four with more than 256 entries.

    A label's errors are summed and joined back as those of a key that may be hot."""
    vectors = usable(table, **columns)
    found = fit(vectors, parts, entries, rounds)
    if found is None:
        empty = vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.where("false")
    codes, books = found
    # a null label is a label of its own
    keyed = codes.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    sums = keyed.groupBy("label", "none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = attach(keyed, sums, ["label", "none"], "n", codes.count(), ["vec_id", "code"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
