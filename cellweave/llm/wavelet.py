"""Token ids in wavelet-matrix shards.

A shard is one file: a head, a table of documents, and a plane of bits for each bit of an id. In
each plane the ids are in the order that sorting by the higher bits (stably, zeros first) gives, so counting
bits takes a place in one plane to its place in the next: a token is read, counted or looked up in as many steps as
an id has bits. Planes are kept in blocks that are compressed for themselves, with the number of ones before each
block; any place is reached by unpacking one block a plane.

Documents go to shards by ranges of doc_id, and each task writes its shard's file under a name that no other
attempt uses; only files that a finished task reports are in the manifest.

Edge cases: a null text is empty and is its end id alone. A null doc_id comes first. Rows that repeat a doc_id follow each other
by their ids. An empty table writes no file. Extra columns are ignored. A character that would end a text early doesn't exist: whole texts are encoded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm._common import cut, shared_folder, text_batches

MAGIC = b"CWWAVE01"
#: Bytes of a plane that are compressed together.
BLOCK = 1 << 14
AT_A_TIME = 4 << 20
CACHE = 1_000_000
#: Ids whose bits are sorted together, so that what a step needs stays in the processor's cache.
STEP = 1 << 16
#: Pieces of words that go to the model together.
PIECES = 1000
#: Ids of a shard, about.
SHARD_IDS = 1 << 24
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The planes, highest bit first, as packed bits, and the number of zeros in each."""
    planes, zeros = [], []
    ids = ids.copy()
    zeros_first, ones = np.empty_like(ids), np.empty_like(ids)
    for b in range(bits - 1, -1, -1):
        plane, bit, z, o = np.empty(-(-len(ids) // 8), np.uint8), ids.dtype.type(1 << b), 0, 0
        for i in range(0, len(ids), STEP):
            part = ids[i : i + STEP]
            one = part & bit != 0
            plane[i >> 3 : (i + STEP) >> 3] = np.packbits(one, bitorder="little")
            of_ones, of_zeros = np.flatnonzero(one), np.flatnonzero(~one)
            ones[o : o + len(of_ones)], zeros_first[z : z + len(of_zeros)] = part[of_ones], part[of_zeros]
            z, o = z + len(of_zeros), o + len(of_ones)
        zeros_first[z:] = ones[:o]
        ids, zeros_first = zeros_first, ids
        planes.append(plane)
        zeros.append(z)
    return planes, zeros


def dump(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, bits: int) -> Iterator[bytes]:
    """The file's bytes: head, documents, directory, blocks. known: whether a doc_id isn't null."""
    pack = zstandard.ZstdCompressor(level=1)
    planes, zeros = build(ids, bits)
    table = pack.compress(doc_ids.astype("<i8").tobytes() + sizes.astype("<u8").tobytes() + known.astype(np.uint8).tobytes())
    parts, before, offsets = [], [], [0]
    for plane in planes:
        ones = 0
        for i in range(0, len(plane), BLOCK):
            block = plane[i : i + BLOCK]
            before.append(ones)
            ones += int(ONES[block].sum(dtype=np.int64))
            parts.append(pack.compress(block.tobytes()))
            offsets.append(offsets[-1] + len(parts[-1]))
    directory = np.array(zeros, "<u8").tobytes() + np.array(before, "<u8").tobytes() + np.array(offsets, "<u8").tobytes()
    yield MAGIC + struct.pack("<QQQQQ", len(ids), len(doc_ids), bits, BLOCK, len(table)) + table + directory
    yield from parts


class Shard:
    """A shard's file, open for reading."""

    def __init__(self, source):
        self.source = source
        head = source.read_at(48, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n, self.docs, self.bits, self.block, table = struct.unpack("<QQQQQ", head[8:])
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(table, 48)) if self.docs else b""
        self.doc_ids = np.frombuffer(raw, "<i8", self.docs)
        self.sizes = np.frombuffer(raw, "<u8", self.docs, 8 * self.docs).astype(np.int64)
        self.known = np.frombuffer(raw, np.uint8, self.docs, 16 * self.docs).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.per_plane = -(-(-(-self.n // 8)) // self.block)
        count = self.bits * self.per_plane
        directory = np.frombuffer(source.read_at(8 * (self.bits + 2 * count + 1), 48 + table), "<u8").astype(np.int64)
        self.zeros, self.before, self.offsets = directory[: self.bits], directory[self.bits : self.bits + count], directory[self.bits + count :]
        self.base = 48 + table + 8 * (self.bits + 2 * count + 1)
        self.unpack = zstandard.ZstdDecompressor()
        self.held: dict[int, np.ndarray] = {}

    def _block(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) >= 256:
                self.held.clear()
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            self.held[k] = np.frombuffer(self.unpack.decompress(self.source.read_at(b - a, self.base + a)), np.uint8)
        return self.held[k]

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a place in a plane."""
        byte, bit = at >> 3, at & 7
        k = byte // self.block
        if k == self.per_plane:
            return self.n - int(self.zeros[plane])
        block, within = self._block(plane * self.per_plane + k), byte % self.block
        ones = int(self.before[plane * self.per_plane + k]) + int(ONES[block[:within]].sum(dtype=np.int64))
        return ones + (bin(block[within] & ((1 << bit) - 1)).count("1") if bit else 0)

    def _bit(self, plane: int, at: int) -> int:
        byte = at >> 3
        return int(self._block(plane * self.per_plane + byte // self.block)[byte % self.block]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for p in range(self.bits):
            bit, ones = self._bit(p, at), self._ones(p, at)
            at = int(self.zeros[p]) + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before ``end`` lie after the last plane."""
        low, high = 0, end
        for p in range(self.bits):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before a place."""
        if token >> self.bits:
            return 0
        low, high = self._span(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th such bit of a plane, from 0."""
        first = plane * self.per_plane
        places = np.arange(self.per_plane, dtype=np.int64) * self.block * 8
        ones = self.before[first : first + self.per_plane]
        j = int(np.searchsorted(ones if bit else places - ones, k, "right")) - 1
        k -= int(ones[j] if bit else places[j] - ones[j])
        flat = np.unpackbits(self._block(first + j), bitorder="little")
        return int(places[j]) + int(np.flatnonzero(flat == bit)[k])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of a token, from 0."""
        if token >> self.bits or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._span(token, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self._select_bit(p, bit, at - int(self.zeros[p]) * bit)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """All ids in order: the sorting of each plane undone, from the last plane to the first."""
        out = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for p in range(self.bits - 1, -1, -1):
            back, bit = np.empty_like(out), out.dtype.type(1 << (self.bits - 1 - p))
            z, o = 0, int(self.zeros[p])
            for k in range(self.per_plane):
                at, place = 8 * k * self.block, p * self.per_plane + k
                first, end = int(self.offsets[place]), int(self.offsets[place + 1])
                packed = np.frombuffer(self.unpack.decompress(self.source.read_at(end - first, self.base + first)), np.uint8)
                one = np.unpackbits(packed, count=min(8 * self.block, self.n - at), bitorder="little").view(bool)
                of_ones, of_zeros, part = np.flatnonzero(one), np.flatnonzero(~one), back[at : at + len(one)]
                part[of_ones], part[of_zeros] = out[o : o + len(of_ones)] | bit, out[z : z + len(of_zeros)]
                z, o = z + len(of_zeros), o + len(of_ones)
            out = back
        return out


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _listed(offsets: np.ndarray, values: np.ndarray, at: pa.Array) -> np.ndarray:
    """The lists of values that begin and end at offsets, in the order of at, one after the other."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
    return lists.take(at).flatten().to_numpy(zero_copy_only=False)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class Words(dict):
    """Ids of words' pieces, as bytes, by a tokenizers file that drops white space, so that words encode for themselves.

    Most words are letters and then signs, which the file's splitter takes apart: in lower case these go to its model
    at once, many together; all others go through the whole tokenizer. Each different word of a batch is looked at once.
    """

    #: Latin letters, which lower case keeps letters (U+0130 becomes two characters).
    LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
    #: ASCII signs that neither begin a contraction nor a special token.
    SIGNS = "[!-&(-/:;=-@\\[-`{-~]"

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends a piece
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _by_model(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are letters alone or signs alone."""
        ids = np.array(self.model.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):  # the file doesn't mark each piece's end
            return [self._by_all(p) for p in pieces]
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _by_all(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def pieces(self, pieces: pa.Array) -> list[bytes]:
        """The ids of different pieces."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, names))
        new = np.array([i for i, f in enumerate(found) if f is None], np.int64)
        if len(new):
            simple = pc.match_substring_regex(pieces.take(pa.array(new)), f"^({self.LETTERS}+|{self.SIGNS}+)$").to_numpy(zero_copy_only=False)
            together = new[simple].tolist()
            for a in range(0, len(together), PIECES):
                some = together[a : a + PIECES]
                for i, f in zip(some, self._by_model([names[i] for i in some]), strict=True):
                    found[i] = f
            for i in new[~simple].tolist():
                found[i] = self._by_all(names[i])
            if len(self) + len(new) > CACHE:
                self.clear()
            self.update((names[i], found[i]) for i in new[:CACHE].tolist() if len(names[i]) < 100)
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end. A null has none."""
        # ASCII white space alone: what else the tokenizer may drop stays
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = pc.dictionary_encode(split.flatten())
        different = words.dictionary
        apart = pc.replace_substring_regex(pc.utf8_lower(different), f"^({self.LETTERS}+)({self.SIGNS}+)$", "\\1 \\2")
        plain = pc.match_substring_regex(different, f"^{self.LETTERS}*{self.SIGNS}*$")
        of_words = pc.split_pattern(pc.if_else(plain, apart, different), " ")
        pieces = pc.dictionary_encode(of_words.flatten())
        found = self.pieces(pieces.dictionary)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = _listed(_ends(sizes), np.frombuffer(b"".join(found), "<u4"), pieces.indices)
        ends = _ends(sizes[pieces.indices.to_numpy()])[_ends(pc.list_value_length(of_words).to_numpy())]
        ids = _listed(ends, ids, words.indices)
        return ids, _ends(np.diff(ends)[words.indices.to_numpy()])[_ends(pc.list_value_length(split).to_numpy())]

    def text(self, text: str | None, end: bytes) -> np.ndarray:
        return np.concatenate([self.texts(pa.array([text], pa.string()))[0], np.frombuffer(end, "<u4")])


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """A worker's words, kept from task to task."""
    return Words(path)


def encode_ids(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, packed): the ids of a text and the end id, as compressed little-endian 32-bit numbers, low halves first."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = _words(path), zstandard.ZstdCompressor(level=1)
        low_end, high_end = np.array([end & 0xFFFF], "<u2").tobytes(), np.array([end >> 16], "<u2").tobytes()
        for whole in rows:
            for batch in text_batches(whole, "text", AT_A_TIME):
                ids, ends = words.texts(batch.column(1))
                low, high = ids.astype("<u2"), (ids >> np.uint32(16)).astype("<u2")
                packed = [pack.compress(low[a:b].tobytes() + low_end + high[a:b].tobytes() + high_end) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) + 1, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "packed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, packed binary")


def write_shards(encoded: DataFrame, folder: str, bits: int = 16, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write encoded documents in ascending doc_id order; returns the manifest (shard, path, n_ids, first), kept in the shared folder."""
    total = encoded.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_ids))
    ordered = encoded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "packed")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack, task = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        done, held, names, sizes, held_ids, part = [], [], [], [], 0, 0

        def flush() -> None:
            nonlocal held, names, sizes, held_ids, part
            uri = f"{folder}/{task:06d}-{part:04d}-{uuid.uuid4().hex}.wave"
            system, path = _open(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                for data in dump(np.concatenate(held), np.array([x or 0 for x in names], np.int64), np.array([x is not None for x in names], bool), np.array(sizes, np.int64), bits):
                    out.write(data)
            done.append((task, part, uri, held_ids))
            held, names, sizes, held_ids, part = [], [], [], 0, part + 1

        for batch in rows:
            for i, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                halves = np.frombuffer(unpack.decompress(packed.as_buffer()), "<u2").reshape(2, -1)
                ids = halves[0] if bits <= 16 else halves[0] | halves[1].astype("<u4") << np.uint32(16)
                if (bits <= 16 and halves[1].any()) or int(ids.max(initial=0)) >> bits:
                    raise ValueError(f"an id has more than {bits} bits")
                held.append(ids)
                names.append(i)
                sizes.append(n)
                held_ids += n
                if held_ids >= 2 * shard_ids:
                    flush()
        if held:
            flush()
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "path", "n_ids"])

    made = cut(ordered.mapInArrow(write, "shard long, part long, path string, n_ids long"))
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each shard
    return made.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the shards."""
    n = max(1, manifest.count())

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inside = _open(path)
                with system.open_input_file(inside) as source:
                    shard = Shard(source)
                    ids = shard.all().astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
                names = pa.array(shard.doc_ids.astype(np.int64), mask=~shard.known)
                yield pa.RecordBatch.from_arrays([names, pa.array(first + shard.starts[:-1]), pa.array(shard.sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "first").repartitionByRange(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, token: int, places: bool = True) -> DataFrame:
    """(path, n, places): how often a token occurs in each shard, and where, counted from the first id of all shards."""
    n = max(1, manifest.count())

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inside = _open(path)
                with system.open_input_file(inside) as source:
                    shard = Shard(source)
                    found = [first + p for p in shard.occurrences(token)] if places else None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([shard.count(token)], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["path", "n", "places"])

    return manifest.select("path", "first").repartitionByRange(n, "path").mapInArrow(read, "path string, n long, places array<long>")


def round_trip(docs: DataFrame, path: str, end: int = 2, bits: int = 16, **options) -> DataFrame:
    """Encode, write and read back: a row of read_documents for each document."""
    encoded = cut(encode_ids(docs, path, end, **options))
    return read_documents(write_shards(encoded, shared_folder(docs.sparkSession, "wavelet"), bits))
