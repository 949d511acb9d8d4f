"""Benchmark decontamination with suffix arrays over the training texts.

The documents of a task are cut into shards of bounded size. A shard's words become numbers, and a sparse suffix array orders those positions whose
first words begin some benchmark window (no other position can start a match). Benchmark suffixes are binary-searched in it, each different one once and only if its
first words occur in the shard: the interval of a suffix's window gives all locations. A location has one window of each length at most, so work
follows the texts' hits, however many items and documents share a passage. A document lies whole in one shard, so its result needs no shuffle.

The longest verbatim match of a location with a whole window is found among all suffixes of the items that the shard has hit, by their suffix array: blocks of 1, 2, 4, ...
words have ranks on both sides, and a location takes the longest block that goes on, then the next shorter ones, each by a binary search in what is left of its interval.

The benchmark is read in blocks of bounded size, each broadcast for itself. A worker keeps what it has built of them, some 30 bytes a word, as far as BUILT_BYTES reach;
of a larger benchmark the blocks that don't fit are built again for each shard.

Edge cases: null texts have no words, on either side. Items without words are ignored; rows of
one item_id count as one item; a null item_id is the id ''. Each document row gives one row, repeated or
not. An empty benchmark hits nothing; empty documents give an empty table. Extra columns pass ``clean`` untouched. Of equally long matches, the one that comes first in the
document counts, and of its places in the benchmark the first by item_id and place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import small_batches, text_batches

WINDOW = 10
#: First words that a position is indexed by, at most.
LEAD = 4
LEAD_BITS = 22
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Bytes of the benchmark whose built blocks a worker keeps.
BUILT_BYTES = 64 << 20
#: Bytes other than letters, digits and those of non-ASCII characters separate words.
SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
LONGEST = pa.schema([("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64()), ("longest_item_at", pa.int64())])
MATCH = pa.struct([("item_id", pa.string()), ("doc_at", pa.int64()), ("item_at", pa.int64()), ("n_words", pa.int64())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(SPACES).split()


def _keys(numbers: np.ndarray, at: np.ndarray, lengths: np.ndarray | int, depth: int, fill: int = 0) -> np.ndarray:
    """The numbers from each position on, filled up from a length on, as strings that sort alike."""
    picked = numbers[at[:, None] + np.arange(depth)].astype(">u4")
    if not isinstance(lengths, int):
        picked[np.arange(depth) >= lengths[:, None]] = fill
    return np.ascontiguousarray(picked).view(f"S{4 * depth}").ravel()


def _lead(numbers: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    """A hash of the first words from each position on."""
    n = len(numbers) - lead + 1
    mixed = np.zeros(max(n, 0), np.uint64)
    for i in range(lead):
        mixed = (mixed + numbers[i : i + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed[at] >> np.uint64(64 - LEAD_BITS)).astype(np.int32)


def _bisect(keys, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """In each interval [low, high) the first place whose key isn't below what is wanted, or with right is above it. keys: of places and the rows that ask."""
    low, high, rows = low.copy(), high.copy(), np.arange(len(low))
    while len(rows):
        rows = rows[low[rows] < high[rows]]
        middle = (low[rows] + high[rows]) >> 1
        found = keys(middle, rows)
        up = found <= wanted[rows] if right else found < wanted[rows]
        low[rows[up]], high[rows[~up]] = middle[up] + 1, middle[~up]
    return low


class Suffixes:
    """All suffixes of some items in order, and the ranks of their first 1, 2, 4, ... words."""

    def __init__(self, items: list[np.ndarray], owners: np.ndarray):
        """items: their words' numbers, from 1 on; owners: a number for each of them."""
        sizes = np.array([len(x) for x in items], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.zeros(int(self.begins[-1]), np.int64)
        for b, x in zip(self.begins, items, strict=False):
            flat[b : b + len(x)] = x
        self.owners = owners
        self.ranks, self.pairs = [(flat + 1).astype(np.int32)], []
        while 1 << len(self.pairs) < sizes.max():
            now, step = self.ranks[-1], 1 << len(self.pairs)
            after = np.ones(len(now), np.int64)
            after[: max(0, len(now) - step)] = now[step:]
            pairs, rank = np.unique(now.astype(np.int64) << 32 | after, return_inverse=True)
            self.pairs.append(pairs)
            self.ranks.append((rank + 1).astype(np.int32))
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.firsts: dict[tuple[int, int], tuple[int, int]] = {}

    def longest(self, numbers: np.ndarray, at: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For positions of a shard's numbers the longest match with any suffix, and the interval of the suffixes that have it. covered: the positions that any match can hold."""
        levels = [np.zeros(len(numbers) + 1, np.int32)]
        levels[0][covered] = np.where(numbers[covered] > 0, numbers[covered] + 1, 0)
        for k, pairs in enumerate(self.pairs):
            now, step = levels[-1], 1 << k
            some = covered[(covered + step < len(numbers)) & (now[covered] > 0)]
            some = some[now[some + step] > 0]
            wanted = now[some].astype(np.int64) << 32 | now[some + step]
            place = np.searchsorted(pairs, wanted)
            there = pairs[np.minimum(place, len(pairs) - 1)] == wanted
            if not there.any():
                break
            following = np.zeros_like(now)
            following[some[there]] = place[there] + 1
            levels.append(following)
        low, high, size = np.zeros(len(at), np.int64), np.full(len(at), len(self.order)), np.zeros(len(at), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            wanted = levels[k][np.minimum(at + size, len(numbers))]
            rows = np.flatnonzero(wanted)
            ranks, held = self.ranks[k], size[rows]
            key = lambda places, which, ranks=ranks, held=held: ranks[np.minimum(self.order[places] + held[which], len(ranks) - 1)]
            a, b = (_bisect(key, low[rows], high[rows], wanted[rows], right) for right in (False, True))
            good = b > a
            low[rows[good]], high[rows[good]] = a[good], b[good]
            size[rows[good]] += 1 << k
        return size, low, high

    def first(self, low: int, high: int) -> tuple[int, int]:
        """Of an interval's suffixes the least owner, and the least place in its text."""
        if (low, high) not in self.firsts:
            place = self.order[low:high]
            text = np.searchsorted(self.begins, place, "right") - 1
            k = np.lexsort((place - self.begins[text], self.owners[text]))[0]
            self.firsts[low, high] = int(self.owners[text[k]]), int(place[k] - self.begins[text[k]])
        return self.firsts[low, high]


class Block:
    """Benchmark items in numbers: their different windows, ready to be searched for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.window = window
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        parts, owner = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                parts.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.uint32, len(words)))
                owner.append(place[item])
        sizes = np.array([len(p) for p in parts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.words = int(self.begins[-1])
        self.numbers = np.zeros(self.words + window + LEAD, np.uint32)
        for b, p in zip(self.begins, parts, strict=False):
            self.numbers[b : b + len(p)] = p
        self.owner = np.array(owner, np.int64)
        long = np.minimum(window, sizes)
        counts = sizes - long + 1
        of = np.repeat(np.arange(len(parts)), counts)
        starts = self.begins[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.lead, self.depth = int(min([LEAD, *long])), int(max(long, default=1))
        # each different window once, by its first place
        keys = _keys(self.numbers, starts, long[of], self.depth)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        self.starts, self.lengths = starts[first], long[of[first]]
        self.leads = _lead(self.numbers, self.starts, self.lead) if len(starts) else np.zeros(0, np.int32)
        self.may = np.zeros(1 << LEAD_BITS, bool)
        self.may[self.leads] = True
        self._classes(np.unique(which * max(1, len(self.ids)) + self.owner[of]) if len(of) else np.zeros(0, np.int64))

    def _classes(self, pairs: np.ndarray) -> None:
        """Windows with the same items are of one class. pairs: window times the number of ids plus item, in order."""
        window, item = pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))
        ends = np.searchsorted(window, np.arange(len(self.starts)), "right")
        seen: dict[bytes, int] = {}
        self.items_of: list[np.ndarray] = []
        self.class_of = np.zeros(len(self.starts), np.int64)
        begin = 0
        for w, end in enumerate(ends.tolist()):
            own = item[begin:end]
            k = seen.setdefault(own.tobytes(), len(seen))
            if k == len(self.items_of):
                self.items_of.append(own.astype(np.int32))
            self.class_of[w], begin = k, end

    def suffixes(self, classes: np.ndarray) -> Suffixes:
        """Those of the items of some classes of windows."""
        hit = np.zeros(len(self.ids), bool)
        for k in classes.tolist():
            hit[self.items_of[k]] = True
        texts = np.flatnonzero(hit[self.owner])
        return Suffixes([self.numbers[self.begins[t] : self.begins[t + 1] - 1] for t in texts.tolist()], self.owner[texts])

    def search(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts in words: their numbers, where each begins, the words hit, the places where a whole window begins, and (text, class) pairs as text times classes plus class."""
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        none = np.zeros(0, np.int64)
        hit = np.zeros(begins[-1] + 1, np.int32)
        if not len(self.starts) or not len(texts):
            return none, begins, hit[:-1] > 0, none, none
        get, flat = self.number.get, []
        for words in texts:
            flat += [get(w, 0) for w in words]
            flat.append(0)
        numbers = np.zeros(len(flat) + self.depth + LEAD, np.uint32)
        numbers[: len(flat)] = flat
        # the sparse suffix array of the shard
        at = np.flatnonzero(numbers[: len(flat)])
        leads = _lead(numbers, at, self.lead)
        some = self.may[leads]
        at, leads = at[some], leads[some]
        keys = _keys(numbers, at, self.depth, self.depth)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        # the windows whose first words are there
        there = np.zeros(1 << LEAD_BITS, bool)
        there[leads] = True
        asked = np.flatnonzero(there[self.leads])
        low, high = (_keys(self.numbers, self.starts[asked], self.lengths[asked], self.depth, fill) for fill in (0, 0xFFFFFFFF))
        first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
        counts = np.maximum(last - first, 0)
        which = np.repeat(asked, counts)
        where = at[np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        np.add.at(hit, where, 1)
        np.add.at(hit, where + self.lengths[which], -1)
        text_of = np.searchsorted(begins, where, "right") - 1
        pairs = np.unique(text_of * len(self.items_of) + self.class_of[which])
        return numbers, begins, np.cumsum(hit[:-1]) > 0, np.unique(where[self.lengths[which] == self.window]), pairs


class Found:
    """What blocks have found in the texts of a shard."""

    def __init__(self, texts: list[str | None], matches: bool = False, longest: bool = False):
        self.words = [words_of(t) for t in texts]
        self.hits: dict[int, np.ndarray] = {}
        self.items: dict[int, list[tuple[Block, tuple[int, ...]]]] = {}
        self.matches: list[list[dict]] = [[] for _ in texts]
        self.longest: list[tuple] = [(0, None, None, None)] * len(texts)
        self.told = matches, longest

    def add(self, block: Block) -> None:
        numbers, begins, hit, where, pairs = block.search(self.words)
        if not len(pairs):
            return
        text, kind = pairs // len(block.items_of), pairs % len(block.items_of)
        names, starts = np.unique(text, return_index=True)
        for i, kinds in zip(names.tolist(), np.split(kind, starts[1:]), strict=True):
            mine = hit[begins[i] : begins[i + 1]]
            self.hits[i] = mine | self.hits[i] if i in self.hits else mine
            self.items.setdefault(i, []).append((block, tuple(kinds.tolist())))
        if any(self.told) and len(where):
            self._measure(block, numbers, begins, hit, where, np.unique(kind))

    def _measure(self, block: Block, numbers, begins, hit, where, classes) -> None:
        suffixes = block.suffixes(classes)
        size, low, high = suffixes.longest(numbers, where, np.flatnonzero(hit))
        text = np.searchsorted(begins, where, "right") - 1
        # a match that goes on the one before it is no match of its own
        own = np.concatenate([[True], (np.diff(where) != 1) | (size[1:] >= size[:-1])])
        for k in np.flatnonzero(own).tolist():
            t, n = int(text[k]), int(size[k])
            if not self.told[0] and n < self.longest[t][0]:
                continue
            owner, item_at = suffixes.first(int(low[k]), int(high[k]))
            told = (n, block.ids[owner], int(where[k] - begins[t]), item_at)
            if self.told[0]:
                self.matches[t].append({"item_id": told[1], "doc_at": told[2], "item_at": item_at, "n_words": n})
            before = self.longest[t]
            if n > before[0] or n == before[0] and (told[2], told[1], item_at) < (before[2], before[1], before[3]):
                self.longest[t] = told

    def columns(self) -> list[list]:
        """The columns of RESULT."""
        known: dict[tuple, tuple[int, str]] = {}
        n_hit, n_items, digests = [], [], []
        for i in range(len(self.words)):
            n_hit.append(int(self.hits[i].sum()) if i in self.hits else 0)
            key = tuple((id(b), kinds) for b, kinds in self.items.get(i, ()))
            if key not in known:  # texts that share a passage have the same items
                names = sorted({b.ids[x] for b, kinds in self.items.get(i, ()) for x in np.unique(np.concatenate([b.items_of[k] for k in kinds])).tolist()})
                known[key] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
            n_items.append(known[key][0])
            digests.append(known[key][1])
        return [[len(w) for w in self.words], n_hit, n_items, digests, [n > 0 for n in n_hit]]


_BUILT: dict[tuple[str, int], Block] = {}


def _built(parts: list, k: int, call: str, window: int, block_bytes: int) -> Block:
    """A block of a call, from what the worker keeps of it, or built now."""
    if any(c != call for c, _ in _BUILT):
        _BUILT.clear()
    if (call, k) in _BUILT:
        return _BUILT[call, k]
    made = Block(parts[k].value, window)
    if (len(_BUILT) + 1) * block_bytes <= BUILT_BYTES:
        _BUILT[call, k] = made
    return made


def _search(parts: list, call: str, window: int, block_bytes: int, texts: list[str | None], **told: bool) -> Found:
    found = Found(texts, **told)
    for k in range(len(parts)):
        found.add(_built(parts, k, call, window, block_bytes))
    return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list:
    """Broadcast blocks of the benchmark; the driver holds one at a time, of about block_bytes."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    size = rows.select(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [spark.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, matches: bool = False) -> DataFrame:
    """A row for each document: its id, the columns of RESULT, its longest verbatim match of a window or more (LONGEST: words, item, places in words; 0 and nulls without one), and on demand
    all matches that don't just go on another one (item_id, doc_at, item_at, n_words)."""
    parts = _blocks(benchmark, item_id, item_text, block_bytes)
    small_batches(docs.sparkSession)
    call = uuid.uuid4().hex
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = f"`{doc_id}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_at long, longest_item_at long"
    if matches:
        columns += ", matches array<struct<item_id:string,doc_at:bigint,item_at:bigint,n_words:bigint>>"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in text_batches(whole, "text", SHARD_BYTES):
                found = _search(parts, call, window, block_bytes, batch.column(1).to_pylist(), matches=matches, longest=True)
                arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(found.columns(), RESULT.types, strict=True))]
                arrays += [pa.array([x[k] for x in found.longest], t) for k, t in enumerate(LONGEST.types)]
                names = [doc_id, *RESULT.names, *LONGEST.names]
                if matches:
                    arrays, names = [*arrays, pa.array(found.matches, pa.list_(MATCH))], [*names, "matches"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(doc_id), F.col(text).alias("text")).mapInArrow(run, columns)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs without any hit, with all their columns; one pass, no shuffle."""
    block_bytes = options.pop("block_bytes", BLOCK_BYTES)
    parts = _blocks(benchmark, options.pop("item_id", "item_id"), options.pop("item_text", "text"), block_bytes)
    window = options.pop("window", WINDOW)
    small_batches(docs.sparkSession)
    call = uuid.uuid4().hex

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in text_batches(whole, text, SHARD_BYTES):
                found = _search(parts, call, window, block_bytes, batch.column(batch.schema.get_field_index(text)).to_pylist())
                yield batch.filter(pa.array([i not in found.hits for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
