"""Language-model scores by logistic context mixing.

A text is coded as its words, each with a blank behind it, and an end; its score is the probability of these bytes, one after the other. Each
bit of a byte is predicted by five hashed-context predictors: from the one to five bytes before it, over the ends of words, and
the bits so far of the byte's code, they look up how often a one and a zero came next in all training texts. Their log-odds are added up with weights that
a gate picks by what the three longest contexts have seen and by whether a word begins; the sum is refined by an adaptive map from what was
predicted to what came. Weights and map are learned online: the training texts are dealt into ``PARTS`` by a hash of their ids, each part is
predicted by the weights so far, every occurrence as if it weren't in the counts, and gives one Newton step and what the map holds. So each text is
learned from once, in an order that neither the number of tasks nor held-out texts change, and a text's score doesn't depend on other texts scored.

Within a text, a second mixture adapts from word to word: the word as spelled by the bits, the word's frequency in training, and how often the text itself
has had it, by several fixed shares, which are weighed by how well they have done in the text so far. Every part is a distribution over what
comes next, so the scores of all texts sum to one at most.

What has the same context costs the same. So a task prices each different run of six bytes once for many MB of text and looks the price up for
each occurrence. Tables of counts have a fixed number of slots, which bounds what is broadcast; counts of words aren't bounded and are joined by a shuffle.
Texts are numbered by blocks of bounded size: a block's words are joined with their counts by hashes of 80 bits, and the counts come back to the block, whose texts are kept as numbers of its own words.

Edge cases: a null text counts as empty and has its end alone. Only rows with a doc_id can be trained on; a row without one is
scored and not held out. doc_id may be of any type. Repeated rows count, and are scored, each for itself. With no training text every bit is
even and counts are zero. A text of any length is scored whole, by segments. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import TOLD_AFTER, count_parts, crc_mod, give_back, small_batches, stored, sum_parts, tidy

#: Slots of each predictor's table, as powers of two: one to five bytes back. They take two bytes a slot, 45 MB in all.
SLOT_BITS = (16, 20, 22, 23, 23)
ORDERS = len(SLOT_BITS)
#: The predictors and a bias.
INPUTS = ORDERS + 1
#: By what the three longest contexts have seen (nothing, always the same bit, both), and whether a word begins.
GATES = 3 * 3 * 3 * 2
#: The map's levels of log-odds, up to REACH to either side.
LEVELS, REACH = 33, 12
#: Parts of the training texts, one after the other.
PARTS = 2
#: Counts that each bit has beforehand, and what holds weights to where they begin.
PRIOR, RIDGE = 0.2, 1.0
#: Bytes in which equal runs are counted once when learning, and that are laid out at a time when scoring.
LEARN_BYTES, PRICE_BYTES = 10 << 20, 1 << 20
#: Runs whose prices are kept; beyond that they are worked out anew.
KNOWN_RUNS = 4_000_000
#: Runs whose bits are handled at a time, and bytes that are copied or made into keys at a time.
AT_A_TIME, BYTES_AT_A_TIME = 1 << 13, 1 << 18
#: Words and bytes of a block, about.
BLOCK_TOKENS, BLOCK_BYTES = 4_000_000, 24 << 20
MODULUS, HELD_OUT = 7, 2
#: Shares of a text's own words among what comes next, and of training words among the rest.
REPEATS, FREQUENT = (0.0, 0.05, 0.3), (0.02, 0.3)
#: Words of a block whose mixture is worked out at a time, about.
SLICE = 60_000
#: Partial sums of the weights' steps meet in so many tasks.
SUMS = 16
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A-Z lower-cased, white space as blanks.
PLAIN = bytes(0x20 if chr(i) in " \t\n\v\f\r" else i for i in range(256)).lower()
#: What stands before a text.
PAD = b"\n" * ORDERS


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def coded(text: str | None) -> bytes:
    """A text's bytes: its words with a blank behind each, and an end. No coded text begins another."""
    data = (text or "").encode("utf-8", "replace").translate(PLAIN).strip(b" ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data + b" \n" if data else b"\n"


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of coded texts, each with its pad before it, and which bytes are the texts' own."""
    flat = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), np.uint8)
    own = np.ones(len(flat), bool)
    starts = np.cumsum([0] + [len(t) + ORDERS for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    for k in range(ORDERS):
        own[starts + k] = False
    return flat, own


class Runs:
    """The different runs of six bytes in flat that end in an own byte: five bytes of context and the byte itself. number: of each own byte, its run's."""

    def __init__(self, flat: np.ndarray, own: np.ndarray, inverse: bool = False, letters: np.ndarray | None = None):
        letters = letters_of(flat) if letters is None else letters
        self.size, rank = len(letters), np.zeros(256, np.uint32)
        rank[letters] = np.arange(self.size)

        def keys() -> Iterator[np.ndarray]:
            for at in range(ORDERS, len(flat), BYTES_AT_A_TIME):
                near = rank[flat[at - ORDERS : at + BYTES_AT_A_TIME]]
                three = near[2:] * np.uint32(self.size)
                three += near[1:-1]
                three *= np.uint32(self.size)
                three += near[:-2]
                # the last byte counts most, so that runs with common endings are neighbours
                key = three[3:].astype(np.uint64)
                key *= np.uint64(self.size**3)
                key += three[:-3]
                yield key[own[at : at + BYTES_AT_A_TIME]]

        if inverse:
            self.key, self.number = _numbered(np.concatenate([np.zeros(0, np.uint64), *keys()]), self.size ** (ORDERS + 1))
        else:
            self.key, self.times = _counted(keys())
        #: Bytes of the runs, the last one first.
        self.bytes = [letters[(self.key // np.uint64(self.size ** (ORDERS - j)) % np.uint64(self.size)).astype(np.int64)].astype(np.uint8) for j in range(ORDERS + 1)]

    def __len__(self) -> int:
        return len(self.key)

    def shorter(self, k: int) -> Runs:
        """The runs of the last byte and k + 1 before it."""
        out = object.__new__(Runs)
        out.size, out.key = self.size, self.key // np.uint64(self.size ** (ORDERS - 1 - k))
        starts = np.flatnonzero(changes(out.key))
        out.times = np.add.reduceat(self.times, starts) if len(starts) else self.times
        out.key, out.bytes = out.key[starts], [b[starts] for b in self.bytes]
        return out

    def pieces(self, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of all or the chosen runs, some runs' numbers and, a row for each, the bits of a part of their last bytes' codes and the nodes that stand for the bits before."""
        chosen = np.arange(len(self)) if chosen is None else chosen
        for at in range(0, len(chosen), AT_A_TIME):
            rows = chosen[at : at + AT_A_TIME]
            last = self.bytes[0][rows].astype(np.int64)
            head = HEAD[last]
            yield rows, *_bits(head, HEAD_BITS, 0)
            rare = np.flatnonzero(head >= len(FREQUENT_BYTES))
            if len(rare):
                yield rows[rare], *_bits(last[rare] & 63, TAIL_BITS, 64 + ((last[rare] >> TAIL_BITS) << TAIL_BITS)[:, None])

    def slots(self, rows: np.ndarray, nodes: np.ndarray, orders: range) -> list[np.ndarray]:
        """The slots that the predictors of these orders have for the bits of a piece."""
        out, context, spread = [], np.zeros(len(rows), np.uint64), nodes.astype(np.uint64) * _MORE
        for k, bits in enumerate(SLOT_BITS[: orders.stop]):
            context = context * np.uint64(521) + self.bytes[k + 1][rows] + np.uint64(1)
            if k in orders:
                mixed = (context + np.uint64(k)) * _ODD
                mixed = (mixed ^ (mixed >> np.uint64(29)))[:, None] + spread
                mixed ^= mixed >> np.uint64(31)
                mixed *= _ODD
                out.append((mixed >> np.uint64(64 - bits)).astype(np.int64).ravel())
        return out


def letters_of(flat: np.ndarray) -> np.ndarray:
    found = np.zeros(256, bool)
    for at in range(0, len(flat), BYTES_AT_A_TIME):
        found |= np.bincount(flat[at : at + BYTES_AT_A_TIME], minlength=256) > 0
    return np.flatnonzero(found)


def _numbered(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and each one's place among them; keys are below most, and are overwritten."""
    shift = max(1, int(len(key)).bit_length())
    if most << shift >= 1 << 64:
        return np.unique(key, return_inverse=True)
    key <<= np.uint64(shift)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    place = (key & np.uint64((1 << shift) - 1)).astype(np.int32)
    key >>= np.uint64(shift)
    new = changes(key)
    number = np.empty(len(key), np.int32)
    number[place] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], number


def _counted(keys: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each comes. Some are counted at a time, and are fewer when they are put together."""
    found = []
    for some in itertools.batched(keys, 8):
        key = np.concatenate(some)
        key.sort()
        starts = np.flatnonzero(changes(key))
        found.append((key[starts], np.diff(starts, append=len(key)).astype(np.float64)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0)
    key, times = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key)
    key, times = key[order], times[order]
    starts = np.flatnonzero(changes(key))
    return key[starts], np.add.reduceat(times, starts) if len(starts) else times


def changes(key: np.ndarray) -> np.ndarray:
    """Where sorted keys are others than before."""
    return np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])


#: A byte's code: five bits for the letters, the blank and the end; for others one of four more such codes, which has its two high bits, and six more bits.
FREQUENT_BYTES, HEAD_BITS, TAIL_BITS = b"abcdefghijklmnopqrstuvwxyz \n", 5, 6
HEAD = len(FREQUENT_BYTES) + (np.arange(256) >> TAIL_BITS)
HEAD[np.frombuffer(FREQUENT_BYTES, np.uint8)] = np.arange(len(FREQUENT_BYTES))


def _bits(code: np.ndarray, width: int, lead: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    places = np.arange(width)
    return (code[:, None] >> (width - 1 - places)) & 1, lead + ((1 << places) | (code[:, None] >> (width - places)))


def _decoded() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By slot code, the log-odds and what was seen; and the same by bit and code as if the bit itself had come once less."""
    code = np.arange(1 << 16)
    zero, one = np.exp2((code & 255) / 8) - 1, np.exp2((code >> 8) / 8) - 1

    def both(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.where(zero + one < 0.5, 0, np.where(np.minimum(zero, one) < 0.5, 1, 2))
        return np.log((one + PRIOR) / (zero + PRIOR)).astype(np.float32), seen.astype(np.uint8)

    less = [both(np.maximum(zero - (bit == 0), 0), np.maximum(one - (bit == 1), 0)) for bit in (0, 1)]
    return *both(zero, one), np.concatenate([x[0] for x in less]), np.concatenate([x[1] for x in less])


ODDS, SEEN, ODDS_LESS, SEEN_LESS = _decoded()


def flat_map() -> np.ndarray:
    """The map that changes nothing."""
    return np.tile(1 / (1 + np.exp(-np.linspace(-REACH, REACH, LEVELS))), (GATES, 1))


def first_weights() -> np.ndarray:
    weights = np.full((GATES, INPUTS), 0.3)
    weights[:, -1] = 0
    return weights


class Known:
    """Prices of runs in the order of their keys, which are made of the letters in flat."""

    def __init__(self, flat: np.ndarray):
        self.letters = letters_of(flat)
        self.key, self.price = np.zeros(0, np.uint64), np.zeros(0, np.float32)


class Model:
    """Tables, weights and map."""

    def __init__(self, parts: list[tuple[int, bytes]], weights: np.ndarray, refined: np.ndarray):
        self.weights, self.refined = weights.astype(np.float32), refined.astype(np.float32)
        self.tables = [np.zeros(1 << b, "<u2") for b in SLOT_BITS]
        unpack = zstandard.ZstdDecompressor()
        for name, part in parts:
            table, at = self.tables[name >> 16].view(np.uint8), (name & 0xFFFF) << 16
            table[at : at + (1 << 16)] = np.frombuffer(unpack.decompress(part), np.uint8)[: len(table)]

    def inputs(self, runs: Runs, rows: np.ndarray, ones: np.ndarray, nodes: np.ndarray, less: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds by predictor, with a bias, and the gate, of a piece's bits. less: as if each bit weren't in the counts."""
        x = np.empty((INPUTS, ones.size), np.float32)
        x[-1] = 0.3
        gate = np.repeat((runs.bytes[1][rows] <= 0x20).astype(np.int64), ones.shape[1])
        for k, own in enumerate(runs.slots(rows, nodes, range(ORDERS))):
            code = self.tables[k][own].astype(np.int64)
            if less:
                code += ones.ravel() << 16
            x[k] = (ODDS_LESS if less else ODDS)[code]
            if k >= ORDERS - 3:
                gate *= 3
                gate += (SEEN_LESS if less else SEEN)[code]
        return x, gate

    def predict(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of a one, mixed and refined; the mixed one; and its log-odds."""
        odds = np.zeros(len(gate), np.float32)
        for k in range(INPUTS):
            odds += x[k] * self.weights[:, k][gate]
        np.clip(odds, -18, 18, out=odds)
        p = 1 / (1 + np.exp(-odds))
        at = np.clip((odds + REACH) * ((LEVELS - 1) / (2 * REACH)), 0, LEVELS - 1.001)
        low = at.astype(np.int64)
        at -= low
        cell = gate * LEVELS + low
        table = self.refined.ravel()
        mapped = table[cell] * (1 - at) + table[cell + 1] * at
        return np.clip(np.where(np.abs(odds) < REACH, (p + 3 * mapped) / 4, p), 1e-6, 1 - 1e-6), p, odds

    def prices(self, flat: np.ndarray, own: np.ndarray, known: Known | None = None) -> np.ndarray:
        """Natural logarithms of the own bytes' probabilities. known: prices that are there already, to which new ones are added."""
        known, out, end = known or Known(flat), np.empty(np.count_nonzero(own[ORDERS:]), np.float32), 0
        for at in range(ORDERS, len(flat), PRICE_BYTES):
            part = slice(at - ORDERS, at + PRICE_BYTES)
            runs = Runs(flat[part], own[part], inverse=True, letters=known.letters)
            place = np.searchsorted(known.key, runs.key)
            new = np.flatnonzero(known.key[np.minimum(place, len(known.key) - 1)] != runs.key) if len(known.key) else np.arange(len(runs))
            price = np.zeros(len(runs), np.float32)
            for rows, ones, nodes in runs.pieces(new):
                p, _, _ = self.predict(*self.inputs(runs, rows, ones, nodes, less=False))
                price[rows] += np.log(np.where(ones.ravel(), p, 1 - p)).reshape(ones.shape).sum(axis=1)
            old = np.ones(len(runs), bool)
            old[new] = False
            price[old] = known.price[place[old]]
            if len(known.key) + len(new) > KNOWN_RUNS:
                known.key, known.price = runs.key, price
            else:
                known.key, known.price = np.insert(known.key, place[new], runs.key[new]), np.insert(known.price, place[new], price[new])
            out[end : end + len(runs.number)] = price[runs.number]
            end += len(runs.number)
        return out

    def step(self, runs: Runs) -> np.ndarray:
        """Sums over bits: by gate, the curvature and the slope of the loss in the weights; by gate and level, the ones and all. In one array."""
        curve, slope, seen = np.zeros((GATES, INPUTS, INPUTS)), np.zeros((GATES, INPUTS)), np.zeros((2, GATES * LEVELS))
        for rows, ones, nodes in runs.pieces():
            x, gate = self.inputs(runs, rows, ones, nodes, less=True)
            _, p, odds = self.predict(x, gate)
            one, times = ones.ravel(), np.repeat(runs.times[rows], ones.shape[1])
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            ends = np.cumsum(np.bincount(gate, minlength=GATES))
            error, bend = ((p - one) * times).astype(np.float32), (p * (1 - p) * times).astype(np.float32)
            for g in np.flatnonzero(np.diff(ends, prepend=0)):
                chosen = order[ends[g - 1] if g else 0 : ends[g]]
                own = x[:, chosen]
                curve[g] += (own * bend[chosen]) @ own.T
                slope[g] += own @ error[chosen]
            level = np.clip(np.round((odds + REACH) * ((LEVELS - 1) / (2 * REACH))), 0, LEVELS - 1).astype(np.int64)
            cell = gate * LEVELS + level
            seen[0] += np.bincount(cell, one * times, minlength=GATES * LEVELS)
            seen[1] += np.bincount(cell, times, minlength=GATES * LEVELS)
        return np.concatenate([curve.ravel(), slope.ravel(), seen.ravel()])


def stepped(weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after a Newton step, and what the step's sums say of the map: ones and all, by gate and level."""
    n = GATES * INPUTS
    curve, slope = sums[: n * INPUTS].reshape(GATES, INPUTS, INPUTS), sums[n * INPUTS :][:n].reshape(GATES, INPUTS)
    move = np.linalg.solve(curve + RIDGE * np.eye(INPUTS), slope[..., None])[..., 0]
    return weights - np.clip(move, -1, 1), sums[n * INPUTS + n :].reshape(2, GATES, LEVELS)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    """The runs of a task's texts, by LEARN_BYTES; a long text comes in segments."""
    texts, held = [], 0
    for batch in batches:
        for t in batch.column(0):
            data = coded(t.as_py())
            for at in range(0, len(data), LEARN_BYTES):
                texts.append((data[max(0, at - ORDERS) : at + LEARN_BYTES], min(at, ORDERS)))
                held += len(texts[-1][0])
                if held >= LEARN_BYTES:
                    runs = _segments(texts)
                    texts, held = [], 0
                    yield runs
                    del runs  # else it stays while the next ones are made
    if texts:
        yield _segments(texts)


def _segments(texts: list[tuple[bytes, int]]) -> Runs:
    """The runs of segments, of which the first bytes, as many as stand beside them, are context alone."""
    flat, own = laid_out([t for t, _ in texts])
    start = ORDERS
    for data, lead in texts:
        own[start : start + lead] = False
        start += len(data) + ORDERS
    return Runs(flat, own)


def count_contexts(texts: DataFrame) -> list[tuple[int, bytes]]:
    """Chunks of the predictors' tables, compressed: for each slot how often a zero and a one came in the column text, on a scale of logarithms. No more than two bytes a slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _runs_of(batches):
            for k in range(ORDERS):
                own, end = runs.shorter(k), 0
                found = np.empty(len(own) * HEAD_BITS + np.count_nonzero(HEAD[own.bytes[0]] >= len(FREQUENT_BYTES)) * TAIL_BITS, np.int64)
                for rows, ones, nodes in own.pieces():
                    times = np.repeat(own.times[rows].astype(np.int64), ones.shape[1])
                    found[end : end + len(times)] = (own.slots(rows, nodes, range(k, k + 1))[0] * 2 + ones.ravel()) << 32 | times
                    end += len(times)
                found.sort()
                slots = found >> 32
                starts = np.flatnonzero(changes(slots))
                slots = slots[starts]
                found &= 0xFFFFFFFF
                yield count_parts(slots, np.add.reduceat(found, starts), k) if len(starts) else count_parts(slots, slots, k)
                del own, found, slots, starts
            del runs
        give_back()

    rows = texts.mapInArrow(count, "chunk long, part binary")
    return sorted((r.chunk, bytes(r.part)) for r in sum_parts(rows).toLocalIterator())


def learn(texts: DataFrame, parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map from the columns id and text, a step for each part of the texts."""
    spark = texts.sparkSession
    weights, seen = first_weights(), np.zeros((2, GATES, LEVELS))
    shared = spark.sparkContext.broadcast(parts)
    for part in range(PARTS):
        now = weights

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            model, sums = None, None
            for runs in _runs_of(batches):
                model = model or Model(shared.value, now, flat_map())
                found = model.step(runs)
                sums = found if sums is None else sums + found
                del runs
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["at", "sums"])
            del model
            give_back()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for b in batch.column(1):
                    found = np.frombuffer(b.as_buffer())
                    sums = found if sums is None else sums + found
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        chosen = texts.where(F.pmod(F.xxhash64("id"), F.lit(PARTS)) == part).select("text")
        rows = chosen.mapInArrow(run, "at int, sums binary").repartition(SUMS, "at").mapInArrow(add, "sums binary").collect()
        if rows:
            weights, came = stepped(weights, np.sum([np.frombuffer(r.sums) for r in rows], axis=0))
            seen = seen * 0.1 + came  # what old weights predicted counts for little
    return weights, (seen[0] + 20 * flat_map()) / (seen[1] + 20)


NARROW = (pa.int64(), pa.int32(), pa.int64(), pa.int16(), pa.int64())


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of two kinds. A block's words: block, idx, high and low, 80 bits of hash that stand for the word in joins, and n, the word's count in
    training texts. Its texts: idx -1, doc_ids, held_out, sizes, bytes, tokens, and the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, pack, kind = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1), pa.null()
        names = ["block", "idx", "high", "low", "n", "doc_ids", "held_out", "sizes", "bytes", "tokens", "words"]
        numbered = lambda: defaultdict(itertools.count().__next__)
        place, ids, tests, sizes, lengths, tokens, learned = numbered(), [], [], [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            n, words = len(place), list(place)
            own = [t for t, x in zip(tokens, learned, strict=True) if x]
            counts = np.bincount(np.concatenate(own), minlength=n) if own else np.zeros(n, np.int64)
            hashes = np.frombuffer(b"".join(map(xxhash.xxh128_digest, words)), [("high", "<i8"), ("low", "<i2"), ("rest", "V6")])
            types = (*NARROW, pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            narrow = (np.full(n, block), np.arange(n, dtype=np.int32), hashes["high"], hashes["low"], counts)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x), t) for x, t in zip(narrow, NARROW, strict=True)), *(pa.nulls(n, t) for t in types[5:])], names=names)
            texts = (block, -1, None, None, None, ids, tests, sizes, lengths, pack.compress(np.concatenate(tokens).tobytes()), pack.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(texts, types, strict=True)], names=names)

        held = size = 0
        for batch in batches:
            kind = batch.column(0).type
            for i, rest, t in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(t.as_py())
                words.append(b"")
                new = len(words)
                if ids and (held + new > BLOCK_TOKENS or size > BLOCK_BYTES):
                    yield from flush()
                    block, place = block + 1, numbered()
                    ids, tests, sizes, lengths, tokens, learned = [], [], [], [], [], []
                    held = size = 0
                tokens.append(np.fromiter(map(place.__getitem__, words), np.int32, new))
                ids.append(i.as_py())
                tests.append(rest == HELD_OUT)
                learned.append(rest is not None and rest != HELD_OUT)
                sizes.append(new)
                lengths.append(len(b"".join(words)) + new)
                held, size = held + new, size + lengths[-1]
        if ids:
            yield from flush()
        del place, tokens
        give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), crc_mod(doc_id, MODULUS).alias("rest"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, idx int, high long, low smallint, n long, doc_ids array<{kind}>, held_out array<boolean>, sizes array<int>, bytes array<long>, tokens binary, words binary"
    return rows.mapInArrow(run, schema)


class Words:
    """Words of a block, joined by blanks, as they are coded: each with its blank, or the end. A pad follows them as one word more."""

    def __init__(self, joined: bytes):
        self.data = np.frombuffer(joined + b" " + PAD, np.uint8).copy()
        ends = np.flatnonzero(self.data == 0x20) + 1
        self.starts = np.concatenate([[0], ends])
        self.widths = np.diff(self.starts, append=len(self.data))
        self.data[self.starts[:-1][self.widths[:-1] == 1]] = 0x0A

    def laid_out(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As laid_out gives them, the texts of so many of these words each."""
        pad = len(self.widths) - 1
        words = np.insert(tokens, np.cumsum(sizes) - sizes, pad)
        widths = self.widths[words]
        ends, first = np.cumsum(widths), 0
        flat = np.empty(widths.sum(), np.uint8)
        while first < len(words):
            begin = int(ends[first] - widths[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + BYTES_AT_A_TIME, "right")))
            if last == first + 1:
                flat[begin : ends[first]] = self.data[self.starts[words[first]] :][: widths[first]]
            else:
                cut = slice(first, last)
                place = np.repeat(self.starts[words[cut]] - (ends[cut] - widths[cut] - begin), widths[cut])
                place += np.arange(len(place))
                flat[begin : ends[last - 1]] = self.data[place]
            first = last
        return flat, np.repeat(words != pad, widths)


def mixed(tokens: np.ndarray, sizes: np.ndarray, price: np.ndarray, often: np.ndarray) -> np.ndarray:
    """log10 of each text's probability. tokens: numbers of the words of all texts, one after the other; price: natural logarithm of each as spelled; often: each one's frequency in training."""
    out, ends, first = [], np.cumsum(sizes), 0
    while first < len(sizes):
        base = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        cut = slice(base, int(ends[last - 1]))
        part, n = tokens[cut], int(ends[last - 1]) - base
        begins = (ends[first:last] - sizes[first:last] - base).astype(np.int64)
        text = np.repeat(np.arange(last - first), sizes[first:last])
        place = np.arange(n) - begins[text]
        # how often the word came before in its text
        key = text.astype(np.int64) * (int(part.max()) + 1) + part
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        seen = np.empty(n, np.int64)
        seen[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        own = seen / np.maximum(place, 1)
        spelled, sums = np.exp(price[cut].astype(np.float64)), []
        for f in FREQUENT:
            plain = np.maximum((1 - f) * spelled + f * often[cut], 1e-300)
            for r in REPEATS:
                sums.append(np.add.reduceat(np.log(np.where(place == 0, plain, (1 - r) * plain + r * own)), begins))
        sums = np.stack(sums)
        high = sums.max(axis=0)
        out.append((high + np.log(np.exp(sums - high).mean(axis=0))) / math.log(10))
        first = last
    return np.concatenate(out) if out else np.zeros(0)


def scored(words: pa.Table, texts: pa.Table, model: Model, n_train: int, n_types: int) -> pa.Table:
    """A block's texts, whose words are as many as the block's size allows; their bytes are laid out by PRICE_BYTES. n_train, n_types: all and different training words."""
    unpack, column_of = zstandard.ZstdDecompressor(), lambda name: texts.column(name).combine_chunks()
    c, base = np.empty(words.num_rows, np.int64), math.log10(n_train + n_types + 1)
    c[words.column("idx").to_numpy()] = words.column("c").to_numpy()
    words_in, logs, often = Words(unpack.decompress(column_of("words")[0].as_py())), np.log10(c + 1.0) - base, c / max(n_train, 1)
    flat = np.frombuffer(unpack.decompress(column_of("tokens")[0].as_py()), np.int32)
    sizes, lengths = (np.asarray(column_of(x).flatten()).astype(np.int64) for x in ("sizes", "bytes"))
    at, known, sums = np.concatenate([[0], np.cumsum(sizes)[:-1]]), Known(words_in.data), []
    starts = np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum(), PRICE_BYTES), "right")
    for part in np.split(np.arange(len(sizes)), np.unique(starts)[1:]):  # texts of about PRICE_BYTES
        tokens, begins = flat[at[part[0]] : at[part[-1]] + sizes[part[-1]]], at[part] - at[part[0]]
        widths = words_in.widths[tokens]
        price = np.add.reduceat(model.prices(*words_in.laid_out(tokens, sizes[part]), known), np.cumsum(widths) - widths, dtype=np.float64)
        sums.append((np.add.reduceat((c > 0)[tokens].astype(np.int64), begins), np.add.reduceat(logs[tokens], begins), mixed(tokens, sizes[part], price, often[tokens])))
    n_known, plain, total = (np.concatenate(x) for x in zip(*sums, strict=True))
    columns = [column_of("doc_ids").flatten(), column_of("held_out").flatten(), sizes, n_known]
    columns += [np.full(len(sizes), n_train, np.int64), plain, total, -total * math.log2(10) / lengths]
    return pa.Table.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each document.

    base_score: log10 of the words' smoothed frequencies; score: log10 of the model's probability of the text, its words with their ends and its own end.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    trained = docs.where(crc_mod(doc_id, MODULUS) != HELD_OUT).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    parts = count_contexts(trained.select("text"))
    tidy(spark, TOLD_AFTER)  # else a step's shuffle stays on disk beside the next ones' until the driver happens to collect its garbage
    model = spark.sparkContext.broadcast((parts, *learn(trained, parts)))
    blocks = stored(_blocks(docs, doc_id, text), "blocks")
    words = blocks.where("idx >= 0").select("block", "idx", "high", "low", "n")
    counted = stored(words.groupBy("high", "low").agg(F.sum("n").alias("c")), "words")
    tidy(spark, TOLD_AFTER)
    n_train, n_types = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    # stored, so that what the join shuffles is gone when the blocks are shuffled
    known = stored(words.drop("n").join(counted, ["high", "low"]).select("block", "idx", "c"), "known")
    tidy(spark, TOLD_AFTER)
    kept = blocks.where("idx < 0").select(F.col("block").alias("of"), *blocks.columns[5:])
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def add_up(words: pa.Table, texts: pa.Table) -> pa.Table:
        out = scored(words, texts, Model(*model.value), n_train, n_types)
        give_back()
        return out

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return known.groupBy("block").cogroup(kept.groupBy("of")).applyInArrow(add_up, schema)
