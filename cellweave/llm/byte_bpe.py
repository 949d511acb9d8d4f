"""Byte-level BPE by dynamic programming over prefixes.

In a correct encoding every prefix of the bytes has one valid last token: the token that ends there
and may follow the last token before it. Storing it for each prefix gives the encoding of any
prefix by walking back, exact appends in time that doesn't depend on what is there, and re-encoding after an edit
from the first changed byte on until the stored tokens meet the old ones again.

Two tokens may stand side by side if byte-pair merging would leave them apart: undoing their
merges step by step, no merge across the border comes before those that made them.

Edge cases: a null text is empty and has no tokens. The result has a row for each input row,
repeated or not; an empty table gives an empty one. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import give_back, small_batches, text_batches

#: Pieces that a worker keeps with their ids, at most.
CACHE = 400_000
AT_A_TIME = 3 << 20


class Vocabulary:
    """Tokens by id with the pair of tokens that merges into each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        for token, i in ranks.items():
            parts = self._merge(token, i)
            if len(parts) == 2:
                self.halves[i] = (ranks[parts[0]], ranks[parts[1]])
        #: Tokens that merging can make; the others only stand for a whole piece.
        self.made = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.halves}
        #: What is known of two tokens side by side, by left << 32 | right.
        self.apart: dict[int, bool] = {}

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """The parts that merges of lower rank leave of a token."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens as it is."""
        known = self.apart.get(left << 32 | right)
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[left << 32 | right] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        """Undo the later merge on either side, again and again; a merge across the border must come after the last one undone.

        Of equal ranks, the leftmost merge comes first.
        """
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        a, b = left, right
        limit, ties = 1 << 62, False  # merges across the border of this rank or more come too late; of just this rank, if ties, too
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and (across < limit or ties and across == limit):
                return False
            x, y = halves.get(a), halves.get(b)
            if x is None and y is None:
                return True
            # the last merge made within the two: that of the higher rank, on a tie the right one
            if y is None or (x is not None and a > b):
                limit, ties, a = a, False, x[1]
            else:
                limit, ties, b = b, True, y[0]


class Prefixes:
    """A piece's bytes with the unique valid last token of each prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes; what is stored for the earlier prefixes stays."""
        start = len(self.data)
        self.data += data
        self._fill(start, len(self.data))

    def cut(self, stop: int) -> None:
        """Keep the first bytes only."""
        del self.data[stop:], self.last[stop:]

    def _fill(self, start: int, end: int) -> None:
        v, last = self.vocabulary, self.last
        made, may, longest, known = v.made.get, v.may_follow, v.longest, v.apart.get
        base = max(0, start + 1 - longest)
        data = bytes(self.data[base:end])
        for stop in range(start + 1, end + 1):
            for begin in range(max(0, stop - longest), stop):
                token = made(data[begin - base : stop - base])
                if token is None:
                    continue
                if begin:
                    apart = known(last[begin - 1] << 32 | token)
                    if not (may(last[begin - 1], token) if apart is None else apart):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks single bytes")

    def edit(self, at: int, removed: int, added: bytes) -> int:
        """Replace bytes; the last tokens before ``at`` stay, and those after the edit are taken over
        once a token's length of them in a row comes out the same. Returns how many prefixes were computed anew."""
        old, tail = self.last, bytes(self.data[at + removed :])
        del self.data[at:]
        self.data += added
        self.last = old[:at]
        self._fill(at, len(self.data))
        edited = len(self.data)
        self.data += tail
        shift, same, stop = len(added) - removed, 0, edited
        while stop < len(self.data):
            self._fill(stop, stop + 1)
            stop += 1
            same = same + 1 if self.last[-1] == old[stop - shift - 1] else 0
            # tokens that end here reach back at most their longest length, where all agree
            if same >= self.vocabulary.longest:
                self.last += old[stop - shift :]
                break
        return stop - at

    def ids(self, stop: int | None = None) -> list[int]:
        """The encoding of the first ``stop`` bytes."""
        out, tokens = [], self.vocabulary.tokens
        stop = len(self.data) if stop is None else stop
        while stop:
            out.append(token := self.last[stop - 1])
            stop -= len(tokens[token])
        return out[::-1]


class Encoder:
    """Texts to ids and back; a piece is a match of the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        #: Of a piece, its ids as decimals joined by commas.
        self.known: dict[str, str] = {}
        self.bytes_of = {str(i): t for i, t in enumerate(self.vocabulary.tokens)}

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces; in sorted order, a piece takes over the last tokens of the prefix that it shares with the one before."""
        ranks, known, prefixes = self.vocabulary.ranks, self.known, Prefixes(self.vocabulary)
        before = b""
        for piece in sorted(pieces):
            data = piece.encode("utf-8", "replace")
            whole = ranks.get(data)  # a piece that is a token as a whole is that token
            if whole is None:
                shared = 0
                for x, y in zip(before, data, strict=False):
                    if x != y:
                        break
                    shared += 1
                prefixes.cut(shared)
                prefixes.append(data[shared:])
                before = data
            ids = (whole,) if whole is not None else tuple(prefixes.ids())
            known[piece] = ",".join(map(str, ids))

    def encode_all(self, texts: list[str | None]) -> Iterator[str]:
        """The ids of each text, as decimals joined by commas."""
        split = [self.pieces(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces}
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn(new - self.known.keys())
        look = self.known.__getitem__
        for pieces in split:
            yield ",".join(map(look, pieces))

    def encode(self, text: str | None) -> list[int]:
        decimals = next(self.encode_all([text]))
        return list(map(int, decimals.split(","))) if decimals else []

    def decode(self, ids: Iterable[int | str]) -> bytes:
        """The bytes of ids, as numbers or as decimals."""
        return b"".join([self.bytes_of[str(i)] for i in ids])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder. The vocabulary file is installed on every machine."""
    return Encoder(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): of whole texts; ids is an array and can be left out.

    keep: whether a worker keeps its pieces for its next task. Where it goes on to other work, it should give their memory back."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for whole in rows:
            for batch in text_batches(whole, "text", AT_A_TIME):
                sizes, digests, decoded, lists = [], [], [], []
                for decimals in bpe.encode_all(batch.column(1).to_pylist()):
                    found = decimals.split(",") if decimals else []
                    sizes.append(len(found))
                    digests.append(hashlib.sha256(decimals.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(bpe.bytes_of.__getitem__, found))).hexdigest())
                    lists.append(pa.array(np.array(found, np.int32))) if ids else None
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    offsets = pa.array([0, *accumulate(sizes)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
        if not keep:
            bpe.known.clear()
            bpe.vocabulary.apart.clear()
            give_back()

    return docs.select(F.col(doc_id), F.col(text).alias("text")).mapInArrow(run, schema)
