"""BPE with word ends, cut first where no merge can reach.

Every token that merging makes stands in the vocabulary, with all pairs of neighbouring bytes inside it. A pair of bytes that occurs inside no token is
therefore a certain border: no merge ever spans it. A piece of text is cut at all such pairs, the fragments are merged for themselves, each different one once,
and what comes out is put together in order. A word's last byte is another symbol than the same byte elsewhere, so its pairs count apart.

The file's own normalizer and splitter make the pieces. As both drop white space, words between ASCII white space encode for themselves, and each different word
of a batch is looked at once. Words of Latin letters, digits and signs alone are split together, by the file's own pattern written for these; all others go through its
normalizer and splitter. Special tokens are found before, as they stand in the text.

Edge cases: a null text is empty and has no tokens. There is a row for each input row, repeated or not; an empty table gives an empty one. Extra columns are left
out. A fragment of n symbols takes n log n steps and some 60 bytes a symbol.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import small_batches, text_batches

#: Words, pieces and fragments that a worker keeps, of each at most.
CACHE = 300_000
#: Symbols of a fragment that is kept, and letters of a word or piece, at most.
SHORT = 100
AT_A_TIME = 4 << 20
#: The normalizer and splitter by which words of LATIN letters, digits and SIGNS split as ``together`` does; with others, every word goes through them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that are their own NFC and whose lower case is among them, where U+0130 becomes two characters.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Printable ASCII signs but for apostrophes, which begin contractions, and what special tokens begin with.
SIGNS = "!-&(-/:;=-@\\[-`{-~"
#: Marks before a piece: it's spelled a letter for each byte, or a special token.
SPELLED, SPECIAL = "\x00", "\x01"


class Vocabulary:
    """A tokenizers file's tokens, merges and certain borders."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], told["added_tokens"]
        unknown = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)] + [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        unknown += ["decoder"] * (told.get("decoder") is not None) + ["added token"] * any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        if model["type"] != "BPE" or unknown:
            raise ValueError(f"not a plain file of BPE: {model['type']}, {', '.join(unknown)}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.id_of: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = {i: t for t, i in [*self.id_of.items(), *self.special.items()]}
        #: The rank of two tokens' merge and the token made, as one number.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.id_of[a], self.id_of[b]] = rank << 32 | self.id_of[a + b]
        #: Pairs of neighbouring symbols inside tokens; all others are borders.
        self.inside = {p for t in self.id_of for s in [self.symbols(t.removesuffix(self.suffix) if self.suffix and t.endswith(self.suffix) else t, t.endswith(self.suffix))] for p in zip(s, s[1:], strict=False)}
        self.tokenizer = Tokenizer.from_file(path)
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        splits = steps[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        bare = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        #: Whether words of LATIN letters, digits and SIGNS can be split together.
        self.together = told["normalizer"] == NORMALIZER and splits and steps[1:] == [bare] and all(t.startswith("<") for t in self.special)
        self.letters = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
        self.letters |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in self.letters)}  # the other bytes' letters, in order

    def symbols(self, piece: str, last: bool = True) -> list[int]:
        """The ids of a piece's bytes; last: whether its end is a word's."""
        if not piece:
            return []
        found = list(map(self.id_of.__getitem__, piece))
        if last and self.suffix:
            found[-1] = self.id_of[piece[-1] + self.suffix]
        return found

    def pieces(self, text: str) -> list[str]:
        """What the file's normalizer and splitter make of a text, a letter for each byte."""
        t = self.tokenizer
        if t.normalizer is not None:
            text = t.normalizer.normalize_str(text)
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer is not None else [text]

    def fragments(self, symbols: Sequence[int]) -> Iterator[tuple[int, ...]]:
        """symbols, cut at all certain borders."""
        start, inside = 0, self.inside
        for at, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1):
            if pair not in inside:
                yield tuple(symbols[start:at])
                start = at
        if start < len(symbols):
            yield tuple(symbols[start:])

    def merged(self, symbols: Sequence[int]) -> list[int]:
        """A fragment's tokens: the pair of the lowest rank is merged first, of equal ones the leftmost."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        parts, merge, none = list(symbols), self.merges.get, 1 << 62
        waiting = [merge(p, none) for p in zip(parts, parts[1:], strict=False)]
        while waiting:
            first = min(waiting)
            if first == none:
                break
            i = waiting.index(first)
            parts[i : i + 2] = [first & 0xFFFFFFFF]
            del waiting[i]
            if i:
                waiting[i - 1] = merge((parts[i - 1], parts[i]), none)
            if i < len(waiting):
                waiting[i] = merge((parts[i], parts[i + 1]), none)
        return parts

    def _merged_long(self, symbols: Sequence[int]) -> list[int]:
        n, merge = len(symbols), self.merges.get
        ids, after, before = array("i", symbols), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        # a pair waits as its rank and place in one number
        waiting = [(found >> 32) * n + i for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (found := merge(p)) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = divmod(heapq.heappop(waiting), n)
            j = after[i]
            found = merge((ids[i], ids[j])) if ids[i] >= 0 and j < n else None
            if found is None or found >> 32 != rank:
                continue  # what stood here is merged already
            ids[i], ids[j], after[i] = found & 0xFFFFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                right = merge((ids[i], ids[after[i]]))
                if right is not None:
                    heapq.heappush(waiting, (right >> 32) * n + i)
            if before[i] >= 0:
                left = merge((ids[before[i]], ids[i]))
                if left is not None:
                    heapq.heappush(waiting, (left >> 32) * n + before[i])
        return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.known: dict[tuple[int, ...], tuple[int, ...]] = {}
        #: Of a word that isn't split together with others, its pieces joined by blanks.
        self.words: dict[str, str] = {}
        #: Of a piece, how many ids it has, these as decimals, and their tokens.
        self.pieces: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def _keep(held: dict, key, value, size: int) -> None:
        if size <= SHORT:
            if len(held) >= CACHE:
                held.clear()
            held[key] = value

    def fragment(self, symbols: tuple[int, ...]) -> Sequence[int]:
        found = self.known.get(symbols)
        if found is None:
            found = tuple(self.vocabulary.merged(symbols)) if len(symbols) > 1 else symbols
            self._keep(self.known, symbols, found, len(symbols))
        return found

    def split(self, text: str) -> list[str]:
        """A text's pieces by the file's rules, with their marks."""
        parts = self.special.split(text) if self.special else [text]
        return [x for k, part in enumerate(parts) for x in ([SPECIAL + part] if k % 2 else [SPELLED + p for p in self.vocabulary.pieces(part)] if part else [])]

    def piece(self, piece: str) -> list[int]:
        """A piece's ids: of its fragments, one after the other."""
        v = self.vocabulary
        if piece[:1] == SPECIAL:
            return [v.special[piece[1:]]]
        spelled = piece[1:] if piece[:1] == SPELLED else piece if piece.isascii() else "".join(map(v.letters.__getitem__, piece.encode()))
        return [i for f in v.fragments(v.symbols(spelled)) for i in self.fragment(f)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        return [i for p in self.split(text or "") for i in self.piece(p)]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ids as they stand in the file, which has no rule to undo its pieces."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))

    def _word(self, word: str) -> str:
        found = self.words.get(word)
        if found is None:
            found = " ".join(self.split(word))
            self._keep(self.words, word, found, len(word))
        return found

    def _piece(self, piece: str) -> tuple[int, str, str]:
        found = self.pieces.get(piece)
        if found is None:
            ids = self.piece(piece)
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            self._keep(self.pieces, piece, found, len(piece))
        return found

    def words_of(self, words: pa.Array) -> pa.Array:
        """The pieces of each word, as lists."""
        plain = pc.match_substring_regex(words, f"^[{LATIN}0-9{SIGNS}]*$") if self.vocabulary.together else pa.array(np.zeros(len(words), bool))
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), f"([{LATIN}]+|[0-9]|[{SIGNS}]+)", "\\1 ")
        others = pc.filter(words, pc.invert(plain)).to_pylist()
        return pc.split_pattern(pc.replace_with_mask(spaced, pc.invert(plain), pa.array(list(map(self._word, others)), pa.string())), " ")

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text the number of ids, these as decimals, and their tokens, both joined by spaces. A null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = pc.dictionary_encode(split.flatten())
        of_words = self.words_of(words.dictionary)
        pieces = pc.dictionary_encode(of_words.flatten())
        found = list(map(self._piece, pieces.dictionary.to_pylist()))
        # pieces of each word, then of each text
        by_word = pa.ListArray.from_arrays(pa.array(_ends(pc.list_value_length(of_words).to_numpy()), pa.int32()), pieces.indices)
        indices = by_word.take(words.indices).flatten().to_numpy()
        ends = _ends(pc.list_value_length(by_word).to_numpy()[words.indices.to_numpy()])[_ends(pc.list_value_length(split).to_numpy())]
        sizes = np.fromiter((f[0] for f in found), np.int64, len(found))[indices]
        some = np.flatnonzero(sizes)  # the others join nothing
        offsets, taken = pa.array(np.searchsorted(some, ends).astype(np.int32)), pa.array(indices[some])
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([f[k] for f in found], pa.string()).take(taken)), " ") for k in (1, 2)]
        return np.diff(_ends(sizes)[ends]), *joined


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task. The file is installed on every machine."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): of whole texts; ids is an array and can be left out."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def digests(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in rows:
            for batch in text_batches(whole, "text", AT_A_TIME):
                sizes, decimals, decoded = bpe.texts(batch.column(1))
                columns = [batch.column(0), pa.array(sizes, pa.int64()), digests(decimals), digests(decoded)]
                if ids:
                    flat = np.array([x for d in decimals.to_pylist() if d for x in d.split(" ")], np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id), F.col(text).alias("text")).mapInArrow(run, schema)
