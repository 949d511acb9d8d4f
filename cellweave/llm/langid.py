"""Language of words and texts by a linear-chain conditional random field.

Every word, a run of letters, gets a label; a longer run than ``LONGEST`` is cut into several words, all of which count, so
clauses of scripts without blanks are read to their ends. Its emission scores come from its affixes, its character n-grams, the
word itself and a lexicon; learned transitions say how labels follow each other, so that a word which several languages share
goes with its neighbours, and a text that switches languages is cut where it switches. Forward-backward gives each
word's label probabilities; a text's language is the label with the largest sum.

The field is trained on at most ``most_docs`` labelled documents (the bound), picked by a hash of their ids with
an equal share for each label, of each a window of ``window`` words. Training sequences switch between windows of
random labels, as code-switched text does. Half of the sample makes the lexicon, the other half is trained on.
All labels are learned; each takes 2 MB of the driver's memory while it is, so they should be languages.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. A null label isn't
learned from, nor is a row with a null doc_id. Repeated rows get equal results; an empty table gives an empty one. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import large_batches, text_batches

MOST_DOCS = 4000
WINDOW = 160
HASH_BITS = 17
CACHE = 400_000
AT_A_TIME = 12 << 20
UNKNOWN = "und"
#: What Python counts to \\w but is neither a letter nor a decimal digit.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: Letters of the longest word.
LONGEST = 40
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; long ones in pieces."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join(" " if c in _NUMBERS else c for c in text)
    return _WORD(text)


def features_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' features, and which word each is of: the word, its length and lexicon entry, beginnings
    and endings of two to five characters with the word's edge counted, and all pairs and triples of characters."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"^{w}$" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    starts, each = ends - sizes, np.arange(len(words))
    owner = np.repeat(each, sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters from here to the word's end
    runs = [chars]
    for k in range(1, 5):  # hashes of runs of two to five characters from each place on
        later = np.zeros_like(chars)
        later[:-k] = chars[k:]
        runs.append(runs[-1] * _NEXT + later)
    hashes, owners = [], []

    def add(kind: int, values: np.ndarray, of: np.ndarray) -> None:
        mixed = (values + np.uint64(kind * 0x51ED27)) * _MIX
        hashes.append(((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        owners.append(of)

    powers = np.cumprod(np.full(LONGEST + 2, _NEXT))
    whole = np.add.reduceat(chars * powers[np.arange(len(chars)) - np.repeat(starts, sizes)], starts)
    add(1, whole, each)
    add(2, np.minimum(sizes, 14).astype(np.uint64), each)
    add(3, np.array([lexicon.get(w, -1) + 1 for w in words], np.uint64), each)
    for k in (2, 3):
        inside = left >= k
        add(2 + k, runs[k - 1][inside], owner[inside])
    for k in range(2, 6):
        long = sizes > k
        add(10 + k, runs[k - 1][starts[long]], each[long])
        add(20 + k, runs[k - 1][ends[long] - k], each[long])
    return np.concatenate(hashes), np.concatenate(owners)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by owner."""
    return np.stack([np.bincount(owner, values[:, c], minlength=n) for c in range(values.shape[1])], axis=1)


class Field:
    """A trained field."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, transitions: np.ndarray, begin: np.ndarray):
        self.labels, self.lexicon, self.weights, self.transitions, self.begin = labels, lexicon, weights, transitions, begin
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.labels)), np.float32)

    def __getstate__(self):
        return self.labels, self.lexicon, self.weights, self.transitions, self.begin

    def __setstate__(self, state):
        self.__init__(*state)

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        """The rows of self.table for all words of all texts, one text after the other."""
        place = self.place
        if len(place) > CACHE:
            self._forget()
            place = self.place
        new = list({w for words in texts for w in words} - place.keys())
        if new:
            start = len(place)
            for i, w in enumerate(new):
                place[w] = start + i
            if len(place) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((len(place), len(self.labels)), np.float32)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                flat, owner = features_of(part, self.lexicon)
                scores = sums_by(owner, self.weights[flat], len(part))
                scores -= scores.max(axis=1, keepdims=True)
                self.table[start + i : start + i + len(part)] = np.exp(np.maximum(scores, -30))
        return np.array([place[w] for words in texts for w in words], np.int64)

    def marginals(self, texts: list[list[str]], each: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums of the words' label probabilities for each text, and on demand those of each word."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1][order] if texts else lengths
        at = self.look_up(texts)  # this may replace the table
        emitted = self.table[at]
        sums, gamma = forward_backward(emitted, begins, lengths, self.transitions, self.begin, each)
        out = np.zeros_like(sums)
        out[order] = sums
        return out, gamma


def forward_backward(emitted: np.ndarray, begins: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of marginals for sequences, longest first; emitted, transitions and begin are potentials.

    A step handles a place of all sequences that are long enough, so the number of steps is the longest length."""
    k = len(begin)
    alpha, sums = np.empty_like(emitted), np.zeros((len(lengths), k), emitted.dtype)
    gamma = np.empty_like(emitted) if each else None
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")
    # active[t]: how many sequences are longer than t
    before = None
    for t in range(longest):
        n = active[t]
        at = begins[:n] + t
        now = emitted[at] * (begin if before is None else before[:n] @ transitions)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
        before = now
    beta, back = np.ones((len(lengths), k), emitted.dtype), transitions.T.copy()
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        both = alpha[at] * beta[:n]
        both /= both.sum(axis=1, keepdims=True)
        sums[:n] += both
        if gamma is not None:
            gamma[at] = both
        next_beta = (emitted[at] * beta[:n]) @ back
        beta[:n] = next_beta / next_beta.sum(axis=1, keepdims=True)
    return sums, gamma


def train(samples: list[tuple[str, list[str]]], labels: list[str], epochs: int = 3, seed: int = 1) -> Field:
    """Learn from windows of words with a label each."""
    rng = np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    counts: Counter = Counter()
    for i, (label, words) in enumerate(samples):
        if i % 2 == 0:
            counts.update((w, place[label]) for w in words)
    by_word: dict[str, list[int]] = {}
    for (w, c), n in counts.items():
        by_word.setdefault(w, [0] * k)[c] += n
    # a word's lexicon entry: the label that has most of it, if it's seen often and mostly there
    lexicon = {w: int(np.argmax(n)) for w, n in by_word.items() if sum(n) >= 3 and max(n) >= 0.6 * sum(n)}
    pools = [[w for i, (label, w) in enumerate(samples) if w and place[label] == c and (i % 2 == 1 or len(samples) < 8)] for c in range(k)]
    pools = [p or [w for label, w in samples if w and place[label] == c] for c, p in enumerate(pools)]
    weights, squares = np.zeros((1 << HASH_BITS, k)), np.full((1 << HASH_BITS, k), 1e-2)
    moves, move_squares = np.zeros((k + 1, k)), np.full((k + 1, k), 1e-2)
    usable = [c for c in range(k) if pools[c]]
    batch, length = 192, 40
    total = sum(len(w) for p in pools for w in p)
    for _ in range(max(30, min(400, epochs * total // (batch * length))) if usable else 0):
        sequences, gold = [], []
        for _ in range(batch):
            words, marks = [], []
            while len(words) < length:
                c = usable[rng.integers(len(usable))]
                window = pools[c][rng.integers(len(pools[c]))]
                n = min(int(rng.geometric(1 / 15)), len(window), length - len(words))
                at = int(rng.integers(len(window) - n + 1))
                words += window[at : at + n]
                marks += [c] * n
            sequences.append(words)
            gold.append(marks)
        types = sorted({w for s in sequences for w in s})
        index = {w: i for i, w in enumerate(types)}
        flat, of = features_of(types, lexicon)
        scores = sums_by(of, weights[flat], len(types))
        potential = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
        at = np.array([index[w] for s in sequences for w in s])
        marks = np.array(gold)
        emitted = potential[at].reshape(batch, length, k)
        step = np.exp(moves)
        # forward-backward with the pairs' marginals
        alpha, beta = np.empty_like(emitted), np.ones_like(emitted)
        for t in range(length):
            alpha[:, t] = emitted[:, t] * (step[k] if t == 0 else alpha[:, t - 1] @ step[:k])
            alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            beta[:, t] = (emitted[:, t + 1] * beta[:, t + 1]) @ step[:k].T
            beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        # a pair's chance is alpha x step x later over their sum, so the sums of all pairs are one product of matrices
        before, later = alpha[:, :-1].reshape(-1, k), (emitted[:, 1:] * beta[:, 1:]).reshape(-1, k)
        pairs = (before / ((before @ step[:k]) * later).sum(axis=1, keepdims=True)).T @ later * step[:k]
        error = gamma.reshape(-1, k).copy()
        error[np.arange(len(error)), marks.ravel()] -= 1
        by_type = sums_by(at, error, len(types))
        touched, inverse = np.unique(flat, return_inverse=True)
        gradient = sums_by(inverse, by_type[of], len(touched)) / batch + 1e-5 * weights[touched]
        squares[touched] += gradient**2
        weights[touched] -= 0.3 * gradient / np.sqrt(squares[touched])
        seen = np.zeros((k + 1, k))
        np.add.at(seen, (marks[:, :-1].ravel(), marks[:, 1:].ravel()), 1)
        np.add.at(seen, (np.full(batch, k), marks[:, 0]), 1)
        expected = np.vstack([pairs, gamma[:, 0].sum(axis=0)[None]])
        change = (expected - seen) / batch + 1e-4 * moves
        move_squares += change**2
        moves -= 0.2 * change / np.sqrt(move_squares)
    step = np.exp(moves - moves.max(axis=1, keepdims=True)).astype(np.float32)
    return Field(labels, lexicon, weights.astype(np.float32), step[:k], step[k])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", most_docs: int = MOST_DOCS, window: int = WINDOW) -> Field | None:
    """Learn from the rows of docs with a label; None if there are none. most_docs and window bound the sample."""
    named = docs.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(F.col(label).cast("string")).count().collect()}
    if not sizes:
        return None
    share = most_docs / len(sizes)
    bar: Column = F.when(F.lit(False), 0)
    for value, n in sizes.items():
        bar = bar.when(F.col(label).cast("string") == value, math.ceil(min(1.0, share / n) * (1 << 20)))
    picked = named.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < bar)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2):
                words = words_of(t.as_py())
                at = zlib.crc32(" ".join(words).encode("utf-8", "replace")) % max(1, len(words) - window + 1)
                out.append(" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.string())], names=["id", "label", "words"])

    taken = picked.select(F.col(doc_id).cast("string"), F.col(label).cast("string"), F.col(text)).mapInArrow(cut, "id string, label string, words string")
    # rows that share an id are picked together, so the bound needs an order of its own
    rows = sorted(taken.orderBy(F.xxhash64("id", "words"), "id", "label", "words").limit(2 * most_docs).collect(), key=lambda r: (zlib.crc32(r[0].encode()), r[1], r[2]))
    return train([(r[1], r[2].split()) for r in rows], sorted(sizes))


def identify(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., lang_pred, score, n_words, n_switches) for whole texts; n_switches counts changes of the most probable label."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    fields = [docs.schema[doc_id], *(docs.schema[c] for c in carry)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, n_words long, n_switches long"
    names = [doc_id, *carry, "lang_pred", "score", "n_words", "n_switches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for whole in large_batches(batches, "__cw_text", AT_A_TIME // 2):
            for batch in text_batches(whole, "__cw_text", AT_A_TIME):
                texts = [words_of(t) for t in batch.column(len(fields)).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                switches = np.zeros(len(texts), np.int64)
                if crf is None:
                    found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    sums, gamma = crf.marginals(texts, each=True)
                    best = sums.argmax(axis=1)
                    found = [crf.labels[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
                    score = np.clip(sums[np.arange(len(texts)), best] / np.maximum(sizes, 1), 0, 1) * (sizes > 0)
                    label, owner = gamma.argmax(axis=1), np.repeat(np.arange(len(texts)), sizes)
                    changed = (label[1:] != label[:-1]) & (owner[1:] == owner[:-1])
                    switches = np.bincount(owner[1:][changed], minlength=len(texts))
                columns = [*(batch.column(i) for i in range(len(fields))), pa.array(found, pa.string()), pa.array(score.astype(float)), pa.array(sizes), pa.array(switches)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*(f.name for f in fields), F.col(text).alias("__cw_text")).mapInArrow(run, schema)


def label_words(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words): each word with its label and the label's probability."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[doc_id].dataType.simpleString()
    item = pa.list_(pa.struct([("word", pa.string()), ("label", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for whole in batches:
            for batch in text_batches(whole, "__cw_text", AT_A_TIME // 4):
                texts = [words_of(t) for t in batch.column(1).to_pylist()]
                _, gamma = crf.marginals(texts, each=True)
                best, at, out = gamma.argmax(axis=1), 0, []
                for words in texts:
                    out.append([{"word": w, "label": crf.labels[best[at + i]], "probability": float(gamma[at + i, best[at + i]])} for i, w in enumerate(words)])
                    at += len(words)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], names=[doc_id, "words"])

    return docs.select(doc_id, F.col(text).alias("__cw_text")).mapInArrow(run, f"`{doc_id}` {kind}, words array<struct<word:string,label:string,probability:double>>")
