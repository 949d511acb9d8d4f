"""Toxicity by a chain of classifiers.

Categories are predicted one after the other by linear models; each model's features are a text's words and word
beginnings, and the log-odds that the earlier models give. Later models are trained with out-of-fold predictions of
the earlier ones, so that they see them as good as they are on new texts.

Features are chosen and models fitted on at most ``most_rows`` labelled documents (the bound), picked by a hash
of their ids over all of them; every document is then scored by its whole text.

Edge cases: a null or empty text has no features and isn't rejected unless the models say so for every empty
text. A category is learned from the documents whose label of it isn't null, whatever their other labels are; labels of documents
that aren't there are left out; of rows that repeat a doc_id, the largest label counts. A probability of exactly the threshold isn't
rejected. Without any labelled document of a category its probability is zero. Each document row gives one row, repeated or not; an
empty table gives an empty one. Extra columns pass ``keep_clean`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import cut, small_batches, text_batches, tidy

#: Labelled documents that are learned from, at most.
MOST_ROWS = 16_000
#: Features that are chosen for each category, at most.
FEATURES = 1500
#: How far a feature's count in a category must be from its share, in standard deviations.
LEAST_FAR = 3.0
#: Documents that a feature must be in.
LEAST_DOCS = 4
#: Characters of a word's beginning that make a feature.
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 4
PENALTY = 0.2
SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
AT_A_TIME = 8 << 20
CACHE = 150_000


def features_of(word: bytes) -> list[str]:
    """A word and its beginnings. Words are lower-cased whole, so É and é are one."""
    text = word.decode("utf-8", "replace").lower()
    return [text, *(f"{text[:n]}-" for n in BEGINNINGS if len(text) >= n)]


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").lower().translate(SPACES).split())


def logistic(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, width: int, penalty: float = PENALTY, steps: int = 120) -> np.ndarray:
    """Weights: of each feature, of each extra column, and the bias last. Full-batch gradient steps with momentum, scaled by each feature's frequency."""
    n = len(rows)
    lengths = np.array([len(r) for r in rows], np.int64)
    where = np.concatenate(rows) if n else np.zeros(0, np.int32)
    of = np.repeat(np.arange(n, dtype=np.int32), lengths)
    k = extra.shape[1]
    w, pace = np.zeros(width + k + 1), np.zeros(width + k + 1)
    rate = max(float(y.mean()), 1e-6) if n else 0.5
    w[-1] = np.log(rate / (1 - min(rate, 1 - 1e-6)))
    scale = np.concatenate([np.bincount(where, minlength=width), (extra**2).sum(0), [n]]) * 0.25 + penalty
    scale[:width] = scale[:width] * max(1.0, lengths.mean() ** 0.5 if n else 1.0)
    for step in range(steps):
        z = np.bincount(of, w[where], minlength=n) + extra @ w[width : width + k] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.concatenate([np.bincount(where, error[of], minlength=width), extra.T @ error, [error.sum()]])
        gradient[:-1] += penalty * w[:-1]
        pace = 0.8 * pace - gradient / scale * (0.5 if step < steps - 20 else 0.2)
        w += pace
    return w


def log_odds(rows: list[np.ndarray], extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    width = len(w) - extra.shape[1] - 1
    lengths = np.array([len(r) for r in rows], np.int64)
    where = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    return np.clip(np.bincount(of, w[:width][where], minlength=len(rows)) + extra @ w[width:-1] + w[-1], -20, 20)


def train_chain(rows: list[np.ndarray], labels: np.ndarray, width: int, folds: np.ndarray) -> list[np.ndarray]:
    """A model for each column of labels, of the rows that have one (not -1); earlier log-odds come out of fold."""
    models, extra = [], np.zeros((len(rows), 0))
    for c in range(labels.shape[1]):
        y, known = labels[:, c].astype(float), labels[:, c] >= 0
        told = np.flatnonzero(known)
        models.append(logistic([rows[i] for i in told], extra[told], y[told], width))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero((folds != f) & known), np.flatnonzero(folds == f)
                fitted = logistic([rows[i] for i in inside], extra[inside], y[inside], width)
                out[outside] = log_odds([rows[i] for i in outside], extra[outside], fitted)
            extra = np.column_stack([extra, out])
    return models


def predict_chain(rows: list[np.ndarray], models: list[np.ndarray]) -> np.ndarray:
    """Probabilities: a column for each category."""
    extra = np.zeros((len(rows), 0))
    for w in models:
        extra = np.column_stack([extra, log_odds(rows, extra, w)])
    return 1 / (1 + np.exp(-extra))


class Chain:
    """Chosen features and models; small, and bounded by FEATURES."""

    def __init__(self, categories: Sequence[str], features: list[str], models: list[np.ndarray]):
        self.categories, self.models = list(categories), models
        self.place = {f: i for i, f in enumerate(features)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def indexes(self, text: str | None) -> np.ndarray:
        """The chosen features of a text, each once."""
        known, out = self.known, set()
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                found = tuple(self.place[f] for f in features_of(word) if f in self.place)
                if len(known) >= CACHE:
                    known.clear()
                known[word] = found
            if found:
                out.update(found)
        return np.fromiter(sorted(out), np.int64, len(out))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        if not self.models:
            return np.zeros((len(texts), len(self.categories)))
        return predict_chain([self.indexes(t) for t in texts], self.models)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", most_rows: int = MOST_ROWS) -> Chain:
    """Learn from documents with labels; categories are columns of labels with 0, 1 or null."""
    spark = docs.sparkSession
    small_batches(spark)
    named = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("__cw_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"__cw_{i}") for i, c in enumerate(categories)))
    named = named.dropna("all", subset=[f"__cw_{i}" for i in range(len(categories))])
    total = named.count()
    if total > most_rows:
        named = named.where(F.pmod(F.xxhash64("__cw_id"), F.lit(1 << 20)) < int(0.9 * most_rows / total * (1 << 20)))
    taken = named.orderBy(F.xxhash64("__cw_id"), "__cw_id").limit(most_rows).collect()
    if not taken:
        return Chain(categories, [], [])
    wanted = spark.createDataFrame([(r[0],) for r in taken], f"__cw_id {named.schema['__cw_id'].dataType.simpleString()}")
    label_of = {r[0]: tuple(r)[1:] for r in taken}
    k = len(categories)
    # at most most_rows ids are broadcast, so only those documents leave the scan
    sample = cut(docs.select(F.col(doc_id).alias("__cw_id"), F.col(text).alias("text")).join(F.broadcast(wanted), "__cw_id", "left_semi"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # documents with a feature, those of each category, and those without a label of it, which are few or none
        totals: list[Counter] = [Counter() for _ in range(2 * k + 1)]

        def rows() -> pa.RecordBatch:
            names = list(totals[0])
            columns = [pa.array(names, pa.string()), *(pa.array([t[f] for f in names], pa.int64()) for t in totals)]
            for t in totals:
                t.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "n", *(f"n_{i}" for i in range(2 * k))])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {f for w in words_of(t.as_py()) for f in features_of(w)}
                totals[0].update(found)
                for c, y in enumerate(label_of[i]):
                    if y is None:
                        totals[k + c + 1].update(found)
                    elif y:
                        totals[c + 1].update(found)
            if len(totals[0]) > 1_000_000:
                yield rows()
        yield rows()

    counts = sample.mapInArrow(count, "feature string, n long, " + ", ".join(f"n_{i} long" for i in range(2 * k)))
    counts = cut(counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in counts.columns[1:])).where(F.col("n") >= LEAST_DOCS))
    chosen = set()
    for c in range(k):
        told = [label_of[i][c] for i in label_of if label_of[i][c] is not None]
        n, positive = len(told), sum(told)
        if 0 < positive < n:
            with_it, seen, rate = F.col(f"n_{c}"), F.col("n") - F.col(f"n_{k + c}"), positive / n
            # how far the count is from what the category's share would give, in standard deviations
            far = F.try_divide(with_it - seen * rate, F.sqrt(seen * rate * (1 - rate)))
            chosen |= {r[0] for r in counts.select("feature", F.abs(far).alias("far")).where(F.col("far") >= LEAST_FAR).orderBy(F.desc("far"), "feature").limit(FEATURES).collect()}
    chain = Chain(categories, sorted(chosen), [])
    shared = spark.sparkContext.broadcast(chain)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.indexes(t.as_py()).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["__cw_id", "found"])

    kind = sample.schema["__cw_id"].dataType.simpleString()
    encoded = sample.mapInArrow(index, f"__cw_id {kind}, found binary").toArrow()  # as bytes: numbers of Python would be many times as large
    rows = sorted(zip(encoded.column(0).to_pylist(), encoded.column(1).to_pylist(), strict=True))
    if not rows:
        return Chain(categories, [], [])
    del encoded
    tidy(spark)  # training takes driver's memory too, and nothing of the steps before is needed
    ids = [r[0] for r in rows]
    folds = np.arange(len(rows)) % FOLDS
    models = train_chain([np.frombuffer(r[1], "<i4") for r in rows], np.array([[-1 if y is None else y for y in label_of[i]] for i in ids]), len(chosen), folds)
    del rows
    tidy(spark)
    return Chain(categories, sorted(chosen), models)


def probabilities(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text", reject: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category>..., rejected): rejected if the probability of ``reject`` is over the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    place = chain.categories.index(reject)
    names = [doc_id, *(f"p_{c}" for c in chain.categories), "rejected"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, "text", AT_A_TIME):
                p = shared.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, place] > threshold)], names=names)

    schema = f"`{doc_id}` {kind}, " + ", ".join(f"`p_{c}` double" for c in chain.categories) + ", rejected boolean"
    return docs.select(F.col(doc_id), F.col(text).alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain, text: str = "text", reject: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    place = chain.categories.index(reject)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, text, AT_A_TIME):
                p = shared.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
                yield batch.filter(pa.array(p[:, place] <= threshold))

    return docs.mapInArrow(run, docs.schema)
