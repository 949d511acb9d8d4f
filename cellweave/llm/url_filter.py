"""URL verdicts by rules, and beyond them by the ratio of two character language models.

Two variable-order Markov models over bytes, one of accepted and one of rejected URLs, give each URL its
log-likelihood difference for a byte of it. A context's counts are smoothed by the estimate of the next
shorter context, down to the uniform one. Counts are kept in a table of fixed size by a hash of context and byte, so a
model's size doesn't follow the input; they are gathered from all labelled URLs but a fold, on which the
threshold is calibrated: of all cuts of a fixed grid, the one that is right for most of both classes.

Rules are pairs of a host and a path's beginning; a rule fits its host and all subdomains, and the longest wins.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null counts as empty text and
scores zero. Without labelled URLs of both classes the verdict is allow. Repeated rows get equal results; an empty table gives an
empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import cut, text_batches

#: Bytes of context, at most.
ORDER = 5
TABLE_BITS = 20
#: How much the shorter context's estimate weighs, in counts.
WEIGHT = 2.0
#: Bytes of URLs whose contexts are held at a time, about; a longer URL comes in segments.
AT_A_TIME = 1 << 18
#: One of so many folds calibrates.
FOLDS = 5
#: Cuts that are tried: so many steps to either side of zero, each of so much.
STEPS, STEP = 400, 0.01
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    rest = F.substring_index(F.col(url), "://", 1)
    after = F.expr(f"substring(`{url}`, length(substring_index(`{url}`, '://', 1)) + 4)")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), *LOWER)
    return F.when(F.col(url).isNull() | (rest == F.col(url)), "").otherwise(host)


def path_of(url: str) -> Column:
    rest = F.substring_index(F.col(url), "://", 1)
    after = F.expr(f"substring(`{url}`, length(substring_index(`{url}`, '://', 1)) + 4)")
    return F.when(F.col(url).isNull() | (rest == F.col(url)), "").otherwise(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def matched(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) by columns host and path; rules are (verdict, host/path), few, and become one expression."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _segments(urls: list[str | None], most: int = AT_A_TIME) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The bytes of URLs, each with an end, in segments that have ORDER bytes of context before them, about so many bytes at a time; and the URL of each segment."""
    of, parts, held = [], [], 0
    for i, u in enumerate(urls):
        data = b"\x00" * ORDER + (u or "").encode("utf-8", "replace") + b"\x03"
        for at in range(0, len(data) - ORDER, most):
            of.append(i)
            parts.append(data[at : at + ORDER + most])
            held += len(parts[-1])
            if held >= most:
                yield np.array(of), parts
                of, parts, held = [], [], 0
    if parts:
        yield np.array(of), parts


def _contexts(data: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For the bytes of segments: the segment of each; for each order the slots of (context, byte) and of context alone. Some 150 bytes a byte."""
    sizes = np.array([len(d) - ORDER for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    begins = np.cumsum([0] + [len(d) for d in data])[:-1]
    owner = np.repeat(np.arange(len(data)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes) + ORDER
    pairs, alone = [], []
    context = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = (context + flat[at - k] + np.uint64(1)) * np.uint64(0x100000001B3)
        seed = (context ^ np.uint64(k * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
        whole = (seed + flat[at] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        pairs.append((whole >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        alone.append((seed * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    return owner, pairs, alone


def _scores(urls: list[str | None], tables: np.ndarray, most: int = AT_A_TIME) -> np.ndarray:
    """Log-likelihood of accepted less that of rejected, by byte. tables: class, pairs or contexts, slot."""
    sums, sizes = np.zeros(len(urls)), np.zeros(len(urls))
    for of, data in _segments(urls, most):
        owner, pairs, alone = _contexts(data)
        logs = []
        for c in (0, 1):
            p = np.full(len(owner), 1 / 256)
            for pair, context in zip(pairs, alone, strict=True):
                # collisions can make a pair's count larger than its context's
                n = np.maximum(tables[c, 1][context], tables[c, 0][pair])
                p = (tables[c, 0][pair] + WEIGHT * p) / (n + WEIGHT)
            logs.append(np.log(p))
        sums += np.bincount(of[owner], logs[0] - logs[1], minlength=len(urls))
        sizes += np.bincount(of[owner], minlength=len(urls))
    return np.where([u is None for u in urls], 0.0, sums / np.maximum(sizes, 1))


def fit(labelled: DataFrame, url: str = "url", accepted: str = "accepted", key: str = "page_id") -> tuple[np.ndarray, float] | None:
    """(tables, threshold) of URLs with a boolean label, or None if a class is empty.

    The driver gets the counts of at most 2**(TABLE_BITS + 2) slots and of 2 * STEPS + 2 cuts.
    """
    size = 1 << TABLE_BITS
    rows = labelled.where(F.col(accepted).isNotNull()).select(F.col(url).alias("url"), F.col(accepted).cast("int").alias("label"), F.pmod(F.crc32(F.concat_ws("|", F.col(key).cast("string"), url)), F.lit(FOLDS)).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 2, size), np.int64)
        for batch in (b for whole in batches for b in text_batches(whole, "url", AT_A_TIME)):
            urls, labels = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = [u for u, x in zip(urls, labels, strict=True) if x == 1 - c]
                for _, data in _segments(own):
                    _, pairs, alone = _contexts(data)
                    for p, a in zip(pairs, alone, strict=True):
                        held[c, 0] += np.bincount(p, minlength=size)
                        held[c, 1] += np.bincount(a, minlength=size)
        flat = held.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["slot", "n"])

    summed = rows.where("fold > 0").select("url", "label").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    tables = np.zeros(4 * size)
    tables[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    tables = tables.reshape(2, 2, size)
    if not tables[0].any() or not tables[1].any():
        return None
    model = rows.sparkSession.sparkContext.broadcast(tables.astype(np.float32))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in text_batches(whole, "url", AT_A_TIME)):
            score = _scores(batch.column(0).to_pylist(), model.value)
            step = np.clip(np.floor(score / STEP), -STEPS, STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(step)], names=["label", "step"])

    seen = rows.where("fold = 0").select("url", "label").mapInArrow(bins, "label int, step long").groupBy("label", "step").count().collect()
    held = np.zeros((2, 2 * STEPS + 1))
    for r in seen:
        held[r["label"], r["step"] + STEPS] += r["count"]
    if not held[0].sum() or not held[1].sum():
        return tables, 0.0
    # a cut before step k accepts steps k and above; of equally good cuts, that nearest to zero
    right = np.concatenate([[0], np.cumsum(held[0])]) / held[0].sum() + (held[1].sum() - np.concatenate([[0], np.cumsum(held[1])])) / held[1].sum()
    cuts = (np.arange(2 * STEPS + 2) - STEPS) * STEP
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return tables, float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): a row for each page; score is null where a rule decides.

    labelled: URLs with a boolean column accepted; by default the pages that the rules decide.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host_of("url"), "path": path_of("url")})
    rule, by_rule = matched(rules)
    rows = cut(rows.withColumns({"rule": rule, "by_rule": by_rule}))
    model = fit(rows.where("by_rule IS NOT NULL").withColumn("accepted", F.col("by_rule") == "allow") if labelled is None else labelled)
    table, threshold = model or (None, 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(None if table is None else table.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "url", AT_A_TIME):
                urls = part.column(1).to_pylist()
                score = np.zeros(len(urls)) if shared.value is None else _scores(urls, shared.value)
                ruled = part.column(5).to_pylist()
                verdict = [r or ("allow" if s >= threshold else "block") for r, s in zip(ruled, score.tolist(), strict=True)]
                shown = pa.array(score, mask=np.array([r is not None for r in ruled], bool))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(verdict, pa.string()), shown], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "host", "path", "rule", "by_rule").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
