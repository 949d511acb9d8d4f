"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is one or more blocks of bits. Every distinct fingerprint emits, for each block,
all variants within half the radius; two blocks within the radius have a variant in common, so
a shuffle on variants brings together every pair to be found. In a ball of half the radius
any two members are within the radius, so each variant's rows are linked in a star instead of
in pairs: no link between components is lost, and the number of links is at most that of emitted rows.

Edge cases: a null or empty text, or one without words, has fingerprint zero. Rows that repeat a
doc_id are rows of their own with equal results. A row with a null doc_id gets a fingerprint, and the component of
its fingerprint's documents if some have an id, else null. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import attach, components, cut

SEED = 42
#: Shingles whose bits are counted at a time, so that memory doesn't grow with a text.
AT_A_TIME = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, split at the six ASCII white spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_A_TIME):
        part = np.ascontiguousarray(hashes[i : i + AT_A_TIME], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    hash_of = xxhash.xxh64_intdigest
    parts = shingles(words_of(text), width)
    return majority(np.fromiter((hash_of(s, SEED) for s in parts), np.uint64, len(parts))) if parts else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def half_ball(bits: int, radius: int) -> list[int]:
    """The masks of all flips within half the radius, as signed 64-bit numbers."""
    out = {0}
    for _ in range((radius + 1) // 2):
        out |= {m ^ (1 << b) for m in out for b in range(bits)}
    return sorted(m - (1 << 64) if m >> 63 else m for m in out)


def ball_links(classes: DataFrame, bits: int = 64, radius: int = 2) -> DataFrame:
    """(a, b) with b < a: star links between classes (rep, fp) whose fp differ in at most radius bits.

    rep is a class's id. radius is even, so that a ball's members are within the radius of each other; links are
    checked all the same. A variant has at most as many rows as half_ball has masks, as fp are distinct.
    """
    masks = F.array(*(F.lit(m) for m in half_ball(bits, radius)))
    emitted = classes.select("rep", "fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    least = F.min(F.struct("rep", F.col("fp").alias("of"))).over(_by_variant())
    star = emitted.select("rep", "fp", least.alias("least")).where("rep <> least.rep")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least.of"))) <= radius
    return star.where(near).select(F.col("rep").alias("a"), F.col("least.rep").alias("b")).distinct()


def _by_variant():
    from pyspark.sql import Window

    return Window.partitionBy("variant")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each document; component_id is the smallest doc_id reachable."""
    prints = cut(fingerprints(docs, doc_id, text, width))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    linked = components(ball_links(classes.where("rep IS NOT NULL").select("rep", "fp"), 64, radius))
    rooted = classes.join(linked, classes["rep"] == linked["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "size")
    return attach(prints, rooted, ["fp"], "size", prints.count(), ["doc_id"]).select("doc_id", "fp", "component_id")
