"""A similarity join of names by difflib's ratio, which loses no pair.

The ratio of two names is twice the number of matched characters over both lengths, and no more characters can match than the names have in common, counted with
repeats. So a ratio of t asks for t/2 of both lengths in common characters, and for lengths that differ by (2 - t)/t at most. A name's characters, numbered by
occurrence, are put in one order for all names, rarest first. Of two names with k characters in common, the first w of these lie among the first n - k + w of either
one, whatever the order; names therefore meet on sets of w characters of such a beginning. Only pairs that meet, and that have enough in common as a whole, are compared.

The matched characters are in the same order in both names, too. Of two short names so few characters may be left over that leaving out each choice of these costs less
than it sorts out: such names meet on what is left of them, and so only if they have that much in common in order. How many meet is then a matter of how many are alike.

Names look for a likeness of 0.94 first, then for less: who has found a name as like as that cannot find a better one later.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import cut

#: Likenesses asked for one after the other, before the least one.
STEPS = (0.94, 0.87)
#: For the shorter name's length, from which on so many characters make a key: short names have few in common, long ones too many sets.
WIDTHS = ((1, 1), (6, 3), (31, 2), (121, 1))
#: So many of the most frequent characters are put in order by their counts; all others come before them.
RANKED = 2000
#: Rows of a name go to so many tasks.
SALTS = 8
#: Names meet on what is left of them if there are no more choices of what is left out than these.
CHOICES = 1000


def numbered(name: str) -> list[tuple[str, int]]:
    """A name's characters with how often each came before."""
    seen: Counter[str] = Counter()
    out = []
    for c in name:
        out.append((c, seen[c]))
        seen[c] += 1
    return out


def _up(x: float) -> int:
    """The least whole number that isn't below x but for rounding."""
    return math.ceil(x - 1e-9)


def bounds(n: int, least: float) -> tuple[int, int, int]:
    """For a name of n characters: the shortest and longest partners, and how many characters any partner has in common, at least."""
    low, high = _up(n * least / (2 - least)), math.floor(n * (2 - least) / least + 1e-9)
    return low, high, _up(least / 2 * (n + low))


def keys(name: str, least: float, rank: dict[tuple[str, int], int]) -> list[int]:
    """Hashes on which the name meets all partners of that likeness."""
    n = len(name)
    low, high, common = bounds(n, least)
    ordered = sorted(numbered(name), key=lambda t: (rank.get(t, -1), t))
    out = set()
    for k, (start, width) in enumerate(WIDTHS):
        stop = WIDTHS[k + 1][0] - 1 if k + 1 < len(WIDTHS) else math.inf
        # the shorter of the two can be of this class: this name, or a shorter partner, with this one at most its longest
        if low > stop or n < start:
            continue
        width = min(width, common)
        begin = ordered[: n - common + width]
        for some in combinations(begin, width):
            out.add(xxhash.xxh64_intdigest(f"{start}\x00" + "\x00".join(f"{c}{i}" for c, i in some)) - (1 << 63))
    return sorted(out)


def lengths(left: set[int], right: set[int], least: float) -> tuple[dict[tuple[int, int], int], bool]:
    """For pairs of lengths of which names can be that alike: how many characters they have in common in order, at least, if they meet on what is left; and whether any others don't."""
    short, others = {}, False
    for n in left:
        for m in right:
            if 2 * min(n, m) < least * (n + m) - 1e-9:
                continue
            common = _up(least / 2 * (n + m))
            if max(math.comb(n, common), math.comb(m, common)) <= CHOICES:
                short[n, m] = common
            else:
                others = True
    return short, others


def remainders(names: list[str], common: int) -> np.ndarray:
    """A row of hashes for each of the names, which are of one length: of all that is left of it with so many characters. In order, so that repeats are side by side."""
    n = len(names[0])
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(len(names), n).astype(np.uint64)
    with np.errstate(over="ignore"):
        codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(29)
        # a character weighs by its place in what is left: its own less the number left out before it
        weights = np.array([xxhash.xxh64_intdigest(f"{common}.{k}") | 1 for k in range(common)], np.uint64)
        sums = []
        for gone in range(n - common + 1):
            each = np.zeros((n + 1, len(names)), np.uint64)
            each[gone + 1 : gone + common + 1] = (codes[:, gone : gone + common] * weights).T
            sums.append(np.cumsum(each, axis=0, dtype=np.uint64))
        out = np.empty((math.comb(n, common), len(names)), np.uint64)
        for row, left_out in enumerate(combinations(range(n), n - common)):
            total, start = np.zeros(len(names), np.uint64), 0
            for gone, at in enumerate((*left_out, n)):
                total += sums[gone][at] - sums[gone][start]
                start = at + 1
            out[row] = total
    return np.sort(out.T.view(np.int64), axis=1)


def _left_over(names: DataFrame, wanted: dict[int, list[int]]) -> DataFrame:
    """(key, name) of names (name), by lengths with the numbers of characters that are to be left."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for name in batch.column(0).to_pylist():
                by_length.setdefault(len(name), []).append(name)
            for n, alike in by_length.items():
                for common in wanted.get(n, ()):
                    for i in range(0, len(alike), 500):
                        part = alike[i : i + 500]
                        found = remainders(part, common)
                        first = np.ones(found.shape, bool)
                        first[:, 1:] = found[:, 1:] != found[:, :-1]
                        rows = np.nonzero(first)[0]
                        yield pa.RecordBatch.from_arrays([pa.array(found[first]), pa.array(part, pa.string()).take(pa.array(rows))], names=["key", "name"])

    # the work is in the keys, of which there are many for few bytes
    return names.select("name").repartition(_tasks(names), "name").mapInArrow(tell, "key long, name string")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _common_lengths(names: DataFrame) -> set[int]:
    return {r.n for r in names.select(F.length("name").alias("n")).distinct().collect()}


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, most): those of ``pairs`` that may have that likeness by their order, too, where names meet on what is left of them."""
    short, others = lengths(_common_lengths(left), _common_lengths(right), least)
    coded = F.length("a") * F.lit(1 << 20) + F.length("b")
    codes = [(n << 20) + m for n, m in short]
    found = []
    if short:
        wanted: list[dict[int, set[int]]] = [{}, {}]
        for of_both, common in short.items():
            for side, n in zip(wanted, of_both, strict=True):
                side.setdefault(n, set()).add(common)
        a, b = (_left_over(x, {n: sorted(c) for n, c in w.items()}).withColumnRenamed("name", to) for x, w, to in zip((left, right), wanted, "ab", strict=True))
        # both sides are many times as large as what they are made of, so neither is to be broadcast
        met = a.join(b.hint("merge"), "key").where(coded.isin(codes)).select("a", "b").distinct()
        found.append(_rated(met, least))
    if others or not short:
        found.append(pairs(left, right, least).where(~coded.isin(codes)) if codes else pairs(left, right, least))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _rated(met: DataFrame, least: float) -> DataFrame:
    """met (a, b) with what their likeness can be at most, if it's enough."""
    return met.withColumn("most", 2 * _in_common("a", "b") / (F.length("a") + F.length("b"))).where(F.col("most") >= least - 1e-9)


def _ranks(names: DataFrame) -> dict[tuple[str, int], int]:
    """The place of the most frequent numbered characters by their counts, in names (name)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                counts.update(numbered(name))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["c", "i", "n"])

    counted = names.select("name").mapInArrow(tell, "c string, i int, n long").groupBy("c", "i").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "c", "i").limit(RANKED).collect()
    return {(r.c, r.i): RANKED - k for k, r in enumerate(top)}


def _keyed(names: DataFrame, least: float, rank: dict[tuple[str, int], int]) -> DataFrame:
    """(key, name) of names (name)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.column(0).slice(i, 500)
                found = [keys(name, least, rank) for name in part.to_pylist()]
                rows = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.int64()), part.take(rows)], names=["key", "name"])

    return names.select("name").mapInArrow(tell, "key long, name string")


def _in_common(a: str, b: str):
    """How many characters two columns of names have in common."""
    part = lambda c: F.transform(F.split(F.col(c), ""), lambda x: x)
    each = F.array_distinct(part(a))
    of = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x, F.lit("")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.least(of(a, x), of(b, x)))


def pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, most): pairs of different names (name) of either side that may have that likeness; most is what it can be at most."""
    rank = _ranks(left.unionByName(right))
    met = _keyed(left, least, rank).withColumnRenamed("name", "a").join(_keyed(right, least, rank).withColumnRenamed("name", "b").hint("merge"), "key")
    total = F.length("a") + F.length("b")
    near = met.where(2 * F.least(F.length("a"), F.length("b")) >= F.lit(least) * total - 1e-9).select("a", "b").distinct()
    return _rated(near, least)


def best(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, r, file): for each name of left (name) that has one, the file of the most alike name of right (name, file), ties by file.

    A name's candidates come in order of what their ratio can be, over several tasks; one that can't beat the best so far isn't compared."""
    found = candidates(left, right.select("name"), least).join(right.withColumnRenamed("name", "b"), "b")
    dealt = found.repartition(_tasks(left), "a", F.pmod(F.xxhash64("b"), F.lit(SALTS))).sortWithinPartitions("a", F.desc("most"), "file")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import difflib

        now, top = None, (0.0, "")
        for batch in batches:
            out = []
            for a, b, most, file in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if a != now:
                    if now is not None and top[0] <= -least:
                        out.append((now, *top))
                    now, top, matcher = a, (0.0, ""), difflib.SequenceMatcher(None, a, "")
                if most < -top[0] - 1e-9:
                    continue
                matcher = difflib.SequenceMatcher(None, a, b)
                top = min(top, (-matcher.ratio(), file))
            yield _rows(out)
        if now is not None and top[0] <= -least:
            yield _rows([(now, *top)])

    rated = dealt.select("a", "b", "most", "file").mapInArrow(compare, "a string, d double, file string")
    return rated.groupBy("a").agg(F.min(F.struct("d", "file")).alias("m")).select("a", (-F.col("m.d")).alias("r"), "m.file")


def _rows(found: list[tuple[str, float, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))], names=["a", "d", "file"])


def most_alike(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, r, file): for each different name of left (name) the file of the most alike name of right (name, file), if the ratio is at least least.

    Empty names have no likeness. Equal names are joined; the others take a pass for each step of likeness, over those that are left."""
    if not 0 < least <= 1:
        raise ValueError("a likeness is over 0 and at most 1")
    files = cut(right.where("name <> ''").groupBy("name").agg(F.min("file").alias("file")))
    names = cut(left.select("name").where("name <> ''").distinct())
    done = cut(names.join(files, "name").select("name", F.lit(1.0).alias("r"), "file"))
    for step in [s for s in STEPS if s > least] + [least]:
        rest = names.join(done.select("name"), "name", "left_anti")
        more = best(rest, files, step).withColumnRenamed("a", "name")
        done = cut(done.unionByName(more))
    return done
