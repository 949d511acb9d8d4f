"""Near-duplicate removal: SimHash balls link the closest texts, a prefix filter on shingles pairs those that no ball reaches, their shingles decide.

Texts are near when their sets of five-word shingles have a similarity (intersection by union) of 0.8 or more.

0. All texts get op8's fingerprint and meet by its half-radius balls, in stars (``simhash``). These links are checked by their sets as all others are. A near
   text can differ in more bits than a ball of usable size has, so what follows is the exact way for the rest.
1. Each text has ``BANDS`` keys, each made of ``ROWS`` minima of the set under different hashes. Two sets of similarity s have a given key in
   common with the chance s**ROWS, so two near ones lack all keys with a chance of 1e-10 at most, at any size of the table. Texts whose
   keys are all their own have no near text; they go no further, and nothing but fingerprints and keys has been shuffled for them.
2. Of two near sets in one order, each has at least four fifths of its shingles in the other, so their first fifths and one shingle more
   have one in common. These prefixes are the keys of the texts that are left: no near pair lacks a common key, however it differs. The order
   puts shingles that more texts have last, as counted over all texts that are left in a table of fixed size. So texts hardly have a key in common by chance or by a passage that
   many share, and one that differs from all others in over a fifth of its shingles has none at all. Any order is exact; where shingles meet in a slot of the table, it is only less sharp.
3. Texts that a ball links are compared first. So are a key's texts with one of them, its centre, not in pairs: the one whose keys most texts share, which is the
   least changed of a group of copies as a rule; and then with the one that most comparisons confirmed. What is left are keys whose texts are in different groups
   yet: there all pairs across groups are compared, but for those that sizes, places in the order or the number of common keys rule out for sure.

So groups are those that a comparison of all with all gives; only pairs within a group are spared. The number of pairs grows with the square of a
key's texts only where these are many, not near each other, and alike in their rarest fifths. Texts that are the same words in the same order are one
class from the start. Keys and classes with very many rows are dealt over salts.

Edge cases: a null text counts as empty; texts without words are the same. Of a group the row with the smallest doc_id stays; a null doc_id
ranks last, and of equal ids the text with the smallest hash stays. Rows are told apart by doc_id and text: those that repeat both share one
fate, rows with the same or no doc_id and other texts do not. doc_id may be of any type that can be sorted. An empty table gives an empty one. Extra columns pass ``filter_near`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm._common import BITMAP_BITS, among, attach, bits_of, components, count_parts, cut, small_batches, sum_parts, tidy, unpacked, with_hit, without
from cellweave.llm.simhash import ball_links, fingerprint, shingles, words_of

#: The least similarity is NEAR[0] / NEAR[1].
SHINGLE, LEAST, NEAR = 5, 0.8, (4, 5)
#: Bits in which fingerprints that a ball links differ at most, as in op8.
BITS, RADIUS = 64, 2
#: Keys of a text and minima in each: near texts lack all keys with a chance of (1 - 0.8 ** ROWS) ** BANDS at most, 1e-10.
BANDS, ROWS = 32, 3
#: Shingles whose minima are taken at a time, so that memory doesn't grow with a text.
AT_A_TIME = 512
#: The table of how many texts have a shingle has two to the power of so many bytes, 16 MB, which is what is broadcast.
TABLE_BITS = 24
#: Rows of a key with more than HOT rows are dealt over SALTS.
HOT, SALTS = 500, 16
#: Texts that a hub's values are shipped to at a time.
HUB = 500
_FACTORS = np.random.default_rng(5).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = np.random.default_rng(8).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes]) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(words, SHINGLE)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as sorted arrays; two empty ones are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def class_of(words: list[bytes]) -> int:
    """A signed hash of 64 bits of the words in order."""
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words)), "big", signed=True)


def bands(held: np.ndarray) -> np.ndarray:
    """The minwise keys of a set."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(held), AT_A_TIME):
        np.minimum(low, np.multiply.outer(_FACTORS, held[i : i + AT_A_TIME]).min(axis=1), out=low)
    low = low ^ (low >> np.uint64(29))
    return (low.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64)


def prefix(held: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those that fewer texts have come first, by the table often. Any near set has one of them in its own prefix."""
    least = -(-len(held) * NEAR[0] // NEAR[1])
    held = held[np.lexsort((held, often[_slot(held)]))]
    return held[: len(held) - least + 1]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _hash_of(text: str) -> Column:
    """16 bytes that tell a row's text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, own, rep, fp, keys): a hash of the text, one of its words in order, which names the class of texts with these words, op8's fingerprint, and the minwise keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, fps, keys = [], np.empty(batch.num_rows, np.uint64), []
            for i, t in enumerate(batch.column(2)):
                words = words_of(t.as_py())
                held = shingle_set(words)
                reps.append(class_of(words))
                fps[i] = fingerprint(t.as_py())
                keys.append(bands(held).view(np.int64) if len(held) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reps, pa.int64()), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "own", "rep", "fp", "keys"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), _hash_of(text).alias("own"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, own binary, rep long, fp long, keys array<bigint>")


def _balls(prints: DataFrame, total: int) -> DataFrame:
    """(a, b): op8's links between texts of other words, whose fingerprints differ in at most RADIUS bits."""
    rows = prints.select("rep", "fp").distinct()
    classes = rows.groupBy("fp").agg(F.min("rep").alias("of"), F.count("*").alias("m"))
    same = attach(rows, classes, ["fp"], "m", total, ["rep"]).where("rep <> of")
    return cut(ball_links(classes.select(F.col("of").alias("rep"), "fp"), BITS, RADIUS).union(same.select(*_pair("rep", "of"))))


def _maybe(prints: DataFrame, total: int) -> DataFrame:
    """(rep): the texts that have a minwise key in common with a text of other words."""
    emitted = prints.select("rep", F.explode("keys").alias("key"))
    held = emitted.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    held = cut(held.select("key", "m"))
    return cut(attach(_hit(emitted, held), held, ["key"], "m", total * BANDS, ["rep"]).where("m IS NOT NULL").select("rep").distinct())


def _hit(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The rows whose key can be in held: a bitmap keeps most others from being shuffled with them."""
    place = F.col("key").bitwiseAND((1 << BITMAP_BITS) - 1)
    return with_hit(rows, place, bits_of(held.select(place.alias("v"))), "__cw_near").where("__cw_near").drop("__cw_near")


def _sets(docs: DataFrame, doc_id: str, text: str, prints: DataFrame, maybe: DataFrame) -> DataFrame:
    """(rep, n, held): the shingle sets of texts in maybe, one for each class of equal words, and maybe some more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            held = [shingle_set(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, words), pa.int64()), pa.array(map(len, held), pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())], names=["rep", "n", "held"])

    wanted = cut(prints.join(maybe, "rep", "left_semi").groupBy("rep").agg(F.min("doc_id").alias("__cw_id")).select("__cw_id").distinct())
    texts = among(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", wanted)
    return cut(texts.mapInArrow(sets, "rep long, n int, held binary").where("n > 0").dropDuplicates(["rep"]))


def _often(sets: DataFrame) -> Broadcast:
    """Broadcast: how many texts have a shingle, by slot, on a scale of logarithms: 2**TABLE_BITS bytes. Shingles of a slot are counted together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(np.frombuffer(t.as_buffer(), np.uint64))
                size += len(held[-1])
                if size > 1 << 20:
                    yield count_parts(*np.unique(_slot(np.concatenate(held)), return_counts=True))
                    held, size = [], 0
        if size:
            yield count_parts(*np.unique(_slot(np.concatenate(held)), return_counts=True))

    rows = sum_parts(sets.select("held").mapInArrow(count, "chunk long, part binary"))
    return sets.sparkSession.sparkContext.broadcast(unpacked(rows, 1 << TABLE_BITS))


def _prefixes(sets: DataFrame) -> DataFrame:
    """(rep, n, first): the texts' prefixes."""
    often = _often(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [prefix(np.frombuffer(h.as_buffer(), np.uint64), often.value).view(np.int64) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.list_(pa.int64()))], names=["rep", "n", "first"])

    return sets.mapInArrow(run, "rep long, n int, first array<bigint>")


def _shared(reps: DataFrame) -> DataFrame:
    """(key, rep, n, at, m) of keys that two or more texts, m, have; at is the key's place in the text's order."""
    emitted = reps.select("rep", "n", F.posexplode("first").alias("at", "key"))
    held = cut(emitted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    total = reps.agg(F.coalesce(F.sum(F.size("first")), F.lit(0))).first()[0]
    return attach(_hit(emitted, held), held, ["key"], "m", total, ["rep"]).where("m IS NOT NULL").select("key", "rep", "n", "at", "m")


def _may(n: Column, at: Column, n_of: Column, at_of: Column) -> Column:
    """Whether texts can be near if this is their first common key: by their sizes, and by what is left in both from that key on."""
    least, most = F.least(n, n_of), F.greatest(n, n_of)
    return (least * NEAR[1] >= most * NEAR[0]) & (F.least(n - at, n_of - at_of) * (NEAR[0] + NEAR[1]) >= (n + n_of) * NEAR[0])


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _candidates(rows: DataFrame, total: int, rank: list) -> DataFrame:
    """(a, b): each key's texts with the key's centre, the one of lowest rank."""
    best = F.min(F.struct(*rank, F.col("rep").alias("of"), F.col("n").alias("n_of"), F.col("at").alias("at_of")))
    centres = rows.groupBy("key").agg(F.count("*").alias("m"), best.alias("best"))
    centres = centres.select("key", "m", "best.of", "best.n_of", "best.at_of")
    met = attach(rows, centres, ["key"], "m", total, ["rep"]).where("rep <> of")
    return met.where(_may(*map(F.col, ("n", "at", "n_of", "at_of")))).select(*_pair("rep", "of")).distinct()


def _across(rows: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """(a, b): each key's pairs of texts that links leave in different groups."""
    root = components(links).select(F.col("node").alias("rep"), "root")
    rooted = cut(rows.join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    tidy(rows.sparkSession)
    torn = rooted.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "m")
    left = cut(attach(rooted, torn, ["key"], "m", total, ["rep"]).where("m IS NOT NULL"))
    hot = F.col("m") > HOT
    bounds = (F.max(F.col("n") - F.col("at")).alias("most_left"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    groups = left.groupBy("key", F.col("root").alias("other")).agg(F.first("m").alias("m"), *bounds)
    groups = groups.select("key", "other", "most_left", "least_n", "most_n", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    dealt = left.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).otherwise(0))
    # a text meets a group only if one with the group's best figures could be near
    n, room = F.col("n"), F.least(F.col("n") - F.col("at"), "most_left")
    some = (n * NEAR[0] <= F.col("most_n") * NEAR[1]) & (n * NEAR[1] >= F.col("least_n") * NEAR[0]) & (room * (NEAR[0] + NEAR[1]) >= (n + F.col("least_n")) * NEAR[0])
    ours = dealt.join(groups, ["key", "salt"]).where((F.col("root") < F.col("other")) & some).select("key", "other", "rep", "n", "at")
    theirs = left.select("key", F.col("root").alias("other"), F.col("rep").alias("of"), F.col("n").alias("n_of"), F.col("at").alias("at_of"))
    return ours.join(theirs, ["key", "other"]).where(_may(*map(F.col, ("n", "at", "n_of", "at_of")))).select(*_pair("rep", "of")).distinct()


def _compared(pairs: DataFrame, values: DataFrame, near: Callable[[int, np.ndarray, int, np.ndarray], bool]) -> DataFrame:
    """(a, b) of pairs, which are kept, for whose texts' values (rep, n, value) near holds.

    Of a pair, the text that is in more of them is a hub. A hub's value isn't joined to each of its pairs: it travels once for HUB texts that meet it, which come one after the other
    behind it. So what a task gets is bounded, and what is shuffled is a value for each pair and not two."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("m"))
    told = pairs
    for c in ("a", "b"):
        told = told.join(degree.select(F.col("rep").alias(c), F.col("m").alias(f"m_{c}")), c)
    more = F.col("m_a") >= F.col("m_b")
    met = told.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("rep"), F.greatest("m_a", "m_b").alias("m"))
    met = cut(met.select("hub", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / HUB)).cast("int").alias("salt"), "rep"))
    texts = met.join(values, "rep").select("hub", "salt", F.lit(1).alias("kind"), "rep", "n", "value")
    hubs = met.select("hub", "salt").distinct().join(values.withColumnRenamed("rep", "hub"), "hub").select("hub", "salt", F.lit(0).alias("kind"), F.col("hub").alias("rep"), "n", "value")
    dealt = hubs.unionByName(texts).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_hub, own = 0, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for hub, kind, rep, n, value in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                held = np.frombuffer(value.as_buffer(), np.uint64)
                if kind == 0:
                    n_hub, own = n, held.copy()  # else it keeps the whole batch
                elif near(n_hub, own, n, held):
                    found.append((max(hub, rep), min(hub, rep)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cut(dealt.select("hub", "kind", "rep", "n", "value").mapInArrow(run, "a long, b long"))


def _close(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs that can be near: of what two sets share, all but their common keys is behind the prefix of one of them."""
    x, y = (held.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")) for c in ("a", "b"))
    # what is behind the prefix of the larger set: the least number it must share, less one
    behind = F.ceil(F.greatest("n_a", "n_b") * NEAR[0] / NEAR[1]) - 1
    both = F.size(F.array_intersect("keys_a", "keys_b")) + behind
    return cut(pairs.join(x, "a").join(y, "b").where(both * (NEAR[0] + NEAR[1]) >= (F.col("n_a") + F.col("n_b")) * NEAR[0]).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of pairs whose sets are near."""
    return _compared(pairs, sets.select("rep", "n", F.col("held").alias("value")), lambda n, held, n_of, held_of: similarity(held, held_of) >= LEAST)


def _links(sets: DataFrame, balls: DataFrame) -> DataFrame:
    """(a, b): pairs of near texts of other words; as many as connect all that are near. balls: the links of the fingerprints, which come first."""
    spark = sets.sparkSession
    rows = cut(_shared(_prefixes(sets)))
    total = rows.count()
    tidy(spark)
    held = cut(rows.groupBy("rep").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys"), (-F.sum("m")).alias("loss")))  # a text's own keys
    typical, rows = rows.drop("m").join(held.select("rep", "loss"), "rep"), rows.drop("m")
    first = _close(balls.union(_candidates(typical, total, [F.col("loss")])).distinct(), held)
    links = _verified(first, sets)
    tidy(spark)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    ranked = rows.join(degree, "rep", "left").withColumn("loss", -F.coalesce("degree", F.lit(0)))
    second = _close(_candidates(ranked, total, [F.col("loss")]).join(first, ["a", "b"], "left_anti"), held)
    links = cut(links.union(_verified(second, sets)))
    tidy(spark)
    third = _close(_across(rows, links, total).join(first.union(second), ["a", "b"], "left_anti"), held)
    links = links.union(_verified(third, sets))
    tidy(spark)
    return links


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, own, keep_id, keep_own) for the rows of groups of two or more: own is 16 bytes that tell the row's text, keep_id and keep_own tell the row that stays."""
    small_batches(docs.sparkSession)
    prints = cut(_prints(docs, doc_id, text))
    total = prints.count()
    balls = _balls(prints, total)
    tidy(docs.sparkSession)
    sets = _sets(docs, doc_id, text, prints, _maybe(prints, total))
    tidy(docs.sparkSession)
    root = components(_links(sets, balls))
    del sets, balls
    tidy(docs.sparkSession)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "own")
    classes = prints.groupBy("rep").agg(F.count("*").alias("m"), F.min(rank).alias("best"))
    classes = cut(classes.join(root.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    groups = classes.groupBy("root").agg(F.count("*").alias("classes"), F.sum("m").alias("members"), F.min("best").alias("keep")).where("members > 1")
    kept = attach(classes, groups, ["root"], "classes", total, ["rep"]).where("members IS NOT NULL").select("rep", "m", "keep")
    rows = attach(prints.select("doc_id", "own", "rep"), kept, ["rep"], "m", total, ["doc_id", "own"]).where("keep IS NOT NULL")
    return rows.select("doc_id", "own", F.col("keep.doc_id").alias("keep_id"), F.col("keep.own").alias("keep_own"))


def filter_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    found = near_groups(docs, doc_id, text)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("keep_own"))
    gone = found.where(~stays).select(F.col("doc_id").alias("__cw_id"), F.col("own").alias("__cw_hash")).distinct()
    return without(docs, doc_id, cut(gone), _hash_of(text))
