import gc
import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash

from cellweave.llm import exact_dedup, near_dedup, queries, simhash

TEXTS = ["a b c", "a b c", None, "", "a b d", "long " * 3000, "long " * 3000, "long " * 2999 + "lonG ", "A b c", " "]


def test_exact_groups(docs_of, empty):
    docs = docs_of([*TEXTS, "a b c", "a b c"], [0, 7, 2, 9, 4, 5, 6, 8, 10, None, 11, 11])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 12
    by = {}
    for i, t in zip([0, 7, 2, 9, 4, 5, 6, 8, 10, None, 11, 11], [*TEXTS, "a b c", "a b c"], strict=True):
        by.setdefault(t or "", []).append(i)
    want = sorted(((i, max((x for x in g if x is not None), default=None), len(g)) for g in by.values() for i in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.filter_duplicates(empty).count() == 0
    kept = exact_dedup.filter_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["11", "11", "9", "4", "6", "8", "10", "None"])


def test_exact_filter_decides_by_row(docs_of):
    rows = [(None, "a copy"), (None, "of its own"), (5, "a copy"), (3, "another"), (3, "twice"), (4, "twice"), (3, None), (6, "")]
    kept = exact_dedup.filter_duplicates(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, "of its own"), (5, "a copy"), (3, "another"), (4, "twice"), (6, "")], key=str)


def test_exact_with_saturated_bitmaps(docs_of):
    texts = [f"t{i % 40}" for i in range(200)]
    got = exact_dedup.exact_groups(docs_of(texts), bits=15).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 160 + i % 40, 5) for i in range(200)}


def test_hot_group_is_attached(docs_of):
    got = exact_dedup.exact_groups(docs_of(["same"] * 3000 + [f"t{i}" for i in range(1500)])).collect()
    assert sum(r.keep_id == 2999 for r in got) == 3000 and sum(r.kept for r in got) == 1501


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = ["ä", "Bc", "d", "e", "F", "x y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "", "\t a\nb\x0bc", "w " * 40000]
    ids = list(range(0, 2 * len(texts), 2))
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    roots = roots_of(len(texts), links)
    assert len(links) > 100
    assert got == {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots, strict=True)}


def test_simhash_of_nulls_repeats_and_nothing(docs_of, empty):
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_components(docs_of(["a b c", "a b c", "q r s t", "q r s t", None], [3, 3, None, None, 5])).collect())
    assert got == [("3", 3), ("3", 3), ("5", 5), ("None", None), ("None", None)]
    assert simhash.near_components(empty).count() == 0


@pytest.mark.parametrize("bits,radius", [(64, 2), (16, 2), (16, 4)])
def test_half_balls_meet(bits, radius):
    masks = set(simhash.half_ball(bits, radius))
    rng = np.random.default_rng(1)
    for _ in range(50):
        flips = rng.choice(bits, rng.integers(1, radius + 1), replace=False)
        other = sum(1 << int(b) for b in flips)
        other -= (1 << 64) if other >> 63 else 0
        assert any(m ^ other in masks for m in masks)


def test_chain_of_links_is_one_component(spark):
    from cellweave.llm._common import components

    edges = [(i, i + 1) for i in range(200)] + [(500, 900), (900, 700), (1000, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 900: 500, 700: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_texts(rng, n, changes, words=150):
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(words), changes):
            copy[at] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


def shingle_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_duplicates(docs_of, empty):
    rng = random.Random(2)
    texts = []
    for n, changes in ((1, 1), (3, 2), (60, 3), (2, 12)):
        texts += similar_texts(rng, n, changes)
    texts += [" ".join(f"u{i}x{j}" for j in range(80)) for i in range(40)] + ["short text", "Short  text", None, ""]
    sets = shingle_sets([t or "" for t in texts])
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8]
    roots = roots_of(len(texts), links)
    want = {r for r in roots}
    got = [r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert near_dedup.filter_near(empty).count() == 0
    assert near_dedup.filter_near(docs_of(["a b", "a b"], [None, None])).count() == 2


def kept_by_brute_force(texts):
    sets = shingle_sets(texts)
    return set(roots_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]))


def test_near_low_vocabulary_copies(docs_of):
    rng, texts = random.Random(4), []
    for k in range(20):
        base = [f"v{rng.randrange(20)}" for _ in range(1000)]
        copy = list(base)
        for j in range(20):
            copy.insert(rng.randrange(len(copy)), f"k{k}n{j}")
        texts += [" ".join(base), " ".join(copy)]
    want = kept_by_brute_force(texts)
    assert len(want) < 30
    assert {r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()} == want


def test_near_copies_with_a_part_more_or_less(docs_of):
    texts = []
    for k in range(40):
        base = [f"b{k}w{j}" for j in range(200)]
        texts += [" ".join(base), " ".join(base + [f"a{k}w{j}" for j in range(48)])] if k % 2 else [" ".join(base), " ".join(base[: 161 + k % 8])]
    want = kept_by_brute_force(texts)
    assert len(want) < 60
    assert {r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()} == want


def test_near_chains_and_templates(docs_of):
    rng, texts = random.Random(6), []
    for c in range(3):
        words = [f"c{c}w{j}" for j in range(500)]
        texts += [" ".join(words[i : i + 120]) for i in range(0, 360, 11)]
    page = [f"t{j}" for j in range(100)]
    for g in range(25):
        own = [f"g{g}w{j}" for j in range(40)]
        texts += [" ".join(page + own + [f"x{rng.random()}" for _ in range(4)]) for _ in range(3)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    want = kept_by_brute_force(texts)
    assert len(want) == 28
    assert {r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()} == want


def test_sha256_of_query(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in queries.op6_exact_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_ids_of_any_type(spark):
    texts = [f"w{i} " * 3 + "same words here as everywhere else in this text" for i in (1, 1, 2)]
    for kind in ("int", "long", "string"):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        assert sorted(int(r.doc_id) for r in exact_dedup.filter_duplicates(docs).collect()) == [1, 2]
        assert sorted(int(r.doc_id) for r in near_dedup.filter_near(docs).collect()) == [0, 2]


def test_near_rows_of_one_id_or_none(docs_of):
    base = [f"w{j}" for j in range(60)]
    a, b, other, far = " ".join(base), " ".join(base + ["z"]), "a text that is another one altogether", "and one more that has nothing in common"
    got = near_dedup.filter_near(docs_of([a, b, other, b, far, other], [1, 5, 5, None, None, 7])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", a), ("5", other), ("None", far)])


def test_near_recall_in_a_large_group(docs_of):
    rng = random.Random(9)
    words = [f"g{j}" for j in range(120)]
    texts = []
    for i in range(700):
        copy = list(words)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], [f"n{i}x{at}"], [copy[at], f"n{i}x{at}"]])
        texts.append(" ".join(copy + [f"e{i}x{j}" for j in range(rng.randrange(20))]))
    texts += [" ".join(["a shared passage of many words that stands in texts that are not alike at all"] + [f"p{i}x{j}" for j in range(60)]) for i in range(300)]
    want = kept_by_brute_force(texts)
    assert 310 < len(want) < 900
    assert {r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()} == want


def test_near_chance_of_a_missing_key():
    assert (1 - near_dedup.LEAST**near_dedup.ROWS) ** near_dedup.BANDS < 2e-10
    rng = np.random.default_rng(3)
    for n in (5, 40, 3000):
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            assert np.isin(near_dedup.bands(np.sort(pool[:n])), near_dedup.bands(np.sort(pool))).any()


def test_near_groups_come_from_balls(docs_of, monkeypatch):
    rng, texts = random.Random(11), []
    for k in range(6):
        base = [f"b{k}w{j}" for j in range(2000)]
        texts += [" ".join(base), " ".join(base[:-1] + ["x"])]
    for k in range(3):  # fingerprints of few bits' difference, sets that aren't near
        base = [f"r{k}w{j}" for j in range(5)] * 200
        texts += [" ".join(base), " ".join(base + [f"a{k}n{j}" for j in range(100)])]
    texts += [" ".join(f"u{k}x{rng.random()}" for _ in range(50)) for k in range(5)]
    prints = [brute_print(t) for t in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    sets = shingle_sets(texts)
    near = [(i, j) for i, j in close if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert 0 < len(near) < len(close)
    seen, found = [], near_dedup.ball_links
    monkeypatch.setattr(near_dedup, "ball_links", lambda classes, *a: seen.append(classes) or found(classes, *a))
    assert {r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()} == kept_by_brute_force(texts)
    (classes,) = seen
    assert {r.fp % (1 << 64) for r in classes.collect()} == set(prints)  # those of all texts
    # without what pairs texts by their shingles, the balls' links stay, and the exact check of them
    nothing = lambda rows, *_: rows.selectExpr("rep a", "rep b").limit(0)
    monkeypatch.setattr(near_dedup, "_candidates", nothing)
    monkeypatch.setattr(near_dedup, "_across", nothing)
    assert {r.doc_id for r in near_dedup.filter_near(docs_of(texts)).collect()} == set(roots_of(len(texts), near))


def test_near_groups_free_what_is_spent(spark, docs_of, monkeypatch):
    rng = random.Random(12)
    docs = docs_of([t for n in (3, 8) for t in similar_texts(rng, n, 2)] + [f"another text {i}" for i in range(5)])
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    seen, components = [], near_dedup.components

    def least(edges):
        counts = []
        for _ in range(12):  # the cleaner runs beside
            counts.append(tracker.shuffleStatuses().size() - before)
            time.sleep(0.25)
        seen.append(min(counts))
        return components(edges)

    monkeypatch.setattr(near_dedup, "components", least)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    before = tracker.shuffleStatuses().size()
    assert near_dedup.near_groups(docs).count() == 13
    assert max(seen) < 15, seen


def test_a_hub_meets_all_its_texts(spark):
    """One text in thousands of pairs, some in a few: the near ones are those of a comparison one by one."""
    rng = np.random.default_rng(4)
    base = np.arange(400, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[: 400 - k % 120], 1000 + rng.integers(0, 10**9, k % 3).astype(np.uint64)])) for k in range(3000)]
    rows = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "rep long, n int, held binary").repartition(4)
    pairs = [(i, 0) for i in range(1, 3000)] + [(i, i - 1) for i in range(2, 200)]
    got = near_dedup._verified(spark.createDataFrame(pairs, "a long, b long"), rows).collect()
    want = {p for p in pairs if near_dedup.similarity(sets[p[0]], sets[p[1]]) >= near_dedup.LEAST}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and 0 < len(want) < len(pairs)
