import collections
import itertools
import math
import random
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest

from cellweave.llm import context_mixing, langid, queries, toxicity


@pytest.fixture(scope="session")
def tables_of(spark, tmp_path_factory):
    def make(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        return path

    return make


def brute_marginals(emitted, transitions, begin):
    n, k = emitted.shape
    sums, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        p = begin[path[0]] * np.prod([emitted[i, c] for i, c in enumerate(path)]) * np.prod([transitions[a, b] for a, b in itertools.pairwise(path)])
        total += p
        for i, c in enumerate(path):
            sums[i, c] += p
    return sums / total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    lengths, k = np.array([6, 4, 4, 1, 0]), 3
    emitted, transitions, begin = rng.random((15, k)) + 0.01, rng.random((k, k)), rng.random(k)
    begins = np.array([9, 0, 5, 4, 15])
    sums, gamma = langid.forward_backward(emitted, begins, lengths, transitions, begin, each=True)
    for i, (b, n) in enumerate(zip(begins, lengths, strict=True)):
        want = brute_marginals(emitted[b : b + n], transitions, begin) if n else np.zeros((0, k))
        assert np.allclose(gamma[b : b + n], want) and np.allclose(sums[i], want.sum(axis=0))


def test_language_of_held_out_documents(spark, data):
    got = {r.doc_id: r for r in queries.op1_langid(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_features(word, lexicon):
    """The features of a word one by one, in whole numbers."""
    top, step, mix = 1 << 64, int(langid._NEXT), int(langid._MIX)
    marks = [ord(c) + 1 for c in f"^{word}$"]

    def run(at, k):
        h = marks[at]
        for c in marks[at + 1 : at + k]:
            h = (h * step + c) % top
        return h

    n = len(marks)
    told = [(1, sum(c * pow(step, i + 1, top) for i, c in enumerate(marks)) % top), (2, min(n, 14)), (3, lexicon.get(word, -1) + 1)]
    told += [(2 + k, run(i, k)) for k in (2, 3) for i in range(n - k + 1)]
    told += [x for k in range(2, 6) if n > k for x in ((10 + k, run(0, k)), (20 + k, run(n - k, k)))]
    mixed = [(v + kind * 0x51ED27) * mix % top for kind, v in told]
    return [((m ^ (m >> 29)) * mix % top) >> (64 - langid.HASH_BITS) for m in mixed]


def plain_language(text, field):
    """(label, mean probability) of a text, by a forward-backward of logarithms over one word after the other."""
    words = langid.words_of(text)
    if not words:
        return "und", 0.0
    scores = [sum(field.weights[h].astype(float) for h in plain_features(w, field.lexicon)) for w in words]
    scores = [np.maximum(x - x.max(), -30) for x in scores]
    moves, first = np.log(field.transitions.astype(float)), np.log(field.begin.astype(float))
    forward = [first + scores[0]]
    for x in scores[1:]:
        forward.append(np.logaddexp.reduce(forward[-1][:, None] + moves, axis=0) + x)
    backward = [np.zeros(len(first))]
    for x in reversed(scores[1:]):
        backward.append(np.logaddexp.reduce(moves + x + backward[-1], axis=1))
    both = np.array(forward) + np.array(backward[::-1])
    sums = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]).sum(axis=0)
    return field.labels[sums.argmax()], sums.max() / len(words)


def test_languages_equal_word_by_word_ones(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    field = langid.fit(docs.where("lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 5 = 0").collect()}
    got = {r.doc_id: r for r in queries.op1_langid(spark, data).collect()}
    for i, t in texts.items():
        label, score = plain_language(t, field)
        assert got[i].lang_pred == label and abs(got[i].score - score) < 1e-3


def test_long_and_many_labelled_words(docs_of):
    """Letters beyond a word's longest count, and so does a text's end; there may be many labels."""
    rng = random.Random(2)
    words = {f"l{i}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{rng.choice('xyz')}" for _ in range(5)] for i in range(210)}
    field = langid.train([(x, [rng.choice(w) for _ in range(20)]) for x, w in words.items() for _ in range(2)], sorted(words), epochs=1)
    assert len(field.labels) == 210
    two = {"en": ["the", "house", "think"], "de": ["das", "haus", "schön"]}
    field = langid.train([(x, [rng.choice(w) for _ in range(40)]) for x, w in two.items() for _ in range(20)], ["de", "en"])
    joined = "".join(["house"] * 8 + ["schön"] * 40)
    assert "".join(langid.words_of(joined)) == joined and len(langid.words_of(joined)) == 6
    long = "das haus " + "the think " * 300_000
    got = sorted(langid.identify(docs_of([joined, long]), field).collect())
    assert got[0].n_words == 6 and got[0].lang_pred == "de" and got[1].n_words == 600_002 and got[1].lang_pred == "en" and got[1].n_switches == 1


def test_language_edge_cases(docs_of, empty):
    words = {"en": ["the", "house", "think"], "de": ["das", "haus", "schön"]}
    rng = random.Random(1)
    samples = [(x, [rng.choice(w) for _ in range(40)]) for x, w in words.items() for _ in range(20)]
    field = langid.train(samples, ["de", "en"])
    texts = ["the house think", "das haus", None, "", "12 ½ ²!", "the house think the house think das haus schön das haus schön das haus"]
    got = sorted(langid.identify(docs_of(texts), field).collect())
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "und", "de"] and got[4].score == 0 and got[5].n_switches == 1
    labelled = langid.label_words(docs_of(texts[5:]), field).first().words
    assert [w.label for w in labelled] == ["en"] * 6 + ["de"] * 8
    assert langid.identify(empty, field).count() == 0
    assert {r.lang_pred for r in langid.identify(docs_of(texts), langid.fit(empty)).collect()} == {"und"}


def test_toxic_documents(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    got = {r.doc_id: r.rejected for r in queries.op9_toxicity(spark, data).collect()}
    assert sum(got[r.doc_id] == bool(r.toxic) for r in labels) >= 0.97 * len(labels)


def test_toxicity_chain_generalizes(spark, docs_of, empty):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]

    def text(rude, junk):
        words = rng.choices(plain, k=60)
        words += rng.choices(["rudeword", "Nastyone", "vile"], k=2) if rude else []
        words += ["zzjunk"] * 3 if junk else []
        rng.shuffle(words)
        return " ".join(words)

    kinds = [(rng.random() < 0.3, rng.random() < 0.3) for _ in range(900)]
    docs = docs_of([text(*k) for k in kinds])
    labels = spark.createDataFrame([(i, int(a), int(b), int(a and b)) for i, (a, b) in enumerate(kinds[:500])] + [(3, None, 1, 1), (None, 1, 1, 1), (5000, 1, 0, 0)], "doc_id long, toxic int, junk int, both int")
    chain = toxicity.fit(docs, labels, ["junk", "toxic", "both"])
    got = {r.doc_id: r for r in toxicity.probabilities(docs, chain).collect()}
    fresh = range(500, 900)
    assert all(got[i].rejected == kinds[i][0] for i in fresh)
    assert np.mean([(got[i].p_both > 0.5) == (kinds[i][0] and kinds[i][1]) for i in fresh]) > 0.97
    assert {r.doc_id for r in toxicity.keep_clean(docs, chain).collect()} == {i for i in got if not got[i].rejected}
    assert toxicity.keep_clean(empty, chain).count() == 0
    odd = toxicity.probabilities(docs_of([None, "", "vile vile rudeword nastyone", "vile"], [1, 1, 2, None]), chain).collect()
    assert len(odd) == 4 and not any(r.rejected for r in odd if r.doc_id == 1) and any(r.rejected for r in odd if r.doc_id == 2)
    nothing = toxicity.fit(docs, labels.limit(0), ["junk", "toxic", "both"])
    assert not any(r.rejected for r in toxicity.probabilities(docs, nothing).collect())


def plain_toxicity(text, chain):
    """A text's probabilities, one category after the other, by sums over its features."""
    words = {w.lower() for w in bytes(text or "", "utf-8").lower().translate(toxicity.SPACES).decode().split()}
    found = {f for w in words for f in (w, *(f"{w[:n]}-" for n in (4, 5, 6, 7) if len(w) >= n))}
    earlier, out = [], []
    for w in chain.models:
        width = len(chain.place)
        z = w[-1] + sum(w[chain.place[f]] for f in found if f in chain.place) + sum(a * b for a, b in zip(earlier, w[width:-1], strict=True))
        earlier.append(min(max(z, -20), 20))
        out.append(1 / (1 + math.exp(-earlier[-1])))
    return out


def test_toxicity_equals_sums_over_features(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chain = queries.toxicity_chain(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op9_toxicity(spark, data).collect():
        want = plain_toxicity(texts[r.doc_id], chain)
        assert np.allclose([r.p_low_quality, r.p_toxic, r.p_toxic_low_quality], want, atol=1e-6) and r.rejected == (want[1] > 0.5)


def test_toxicity_of_held_out_documents(spark, data):
    """Learned from the labels of even ids, it finds the toxic ones among the odd."""
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/{n}.parquet") for n in ("documents", "labels"))
    chain = queries.toxicity_chain(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.rejected for r in toxicity.probabilities(docs.where("doc_id % 2 = 1"), chain).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got and r.toxic is not None]
    caught = sum(got[r.doc_id] and r.toxic > 0 for r in held)
    assert sum(got[r.doc_id] == (r.toxic > 0) for r in held) >= 0.97 * len(held)
    assert caught >= 0.8 * sum(r.toxic > 0 for r in held) and caught >= 0.95 * sum(got[r.doc_id] for r in held)


def test_labels_of_one_category_only(spark, docs_of):
    """A toxic label counts although the other category's is null; very long texts are read to their ends."""
    texts = ["vile rudeword here", "calm words here"] * 40 + ["calm words " * 300_000 + "vile rudeword"]
    labels = spark.createDataFrame([(i, None, 1 - i % 2) for i in range(80)], "doc_id long, junk int, toxic int")
    got = {r.doc_id: r for r in toxicity.probabilities(docs_of(texts), toxicity.fit(docs_of(texts), labels, ["junk", "toxic"])).collect()}
    assert all(got[i].rejected == (i % 2 == 0) for i in range(80)) and got[80].p_toxic > got[1].p_toxic


def brute_base(docs):
    counts = collections.Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for _, t in docs:
        tokens = [*(t or "").encode().lower().split(), None]
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def test_scores_of_words(docs_of, empty, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "epsilon", "É", "x" * 100]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (502, "q" * 50_000), (600, "\x01\x02 zz"), (7, "alpha"), (7, "alpha")]
    monkeypatch.setattr(context_mixing, "BLOCK_TOKENS", 200)
    got = sorted(context_mixing.score(docs_of([t for _, t in docs], [i for i, _ in docs])).collect())
    want = sorted((i, *w) for (i, _), w in zip(docs, brute_base(docs), strict=True))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score <= 0 and r.bits_per_byte >= 0
    score = {r.doc_id: r.score / r.n_tokens for r in got}
    # known words are likely, unknown ones aren't, but possible
    assert -3 < score[7] and score[600] < score[7] and math.isfinite(score[502])
    assert context_mixing.score(empty).count() == 0
    alone = context_mixing.score(docs_of(["a b"], [None])).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score, alone.held_out) == (3, 0, 0, 0.0, False)


def plain_code(byte):
    """The bits of a byte's code, each with its node."""
    common = b"abcdefghijklmnopqrstuvwxyz \n"
    head = common.index(byte) if byte in common else 28 + (byte >> 6)
    out = [(head >> (4 - i) & 1, (1 << i) | (head >> (5 - i))) for i in range(5)]
    if byte not in common:
        out += [((byte & 63) >> (5 - i) & 1, 64 + (byte >> 6) * 64 + ((1 << i) | ((byte & 63) >> (6 - i)))) for i in range(6)]
    return out


def plain_slots(before, byte):
    """By predictor, the (slot, bit) of each bit of a byte after the bytes before, in plain Python."""
    m, out, context = (1 << 64) - 1, [], 0
    odd, more = int(context_mixing._ODD), int(context_mixing._MORE)
    for k, bits in enumerate(context_mixing.SLOT_BITS):
        context = (context * 521 + before[-k - 1] + 1) & m
        mixed = ((context + k) * odd) & m
        mixed ^= mixed >> 29
        own = []
        for bit, node in plain_code(byte):
            x = (mixed + node * more) & m
            x ^= x >> 31
            own.append((((x * odd) & m) >> (64 - bits), bit))
        out.append(own)
    return out


def plain_bytes(text):
    """Each byte of a text as it is coded, with the bytes before it."""
    data = context_mixing.PAD + b"".join(w + b" " for w in text.lower().encode().split()) + b"\n"
    return [(data[:i], data[i]) for i in range(len(context_mixing.PAD), len(data))]


TEXTS = ["red apple pie", "a red apple", "Red APPLE pie and more", "", "blue sky " * 30, "é ü", "red apple pie"]


def plain_model(parts):
    """Tables of counts' codes, weights that differ, and a map that isn't flat."""
    rng = np.random.default_rng(6)
    weights = context_mixing.first_weights() + rng.normal(0, 0.1, (context_mixing.GATES, context_mixing.INPUTS))
    return context_mixing.Model(parts, weights, np.clip(context_mixing.flat_map() ** 1.1, 0.001, 0.999))


def test_contexts_are_counted(spark):
    parts = context_mixing.count_contexts(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    want = [collections.Counter() for _ in context_mixing.SLOT_BITS]
    for t in TEXTS:
        for before, byte in plain_bytes(t):
            for k, own in enumerate(plain_slots(before, byte)):
                want[k].update(own)
    for table, counts in zip(context_mixing.Model(parts, context_mixing.first_weights(), context_mixing.flat_map()).tables, want, strict=True):
        codes = np.zeros((len(table), 2), np.uint8)
        for (slot, bit), n in counts.items():
            codes[slot, bit] = round(8 * math.log2(1 + n))
        assert (table.view(np.uint8).reshape(-1, 2) == codes).all()


def test_texts_are_coded_by_words():
    for t in [*TEXTS, None, " \t ", "A\n\n\v b\u00a0\u2003C\x1c d ", "x" * 9, "\ud800 e"]:
        words = context_mixing.words_of(t)
        assert context_mixing.coded(t) == b"".join(w + b" " for w in words) + b"\n"


def plain_price(model, before, byte):
    """Natural logarithm of the byte's probability, bit by bit."""
    total, every = 0.0, plain_slots(before, byte)
    for i in range(len(every[0])):
        x, gate = [], int(before[-1] <= 0x20)
        for k, own in enumerate(every):
            code = int(model.tables[k][own[i][0]])
            zero, one = 2 ** ((code & 255) / 8) - 1, 2 ** ((code >> 8) / 8) - 1
            x.append(math.log((one + context_mixing.PRIOR) / (zero + context_mixing.PRIOR)))
            if k >= 2:
                gate = gate * 3 + (0 if zero + one < 0.5 else 1 if min(zero, one) < 0.5 else 2)
        odds = max(-18.0, min(18.0, float(np.dot([*x, 0.3], model.weights[gate]))))
        p, at = 1 / (1 + math.exp(-odds)), (odds + context_mixing.REACH) * (context_mixing.LEVELS - 1) / (2 * context_mixing.REACH)
        if abs(odds) < context_mixing.REACH:
            at = min(max(at, 0), context_mixing.LEVELS - 1.001)
            row = model.refined[gate]
            p = (p + 3 * (row[int(at)] * (1 - at % 1) + row[int(at) + 1] * (at % 1))) / 4
        p = min(max(p, 1e-6), 1 - 1e-6)
        total += math.log(p if every[0][i][1] else 1 - p)
    return total


@pytest.mark.parametrize("at_a_time", [40, 1 << 20])
def test_prices_equal_bit_by_bit_ones(spark, monkeypatch, at_a_time):
    model = plain_model(context_mixing.count_contexts(spark.createDataFrame([(t,) for t in TEXTS], "text string")))
    monkeypatch.setattr(context_mixing, "PRICE_BYTES", at_a_time)
    texts = [*TEXTS, "red sky é", "zzz"]
    got = model.prices(*context_mixing.laid_out([context_mixing.coded(t) for t in texts]))
    want = [plain_price(model, before, byte) for t in texts for before, byte in plain_bytes(t)]
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def most_held(f):
    """Bytes that f allocates at most at a time."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_beside_the_text_is_bounded():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(3000)]
    laid = context_mixing.laid_out([context_mixing.coded(" ".join(rng.choices(words, k=1000))) for _ in range(1500)])
    n = len(laid[0])
    model = context_mixing.Model([], context_mixing.first_weights(), context_mixing.flat_map())
    # four bytes for each price
    assert n > 7 << 20 and most_held(lambda: model.prices(*laid)) < 4 * n + (48 << 20)
    assert most_held(lambda: context_mixing.Runs(*laid)) < 64 << 20


def test_prices_that_are_let_go_come_again(spark, monkeypatch):
    model = plain_model(context_mixing.count_contexts(spark.createDataFrame([(t,) for t in TEXTS], "text string")))
    laid = context_mixing.laid_out([context_mixing.coded(t) for t in [*TEXTS, "red sky é", *TEXTS]])
    whole = model.prices(*laid)
    monkeypatch.setattr(context_mixing, "PRICE_BYTES", 40)
    monkeypatch.setattr(context_mixing, "KNOWN_RUNS", 50)
    known = context_mixing.Known(laid[0])
    assert (model.prices(*laid, known) == whole).all() and len(known.key) <= 50


@pytest.mark.parametrize("at_a_time", [7, 64, 1 << 18])
def test_words_are_laid_out_as_texts_are(monkeypatch, at_a_time):
    monkeypatch.setattr(context_mixing, "BYTES_AT_A_TIME", at_a_time)
    texts = [*TEXTS, "q" * 300, None, "é " * 40 + "x" * 80, "red"]
    place = {}
    tokens = [[place.setdefault(w, len(place)) for w in [*context_mixing.words_of(t), b""]] for t in texts]
    words = context_mixing.Words(b" ".join(place))
    got = words.laid_out(np.array([i for t in tokens for i in t], np.int32), np.array([len(t) for t in tokens]))
    want = context_mixing.laid_out([context_mixing.coded(t) for t in texts])
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(got, want, strict=True))
    key = context_mixing.Runs(*got, inverse=True)
    monkeypatch.undo()
    other = context_mixing.Runs(*want, inverse=True)
    assert key.key.tolist() == other.key.tolist() and key.number.tolist() == other.number.tolist()


def test_next_bytes_chances_sum_to_one_at_most(spark):
    model = plain_model(context_mixing.count_contexts(spark.createDataFrame([(t,) for t in TEXTS], "text string")))
    for before in (context_mixing.PAD, b"red a", b"apple", b" pie ", b"zz\xc3\xa9"):
        flat = np.frombuffer(b"".join((context_mixing.PAD + before)[-5:] + bytes([b]) for b in range(256)), np.uint8)
        got = model.prices(flat, np.arange(len(flat)) % 6 == 5)
        total = np.exp(got.astype(float)).sum()
        assert len(got) == 256 and 0.9 < total < 1 + 1e-4  # codes of escaped letters stand for nothing


def test_long_texts_are_learned_by_segments(monkeypatch):
    data = b"some words and some more " * 20 + b"\n"
    whole = context_mixing._segments([(data, 0)])
    cut = context_mixing._segments([(data[max(0, a - 5) : a + 37], min(a, 5)) for a in range(0, len(data), 37)])
    assert [x.tolist() for x in whole.bytes] == [x.tolist() for x in cut.bytes] and whole.times.tolist() == cut.times.tolist()


def test_learning_finds_the_better_weights(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["salt water", "fresh bread", "cold wind", "warm fire"], k=20)) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    parts = context_mixing.count_contexts(table.select("text"))
    weights, refined = context_mixing.learn(table, parts)
    runs = context_mixing._segments([(context_mixing.coded(t), 0) for t in texts[:50]])
    laid = context_mixing.laid_out([context_mixing.coded(t) for t in texts[:50]])
    before = context_mixing.Model(parts, context_mixing.first_weights(), context_mixing.flat_map())
    after = context_mixing.Model(parts, weights, refined)
    assert len(runs) and after.prices(*laid).sum() > before.prices(*laid).sum()


def test_one_model_whatever_the_tasks_and_held_out_texts(spark, docs_of):
    rng = random.Random(5)
    pairs = ["north wind", "south sea", "old house", "new road", "high tower"]
    texts = [" ".join(rng.choices(pairs, k=12)) for _ in range(150)]
    ids = list(range(1000, 1150))
    more = [i for i in range(5000, 5200) if zlib.crc32(str(i).encode()) % 7 == 2]
    score = lambda d: {r.doc_id: r.score for r in context_mixing.score(d).collect()}
    one, many = score(docs_of(texts, ids).repartition(1)), score(docs_of(texts + ["quite other words"] * len(more), ids + more).repartition(6))
    assert all(abs(one[i] - many[i]) < 1e-3 * abs(one[i]) for i in ids)
    # what words follow each other counts
    held = [i for i in range(6000, 6100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    fluent = "north wind old house south sea new road high tower"
    turned = "wind tower north road house new old sea high south"
    both = score(docs_of([*texts, fluent, turned], ids + held))
    assert both[held[0]] > both[held[1]] + 2


def test_scores_of_held_out_text(spark, data):
    got = [r for r in queries.op10_context_mixing(spark, data).collect() if r.held_out]
    per_byte = sum(r.bits_per_byte for r in got) / len(got)
    assert len(got) > 10 and per_byte < 3


def brute_mixed(text, price, often):
    """Word by word: the chances of each share of training words and of a text's own."""
    shares = {(f, r): 1 / (len(context_mixing.REPEATS) * len(context_mixing.FREQUENT)) for f in context_mixing.FREQUENT for r in context_mixing.REPEATS}
    total = 0.0
    for t, w in enumerate(text):
        each = {}
        for f, r in shares:
            plain = (1 - f) * math.exp(price[t]) + f * often[t]
            each[f, r] = (1 - r) * plain + r * text[:t].count(w) / t if t else plain
        now = sum(shares[k] * each[k] for k in shares)
        shares = {k: shares[k] * each[k] / now for k in shares}
        total += math.log10(now)
    return total


def test_mixture_equals_word_by_word_sums(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(context_mixing, "SLICE", 25)
    sizes = np.array([1, 7, 30, 2, 11, 40, 1])
    tokens, price, often = rng.integers(0, 9, sizes.sum()).astype(np.int32), -3 * rng.random(sizes.sum()), rng.random(sizes.sum()) / 20
    got = context_mixing.mixed(tokens, sizes, price, often)
    ends = np.cumsum(sizes)
    want = [brute_mixed(tokens[e - n : e].tolist(), price[e - n : e], often[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    assert np.allclose(got, want)


def test_mixture_is_a_distribution():
    """Over what can come next: the words of a closed vocabulary, whose spelled chances and frequencies sum to one."""
    rng = np.random.default_rng(3)
    spelled, often = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
    for held in ([], [1], [1, 4, 1, 0]):
        tokens = np.array([x for w in range(6) for x in (*held, w)], np.int32)
        sizes = np.full(6, len(held) + 1)
        total = (10 ** context_mixing.mixed(tokens, sizes, np.log(spelled)[tokens], often[tokens])).sum()
        before = 10 ** context_mixing.mixed(np.array(held, np.int32), np.array([len(held)]), np.log(spelled)[held], often[held])[0] if held else 1.0
        assert abs(total - before) < 1e-9


def test_scores_of_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), (None, "x")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in context_mixing.score(docs).collect()) == [("None", 2), ("a", 3), ("b", 1)]


def test_model_beats_the_base_on_held_out_text(spark, data):
    got = [r for r in queries.op10_context_mixing(spark, data.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_steps_shuffles_go_before_the_last_step(spark, docs_of):
    """What the steps of op10 have shuffled doesn't stay on disk beside what its last step shuffles."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    there = lambda: {p.name for d in folders for p in Path(d).rglob("shuffle_*")}
    docs, before = docs_of([f"some words {i % 7} of {i}" for i in range(200)]), there()
    scored = context_mixing.score(docs)
    for _ in range(40):  # files go a little later than what refers to them
        if not there() - before:
            break
        time.sleep(0.25)
    assert not there() - before
    assert scored.count() == 200
