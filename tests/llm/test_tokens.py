import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from cellweave.llm import byte_bpe, queries, wavelet

RANKS = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
ODD = ["", "Hello  world's\n\n\tcafé 中文 😀 ́x ﬁ", "a" * 3000, " " * 500, "<|endoftext|> <|startoftext|>A", "x²½Ⅷ İß don't I'LL", "\x00\x1c\x85  ", "!?" * 40, "thntiedin," * 100]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Encoder(RANKS, P.PATTERN)


def test_bpe_equals_tiktoken_on_test_data(spark, data, oracle):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, data).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = oracle.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_bpe_of_odd_texts(docs_of, empty, oracle):
    encode = lambda df: byte_bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = sorted(encode(docs_of([*ODD, None])).collect())
    for r, t in zip(got, [*ODD, ""], strict=True):
        assert list(r.ids) == oracle.encode_ordinary(t) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert encode(empty).count() == 0 and encode(docs_of(["a", "a"], [None, None])).count() == 2


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    bpe, oracle = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert bpe.encode(text) == oracle.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()


def test_prefixes_appends_and_edits(bpe):
    rng, v = random.Random(4), bpe.vocabulary
    fresh = lambda data: byte_bpe.Prefixes(v, data).ids()
    data = "internationalizationsüberschwänglichkeiten".encode() * 8
    held = byte_bpe.Prefixes(v)
    for i in range(0, len(data), 7):
        held.append(data[i : i + 7])
    assert held.ids() == fresh(data)
    assert all(held.ids(stop) == fresh(data[:stop]) for stop in range(0, len(data), 31))
    for _ in range(60):
        at, removed = rng.randrange(len(data) + 1), rng.randrange(4)
        removed, added = min(removed, len(data) - at), bytes(rng.choices(b"abcdefstuvn", k=rng.randrange(4)))
        anew = held.edit(at, removed, added)
        data = data[:at] + added + data[at + removed :]
        assert held.ids() == fresh(data) and held.last == byte_bpe.Prefixes(v, data).last
        assert anew <= len(data) - at
    held.edit(3, 1, b"x")
    assert held.edit(3, 1, b"y") < len(data) / 2


def test_words_equal_tokenizer():
    words, tokenizer = wavelet.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for t in [*ODD, "É é É ﬁn 'S 12,3 a\u0085b", "Ǆ ẞ ſ"]:
        assert words.text(t, b"\2\0\0\0").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


class Counted(wavelet.Words):
    asked = 0

    def __getitem__(self, word):
        self.asked += 1
        return super().__getitem__(word)

    def get(self, word):
        self.asked += 1
        return super().get(word)


def test_words_are_looked_up_once_a_batch():
    words, tokenizer, text = Counted(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json")), "Internal, INTERNAL! internal 7th " * 500
    assert words.text(text, b"\2\0\0\0").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert words.asked <= 10


@pytest.mark.parametrize("cache", [1, 1000])
def test_words_of_a_batch_equal_tokenizer(cache, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", cache)
    monkeypatch.setattr(wavelet, "PIECES", 7)
    words, tokenizer = wavelet.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    latin = [f"{chr(c)}{s} a{chr(c)}B" for c in range(0x80, 0x2B0) for s in ("", "!", "<", "'s", "9")]
    texts = ["skipped", None, *ODD, *latin, "a </w> b</w>", "<|endoftext|>!", "x" * 200 + ",,", None, "  "]
    batch = pa.array(texts, pa.string()).slice(1)
    for _ in range(2):  # the second time from what is kept
        ids, ends = words.texts(batch)
        for t, a, b in zip(texts[1:], ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
        assert ends[-1] == len(ids) and len(words) <= cache
    words.last[:] = False  # as of a file that doesn't mark the ends of pieces
    words.clear()
    assert words.texts(batch)[0].tolist() == ids.tolist()


def test_planes_are_built_in_steps(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 1 << 16, 1000).astype(np.uint16)
    monkeypatch.setattr(wavelet, "STEP", 64)
    for n in (0, 1, 63, 64, 65, 1000):
        planes, zeros, order = *wavelet.build(ids[:n], 16), ids[:n]
        for b, plane, z in zip(range(15, -1, -1), planes, zeros, strict=True):
            bit = order >> b & 1
            assert np.unpackbits(plane, count=n, bitorder="little").tolist() == bit.tolist() and z == int((bit == 0).sum())
            order = np.concatenate([order[bit == 0], order[bit == 1]])


def test_shards_of_test_data(spark, data):
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in queries.op5_wavelet(spark, data).collect()}
    for d in docs:
        ids = [*tokenizer.encode(d.text, add_special_tokens=False).ids, 2]
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def shard_of(tmp_path, ids, bits):
    path = f"{tmp_path}/s.wave"
    with fs.LocalFileSystem().open_output_stream(path) as out:
        for part in wavelet.dump(np.array(ids, np.uint32), np.array([1]), np.array([True]), np.array([len(ids)]), bits):
            out.write(part)
    return wavelet.Shard(fs.LocalFileSystem().open_input_file(path))


@pytest.mark.parametrize("bits,n", [(5, 1), (5, 2000), (16, 700), (17, 300), (3, 0)])
def test_wavelet_operations(tmp_path, bits, n, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 16)
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << bits, n) // rng.choice([1, 7], n)).tolist()
    shard = shard_of(tmp_path, ids, bits)
    assert shard.all().tolist() == ids
    assert [shard.access(i) for i in range(n)] == ids
    for t in {*ids[:20], 0, (1 << bits) - 1}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert shard.count(t) == len(places) and shard.occurrences(t) == places
        assert all(shard.rank(t, e) == sum(p < e for p in places) for e in range(0, n + 1, max(1, n // 9)))
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(0, n)


def test_shards_of_nulls_repeats_and_nothing(spark, docs_of, empty):
    path = P.path("word_bpe_49k.json")
    got = [(r.doc_id, r.start, r.n_tokens) for r in wavelet.round_trip(docs_of(["a b", None, "c", "c", ""], [5, None, 2, 2, 9]), path).orderBy("start").collect()]
    assert got == [(None, 0, 1), (2, 1, 2), (2, 3, 2), (5, 5, 3), (9, 8, 1)]
    assert wavelet.round_trip(empty, path).count() == 0
    encoded = wavelet.encode_ids(docs_of(["a b a"] * 40), path, 2)
    manifest = wavelet.write_shards(encoded, wavelet.shared_folder(spark, "t"), shard_ids=50)
    assert manifest.count() > 1
    token = Tokenizer.from_file(path).encode("a", add_special_tokens=False).ids[0]
    found = wavelet.look_up(manifest, token).collect()
    assert sum(r.n for r in found) == 80 and sorted(p for r in found for p in r.places) == sorted(p for i in range(40) for p in (4 * i, 4 * i + 2))
    assert pa.types.is_integer(pa.int64())
