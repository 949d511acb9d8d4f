import hashlib
import json
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import forced_bpe, queries

PATH = P.path("word_bpe_49k.json")
ODD = [
    "", "Hello  world's\n\n\tcafé 中文 😀 ́x ﬁ", "a" * 3000, " " * 500, "<|endoftext|> <|startoftext|>A", "x²½Ⅷ İß don't'LL ΣΑΣ ς", "\x00\x1c\x85   a b", "!?" * 40, "qzxjqk" * 300,
    "<|endoftext|<|endoftext|>x", "A<|ENDOFTEXT|>", "</w> a</w>", "é ́a", "ab" * 20_000, "中" * 5000, "각 가", "l'l ' 's''s",
]


@pytest.fixture(scope="module")
def bpe():
    return forced_bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def oracle():
    return Tokenizer.from_file(PATH)


def row_of(oracle, text):
    ids = oracle.encode(text or "", add_special_tokens=False).ids
    decoded = oracle.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_equals_tokenizer_on_test_data(spark, data, oracle):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_forced_bpe(spark, data).collect()}
    assert got == {d.doc_id: row_of(oracle, d.text) for d in docs}


def test_odd_texts(docs_of, empty, oracle):
    texts = [*ODD, None, ODD[1]]
    got = sorted(forced_bpe.encode(docs_of(texts), PATH).collect())
    for r, t in zip(got, texts, strict=True):
        assert tuple(r)[1:4] == row_of(oracle, t) and list(r.ids) == oracle.encode(t or "", add_special_tokens=False).ids
    assert forced_bpe.encode(empty, PATH).count() == 0 and forced_bpe.encode(docs_of(["a", "a"], [None, None]), PATH).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    bpe, oracle = forced_bpe.encoder(PATH), Tokenizer.from_file(PATH)
    ids = oracle.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids and bpe.decode(ids) == oracle.decode(ids, skip_special_tokens=False)
    n, decimals, _ = bpe.texts(pa.array(["skipped", text, None]).slice(1))
    assert n.tolist() == [len(ids), 0] and decimals.to_pylist() == [" ".join(map(str, ids)), ""]


def test_cuts_are_borders_of_tokens(bpe):
    """Fragments hold no pair that is outside all tokens, and merging them apart gives what merging all at once does."""
    rng, v = random.Random(5), bpe.vocabulary
    cut = 0
    for _ in range(400):
        symbols = v.symbols("".join(rng.choices("abcdeqxzjkvÃ¤©Ł", k=rng.randrange(1, 40))))
        parts = list(v.fragments(symbols))
        assert [s for p in parts for s in p] == symbols and all(pair in v.inside for p in parts for pair in zip(p, p[1:]))
        assert all((a[-1], b[0]) not in v.inside for a, b in zip(parts, parts[1:]))
        assert [i for p in parts for i in v.merged(p)] == v.merged(symbols)
        cut += len(parts) - 1
    assert cut > 400


@pytest.mark.parametrize("together", [True, False])
def test_latin_words(bpe, oracle, together, monkeypatch):
    assert bpe.vocabulary.together
    monkeypatch.setattr(bpe.vocabulary, "together", together)
    texts = [f"{chr(c)}{s} a{chr(c)}B 1{chr(c)}2" for c in (*range(0x21, 0x7F), *range(0x80, 0x2B0)) for s in ("", "!", "<", "'s", "9", "\u0301")]
    _, decimals, decoded = bpe.texts(pa.array(texts))
    for t, d, x in zip(texts, decimals.to_pylist(), decoded.to_pylist(), strict=True):
        ids = oracle.encode(t, add_special_tokens=False).ids
        assert d == " ".join(map(str, ids)) and x == oracle.decode(ids, skip_special_tokens=False), t


def test_long_fragments_merge_alike(bpe):
    rng, v = random.Random(6), bpe.vocabulary
    for n in (1, 2, 30, 90):
        symbols = v.symbols("".join(rng.choices("aenrst", k=n)))
        assert v._merged_long(symbols) == v.merged(symbols)


def test_caches_are_bounded(monkeypatch, oracle):
    monkeypatch.setattr(forced_bpe, "CACHE", 7)
    bpe = forced_bpe.Encoder(PATH)
    for _ in range(2):
        for t in ODD:
            assert bpe.texts(pa.array([t]))[1].to_pylist() == [" ".join(map(str, oracle.encode(t, add_special_tokens=False).ids))]
    assert max(map(len, (bpe.known, bpe.words, bpe.pieces))) <= 7


def test_other_files_are_refused(tmp_path):
    told = json.load(open(PATH))
    told["model"]["unk_token"] = "<|endoftext|>"
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="unk_token"):
        forced_bpe.Vocabulary(str(tmp_path / "t.json"))
