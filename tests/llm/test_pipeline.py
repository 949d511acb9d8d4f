import hashlib

import public_tokenizers as P
import tiktoken

import __spark_entry__
import corpus_pipeline
from cellweave.llm import byte_bpe
from cellweave.llm._common import stored
from test_dedup import roots_of, shingle_sets
from test_records import brute_hits


def test_stages_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data), "t")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    wrong = [i for i, r in labels.items() if (i in kept["toxicity"]) == bool(r.toxic)]
    assert len(wrong) <= 0.03 * len(labels)
    largest = {}
    for i, t in kept["toxicity"].items():
        largest[t] = max(i, largest.get(t, i))
    assert set(kept["exact_dedup"]) == set(largest.values())
    ids = sorted(kept["exact_dedup"])
    sets = shingle_sets([kept["exact_dedup"][i] for i in ids])
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert set(kept["near_dedup"]) == {ids[r] for r in roots_of(len(ids), links)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(kept["decontaminate"]) == {i for i, t in kept["near_dedup"].items() if not brute_hits(t, items)[4]}
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()}
    assert set(last) == set(kept["decontaminate"]) <= set(before)
    for i, r in last.items():
        assert list(r.ids) == oracle.encode_ordinary(before[i]) and r.decoded_sha256 == hashlib.sha256(before[i].encode()).hexdigest()


def test_run_applies_all_stages(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_all_eleven_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_of_nothing(spark, data, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data), "t")
        assert docs.count() == 0


def test_stages_of_nulls_and_repeats(spark, data, docs_of):
    docs = docs_of([None, "", "a b", "a b", "a b", "c d e", "c d e"], [1, 2, 3, None, 3, None, 5])
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data), "t")
        kept.append(sorted((str(r.doc_id), r.text or "") for r in docs.collect()))
    texts = [("1", ""), ("2", ""), ("3", "a b"), ("3", "a b"), ("5", "c d e"), ("None", "a b"), ("None", "c d e")]
    once = [("2", ""), ("3", "a b"), ("3", "a b"), ("5", "c d e")]  # rows that repeat both id and text share one fate
    assert kept == [texts, once, once, once]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sorted((r.doc_id, r.n_tokens > 0) for r in last) == [(2, False), (3, True), (3, True), (5, True)]
