import json

import pytest
from pyspark.sql import functions as F

from cellweave.operators import alignment, eda, layout, matching, reconcile, verify
from cellweave.plans import evaluation, extraction
from cellweave.sources import records, sinks


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


@pytest.fixture
def files(tmp_path):
    gold = [{"pdf": "a.pdf", "Country": "USA", "N cases": 3, "Age": [4, 5], "Study": "Smith 2001"}, {"pdf": "b.pdf", "Country": "NL", "Study": "Jones 2002"}, {"pdf": "c.pdf", "Country": "UK"}]
    predicted = [{"pdf": "a.pdf", "Country": "x"}, "", {"pdf": "a.pdf", "Country": "United States", "Number of Cases": "3", "Age": "4-5", "Study": "Smith 2001"}, {"pdf": "b.pdf", "Country": "Germany"}, {"pdf": "d.pdf"}]
    told = [{"pdf": "b.pdf", "verdicts": {"Country": {"verdict": "supported", "quote": "in Germany"}}}, {"pdf": "a.pdf", "verdicts": {"Country": {"verdict": "contradicted", "quote": "q"}}}]
    return {n: write(tmp_path / f"{n}.jsonl", r) for n, r in (("gold", gold), ("predicted", predicted), ("told", told))}


def test_evaluation_of_files(spark, files):
    out = evaluation.evaluate_files(spark, files["predicted"], files["gold"], files["told"])
    metrics = {r.field: r for r in out["metrics"].collect()}
    assert (metrics["Country"].tp, metrics["Country"].fp, metrics["Country"].fn) == (1, 1, 1)
    assert (metrics["Age"].tp, metrics["Number of Cases"].tp) == (1, 1)
    assert metrics[None].tp == 4 and metrics[None].fn == 2
    assert tuple(out["documents"].first()) == (2, 1, 0.5)
    assert {(r.key, r.side) for r in out["keys"].collect()} == {("a.pdf", "both"), ("b.pdf", "both"), ("c.pdf", "missing"), ("d.pdf", "extra")}
    crossed = {r.verdict: (r.agree, r.disagree) for r in out["crosstab"].collect()}
    assert crossed == {"supported": (0, 1), "contradicted": (1, 0), "not_in_text": (0, 0), "inferred": (0, 0)}
    assert {(r.kind, r.key) for r in out["suspects"].collect()} == {("gold_suspect", "b.pdf"), ("both_suspect", "a.pdf")}


def test_bad_lines_fail(spark, tmp_path):
    with pytest.raises(Exception, match="no JSON object"):
        records.json_lines(spark, write(tmp_path / "x.jsonl", ["[1]"])).collect()
    with pytest.raises(Exception, match="no pdf"):
        records.records_by_key(records.json_lines(spark, write(tmp_path / "y.jsonl", [{"pdf": " "}]))).collect()
    dropped = records.records_by_key(records.json_lines(spark, str(tmp_path / "y.jsonl")), blank="drop")
    assert dropped.count() == 0


def test_three_sources_to_gold(spark, tmp_path):
    load = lambda name, rows: records.records_by_key(records.json_lines(spark, write(tmp_path / name, rows)))
    legacy = load("l", [{"pdf": "a", "Study": "S 1999", "Country": "USA", "Age": 4, "Gender": "F"}])
    a = load("a", [{"pdf": "a", "Country": "us", "Age": 5, "Gender": "girl", "Setting": {"value": "UC", "evidence_quote": "clinic", "page": 3}}])
    b = load("b", [{"pdf": "a", "Country": "U.S.", "Age": 5, "Gender": "x"}])
    issues = spark.createDataFrame([("a", "missing_input_pdf", "", "gone")], "key string, issue_type string, related string, evidence string")
    out = evaluation.review(legacy, a, b)
    silver = {r.field: r for r in out["silver"].collect()}
    assert set(silver) == {"Country"} and silver["Country"].silver_value_json == '"USA"'
    review = {r.field: r for r in out["review"].collect()}
    assert review["Age"].status == "two_llms_agree_legacy_diff" and review["Age"].suggested_value_json == "5"
    assert review["Gender"].status == "legacy_llm_a_agree"
    assert review["Setting"].status == "one_source_only" and review["Setting"].suggested_source == "llm_a"
    assert (review["Setting"].evidence_quote, review["Setting"].page) == ("clinic", "3")
    assert {r.study for r in out["review"].collect()} == {"S 1999"}
    counts = {r.status: r.n for r in out["counts"].where("field IS NULL").collect()}
    assert sum(counts.values()) == 23 and counts["all_missing"] == 19
    assert evaluation.review(legacy, a, b, issues)["review"].first().review_action == "fix_pdf_alignment_first"
    rows = out["review"].withColumn("reviewed_value_json", F.when(F.col("field") == "Age", "5").otherwise(""))
    old = records.cells(legacy).select("key", "field", F.to_json("value").alias("value_json"))
    gold = {r.field: (r.value_json, r.origin) for r in reconcile.gold(old, out["silver"], rows).collect()}
    assert gold["Country"] == ('"USA"', "silver") and gold["Age"] == ("5", "reviewed") and gold["Gender"] == (None, "missing") and gold["Study"] == ('"S 1999"', "legacy")
    with pytest.raises(ValueError, match="Gender"):
        reconcile.require_complete(reconcile.gold(old, out["silver"], rows))
    assert reconcile.gold(old, out["silver"], rows, partial=True).where("origin = 'missing'").count() == 0
    with pytest.raises(Exception, match="repeated key"):
        reconcile.gold(old, out["silver"].union(out["silver"]), rows).collect()


def test_quotes(spark):
    told = spark.createDataFrame([("a", "f", "supported", "Big\n cat"), ("a", "g", "contradicted", "dog"), ("a", "h", "inferred", "big"), ("b", "f", "supported", "x")], "key string, field string, verdict string, quote string")
    texts = spark.createDataFrame([("a", "The BIG   cat sat")], "key string, text string")
    got = verify.annotate_quotes(told, texts)
    assert {(r.key, r.field): r.quote_matched for r in got.collect()} == {("a", "f"): True, ("a", "g"): False, ("a", "h"): None, ("b", "f"): None}
    assert verify.verdict_summary(got).where("key = 'a'").first().quote_unmatched == 1


def test_layout(spark):
    rows = [("d", 1, i, 100.0, 100.0, 5.0 if i < 4 else 55.0, 10.0 * (i % 4) + 10, 45.0 if i < 4 else 95.0, 10.0 * (i % 4) + 19, f"line{i}-" if i == 0 else f"w{i}", 10.0) for i in range(8)]
    lines = spark.createDataFrame([*rows, ("d", 1, 9, 100.0, 100.0, 50.0, 97.0, 52.0, 99.0, "17", 8.0)], "doc string, page int, ord int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    got = [(r["column"], r["text"], r["line_count"]) for r in layout.reading_blocks(lines).orderBy("column", "block").collect()]
    assert got == [(0, "line0-w1 w2 w3", 4), (1, "w4 w5 w6 w7", 4)] or got == [(0, "line0- w1 w2 w3", 4), (1, "w4 w5 w6 w7", 4)]


def test_matching_of_names(spark):
    studies = spark.createDataFrame([("Smith 2001",), ("Van Berg & Jones, 1999",), ("Nothing",), ("Lee2004 a",)], "study string")
    names = spark.createDataFrame([("smith 2001.pdf",), ("berg jones 1999 paper.pdf",), ("Lee_2004_a.PDF",), ("x.pdf",)], "file string")
    got = {r.study: (r.file, r.tier) for r in alignment.match_studies(studies, names).collect()}
    assert got == {"Smith 2001": ("smith 2001.pdf", "exact"), "Van Berg & Jones, 1999": ("berg jones 1999 paper.pdf", "author_year"), "Nothing": (None, None), "Lee2004 a": ("Lee_2004_a.PDF", "slug")}
    assert {r.study: r.file for r in alignment.by_containment(studies, names).collect()}["Smith 2001"] == "smith 2001.pdf"
    assert {r.citation: r.file for r in alignment.cited(spark.createDataFrame([("Smith, J. (2001)",)], "citation string"), names).collect()} == {"Smith, J. (2001)": "smith 2001.pdf"}


def test_duplicates_and_missing_authors(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "file string, sha256 string")
    studies = spark.createDataFrame([("a", "Smith 2001"), ("b", "Jones"), ("z", "Q")], "key string, study string")
    dup = {r.key: r.related for r in alignment.duplicate_files(found, studies).collect()}
    assert dup == {"a": "b (Jones)", "b": "a (Smith 2001)"}
    pages = spark.createDataFrame([("a", "a_blocks.json", "by SMITH"), ("b", "b_blocks.json", " ")], "key string, name string, text string")
    got = {r.key: r.issue_type for r in alignment.author_absent(studies, found, pages).collect()}
    assert got == {"b": "empty_extracted_blocks", "z": "missing_input_pdf"}


def test_extraction_with_retries_and_cache(spark):
    def make():
        seen = {}

        def call(system, prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad":
                return "no json"
            if prompt == "long":
                raise RuntimeError("maximum context length")
            return "oops" if seen[prompt] == 1 else '```json\n{"Country": "USA"}\n```'

        return call

    prompts = spark.createDataFrame([("good",), ("bad",), ("long",)], "prompt string")
    got = extraction.answers(prompts, make, "s", "m").cache()
    told = {r.answer: r.error for r in got.collect()}
    assert '{"Country": "USA"}' in told and sum(e is not None for e in told.values()) >= 1
    again = extraction.with_fallback(got, got.select("id"), lambda p: p.select("id", F.lit("{}").alias("answer"), F.lit(None).cast("string").alias("error")))
    assert again.where("answer = '{}'").count() == 1
    record = json.loads(extraction.records(got.where("answer IS NOT NULL")).first().record)
    assert record["Country"] == "USA" and record["Age"] is None and len(record) == 24
    assert "Country" in extraction.system_prompt() and extraction.needs_fallback("context length exceeded")


def test_sheet_tei_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "x"), (2, "A", "1"), (3, None, "2"), (4, None, None), (5, "B", "NA"), *[(i, None, None) for i in range(6, 60)], (60, "C", "9")], "n int, study string, v string")
    got = [(r.study, r.v) for r in records.spreadsheet_records(rows, "n", "study", ["v"]).orderBy("n").collect()]
    assert got == [("A", "1"), ("A", "2"), ("B", None)]
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T <hi>x</hi></title></titleStmt></fileDesc></teiHeader><text><body><div><head>H</head><p>one <b>two</b></p><p/><figure>F</figure></div></body></text></TEI>'
    blocks = [(r.part, r.block_type, r.section, r.text, r.ord) for r in records.tei_blocks(spark.createDataFrame([("k", xml)], "key string, xml string")).collect()]
    assert blocks == [("title", "title", None, "T x", 1), ("body", "section_heading", "H", "H", 1), ("body", "paragraph", "H", "one two", 2), ("body", "figure_or_table", "H", "F", 3)]
    frame = spark.createDataFrame([("a", None)], "k string, v string")
    assert sinks.write_json_lines(frame, str(tmp_path / "o")) and not sinks.write_json_lines(frame.limit(0), str(tmp_path / "o"), keep_old_if_empty=True)
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"k":"a","v":null}'
    sinks.write_csv(spark.createDataFrame([('x"y', "1,2")], "a string, b string"), str(tmp_path / "c"), ["b", "a"])
    assert records.csv_rows(spark, str(tmp_path / "c")).first().asDict() == {"b": "1,2", "a": 'x"y'}
    assert records.csv_row_count(spark, str(tmp_path / "nothing")) == 0


def test_presence_and_flattening(spark):
    row = spark.range(1).select(
        eda.first_present(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(None).cast("string"), F.lit("x")), ["z", "a", "b"]).alias("f"),
        eda.flattened(F.parse_json(F.lit('{"age": 5, "sex": ""}'))).alias("m"),
    ).first()
    assert row.f is None and row.m == ["age:5"]


def test_short_names_match_like_all_with_all(spark):
    slug = lambda x: "".join(c for c in x.lower() if c.isalnum())
    studies = ["Wu", "Wu Li", "Ng 2001", "Ono", "Zhang Wei 2014", "Q"]
    files = ["Wu 2014 trial.pdf", "Ng.pdf", "ono_a.pdf", "on.pdf", "Zhang.pdf", "unrelated.pdf"]
    names = spark.createDataFrame([(f,) for f in files], "file string")
    got = {r.study: r.file for r in alignment.by_containment(spark.createDataFrame([(s,) for s in studies], "study string"), names).collect()}
    want = {}
    for s in studies:
        found = [f for f in files if slug(s) in slug(f[:-4]) or slug(f[:-4]) in slug(s)]
        if found:
            want[s] = min(found, key=lambda f: (len(f), f))
    assert got == want and want["Wu"] == "Wu 2014 trial.pdf"
    keys, blocks = ["Wu.pdf", "Wu 2014 trial.pdf", "Li.pdf", "A long name of a study 1999.pdf"], ["Wu_2014_blocks.json", "W_blocks.json", "A_long_name_of_a_study_blocks.json"]
    tables = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(b,) for b in blocks], "file string")
    got = {r.key: r.file for r in alignment.blocks_for(*tables).collect()}
    want = {}
    for k in keys:
        a = slug(k[:-4])
        found = [(0 if a == b else 1, f) for f in blocks for b in [slug(f.removesuffix("_blocks.json"))] if a == b or b.startswith(a[:50]) or a.startswith(b[:50])]
        want[k] = min(found)[1] if found else None
    assert got == want and want["Wu.pdf"] is not None and want["Li.pdf"] is None


def test_document_of_results(spark, tmp_path):
    predicted = [{"pdf": "a", "Country": "USA", "Setting": "S", "Quality rating RoBiNT scale": "1"}, {"pdf": "b", "Country": "UK"}, {"pdf": "only p"}]
    gold = [{"pdf": "a", "Country": "United States", "Setting": "UC"}, {"pdf": "b", "Country": ["UK", "Spain"]}, {"pdf": "only g", "Age": "5"}]
    out = evaluation.evaluate_files(spark, write(tmp_path / "p.jsonl", predicted), write(tmp_path / "g.jsonl", gold), write(tmp_path / "v.jsonl", [{"pdf": "a", "verdicts": {"Setting": {"verdict": "supported", "quote": "q"}}}, {"pdf": "zz", "verdicts": {}}]))
    one = evaluation.listed(out).first()
    assert (one.predictions_file_count, one.gold_file_count, one.matched_file_count, one.scored_field_count) == (3, 3, 2, 22)
    assert one.missing_predictions == ["only g"] and one.extra_predictions == ["only p"] and one.excluded_fields["Quality rating RoBiNT scale"] == "reviewer-assigned"
    assert (one.overall.tp, one.overall.fp, one.overall.fn, one.overall.exact_match_rate) == (2, 1, 2, 0.0) and one.overall.partial.tp == 2.0
    assert (one.per_field["Country"].tp, one.per_field["Country"].fn, one.per_field["Setting"].fp, one.per_field["Age"].f1) == (2, 1, 1, 0.0)
    assert [d.key for d in one.per_document] == ["a", "b"] and one.per_document[0].fields["Country"].predicted == ["united states"] and len(one.per_document[1].fields) == 22
    assert tuple(out["coverage"].first()) == (1, 1, 0) and {r.key: r.side for r in out["keys"].collect()} == {"a": "both", "b": "both", "only p": "extra", "only g": "missing"}


def test_three_ways_deal_cells_once(spark, monkeypatch):
    """Each different value is made a set once, however many cells have it, and cells are dealt by key once; repeated cells, null keys and documents without a wanted field count."""
    asked, kept = [], reconcile.value_sets
    monkeypatch.setattr(reconcile, "value_sets", lambda texts, *a: asked.append(out := kept(texts, *a)) or out)
    rows = lambda values: spark.createDataFrame(values, "key string, field string, j string").select("key", "field", F.parse_json("j").alias("value"))
    many = [(f"k{i}", "Setting", '"UC"') for i in range(50)]
    legacy = rows([*many, ("k1", "Study", '" S 1 "'), ("k2", "Study", '" "'), ("only", "Country", '"NL"'), (None, "Setting", '"S"')])
    a = rows([*many, ("k1", "Setting", '"OTH"'), ("k2", "Study", '{"value": "S 2", "page": 3}')])
    b = rows([("k0", "Setting", '{"value": "UC", "evidence_quote": "q"}'), ("k3", "Setting", "null")])
    cells = reconcile.three_way({"legacy": legacy, "llm_a": a, "llm_b": b}, ["Setting", "Number of Cases"])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert sorted((r.field, r.text) for r in asked[0].collect()) == [("Setting", '"OTH"'), ("Setting", '"S"'), ("Setting", '"UC"'), ("Setting", "null")]
    got = {(r.key, r.field): r for r in cells.collect()}
    assert len(got) == 2 * 52 and got["k0", "Setting"].status == "silver_auto" and got["k0", "Setting"].llm_b.evidence_quote == "q"
    assert got["k1", "Setting"].study == "S 1" and got["k2", "Setting"].study == "S 2" and got["k3", "Setting"].study == ""
    assert got["k1", "Setting"].llm_a.norm == ["university clinic"] and got["k3", "Setting"].llm_b.norm == [] and got["k3", "Setting"].llm_b.raw == "null"
    assert got["only", "Setting"].status == got["k0", "Number of Cases"].status == "all_missing" and got[None, "Setting"].legacy.norm == ["school"]


def _records(spark, rows):
    """(key, record), a record of a null key, too."""
    return spark.createDataFrame([(k, json.dumps(r)) for k, r in rows], "key string, text string").select("key", F.parse_json("text").alias("record"))


def test_evaluation_keeps_what_is_there_in_all_partitions(spark, monkeypatch):
    """Kept are scores of fields that a side has, not of each document's 22, and in all partitions however few bytes they are."""
    kept, cut = [], evaluation.cut
    monkeypatch.setattr(evaluation, "cut", lambda df: kept.append(out := cut(df)) or out)
    side = lambda n: _records(spark, [(f"k{i}", {"Age": f"{i % 5}-{i % 7 + n}", "Setting": "S"}) for i in range(40)])
    out = evaluation.evaluate(side(5), side(6))
    metrics = {r.field: r for r in out["metrics"].collect()}
    assert metrics["Setting"].tp == 40 and metrics["Age"].tp + metrics["Age"].fp == 40 and metrics["Study"].tp == 0 and len(metrics) == 23
    assert kept[-1].count() == 80 and out["scored"].count() == 40 * 22
    assert {df.rdd.getNumPartitions() for df in kept} == {int(spark.conf.get("spark.sql.shuffle.partitions"))}


def test_evaluation_of_sides_that_share_no_document(spark):
    """A field's metrics are there, and zero, even if no document is on both sides."""
    out = evaluation.evaluate(_records(spark, [("a", {"Age": "3"})]), _records(spark, [("b", {"Age": "3"})]))
    assert out["metrics"].count() == 23 and out["documents"].first() == (0, 0, 0.0)
    one = out["summary"].first()
    assert (one.missing_prediction_count, one.extra_prediction_count, one.overall.tp, one.overall.exact_match_rate, one.per_field["Age"].f1) == (1, 1, 0, 0.0, 0.0)


def test_evaluation_without_broadcast_is_the_same(spark, monkeypatch):
    p = _records(spark, [("a", {"Age": ["3", "5-6"], "Country": "usa, uk"}), ("b", {"Age": None}), ("c", {}), ("d", {"Setting": "S"}), (None, {"Age": 7})])
    g = _records(spark, [("a", {"Age": "3-6", "Country": ["united kingdom", "spain"]}), ("b", {"Age": "4"}), ("c", {}), ("e", {"Setting": "S"}), (None, {"Age": 7})])
    told = lambda: sorted(map(repr, evaluation.evaluate(p, g)["by_document"].collect()))
    few = told()
    monkeypatch.setattr(matching, "SMALL", 0)
    assert told() == few and len(few) == 6 and "predicted=['7'], gold=['7']" in few[-1]


def test_texts_by_field_are_those_of_cells(spark):
    """Without a row for each: headers that name one field, nulls, and what is no object; records of one key add up."""
    rows = _records(spark, [("a", {"N cases": 1, "Number of Cases": 2, "Drop-outs": 3, "Drop-outs ": [4, None], "other": 5}), ("b", {"Age": None, "pdf": "b"}), ("c", [1, 2]), ("d", "x"), ("e", {})])
    wanted = matching.scored_fields()
    want = {(r.key, r.field, r.text) for r in records.cells(rows, wanted).select("key", "field", F.to_json("value").alias("text")).collect()}
    got = {(r.key, r.field, r.text) for r in rows.select("key", F.explode(records.texts_by_field(F.col("record"), wanted)).alias("field", "text")).collect()}
    assert got == want == {("a", "Number of Cases", "2"), ("a", "Drop-outs", "[4,null]"), ("b", "Age", "null")}
    twice = _records(spark, [("a", {"Age": "3"}), ("a", {"Setting": "S"})])
    pairs = evaluation.paired(twice, _records(spark, [("a", {"Age": "3"})]), wanted).collect()
    assert len(pairs) == 1 and {f: (x.p, x.g) for f, x in pairs[0].cells.items()} == {"Age": ('"3"', '"3"'), "Setting": ('"S"', None)}


def test_scores_of_values_read_once_are_those_of_values(spark):
    import itertools

    values = ["a b c", "c b a", "b", "3-6", "4", "4.5-5", "0", "(x)", "the b"]
    sets = [[], *([v] for v in values), ["a b c", "c b a"], ["3", "3-4", "b"], ["b", "the b"]]
    rows = [(f"{i}", f, p, g) for i, (f, p, g) in enumerate(itertools.product(("Age", "Setting"), sets, sets))]
    cells = spark.createDataFrame(rows, "key string, field string, predicted array<string>, gold array<string>")
    want = cells.withColumn("score", matching.score(F.col("predicted"), F.col("gold"), F.col("field"))).orderBy("key").collect()
    read = cells.select("key", "field", *(matching.read_sets(F.col(c), F.col("field")).alias(c) for c in ("predicted", "gold")))
    assert matching.with_scores(read).orderBy("key").collect() == want
