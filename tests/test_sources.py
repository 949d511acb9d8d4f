"""Sources and sinks: splits, sheets, versions, caches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import reconcile
from cellweave.sources import records


@pytest.fixture
def small_splits(spark):
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = spark.conf.get(key), spark.conf.get(cost)
    spark.conf.set(key, "4096")
    spark.conf.set(cost, "0")
    yield
    spark.conf.set(key, old[0])
    spark.conf.set(cost, old[1])


def test_files_are_read_in_splits(spark, tmp_path, small_splits):
    rng, last = random.Random(1), {}
    with open(tmp_path / "a.jsonl", "w") as f:
        for i in range(3000):
            k = f"k{rng.randrange(400)}"
            last[k] = i
            f.write(json.dumps({"pdf": k, "n": i, "pad": "x" * rng.randrange(60)}) + rng.choice(["\n", "\r\n", "\n\n"]))
    lines = records.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert lines.rdd.getNumPartitions() > 20 and lines.count() == 3000
    got = records.records_by_key(lines).select("key", "seen", F.try_variant_get("record", "$.n", "int").alias("n")).collect()
    assert {r.key: r.n for r in got} == last and sum(r.seen for r in got) == 3000
    ordered = [r.n for r in lines.orderBy("file", "line").select(F.try_variant_get("record", "$.n", "int").alias("n")).collect()]
    assert ordered == list(range(3000))


def test_of_repeated_keys_the_last_counts_and_nothing_fails_if_told(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"pdf": "a", "x": 1, "x": 2}\n')
    (tmp_path / "none.jsonl").write_text(" \n\n")
    assert records.json_lines(spark, str(tmp_path / "b.jsonl")).select(F.to_json("record")).first()[0] == '{"pdf":"a","x":2}'
    assert records.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(ValueError, match="no records"):
        records.json_lines(spark, str(tmp_path / "none.jsonl"), empty="error")
    (tmp_path / "bad.jsonl").write_text('{"pdf": "a"}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        records.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def plain_sheet(rows, run):
    """Rows top to bottom: (order, study, value)."""
    out, study, blank = [], None, 0
    clean = lambda x: None if x is None or x.strip() in ("", "NA") else x.strip()
    for n, s, v in rows:
        s, v = clean(s), clean(v)
        if s is None and v is None:
            blank += 1
            if blank >= run:
                break
            continue
        blank = 0
        study = s or study
        if study:
            out.append((n, study, v))
    return out


@pytest.mark.parametrize("seed,run", [(1, 50), (2, 3), (3, 7), (4, 1)])
def test_sheets_are_filled_over_ranges(spark, seed, run):
    rng = random.Random(seed)
    sheets = {}
    for name in ("a", "b", None, "long"):
        full = rng.choice([0.3, 0.7])
        sheets[name] = [(i, rng.choice([f"s{i}", "", " NA ", None]) if rng.random() < 0.2 else None, rng.choice(["v", " ", "NA"]) if rng.random() < full else None) for i in range(300 if name != "long" else 2000)]
    rows = [(name, *r) for name, rs in sheets.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sheet string, n int, study string, v string")
    got = records.spreadsheet_records(df, "n", "study", ["v"], run).collect()
    for name, rs in sheets.items():
        assert sorted((r.n, r.study, r.v) for r in got if r.sheet == name) == plain_sheet(rs, run), name
    one = records.spreadsheet_records(df.where("sheet = 'long'").drop("sheet"), "n", "study", ["v"], run)
    assert one.columns == ["n", "study", "v"] and sorted(tuple(r) for r in one.collect()) == plain_sheet(sheets["long"], run)


def test_issues_of_a_file_or_of_none(spark, tmp_path):
    assert records.alignment_issues(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "i.csv").write_text('pdf,issue_type,related_pdf,evidence\n b.pdf ,z,,"second, said first"\n,q,,x\nb.pdf,a,o,last\n')
    issues = records.alignment_issues(spark, str(tmp_path / "i.csv"))
    row = spark.createDataFrame([("b.pdf", "", "r", "", "", "", "")], "key string, notes string, suggestion_reason string, alignment_issue string, alignment_evidence string, needs_pdf_check string, review_action string")
    assert reconcile.annotate(row, issues).first().alignment_evidence == "second, said first | last Related: o"
    assert reconcile.annotate(row, records.alignment_issues(spark, str(tmp_path / "no.csv"))).first().alignment_issue == ""
