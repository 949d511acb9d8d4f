"""Rules held against plain Python, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from cellweave.operators import eda, layout, reconcile
from cellweave.sources import records

VALUES = [
    None, "", " a ", "a; b,/c|", 3, True, False, 1.5, [], ["x", " ", None, 2], [["p;q", ["r"]], "s"], {}, {"k": "v"}, {"b": "", "a": None, "c": [1, "", " z ", None], "d": True, "e": "  "}, {"n": 2.5},
]


def said(x):
    return x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), sort_keys=True) if isinstance(x, (list, dict)) else str(x)


def listed(v):
    if v is None:
        return []
    return [t for x in (v if isinstance(v, list) else [v]) if (t := said(x).strip())]


def flat(v):
    if not isinstance(v, dict):
        return listed(v)
    return [f"{k}:{t}" for k in sorted(v) for x in (v[k] if isinstance(v[k], list) else [v[k]]) if (t := said(x).strip())]


def split(v):
    if v is None:
        return []
    if isinstance(v, list):
        return [t for x in v for t in split(x)]
    for c in ";,/":
        v = said(v).replace(c, "|")
    return [t.strip() for t in v.split("|") if t.strip()]


def test_labels_of_values(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, j string").withColumn("v", F.parse_json("j"))
    got = {r.i: r for r in rows.select("i", eda.label_list(F.col("v")).alias("l"), eda.flattened(F.col("v")).alias("f"), eda.split_list(F.col("v")).alias("s")).collect()}
    for i, v in enumerate(VALUES):
        assert got[i].l == listed(v) and got[i].f == flat(v), v
        if not isinstance(v, dict):
            assert got[i].s == split(v), v


def test_study_items_are_objects(spark):
    texts = ['["x", {"a": 1}, 3, {"b": 2}]', '{"studies": [{"c": 1}, null, "y"]}', '{"studies": "z", "d": 1}', '{"e": 2}', "3", "no json", "[]"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, value string")
    got = [(r.file, r.ord, r.s) for r in records.study_items(rows).select("file", "ord", F.to_json("study").alias("s")).orderBy("file", "ord").collect()]
    assert got == [("0", 0, '{"a":1}'), ("0", 1, '{"b":2}'), ("1", 0, '{"c":1}'), ("2", 0, '{"d":1,"studies":"z"}'), ("3", 0, '{"e":2}')]


@pytest.mark.parametrize("drawings", [0, 14, 15, 59, 60])
@pytest.mark.parametrize("images", [[], [(500, 500)], [(500, 500)] * 2, [(100, 100)], [(6000, 500)]])
@pytest.mark.parametrize("cue", [False, True])
def test_figure_rule(spark, drawings, images, cue):
    sizeable = sum(w * h > 40000 and max(w, h) / min(w, h) < 6 for w, h in images)
    want = drawings >= 60 or sizeable >= 2 or (cue and (sizeable >= 1 or drawings >= 15)) or (sizeable == 1 and (drawings >= 15 or cue))
    shown = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in images)).cast("array<struct<width:int,height:int>>")
    assert spark.range(1).select(layout.shows_figure(F.lit(drawings), shown, F.lit("See Figure 2" if cue else "text"))).first()[0] is want


def test_evidence_is_of_the_models(spark):
    part = "struct<raw:string,evidence_quote:string,page:string,norm:array<string>>"
    told = lambda q, p: ('"v"', q, p, ["v"])
    rows = [("1", told("LEG", "9"), told("", None), told("B", "3")), ("2", told("LEG", "9"), told("A", ""), told("B", "3")), ("3", told("LEG", "9"), told(None, None), told("", ""))]
    cells = spark.createDataFrame([(k, "s", "Age", *x, "all_different", "high", "p") for k, *x in rows], f"key string, study string, field string, legacy {part}, llm_a {part}, llm_b {part}, status string, priority string, pattern string")
    assert [tuple(r) for r in reconcile.for_review(cells).select("key", "evidence_quote", "page").orderBy("key").collect()] == [("1", "B", "3"), ("2", "A", "3"), ("3", "", "")]


def test_issues_in_the_order_of_their_file(spark):
    row = spark.createDataFrame([("k", "n", "r", "", "", "", "", "")], "key string, notes string, suggestion_reason string, alignment_issue string, alignment_evidence string, needs_pdf_check string, review_action string, status string")
    issues = spark.createDataFrame([(" k", "z", "", "second said first", 1), ("k ", "a", "other", "b", 2), ("k", "a", "", "", 3), (" ", "q", "", "x", 4)], "key string, issue_type string, related string, evidence string, line int")
    got = reconcile.annotate(row, issues).first()
    assert (got.alignment_issue, got.alignment_evidence) == ("a; z", "second said first | b Related: other")
