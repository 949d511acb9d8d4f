import json

import pytest
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.functions.normalize import atom, plain_keys, value_set

CASES = [
    ("Country", '"USA"', ["united states"]),
    ("Country", '"UK/USA"', ["united kingdom", "united states"]),
    ("Country", '"new zealand-aus"', ["australia", "new zealand"]),
    ("Gender", '"F"', ["female"]),
    ("Gender", '"8F/2M"', ["female:8|male:2"]),
    ("Gender", '"8F 2M"', ["female:2"]),
    ("Study", '"2 boys in school"', ["male:2"]),
    ("Age", "[4, 5]", ["4-5"]),
    ("Age", "[18, 19, 20]", ["18-20"]),
    ("Age", '["4.5", "6.2"]', ["4-7"]),
    ("Age", '"8 years"', ["8"]),
    ("Age", '["8", "x"]', ["8", "x"]),
    ("Treatment length", '"4 weeks"', ["4"]),
    ("Treatment length", '"6 to 7 weeks"', ["6-7"]),
    ("Number of sessions", '"NR"', []),
    ("Number of sessions", '"about 12 sessions"', ["12"]),
    ("Setting", '"NR"', ["not reported"]),
    ("Setting", '"UC"', ["university clinic"]),
    ("Number of Cases", "3.0", ["3"]),
    ("Number of Cases", '"03"', ["3"]),
    ("Number of Cases", "1000000000000000", ["1e+15"]),
    ("Study", "true", ["true"]),
    ("Study", '"n/a"', []),
    ("Study", '""', []),
    ("Study", "null", []),
    ("Study", '"Crème  Brûlée"', ["creme brulee"]),
    ("Type of treatments", '"CBT"', ["cognitive behavioral therapy"]),
    ("Type of treatments", '"CBT + interpersonal skills"', ["cognitive behavioral therapy", "interpersonal skills"]),
    ("Data availability", '"diagnosis/ f.a."', ["diagnosis", "frequent assessment"]),
    ("Primary diagnosis", '"anxiety disorder"', ["generalized anxiety disorder"]),
    ("Primary diagnosis", '"AD (specific phobia)"', ["ad"]),
    ("Primary diagnosis", '"specific phobia of dogs"', ["specific phobia of dogs"]),
    ("Primary diagnosis", '"ADHD; depression"', ["adhd", "depression"]),
    ("Ethnicity / Race", '"White 3, Black 2"', ["black", "white"]),
    ("Type of SCED design", '"multiple-baseline"', ["multiple baseline"]),
]


@pytest.fixture(scope="module")
def sets(spark):
    rows = spark.createDataFrame([(f, v) for f, v, _ in CASES], "field string, v string")
    return {(r["field"], r["v"]): r["s"] for r in rows.select("field", "v", value_set(F.parse_json("v"), F.col("field")).alias("s")).collect()}


@pytest.mark.parametrize("field,value,want", CASES)
def test_value_set(sets, field, value, want):
    assert sets[field, value] == want


def test_own_aliases_come_first(spark):
    own = {"Country": {"usa": "elsewhere"}, "global": {"xyz": "known"}}
    rows = spark.createDataFrame([("Country", '"USA"'), ("Study", '"xyz"'), ("Study", '"USA"')], "field string, v string")
    got = [r[0] for r in rows.select(value_set(F.parse_json("v"), F.col("field"), own)).collect()]
    assert got == [["elsewhere"], ["known"], ["united states"]]


def test_own_diagnoses_are_labels(spark):
    aliases = {"Primary diagnosis": {"tourettes": "Tourette syndrome with tics"}}
    atoms = spark.createDataFrame([("tourette syndrome tics",)], "v string")
    got = atoms.select(atom(F.col("v"), F.lit("Primary diagnosis"), plain_keys(aliases)).alias("x")).first().x
    assert got == "tourette syndrome with tics"
    assert atoms.select(atom(F.col("v"), F.lit("Primary diagnosis")).alias("x")).first().x == "tourette syndrome tics"


def test_general_is_twelve_digits(spark):
    numbers = [0.0, 1.0, 3.5, 1e12, 1e15, 123456789.123456, 0.0001, 0.00001234, 999999999999.5, -2.5, 1 / 3, 100.0, 1e-300]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", text.general(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in rows] == [format(r["x"], ".12g") for r in rows]


def test_general_of_whole_numbers(spark):
    """Whole numbers of few digits are spelled without a format, as with one."""
    numbers = [-0.0, 7.0, -7.0, 99999999999.0, -99999999999.0, 1e11, 1e11 + 1, 999999999999.0, 1e12 + 1, 2.0**53, 99999999999.5, 1e300, None]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", text.general(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in rows[:-1]] == [format(r["x"] + 0.0, ".12g") for r in rows[:-1]]


def test_fences(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        ' \n```\n{"a":\n 1}\n  ``` \n': '{"a":\n 1}',
        '{"a": "```x```"}': '{"a": "```x```"}',
        '```json\n{"a": "```x```"}\n```': '{"a": "```x```"}',
        '```json\n{"a": 1}': '{"a": 1}',
        'Here:\n```json\n{"a": 1}\n```\nDone.': '{"a": 1}',
        "```": "",
        " no fence ": "no fence",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.without_fence(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == cases == {k: text.plain_answer(k) for k in cases}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.slug(F.lit("A-b 1é")).alias("slug"),
        text.chunks(F.lit("abcdefg"), 3).alias("chunks"),
        text.without_fence(F.lit('x ```json\n{"a": 1}\n``` y')).alias("fence"),
        text.split_labels(F.lit("a; b,/c|")).alias("labels"),
        text.strip_accents(F.lit("ﬁ½ Ålesund")).alias("plain"),
    ).first()
    assert (row.slug, row.chunks, row.labels, row.plain) == ("ab1", ["abc", "def", "g"], ["a", "b", "c"], "fi1⁄2 Alesund")
    assert json.loads(row.fence) == {"a": 1}
    with pytest.raises(ValueError):
        text.chunks(F.lit("a"), 0)
