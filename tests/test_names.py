"""Names matched with files, against comparing all with all."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from cellweave.operators import alignment, contain, likeness


def names(spark, values, column="study"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def slug(x):
    return "".join(c for c in x.lower() if c.isalnum())


def changed(rng, name, letters):
    out = list(name)
    for _ in range(rng.randrange(1, max(2, len(name) // 5))):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        out[at : at + (kind > 0)] = [rng.choice(letters)] * (kind < 2)
    return "".join(out)


def most_alike(name, files, least):
    """(ratio, file) of the best, by comparing with all."""
    rated = [(difflib.SequenceMatcher(None, name, f).ratio(), f) for f in files]
    best = max((r for r, _ in rated), default=0)
    return (best, min(f for r, f in rated if r == best)) if best >= least else None


@pytest.mark.parametrize("letters,least,seed", [("ab", 0.8, 1), ("abcdefghij0123", 0.8, 2), ("abcdefghijklmnopqrstuvwxyzäß中", 0.8, 3), ("abcde", 0.65, 4), ("abcdefg", 0.9, 5)])
def test_likeness_loses_no_pair(spark, letters, least, seed):
    rng = random.Random(seed)
    right = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 41))) for _ in range(160)} | {"".join(rng.choices(letters, k=k)) for k in (60, 130, 240)})
    left = sorted({changed(rng, f, letters) for f in right} | {"".join(rng.choices(letters, k=rng.randrange(1, 41))) for _ in range(60)} | set(right[:9]))
    got = likeness.most_alike(names(spark, left, "name"), names(spark, right, "name").withColumn("file", F.col("name")), least)
    found = {r.name: (pytest.approx(r.r), r.file) for r in got.collect()}
    want = {n: m for n in left if n and (m := most_alike(n, right, least))}
    assert found == want and len(want) > 20


def test_pairs_are_those_that_can_be_alike(spark):
    """Every pair over the bound is among the candidates, and only pairs with enough in common."""
    rng = random.Random(7)
    values = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 30))) for _ in range(120)})
    values += sorted({changed(rng, v, "abc") for v in values} - {""} - set(values))
    df = names(spark, values, "name")
    got = {(r.a, r.b): r.most for r in likeness.pairs(df, df, 0.8).collect()}
    for a in values:
        for b in values:
            bound = difflib.SequenceMatcher(None, a, b).quick_ratio()
            assert ((a, b) in got) == (bound >= 0.8 - 1e-9)
            if (a, b) in got:
                assert got[a, b] == pytest.approx(bound)


def test_cases_of_likeness_and_years(spark):
    got = alignment.by_likeness(names(spark, ["ab", "a b-cdef", "zz", "--"]), names(spark, ["abc.pdf", "abxcdxef.pdf", "abxcdxeg.pdf"], "file"))
    assert {tuple(r) for r in got.collect()} == {("ab", "abc.pdf"), ("a b-cdef", "abxcdxef.pdf")}
    found = alignment.by_author_and_year(names(spark, ["Smith 2001", "Müller 2001", "Smith Jones 1999", "Lee 1920"]), names(spark, ["smith 192001.pdf", "müller 2001.pdf", "jones smith 1999.pdf", "smith 1999.pdf", "lee_1920.pdf", "lee 1920x.pdf"], "file"))
    assert {tuple(r) for r in found.collect()} == {("Smith 2001", "smith 192001.pdf"), ("Smith Jones 1999", "jones smith 1999.pdf"), ("Lee 1920", "lee 1920x.pdf")}
    with pytest.raises(ValueError):
        likeness.most_alike(names(spark, [], "name"), names(spark, [], "name"), 0)


def test_tiers_see_what_is_left(spark):
    files = names(spark, ["Wu 2014.pdf", "wu-2015.PDF", "Adams and Brown 2001 final.pdf", "Kratochwil 2010 singlecase.pdf"], "file")
    studies = ["wu 2014", "Wu, 2015", "Brown et al 2001", "Kratochwill 2010 single-case", "Nobody 1990", "!!"]
    got = {r.study: (r.file, r.tier) for r in alignment.match_studies(names(spark, [*studies, studies[0]]), files).collect()}
    assert got == {
        "wu 2014": ("Wu 2014.pdf", "exact"), "Wu, 2015": ("wu-2015.PDF", "slug"), "Brown et al 2001": ("Adams and Brown 2001 final.pdf", "author_year"),
        "Kratochwill 2010 single-case": ("Kratochwil 2010 singlecase.pdf", "likeness"), "Nobody 1990": (None, None), "!!": (None, None),
    }


@pytest.mark.parametrize("block", [20, 1 << 20])
def test_patterns_equal_all_with_all(spark, block):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abc ", k=rng.randrange(0, 30))) for _ in range(80)] + [None, "", "中文abc"]
    patterns = ["".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(30)] + ["", None, "文a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {(i, p) for i, t in enumerate(texts) for p in patterns if t and p and p in t}
    got = [tuple(r) for r in contain.found_in(df, names(spark, patterns, "pattern"), block).collect()]
    assert set(got) == want and len(got) == len(want)
    ranked = df.select(F.col("id").cast("string").alias("id"), "text", F.length("text").alias("rank"))
    best = {p: min((len(texts[i]), str(i)) for i, q in want if q == p) for _, p in want}
    assert {r.pattern: (r.rank, r.id) for r in contain.first_holder(ranked, names(spark, patterns, "pattern"), block).collect()} == best
    assert contain.found_in(df, names(spark, ["", None], "pattern")).count() == 0 and contain.first_holder(ranked, names(spark, [], "pattern")).count() == 0


def test_citations_of_one_year(spark):
    rng = random.Random(9)
    authors = ["".join(rng.choices("abcde", k=rng.randrange(2, 6))) for _ in range(40)]
    files = [f"{rng.choice(authors)}{rng.choice(['', ' x'])} {y}{rng.choice(['', '7'])}.pdf" for y in (2001, 1999) for _ in range(60)] + ["19201.pdf", "Van der B. 1850.pdf"]
    citations = [f"{a.title()}, B. ({y}). (1999)" for a in authors for y in (2001, 2000)] + [", (2001)", "ab", "ab 2001", " , (2001)", "van der B., c (1850)", "abc, 2001"]
    got = {r.citation: r.file for r in alignment.cited(names(spark, citations, "citation"), names(spark, files, "file")).collect()}
    for c in citations:
        told = re.search(r"^([^,]+),.*?\((\d{4})\)", c)
        author, year = (told[1].strip().lower(), told[2]) if told else ("", "")
        assert got[c] == min((f for f in files if author and year in f and author in f.lower()), default=None), c


def test_short_names_meet_on_what_is_left(spark):
    """Random digests have many letters in common, and few in order: they don't meet, those that are alike do."""
    rng = random.Random(11)
    right = sorted({"".join(rng.choices("01234567", k=16)) for _ in range(400)})
    left = sorted(f[:8] + "x" + f[8:15] + "y" for f in right[:100]) + sorted(changed(rng, f, "01234567") for f in right[100:200])
    assert likeness.lengths({17}, {16}, 0.8) == ({(17, 16): 14}, False) and likeness.lengths({40}, {40}, 0.8) == ({}, True)
    a, b = names(spark, left, "name"), names(spark, right, "name")
    near = {(r.a, r.b) for r in likeness.candidates(a, b, 0.8).collect()}
    assert {(x, y) for x in left for y in right if difflib.SequenceMatcher(None, x, y).ratio() >= 0.8} <= near
    assert len(near) < likeness.pairs(a, b, 0.8).count() / 4
