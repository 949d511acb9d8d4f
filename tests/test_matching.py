import itertools
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.operators import matching, sampling


def tokens(text):
    found = [t for t in re.findall("[a-z0-9]+", text) if t not in fields.STOPS]
    return [t[:-1] if len(t) > 3 and t.endswith("s") else t for t in found]


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return 0.0
    dot = sum(x.count(t) * y.count(t) for t in set(x) & set(y))
    norm = lambda z: math.sqrt(sum(z.count(t) ** 2 for t in set(z)))
    return dot / (norm(x) * norm(y))


def brute(predicted, gold):
    pairs = sorted((-likeness(p, g), p, g) for p, g in itertools.product(predicted, gold) if likeness(p, g) >= 0.5)
    left, right, soft = set(), set(), 0.0
    for s, p, g in pairs:
        if p not in left and g not in right:
            left.add(p)
            right.add(g)
            soft -= s
    return round(soft, 6)


def score_all(spark, cases, field="Study"):
    rows = spark.createDataFrame([(i, sorted(p), sorted(g)) for i, (p, g) in enumerate(cases)], "i int, p array<string>, g array<string>")
    return [r["s"] for r in rows.withColumn("s", matching.score(F.col("p"), F.col("g"), F.lit(field))).orderBy("i").collect()]


def test_documented_cases(spark):
    got = score_all(spark, [({"6", "7"}, {"6-7"})], "Treatment length")[0]
    assert (got.tp, got.fp, got.fn, got.soft_tp, got.soft_fp, got.soft_fn) == (0, 2, 1, 0.5, 1.5, 0.5)
    got = score_all(spark, [({"16-20"}, {"18", "19", "20"})], "Number of sessions")[0]
    assert (got.tp, got.soft_tp, got.soft_fp, got.soft_fn) == (0, 0, 1, 3)
    got = score_all(spark, [({"multiple baseline design across families"}, {"multiple baseline design"}), (set(), set())])
    assert (got[0].soft_tp, got[0].soft_fp) == (0.774597, 0.225403)
    assert (got[1].tp, got[1].soft_tp) == (0, 0)


WORDS = st.sampled_from(["red", "blue", "green house", "the house", "houses", "red house blue", "a", "blue house of red"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sets(WORDS, max_size=5), st.sets(WORDS, max_size=5)), min_size=5, max_size=30))
def test_greedy_equals_brute_force(cases):
    from pyspark.sql import SparkSession

    for (p, g), s in zip(cases, score_all(SparkSession.getActiveSession(), cases), strict=True):
        assert s.tp + s.fp == len(p) and s.tp + s.fn == len(g)
        assert abs(s.soft_tp - brute(p, g)) < 1e-5
        assert abs(s.soft_tp + s.soft_fp - len(p)) < 1e-5 and abs(s.soft_tp + s.soft_fn - len(g)) < 1e-5


def test_split_is_exact_and_the_same_for_any_layout(spark):
    rows = spark.range(71)
    one, other = (sampling.split(r, 0.8, ["id"]).where("part = 'train'").select("id") for r in (rows, rows.repartition(7)))
    assert one.count() == 56 and {r.id for r in one.collect()} == {r.id for r in other.collect()} == set(range(56))
    shuffled = list(range(71))
    random.Random(3).shuffle(shuffled)
    got = sampling.split_like_shuffle(rows, 0.8, "id", 3).where("part = 'train'")
    assert {r.id for r in got.collect()} == set(shuffled[:56])


def test_round_robin(spark):
    rows = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else "c") for i in range(10)], "i int, s string")
    got = [r.i for r in sampling.round_robin(rows, F.col("s"), 5, F.col("i")).collect()]
    assert got == [0, 6, 9, 1, 7]
    assert sampling.round_robin(rows, F.col("s"), 0, F.col("i")).count() == 0
