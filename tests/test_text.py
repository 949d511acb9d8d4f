import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from cellweave.functions import text


def plain(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_every_code_point_loses_its_accents(spark):
    points = [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    rows = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(points)], "i int, t string").repartition(8)
    got = dict(rows.select("i", text.strip_accents(F.col("t"))).collect())
    wrong = [points[i] for i, t in got.items() if t != plain(f"a{points[i]}b")]
    assert len(got) == len(points) > 140_000 and not wrong, [hex(ord(c)) for c in wrong[:20]]


@pytest.mark.parametrize("t", [None, "", "Zürich ﬁn ½ 각가힣 e\u0301\u0323 ① ｶﾞ ㍿ 𝕏 ﷺ", "plain ascii", "é" * 500])
def test_texts_lose_their_accents(spark, t):
    assert spark.createDataFrame([(t,)], "t string").select(text.strip_accents(F.col("t"))).first()[0] == (None if t is None else plain(t))
