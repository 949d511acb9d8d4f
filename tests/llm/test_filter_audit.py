from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cellweave.llm import filter_audit, queries
from oracle import connect, same_rows


def plain(rows, labels):
    """What the docstring says, order by order and step by step."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        known.append((lang or "", fails, i))
    out, removed_by = {}, {}
    for part in {p for p, _, _ in known}:
        own = [(f, i) for p, f, i in known if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                here = [d for d in own if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(gone)
                out[part, order, step] = (len(left), len(gone), len(here) - len(gone), sum(f == {x} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone))
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


WORDS = " ".join(f"w{k}" for k in range(220))
ROWS = [
    (1, WORDS, "en"), (2, WORDS, "en"), (3, WORDS, "de"), (None, WORDS, "en"), (3, WORDS, "de"), (4, "a " * 300, "en"), (5, None, None), (6, "", ""), (7, "  \t\r\n\x0b\x0c ", "fr"),
    (8, WORDS + " #", "en"), (9, WORDS.upper(), "de"), (10, "Ab  é 😀" * 90, None), (2, WORDS, "en"), (11, "x " * 199 + "|", "en"), (12, ("a b c d " * 30_000) + "$", "fr"), (13, "ABC", "en"), (0, "ABC", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, 0, 1), (9, None, 1), (13, 1, None), (99, 1, 1), (None, 1, 1)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 1, "x", 2) for i, t, p in rows], "doc_id long, text string, lang string, fails int, part string, n int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_all_orders_equal_plain_steps(spark):
    docs, labels = frames(spark, ROWS, LABELS)
    got = filter_audit.audit(docs, labels, filter_audit.failures(F.coalesce("text", F.lit(""))), "E").collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(ROWS, LABELS) and len(got) == 600 * 4


def test_nothing_and_names(spark):
    docs, labels = frames(spark, ROWS[:1], LABELS)
    conditions = filter_audit.failures(F.col("text"))
    assert filter_audit.audit(docs.limit(0), labels, conditions, "E").count() == 0
    assert filter_audit.audit(docs, labels.limit(0), {"A": conditions["A"], "B": conditions["B"]}, None).count() == 4
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, conditions, "A")


def test_a_text_of_most_rows(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", "en") for i in range(4000)]
    docs, labels = frames(spark, rows, LABELS)
    got = filter_audit.audit(docs, labels, {}, "E").collect()
    assert [(r.removed, r.kept) for r in got] == [(sum(i % 3 > 0 for i in range(4000)) - 1, 4000 - sum(i % 3 > 0 for i in range(4000)) + 1)]


def test_query_equals_sql(spark, data):
    same_rows(queries.op11_filter_audit(spark, data), connect(data), queries.ORACLES["op11_filter_audit"])
