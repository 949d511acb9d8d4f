import hashlib
import math

import numpy as np
import pytest

from cellweave.llm import product_codes, queries
from oracle import connect, same_rows

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int, none int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, 2) for i, v, c in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    """Lloyd's rounds with all distances, in Python's integers."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v: [tuple(math.floor(256 * x) for x in v[p * width : (p + 1) * width]) for p in range(parts)]
    vectors = [cut(r[1]) for r in rows]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(v[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in vectors]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, a in zip(vectors, found, strict=True) if a[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = assign()
    errors = [sum(d for d, _ in a) for a in found]
    by_label = {c: sum(e for r, e in zip(rows, errors, strict=True) if r[2] == c) for c in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in a), d, by_label[r[2]], digest) for r, a, d in zip(rows, found, errors, strict=True)), key=repr)


def rows_of(n, length, grid, seed=1):
    """Vectors near a grid, so that distances are often equal, and many copies of one of them."""
    rng = np.random.default_rng(seed)
    made = (rng.integers(-grid, grid, (n, length)) / 256 + rng.choice([0, 0.001], (n, length))).tolist()
    made[n // 3 : 2 * n // 3] = [made[0]] * (2 * n // 3 - n // 3)
    return [(int(i), v, int(c) if c else None) for i, v, c in zip(rng.permutation(n) - 5, made, rng.integers(0, 4, n), strict=True)]


@pytest.mark.parametrize("n,length,grid", [(300, 32, 3), (500, 64, 60), (20, 16, 2), (260, 48, 30000)])
def test_codes_equal_all_distances(spark, n, length, grid):
    rows = rows_of(n, length, grid)
    rows += [(7, None, 1), (8, [None] * length, 1), (9, [float("nan")] * length, 2), (10, [float("inf")] + [0.0] * (length - 1), 2), (11, [], 1), (None, rows[3][1], 1), (2, rows[4][1], None), (2, rows[4][1], 3)]
    got = product_codes.quantize(frame(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_blocks_and_bounds(spark):
    rows = rows_of(700, 32, 40)
    table = product_codes.usable(frame(spark, rows))
    books = product_codes.first_books(table, 16, 64)
    first, _ = product_codes._published(product_codes._pass(table.coalesce(1), books, None, 64))
    then = product_codes.moved(first, books)
    second = product_codes._pass(first, then, books)
    total = lambda df: df.agg({"computed": "sum"}).first()[0]
    assert first.count() == 11 and total(first) == 700 * 16 * 64
    assert total(second) < 0.5 * total(first)  # the bounds exclude most entries


@pytest.mark.parametrize("entries,rounds", [(5, 0), (300, 3)])
def test_other_sizes(spark, entries, rounds):
    rows = rows_of(400, 8, 50)
    got = product_codes.quantize(frame(spark, rows), parts=4, entries=entries, rounds=rounds).collect()
    want = plain(rows, 4, entries, rounds)
    assert sorted((r.vec_id, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted((i, d, c, s) for i, _, d, c, s in want)
    assert {len(r.code) for r in got} == {8 if entries < 256 else 16}


def test_nothing_and_what_does_not_fit(spark):
    assert product_codes.quantize(frame(spark, [])).count() == 0 and product_codes.quantize(frame(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for rows in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 17, 1)], [(1, [1e9] * 16, 1)]):
        with pytest.raises(Exception, match="components|64 bits"):
            product_codes.quantize(frame(spark, rows)).count()


def test_query_equals_sql(spark, data):
    same_rows(queries.op12_product_codes(spark, data), connect(data), queries.ORACLES["op12_product_codes"])
