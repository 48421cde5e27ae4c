import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gridmere.llm import queries, whitening


def test_residues_give_the_number_back():
    moduli = whitening.primes(100)
    product = math.prod(moduli)
    assert product.bit_length() > 100 and len(set(moduli)) == len(moduli) and all(p < 1 << 20 and pow(2, p - 1, p) == 1 for p in moduli)
    draw = random.Random(1)
    for n in [0, 1, -1, product // 2, -(product // 2), *(draw.randrange(-product // 2 + 1, product // 2) for _ in range(200))]:
        assert whitening.from_residues([n % p for p in moduli], moduli) == n


def plain(rows, components=32):
    """Whole numbers and fractions throughout; only eigh is in doubles."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    centred = [[n * a - b for a, b in zip(v, s)] for v in x]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    white = np.array([[float(Fraction(a, n)) for a in v] for v in centred]) @ vectors[:, order] / np.sqrt(values[order])
    return n, [sum(a * a for a in v) for v in centred], white, values[order] / np.trace(cov)


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain(spark, sf):
    ids, rows = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet' ORDER BY vec_id").fetchall())
    n, deviation, white, explained = plain(rows)
    found = by_row(queries.op12_whitening(spark, f"/root/testdata/{sf}"))
    got = np.array([[found[i][c].whitened for c in range(1, 33)] for i in ids])
    sign = np.sign((got * white).sum(0))
    assert np.allclose(got * sign, white, atol=1e-6)
    for i, d in zip(ids, deviation):
        for c, r in found[i].items():
            assert (r.n, r.deviation) == (n, d) and math.isclose(r.explained, explained[c - 1], rel_tol=1e-9) and r.identity_error < 1e-9


def test_scatter_is_exact_for_great_numbers(spark):
    """Numbers whose squares no double holds, dealt in many ways."""
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.randrange(12) for _ in range(3)]) for i in range(300)]
    x, n, size, top = whitening.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7))
    model = whitening.fit(x, n, size, top)
    whole = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    moduli = whitening.primes((n * top**2).bit_length() + 2)
    assert len(moduli) > 4
    sums = whitening.residue_sums(x, size, moduli)
    for i in range(3):
        for j in range(i, 3):
            assert whitening.from_residues([sums[k, i, j] % p for k, p in enumerate(moduli)], moduli) == sum(v[i] * v[j] for v in whole)
    assert model.sums == [sum(v[i] for v in whole) for i in range(3)]
    found = by_row(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    white = np.array([[found[i][c].whitened for c in (1, 2, 3)] for i, _ in rows])
    assert np.allclose(white.T @ white / len(rows), np.eye(3), atol=1e-9) and found[0][1].identity_error < 1e-9


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, x string, n string"
    good = [(i, [float(i % 5), float(i % 3), 1.5]) for i in range(20)] + [(3, [3.0, 0.0, 1.5]), (None, [1.0, 1.0, 1.5])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 2.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, None, "a", "b") for r in good + bad], schema)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 3 * len(good) and {r.vec_id for r in rows} == {i for i, _ in good}
    flat = [r for r in rows if r.component == 3]
    assert all(r.whitened == 0 and abs(r.explained) < 1e-12 for r in flat)  # the third entry never varies
    assert all(r.n == len(good) and r.identity_error < 1e-9 for r in rows)
    _, deviation, white, _ = plain([v for _, v in good], 2)
    assert sorted(r.deviation for r in flat) == sorted(deviation)
    one = whitening.whiten(df.filter("vec_id = 7")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, 0, 0, 0) for c in (1, 2, 3)]
    for none in (df.limit(0), df.filter("vec_id >= 100 AND vec_id < 105")):
        assert whitening.whiten(none).count() == 0
    far = spark.createDataFrame([(i, [float(i) * 1e15, float(i % 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far).collect() if r.vec_id in (0, 8)} == {None}
