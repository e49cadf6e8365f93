import cmath

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from lagweave.errors import DimensionError, NumericalError, SpecificationError, translated
from lagweave.functions import companion as co
from lagweave.functions import lagpoly as lp
from lagweave.functions import stability as st

M = "array<array<array<double>>>"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, kind="array<double>"):
    return spark.createDataFrame([(value,)], f"a {kind}")


def of(df, c):
    return df.select(c.alias("x")).first()["x"]


def fails(kind, df, c):
    with pytest.raises(kind), translated():
        of(df, c)


def test_from_ar(spark):
    df = one(spark, [0.5, -0.3])
    p = lp.LagPolynomial.from_ar_coeffs(df, "a")
    assert of(df, p.coefficients) == [1, -0.5, 0.3] and of(df, p.ar_coeffs()) == [0.5, -0.3]
    assert of(df, p.degree) == 2 and of(df, p.dim) == 1 and not p.is_matrix
    assert of(df, p.describe()) == "LagPolynomial(degree=2, dim=1)"
    assert of(df, p.evaluate(F.lit(1.0)))["re"] == pytest.approx(0.8)
    assert of(one(spark, []), lp.from_ar(F.col("a"))) == [1.0]


def test_guards_of_polynomials(spark):
    fails(DimensionError, one(spark, []), lp.polynomial(F.col("a")))
    fails(NumericalError, one(spark, [1.0, float("nan")]), lp.polynomial(F.col("a")))
    fails(NumericalError, one(spark, [float("inf")]), lp.from_ar(F.col("a")))
    fails(DimensionError, one(spark, [[[1.0, 2.0]]], M), lp.polynomial(F.col("a"), True))
    fails(DimensionError, one(spark, [], M), lp.from_ar(F.col("a"), True))
    with pytest.raises(DimensionError):
        lp.LagPolynomial.of(one(spark, [[1.0]], "array<array<double>>"), "a")
    with pytest.raises(DimensionError):
        lp.multiply(F.col("a"), F.col("a"), True, False)
    with pytest.raises(DimensionError):
        lp.roots(F.col("a"), True)


def test_leading_coefficient_tolerance(spark):
    for lead, ok in ((1 + 9e-6, True), (1 + 2e-5, False)):
        df = one(spark, [lead, 0.5])
        if ok:
            assert of(df, lp.ar_coeffs(df["a"])) == [-0.5]
        else:
            fails(SpecificationError, df, lp.ar_coeffs(df["a"]))
    fails(SpecificationError, one(spark, [[[1.0, 1e-9], [0.0, 1.0]]], M), lp.ar_coeffs(F.col("a"), True))
    assert of(one(spark, [[[1.0, 1e-11], [0.0, 1.0]]], M), lp.ar_coeffs(F.col("a"), True)) == []


def test_products(spark):
    df = one(spark, [1.0, -0.5, 0.3])
    p = lp.LagPolynomial(df["a"])
    assert of(df, (p * lp.LagPolynomial(F.array(F.lit(1.0), F.lit(-1.0)))).column) == pytest.approx([1, -1.5, 0.8, -0.3])
    assert p.__mul__(3) is NotImplemented and p.__eq__(3) is NotImplemented
    assert of(df, p == p) is True and of(df, p == lp.LagPolynomial(F.array(F.lit(1.0)))) is False
    assert of(df, p == lp.LagPolynomial(df["a"], True)) is False
    with pytest.raises(TypeError):
        hash(p)
    fails(NumericalError, one(spark, [1.0, 1e308]), lp.multiply(F.col("a"), F.array(F.lit(1.0), F.lit(1e10))))


def test_matrix_products_do_not_commute(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 3, 3)), rng.normal(size=(4, 3, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], f"a {M}, b {M}")

    def want(x, y):
        out = np.zeros((5, 3, 3))
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                out[i + j] += p @ q
        return out

    ab, ba = (np.array(of(df, lp.multiply(df[x], df[y], True, True))) for x, y in ("ab", "ba"))
    assert np.allclose(ab, want(a, b)) and np.allclose(ba, want(b, a)) and not np.allclose(ab, ba)
    fails(DimensionError, spark.createDataFrame([([[[1.0]]], b.tolist())], f"a {M}, b {M}"), lp.multiply(F.col("a"), F.col("b"), True, True))


def test_evaluation_at_a_frequency(spark):
    z = cmath.exp(-0.7j)
    df = one(spark, [1.0, -0.5, 0.3])
    got, want = of(df, lp.evaluate(df["a"], F.lit(z.real), F.lit(z.imag))), 1 - 0.5 * z + 0.3 * z * z
    assert (got["re"], got["im"]) == pytest.approx((want.real, want.imag))
    m = one(spark, [[[1.0, 0.0], [0.0, 1.0]], [[0.5, 2.0], [0.0, -1.0]]], M)
    cell = of(m, lp.evaluate(m["a"], F.lit(2.0), matrix=True))
    assert [[c["re"] for c in r] for r in cell] == [[2.0, 4.0], [0.0, -1.0]]


def test_roots_drop_trailing_zeros(spark):
    df = one(spark, [1.0, -0.5, 0.0])
    for found in (lp.roots(df["a"]), lp.roots_p2(df["a"])):
        assert [complex(z["re"], z["im"]) for z in of(df, found)] == pytest.approx([2.0])
    assert of(df, lp.degree(df["a"])) == 2


def test_companion(spark):
    df = one(spark, [0.5, -0.3])
    assert of(df, co.companion_matrix(df["a"])) == [[0.5, -0.3], [1, 0]]
    assert of(df, co.companion_from_polynomial(lp.from_ar(df["a"]))) == [[0.5, -0.3], [1, 0]]
    assert of(one(spark, [0.5]), co.companion_matrix(F.col("a"))) == [[0.5]]
    blocks = np.arange(1.0, 13).reshape(3, 2, 2)
    got = np.array(of(one(spark, blocks.tolist(), M), co.companion_matrix(F.col("a"), True)))
    assert np.array_equal(got[:2], np.hstack(list(blocks))) and np.array_equal(got[2:], np.eye(6)[:4])
    fails(DimensionError, one(spark, []), co.companion_matrix(F.col("a")))
    fails(NumericalError, one(spark, [float("nan")]), co.companion_matrix(F.col("a")))
    fails(DimensionError, one(spark, [1.0]), co.companion_from_polynomial(F.col("a")))


def test_selector(spark):
    assert of(one(spark, []), co.selector_matrix(2, 2)) == [[1, 0, 0, 0], [0, 1, 0, 0]]
    for k, p in ((0, 1), (1, 0)):
        with pytest.raises(DimensionError):
            co.selector_matrix(k, p)


def test_stability(spark):
    df = one(spark, [0.5])
    r = of(df, st.assess_stability(df["a"]))
    assert r["is_stable"] and r["max_modulus"] == 0.5 and r["tol"] == 1e-8
    assert of(one(spark, [1.5]), st.is_stationary(F.col("a"))) is False
    unit = of(one(spark, [1.0]), st.assess_stability(F.col("a"), allow_unit_roots=True))
    assert unit["is_stable"] and unit["n_unit_roots"] == 1
    triple = of(one(spark, [3.0, -3.0, 1.0]), st.assess_stability(F.col("a")))
    assert triple["max_modulus"] == pytest.approx(1, abs=1e-4) and not triple["is_stable"]
    for c in (st.assess_stability, st.is_stationary):
        fails(DimensionError, one(spark, []), c(F.col("a")))
        fails(NumericalError, one(spark, [float("nan")]), c(F.col("a")))
    for tol in (-1.0, float("nan")):
        with pytest.raises(SpecificationError):
            st.assess_stability(F.col("a"), tol=tol)


def test_stability_of_given_companions(spark):
    kind = "array<array<double>>"
    assert of(one(spark, [], kind), st.assess_stability_from_companion(F.col("a")))["is_stable"]
    assert of(one(spark, [[0.0, 1.0], [-0.25, 0.0]], kind), st.assess_stability_from_companion(F.col("a")))["max_modulus"] == pytest.approx(0.5)
    fails(DimensionError, one(spark, [[1.0, 2.0]], kind), st.assess_stability_from_companion(F.col("a")))
    fails(NumericalError, one(spark, [[float("nan")]], kind), st.assess_stability_from_companion(F.col("a")))


def test_ragged_sizes_in_one_batch(spark):
    rows = [(0, [0.5]), (1, [0.2, 0.1]), (2, [2.0]), (3, [0.1, 0.1, 0.9])]
    df = spark.createDataFrame(rows, "i int, a array<double>").coalesce(1)
    got = {r["i"]: r["s"]["is_stable"] for r in df.select("i", st.assess_stability(df["a"]).alias("s")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_moving_average_sign(spark):
    df = one(spark, [0.5, 0.6])
    assert of(df, st.is_invertible(df["a"])) is False
    assert of(df, st.is_invertible(df["a"], ma_sign="plus")) is True
    assert of(df, st.is_invertible(df["a"], native=True)) is False
    with pytest.raises(SpecificationError):
        st.is_invertible(df["a"], ma_sign="?")


@SLOW
@given(a=hs.lists(hs.floats(-1.5, 1.5).filter(lambda x: abs(x) > 1e-3), min_size=1, max_size=5))
def test_eigenvalues_are_reciprocal_roots_and_step_down_agrees(spark, a):
    df = one(spark, a)
    r = of(df, st.assess_stability(df["a"]))
    roots = of(df, lp.roots(lp.from_ar(df["a"])))
    eigen = sorted(abs(complex(z["re"], z["im"])) for z in r["eigenvalues"])
    assert eigen == pytest.approx(sorted(1 / abs(complex(z["re"], z["im"])) for z in roots), rel=1e-5)
    if abs(r["max_modulus"] - 1) > 1e-6:
        assert of(df, st.is_stationary(df["a"], native=True)) == r["is_stable"]
