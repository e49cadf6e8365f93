"""Lag polynomials as array columns: ``array<double>`` (scalar) or ``array<array<array<double>>>`` (matrix).

Element i of the array is the coefficient of ``L^i``. An autoregression ``A_1..A_p`` is the polynomial
``I - A_1 L - ... - A_p L^p``. A rank is a column's type, so it is known when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.errors import DimensionError, NumericalError, SpecificationError, guard, not_finite

COMPLEX = "struct<re:double,im:double>"
#: Relative part of the tolerance with which a leading coefficient may differ from the identity.
RELATIVE = 1e-5


def rank_of(kind: T.DataType) -> bool:
    """Whether a column of this type holds matrices; any other rank raises."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    if depth not in (1, 3) or not isinstance(kind, T.NumericType):
        raise DimensionError("coefficients are array<double> or array<array<array<double>>>")
    return depth == 3


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once: a guard names its value several times, and guards nest."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, .., n - 1; nothing if n is 0 (``sequence(0, -1)`` would count down)."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), F.greatest(n, F.lit(0)))


def add_up(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def as_double(c: Column, matrix: bool) -> Column:
    return c.cast("array<array<array<double>>>" if matrix else "array<double>")


def all_finite(c: Column, matrix: bool) -> Column:
    if not matrix:
        return F.forall(c, lambda x: ~not_finite(x))
    return F.forall(c, lambda m: F.forall(m, lambda r: F.forall(r, lambda x: ~not_finite(x))))


def square(c: Column) -> Column:
    k = F.size(F.get(c, F.lit(0)))
    return F.forall(c, lambda m: (F.size(m) == k) & (k > 0) & F.forall(m, lambda r: F.size(r) == k))


def polynomial(c: Column, matrix: bool = False) -> Column:
    """Checked coefficients: not empty, square, finite, in this order."""

    def checked(c: Column) -> Column:
        out = guard(~all_finite(c, matrix), NumericalError, "coefficients must be finite", c)
        if matrix:
            out = guard(~square(c), DimensionError, "coefficients must be square", out)
        return guard(c.isNull() | (F.size(c) == 0), DimensionError, "a polynomial needs a coefficient", out)

    return bind(as_double(c, matrix), checked)


def identity(k: Column) -> Column:
    return F.transform(upto(k), lambda i: F.transform(upto(k), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def dim(c: Column, matrix: bool = False) -> Column:
    return F.size(F.get(c, F.lit(0))) if matrix else F.lit(1)


def degree(c: Column) -> Column:
    """Number of coefficients less one; trailing zeros count."""
    return F.size(c) - 1


def is_matrix(kind: T.DataType) -> bool:
    return rank_of(kind)


def coefficients(c: Column) -> Column:
    return c


def negated(c: Column, matrix: bool) -> Column:
    if not matrix:
        return F.transform(c, lambda x: -x)
    return F.transform(c, lambda m: F.transform(m, lambda r: F.transform(r, lambda x: -x)))


def from_ar(a: Column, matrix: bool = False) -> Column:
    """``I - A_1 L - ... - A_p L^p``; without scalar coefficients it is 1."""
    a = as_double(a, matrix)
    if matrix:
        a = bind(a, lambda x: guard((F.size(x) == 0) | ~square(x), DimensionError, "coefficients must be square", x))
        return polynomial(bind(a, lambda x: F.concat(F.array(identity(dim(x, True))), negated(x, True))), True)
    return polynomial(F.concat(F.array(F.lit(1.0)), negated(a, False)))


def ar_coeffs(c: Column, matrix: bool = False, tol: float = 1e-10) -> Column:
    """``A_1..A_p``; the leading coefficient must be the identity within ``tol + 1e-5 * |identity|``."""
    return bind(c, lambda x: _ar_coeffs(x, matrix, tol))


def _ar_coeffs(c: Column, matrix: bool, tol: float) -> Column:
    near = lambda x, e: F.abs(x - F.lit(e)) <= F.lit(tol + RELATIVE * e)
    lead = F.get(c, F.lit(0))
    if matrix:
        off = F.exists(F.transform(lead, lambda r, i: F.exists(F.transform(r, lambda x, j: F.when(i == j, ~near(x, 1.0)).otherwise(~near(x, 0.0))), lambda b: b)), lambda b: b)
    else:
        off = ~near(lead, 1.0)
    return guard(off, SpecificationError, "the leading coefficient must be the identity", negated(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), matrix))


def multiply(a: Column, b: Column, a_matrix: bool = False, b_matrix: bool = False) -> Column:
    """The product; matrices do not commute. A product that overflows raises."""
    if a_matrix != b_matrix:
        raise DimensionError("a scalar and a matrix polynomial have no product")
    return bind(a, lambda x: bind(b, lambda y: _multiply(x, y, a_matrix)))


def _multiply(a: Column, b: Column, matrix: bool) -> Column:
    n = F.size(a) + F.size(b) - 1

    def pairs(k: Column) -> Column:  # i from max(0, k - q) to min(k, p)
        lo, hi = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
        return F.sequence(lo, hi)

    if not matrix:
        out = F.transform(upto(n), lambda k: add_up(F.transform(pairs(k), lambda i: F.get(a, i) * F.get(b, k - i))))
        return polynomial(out)
    size = dim(a, True)

    def cell(k: Column, r: Column, s: Column) -> Column:
        def block(total: Column, i: Column) -> Column:
            return F.aggregate(upto(size), total, lambda t, j: t + F.get(F.get(F.get(a, i), r), j) * F.get(F.get(F.get(b, k - i), j), s))

        return F.aggregate(pairs(k), F.lit(0.0), block)

    out = F.transform(upto(n), lambda k: F.transform(upto(size), lambda r: F.transform(upto(size), lambda s: cell(k, r, s))))
    return guard(size != dim(b, True), DimensionError, "matrices of unequal size", polynomial(out, True))


def equal(a: Column, b: Column) -> Column:
    """Same length and equal elements."""
    return a.eqNullSafe(b)


def describe(c: Column, matrix: bool = False) -> Column:
    return F.format_string("LagPolynomial(degree=%d, dim=%d)", degree(c), dim(c, matrix))


def _horner(c: Column, re: Column, im: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return F.aggregate(F.reverse(c), start, lambda z, x: F.struct((z["re"] * re - z["im"] * im + x).alias("re"), (z["re"] * im + z["im"] * re).alias("im")))


def evaluate(c: Column, re: Column, im: Column | None = None, matrix: bool = False) -> Column:
    """The value at ``re + im i`` as a struct, for matrices an array of rows of structs."""
    im = F.lit(0.0) if im is None else im
    if not matrix:
        return _horner(c, re, im)

    def cells(x: Column) -> Column:
        k = dim(x, True)
        return F.transform(upto(k), lambda r: F.transform(upto(k), lambda s: _horner(F.transform(x, lambda m: F.get(F.get(m, r), s)), re, im)))

    return bind(c, cells)


def roots(c: Column, matrix: bool = False) -> Column:
    """Complex roots of a scalar polynomial, by modulus, then real and imaginary part.

    Trailing zero coefficients have no roots, so there can be fewer roots than the degree says. Arrow batches,
    since eigenvalues of any size are no expression.
    """
    if matrix:
        raise DimensionError("only a scalar polynomial has roots here")

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def find(batch: pd.Series) -> pd.Series:
        out = []
        for x in batch:
            z = np.roots(np.asarray(x, dtype=float)[::-1]) if x is not None else np.zeros(0)
            z = sorted(z.tolist(), key=lambda v: (round(abs(v), 9), round(complex(v).real, 9), complex(v).imag))
            out.append([{"re": complex(v).real, "im": complex(v).imag} for v in z])
        return pd.Series(out)

    return find(c)


def roots_p2(c: Column) -> Column:
    """Roots of a polynomial of degree 2 or less in closed form, without Python."""
    c0, c1, c2 = (F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) for i in range(3))
    z = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    disc = c1 * c1 - 4 * c2 * c0
    r = F.sqrt(F.abs(disc))
    q = -0.5 * (c1 + F.when(c1 >= 0, r).otherwise(-r))  # no cancellation
    a = F.when(q == 0, F.lit(0.0)).otherwise(c0 / F.nullif(q, F.lit(0.0)))
    real = F.array(z(a, F.lit(0.0)), z(q / F.nullif(c2, F.lit(0.0)), F.lit(0.0)))
    two = F.nullif(2 * c2, F.lit(0.0))
    pair = F.array(z(-c1 / two, -r / F.abs(two)), z(-c1 / two, r / F.abs(two)))
    one = F.array(z(-c0 / F.nullif(c1, F.lit(0.0)), F.lit(0.0)))
    none = F.array().cast("array<struct<re:double,im:double>>")
    return F.when(F.size(c) > 3, F.raise_error(F.lit("[DimensionError] closed form up to degree 2"))).when(c2 != 0, F.when(disc < 0, pair).otherwise(real)).when(c1 != 0, one).otherwise(none)


@dataclass(frozen=True, eq=False)
class LagPolynomial:
    """A polynomial column with its rank: the functions above as methods and operators."""

    column: Column
    is_matrix: bool = False

    @classmethod
    def of(cls, df: DataFrame, name: str) -> LagPolynomial:
        matrix = rank_of(df.schema[name].dataType)
        return cls(polynomial(df[name], matrix), matrix)

    @classmethod
    def from_ar_coeffs(cls, df: DataFrame, name: str) -> LagPolynomial:
        matrix = rank_of(df.schema[name].dataType)
        return cls(from_ar(df[name], matrix), matrix)

    def __mul__(self, other: object) -> LagPolynomial:
        if not isinstance(other, LagPolynomial):
            return NotImplemented
        return LagPolynomial(multiply(self.column, other.column, self.is_matrix, other.is_matrix), self.is_matrix)

    def __eq__(self, other: object) -> Column:  # type: ignore[override]
        if not isinstance(other, LagPolynomial):
            return NotImplemented
        return equal(self.column, other.column) if self.is_matrix == other.is_matrix else F.lit(False)

    __hash__ = None  # type: ignore[assignment]

    @property
    def degree(self) -> Column:
        return degree(self.column)

    @property
    def dim(self) -> Column:
        return dim(self.column, self.is_matrix)

    @property
    def coefficients(self) -> Column:
        return self.column

    def describe(self) -> Column:
        return describe(self.column, self.is_matrix)

    def ar_coeffs(self, *, tol: float = 1e-10) -> Column:
        return ar_coeffs(self.column, self.is_matrix, tol)

    def evaluate(self, re: Column, im: Column | None = None) -> Column:
        return evaluate(self.column, re, im, self.is_matrix)

    def roots(self) -> Column:
        return roots(self.column, self.is_matrix)
