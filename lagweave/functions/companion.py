"""Companion matrices and selectors as array columns, and as (i, j, v) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.errors import DimensionError, NumericalError, guard
from lagweave.functions import lagpoly as lp


def normalized(a: Column, matrix: bool = False) -> Column:
    """Checked coefficients as 1x1 or kxk matrices: square, then finite."""

    def checked(a: Column) -> Column:
        out = guard(~lp.all_finite(a, matrix), NumericalError, "coefficients must be finite", a)
        if matrix:
            return guard(~lp.square(a), DimensionError, "coefficients must be square", out)
        return F.transform(out, lambda x: F.array(F.array(x)))

    return lp.bind(lp.as_double(a, matrix), checked)


def companion_matrix(a: Column, matrix: bool = False) -> Column:
    """The (kp, kp) companion: ``[A_1 .. A_p]`` above an identity that shifts the blocks down."""

    def built(m: Column) -> Column:
        p, k = F.size(m), F.size(F.get(m, F.lit(0)))
        top = F.transform(lp.upto(k), lambda i: F.flatten(F.transform(m, lambda block: F.get(block, i))))
        shift = F.transform(lp.upto(k * (p - 1)), lambda i: F.transform(lp.upto(k * p), lambda j: F.when(i == j, 1.0).otherwise(0.0)))
        return guard(p < 1, DimensionError, "a companion needs a coefficient", F.concat(top, shift))

    return lp.bind(normalized(a, matrix), built)


def companion_from_polynomial(c: Column, matrix: bool = False) -> Column:
    return companion_matrix(lp.ar_coeffs(c, matrix), matrix)


def selector_matrix(k: int | Column, p: int | Column) -> Column:
    """``[I_k, 0, .., 0]``, of shape (k, kp)."""
    for n in (k, p):
        if isinstance(n, int) and n < 1:
            raise DimensionError("k and p must be at least 1")
    k, p = (F.lit(n) if isinstance(n, int) else n for n in (k, p))
    rows = F.transform(lp.upto(k), lambda i: F.transform(lp.upto(k * p), lambda j: F.when(i == j, 1.0).otherwise(0.0)))
    return guard((k < 1) | (p < 1), DimensionError, "k and p must be at least 1", rows)


def entries(df: DataFrame, id_column: str, matrix: Column) -> DataFrame:
    """A matrix column as rows ``(id, i, j, v)``, zeros included."""
    rows = df.select(id_column, F.posexplode(matrix).alias("i", "__row"))
    return rows.select(id_column, "i", F.posexplode("__row").alias("j", "v"))


def companion_entries(df: DataFrame, id_column: str, a: Column) -> DataFrame:
    """The non-zero pattern of the companion of a matrix autoregression as rows, for relational work on large kp."""
    m = df.select(id_column, a.alias("__a"), F.size(F.get(a, F.lit(0))).alias("__k"), F.size(a).alias("__p"))
    top = m.select(id_column, "__k", F.posexplode("__a").alias("b", "__m")).select(id_column, "__k", "b", F.posexplode("__m").alias("i", "__r"))
    top = top.select(id_column, "i", (F.col("b") * F.col("__k")).alias("o"), F.posexplode("__r").alias("c", "v")).select(id_column, "i", (F.col("o") + F.col("c")).alias("j"), "v")
    shift = m.select(id_column, "__k", F.explode(lp.upto(F.col("__k") * (F.col("__p") - 1))).alias("j"))
    return top.unionByName(shift.select(id_column, (F.col("j") + F.col("__k")).alias("i"), "j", F.lit(1.0).alias("v")))
