"""Stability of autoregressions: eigenvalues by Arrow batches, or natively by the step-down recursion."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lagweave.errors import DimensionError, NumericalError, SpecificationError, guard
from lagweave.functions import lagpoly as lp

RESULT = "struct<eigenvalues:array<struct<re:double,im:double>>,max_modulus:double,is_stable:boolean,n_unit_roots:int,n_explosive:int,tol:double>"


def _check(tol: float) -> None:
    if not (math.isfinite(tol) and tol >= 0):
        raise SpecificationError("tol must be finite and not negative")


def assess_batch(matrices: list[np.ndarray], tol: float, allow_unit_roots: bool) -> list[dict]:
    """Results in order; matrices of one size go to the eigenvalue solver as one stack."""
    out: list[dict] = [{} for _ in matrices]
    by_size = defaultdict(list)
    for i, m in enumerate(matrices):
        by_size[m.shape].append(i)
    for shape, rows in by_size.items():
        if shape[0] == 0:
            for i in rows:
                out[i] = {"eigenvalues": [], "max_modulus": 0.0, "is_stable": True, "n_unit_roots": 0, "n_explosive": 0, "tol": tol}
            continue
        stack = np.stack([matrices[i] for i in rows])
        if not np.isfinite(stack).all():
            raise NumericalError("[NumericalError] the matrix must be finite")
        for i, values in zip(rows, np.linalg.eigvals(stack), strict=True):
            modulus = np.abs(values)
            if not np.isfinite(modulus).all():
                raise NumericalError("[NumericalError] eigenvalues are not finite")
            explosive, largest = int((modulus > 1 + tol).sum()), float(modulus.max())
            out[i] = {
                "eigenvalues": [{"re": float(v.real), "im": float(v.imag)} for v in values.astype(complex)], "max_modulus": largest,
                "is_stable": explosive == 0 if allow_unit_roots else bool(largest < 1 - tol),
                "n_unit_roots": int((np.abs(modulus - 1) <= tol).sum()), "n_explosive": explosive, "tol": tol,
            }
    return out


def assess_stability_from_companion(c: Column, *, tol: float = 1e-8, allow_unit_roots: bool = False) -> Column:
    """The result struct for a column of square matrices; a 0x0 matrix is stable."""
    _check(tol)

    @F.pandas_udf(RESULT)
    def run(batch: pd.Series) -> pd.DataFrame:
        matrices = [np.array([list(r) for r in m], dtype=float).reshape(len(m), -1 if len(m) else 0) for m in batch]
        return pd.DataFrame(assess_batch(matrices, tol, allow_unit_roots), columns=["eigenvalues", "max_modulus", "is_stable", "n_unit_roots", "n_explosive", "tol"])

    c = c.cast("array<array<double>>")
    return run(guard(c.isNull() | ~F.forall(c, lambda r: F.size(r) == F.size(c)), DimensionError, "the matrix must be square", c))


def companions(batch: pd.Series, matrix: bool) -> list[np.ndarray]:
    """Companions of a batch of coefficient sets: rank, then finite values, then at least one coefficient."""
    out = []
    for a in batch:
        if a is None or len(a) == 0:
            raise DimensionError("[DimensionError] a companion needs a coefficient")
        try:
            blocks = np.array([[list(r) for r in m] for m in a] if matrix else [[[x]] for x in a], dtype=float)
        except (TypeError, ValueError) as e:
            raise DimensionError("[DimensionError] coefficients must be square") from e
        p, k = len(blocks), blocks.shape[1]
        if blocks.ndim != 3 or blocks.shape[1] != blocks.shape[2] or k == 0:
            raise DimensionError("[DimensionError] coefficients must be square")
        if not np.isfinite(blocks).all():
            raise NumericalError("[NumericalError] coefficients must be finite")
        c = np.eye(k * p, k=-k)
        c[:k] = np.hstack(list(blocks))
        out.append(c)
    return out


def assess_stability(a: Column, matrix: bool = False, *, tol: float = 1e-8, allow_unit_roots: bool = False) -> Column:
    """The result struct for a column of coefficient sets. The companions are built where their eigenvalues are, so only coefficients travel."""
    _check(tol)

    @F.pandas_udf(RESULT)
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(assess_batch(companions(batch, matrix), tol, allow_unit_roots), columns=["eigenvalues", "max_modulus", "is_stable", "n_unit_roots", "n_explosive", "tol"])

    return run(lp.as_double(a, matrix))


def step_down(a: Column, tol: float = 1e-8) -> Column:
    """Whether all roots of a scalar autoregression lie within ``1 - tol``, without Python (Schur-Cohn).

    Coefficients are scaled to the unit circle; then each step removes the last one, which must stay below 1.
    """
    _check(tol)
    a = a.cast("array<double>")
    r = F.lit(1.0 - tol)
    scaled = F.transform(a, lambda x, i: x / F.pow(r, i + 1))
    start = F.struct(scaled.alias("b"), F.lit(True).alias("ok"))

    def step(acc: Column, _: Column) -> Column:
        b = acc["b"]
        m = F.size(b)
        last = F.get(b, m - 1)
        ok = acc["ok"] & (F.abs(last) < 1)
        rest = F.transform(F.slice(b, F.lit(1), m - 1), lambda x, i: (x + last * F.get(b, m - 2 - i)) / (1 - last * last))
        return F.struct(F.when(ok, rest).otherwise(F.slice(b, F.lit(1), m - 1)).alias("b"), ok.alias("ok"))

    verdict = F.aggregate(a, start, step, lambda acc: acc["ok"])
    checked = guard(~lp.all_finite(a, False), NumericalError, "coefficients must be finite", verdict)
    return guard(F.size(a) < 1, DimensionError, "a companion needs a coefficient", checked)


def is_stationary(a: Column, matrix: bool = False, *, tol: float = 1e-8, native: bool = False) -> Column:
    """Strict stability. ``native`` uses the step-down recursion (scalar coefficients only)."""
    if native and not matrix:
        return step_down(a, tol)
    return assess_stability(a, matrix, tol=tol)["is_stable"]


def is_invertible(m: Column, matrix: bool = False, *, tol: float = 1e-8, native: bool = False, ma_sign: str = "minus") -> Column:
    """Invertibility of a moving average laid out as an autoregression, ``I - M_1 L - ...``; ``ma_sign="plus"`` is for ``I + M_1 L + ...``."""
    if ma_sign not in ("minus", "plus"):
        raise SpecificationError("ma_sign is 'minus' or 'plus'")
    m = lp.as_double(m, matrix)
    return is_stationary(lp.negated(m, matrix) if ma_sign == "plus" else m, matrix, tol=tol, native=native)
