"""The operations as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lagweave.functions import stability as st
from lagweave.session import ship

_P = "ARRAY<DOUBLE>"



def _error(kind: str, what: str) -> str:
    return f"raise_error('[{kind}] {what}')"


def _finite(c: str) -> str:
    return f"forall({c}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"


def _checked(c: str, body: str, empty: str = "a polynomial needs a coefficient") -> str:
    """``body`` of coefficients that are there and finite."""
    return f"CASE WHEN {c} IS NULL OR size({c}) = 0 THEN {_error('DimensionError', empty)} WHEN NOT {_finite(c)} THEN {_error('NumericalError', 'coefficients must be finite')} ELSE {body} END"


#: 0, 1, .., n - 1 for n of at least 0 (``sequence(0, -1)`` would count down).
def _upto(n: str) -> str:
    return f"slice(sequence(0, greatest({n}, 1) - 1), 1, greatest({n}, 0))"


_PRODUCT = f"transform({_upto('size(a) + size(b) - 1')}, k -> aggregate(sequence(greatest(0, k - size(b) + 1), least(k, size(a) - 1)), 0D, (s, i) -> s + get(a, i) * get(b, k - i)))"
_SHIFT = f"transform({_upto('size(a) - 1')}, i -> transform({_upto('size(a)')}, j -> if(i = j, 1D, 0D)))"

#: Name, arguments, result and body of the functions that are plain SQL, with the guards of their Column forms.
NATIVE = {
    "lag_from_ar": (f"a {_P}", _P, f"CASE WHEN a IS NULL THEN {_error('DimensionError', 'a polynomial needs a coefficient')} WHEN NOT {_finite('a')} THEN {_error('NumericalError', 'coefficients must be finite')} ELSE concat(array(1D), transform(a, x -> -x)) END"),
    "lag_ar_coeffs": (f"c {_P}", _P, _checked("c", f"if(abs(get(c, 0) - 1) <= 1e-10 + 1e-5, transform(slice(c, 2, size(c) - 1), x -> -x), {_error('SpecificationError', 'the leading coefficient must be the identity')})")),
    "lag_multiply": (f"a {_P}, b {_P}", _P, _checked("a", _checked("b", f"get(transform(array({_PRODUCT}), p -> CASE WHEN {_finite('p')} THEN p ELSE {_error('NumericalError', 'coefficients must be finite')} END), 0)"))),
    "lag_degree": (f"c {_P}", "INT", _checked("c", "size(c) - 1")),
    "lag_evaluate": (f"c {_P}, z DOUBLE", "DOUBLE", _checked("c", "aggregate(reverse(c), 0D, (s, x) -> s * z + x)")),
    "lag_companion": (f"a {_P}", f"ARRAY<{_P}>", _checked("a", f"concat(array(a), {_SHIFT})", "a companion needs a coefficient")),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions for this session; returns their names."""
    ship(spark)
    for name, (arguments, result, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")

    @F.pandas_udf(st.RESULT)
    def ar_stability(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(st.assess_batch(st.companions(batch, False), 1e-8, False), columns=["eigenvalues", "max_modulus", "is_stable", "n_unit_roots", "n_explosive", "tol"])

    spark.udf.register("ar_stability", ar_stability)
    return [*NATIVE, "ar_stability"]
