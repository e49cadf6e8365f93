"""Error classes, and guards that raise inside a plan.

Parameter errors raise at once in Python. Data errors are found while rows are computed: a guard wraps the value
it protects, so that no rewriting of the plan can drop the guard and keep the value. Spark reports them as its own
exception; ``translated`` turns that into the class the guard names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F


class LagweaveError(Exception):
    """Base of all errors of this package."""


class DimensionError(LagweaveError, ValueError):
    """Shapes that do not fit."""


class SpecificationError(LagweaveError, ValueError):
    """A parameter or input outside what an operation is defined for."""


class NumericalError(LagweaveError, RuntimeError):
    """Values that are not finite, or a computation that breaks down."""


class StabilityWarning(UserWarning):
    """A model near or beyond the edge of stability."""


_CLASSES = {c.__name__: c for c in (DimensionError, SpecificationError, NumericalError)}
_MARK = re.compile(rf"\[({'|'.join(_CLASSES)})\] ([^\n]*)")


def guard(bad: Column, kind: type[LagweaveError], message: str, value: Column) -> Column:
    """``value``, or an error where ``bad`` is true."""
    return F.when(bad, F.raise_error(F.lit(f"[{kind.__name__}] {message}"))).otherwise(value)


@contextmanager
def translated() -> Iterator[None]:
    """Raises the guard's error class for a Spark error that a guard has caused."""
    try:
        yield
    except PySparkException as e:
        if m := _MARK.search(str(e)):
            raise _CLASSES[m[1]](m[2].rstrip("'\" ")) from e
        raise


def not_finite(v: Column) -> Column:
    """True for null, NaN and infinities."""
    return v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
