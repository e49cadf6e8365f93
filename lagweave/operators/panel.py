"""Panels: many series in long form, one row per key and time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.errors import NumericalError, SpecificationError, guard, not_finite, translated


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the key columns, the time column and the value columns of a panel.

    Order within a key is by ``time``, by position and not by calendar: a missing month is not a gap.
    """

    keys: tuple[str, ...]
    time: str
    values: tuple[str, ...]

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(self.time)

    def check(self, df: DataFrame) -> None:
        for name in (*self.keys, self.time, *self.values):
            if name not in df.columns:
                raise SpecificationError(f"no column {name!r}")
        if not self.values:
            raise SpecificationError("a panel needs a value column")
        for name in self.values:
            if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
                raise SpecificationError(f"{name!r} is not numeric")


def finite(v: Column) -> Column:
    """``v`` as double; null, NaN and infinities raise."""
    v = v.cast("double")
    return guard(not_finite(v), NumericalError, "values must be finite", v)


def as_panel(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Keys, time and values, the latter guarded; a second row at one time of a key raises."""
    spec.check(df)
    repeated = F.lag(spec.time).over(spec.window()) == F.col(spec.time)
    first = spec.values[0]
    out = df.select(*spec.keys, spec.time, *[finite(F.col(v)).alias(v) for v in spec.values])
    return out.withColumn(first, guard(repeated | F.col(spec.time).isNull(), SpecificationError, "times must be unique within a series", F.col(first)))


def validated(df: DataFrame, values: tuple[str, ...], validate: str) -> DataFrame:
    """``lazy``: errors surface with the rows. ``eager``: one pass now, which raises this package's classes."""
    if validate not in ("lazy", "eager"):
        raise SpecificationError("validate is 'lazy' or 'eager'")
    if validate == "eager" and values:
        with translated():
            df.agg(*[F.max(v) for v in values]).collect()
    return df
