"""Stationarity transforms of panels and their inverses, as window and aggregate plans."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagweave.errors import DimensionError, NumericalError, SpecificationError, guard
from lagweave.operators.panel import SeriesSpec, as_panel, finite, validated

_N = "__position"


def _across(df: DataFrame, spec: SeriesSpec, step: int, times: int) -> DataFrame:
    """Differences between value columns; the result's columns keep the later name."""
    names, columns = list(spec.values), {v: finite(F.col(v)) for v in spec.values}
    for _ in range(times):
        columns = {b: columns[b] - columns[a] for a, b in zip(names, names[step:], strict=False)}
        names = names[step:]
    return df.select(*spec.keys, spec.time, *[columns[n].alias(n) for n in names])


def _validated_across(out: DataFrame, spec: SeriesSpec, lost: int, validate: str) -> DataFrame:
    return validated(out, spec.values[lost:], validate)


def difference(df: DataFrame, spec: SeriesSpec, d: int = 1, *, axis: int = 0, validate: str = "lazy") -> DataFrame:
    """``(1 - L)^d`` along time (axis 0) or across the value columns (axis 1).

    A series of at most ``d`` rows gives no rows. All passes share one exchange and one sort.
    """
    if d < 0:
        raise SpecificationError("d must not be negative")
    if axis == 1:
        spec.check(df)
        return _validated_across(_across(df, spec, 1, d), spec, d, validate)
    w, out = spec.window(), as_panel(df, spec)
    for _ in range(d):
        out = out.withColumns({v: F.col(v) - F.lag(v).over(w) for v in spec.values})
    if d:
        out = out.withColumn(_N, F.row_number().over(w)).where(F.col(_N) > d).drop(_N)
    return validated(out, spec.values, validate)


def seasonal_difference(df: DataFrame, spec: SeriesSpec, s: int, capital_d: int = 1, *, axis: int = 0, validate: str = "lazy") -> DataFrame:
    """``(1 - L^s)^D``. A series that is too short for any pass raises DimensionError."""
    if s < 1:
        raise SpecificationError("s must be at least 1")
    if capital_d < 0:
        raise SpecificationError("capital_d must not be negative")
    if axis == 1:
        spec.check(df)
        if capital_d and len(spec.values) <= s * capital_d:
            raise DimensionError("too few columns for the seasonal difference")
        return _validated_across(_across(df, spec, s, capital_d), spec, s * capital_d, validate)
    w, out = spec.window(), as_panel(df, spec)
    if capital_d:
        everything = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        short = F.count(F.lit(1)).over(everything) <= s * capital_d
        first = spec.values[0]
        # a short series has no row that survives, so its first row stays and raises
        out = out.withColumn("__short", short)
        for _ in range(capital_d):
            out = out.withColumns({v: F.col(v) - F.lag(v, s).over(w) for v in spec.values})
        out = out.withColumn(_N, F.row_number().over(w)).where((F.col(_N) > s * capital_d) | F.col("__short"))
        out = out.withColumn(first, guard(F.col("__short"), DimensionError, "series too short for the seasonal difference", F.col(first))).drop(_N, "__short")
    return validated(out, spec.values, validate)


def _log(v: Column) -> Column:
    v = finite(v)
    return guard(v <= 0, SpecificationError, "the logarithm needs positive values", F.ln(v))


def log_transform(df: DataFrame, spec: SeriesSpec, *, validate: str = "lazy") -> DataFrame:
    """Natural logarithm; no shuffle."""
    spec.check(df)
    out = df.select(*spec.keys, spec.time, *[_log(F.col(v)).alias(v) for v in spec.values])
    return validated(out, spec.values, validate)


def log_difference(df: DataFrame, spec: SeriesSpec, *, axis: int = 0, validate: str = "lazy") -> DataFrame:
    return difference(log_transform(df, spec), spec, 1, axis=axis, validate=validate)


@dataclass(frozen=True)
class Standardized:
    """Standardised values, and per key ``mean_v`` and ``scale_v`` of each value column."""

    values: DataFrame
    parameters: DataFrame
    spec: SeriesSpec

    def inverse(self, values: DataFrame | None = None) -> DataFrame:
        """``value * scale + mean``; the values are not checked."""
        joined = _with_parameters(self.values if values is None else values, self.parameters, self.spec)
        return joined.select(*self.spec.keys, self.spec.time, *[(F.col(v) * F.col(f"scale_{v}") + F.col(f"mean_{v}")).alias(v) for v in self.spec.values])


def _with_parameters(df: DataFrame, parameters: DataFrame, spec: SeriesSpec) -> DataFrame:
    if not spec.keys:
        return df.crossJoin(F.broadcast(parameters))  # a single row
    left, right = df.alias("l"), parameters.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in spec.keys])
    return left.join(right, same).select("l.*", *[f"r.{c}" for c in parameters.columns if c not in spec.keys])


def standardize(df: DataFrame, spec: SeriesSpec, *, axis: int = 0, ddof: int = 0, validate: str = "lazy") -> Standardized:
    """``(v - mean) / scale`` per key and column.

    Means and scales come from one aggregate with partial sums and are joined back: the optimizer broadcasts them if
    they are small, and a long series is never gathered in one task.
    """
    spec.check(df)
    panel = df.select(*spec.keys, spec.time, *[finite(F.col(v)).alias(v) for v in spec.values])
    if axis == 1:
        return _standardize_rows(panel, spec, ddof, validate)
    parameters = []
    for v in spec.values:
        n = F.count(v)
        scale = F.stddev_pop(v) if ddof == 0 else F.stddev_pop(v) * F.sqrt(n / F.nullif(n - ddof, F.lit(0)))
        scale = guard(scale == 0, NumericalError, "zero scale", scale)
        parameters += [F.avg(v).alias(f"mean_{v}"), guard(n <= ddof, SpecificationError, "ddof must be below the series' length", scale).alias(f"scale_{v}")]
    params = panel.groupBy(*spec.keys).agg(*parameters)
    joined = _with_parameters(panel, params, spec)
    values = joined.select(*spec.keys, spec.time, *[((F.col(v) - F.col(f"mean_{v}")) / F.col(f"scale_{v}")).alias(v) for v in spec.values])
    return Standardized(validated(values, spec.values, validate), params, spec)


def _standardize_rows(panel: DataFrame, spec: SeriesSpec, ddof: int, validate: str) -> Standardized:
    n = len(spec.values)
    if ddof >= n:
        raise SpecificationError("ddof must be below the number of columns")
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    mean = add([F.col(v) for v in spec.values]) / n
    with_mean = panel.withColumn("__m", mean)
    scale = F.sqrt(add([F.pow(F.col(v) - F.col("__m"), 2) for v in spec.values]) / (n - ddof))
    full = with_mean.withColumn("__s", guard(scale == 0, NumericalError, "zero scale", scale))
    keys = (*spec.keys, spec.time)
    params = full.select(*keys, *[c for v in spec.values for c in (F.col("__m").alias(f"mean_{v}"), F.col("__s").alias(f"scale_{v}"))])
    values = full.select(*keys, *[((F.col(v) - F.col("__m")) / F.col("__s")).alias(v) for v in spec.values])
    return Standardized(validated(values, spec.values, validate), params, replace(spec, keys=spec.keys + (spec.time,)))


def undifference(dx: DataFrame, spec: SeriesSpec, initials: DataFrame, *, d: int = 1, order: str = "ord", validate: str = "lazy") -> DataFrame:
    """The inverse of ``difference``: keys, ``pos`` from 0, time (null for anchors) and values.

    ``initials`` has ``d`` rows per key: anchors of the highest order first, by ``order``. Every pass is a running sum
    in one window over differences and anchors together, so all passes share one exchange and one sort.
    """
    if d < 1:
        raise SpecificationError("d must be at least 1")
    panel = as_panel(dx, spec)
    missing = [c for c in (*spec.keys, order, *spec.values) if c not in initials.columns]
    if missing:
        raise DimensionError(f"initials lack {missing}")
    rows = panel.withColumn(_N, F.row_number().over(spec.window()).cast("long"))
    nth = F.row_number().over(W.partitionBy(*spec.keys).orderBy(order)) - 1
    anchors = initials.select(*spec.keys, F.lit(None).cast(panel.schema[spec.time].dataType).alias(spec.time), *[finite(F.col(v)).alias(v) for v in spec.values], (-nth).cast("long").alias(_N))
    both = rows.unionByName(anchors)
    w = W.partitionBy(*spec.keys).orderBy(_N)
    everything = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = F.count(F.when(F.col(_N) <= 0, 1)).over(everything)
    first = spec.values[0]
    both = both.withColumn(first, guard(n != d, SpecificationError, "initials must have d rows for each series", F.col(first)))
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in range(d):
        both = both.withColumns({v: F.when(F.col(_N) >= -k, F.sum(F.when(F.col(_N) >= -k, F.col(v))).over(so_far)).otherwise(F.col(v)) for v in spec.values})
    out = both.select(*spec.keys, (F.col(_N) + d - 1).alias("pos"), spec.time, *spec.values)
    return validated(out, spec.values, validate)
