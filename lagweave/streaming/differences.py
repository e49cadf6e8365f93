"""Differences of a panel that arrives as a stream.

Batch windows are not defined on streams, so each key keeps the last value of every order below ``d`` as state. Rows of a
micro-batch are put in time order within their key; a row that is not later than the key's last one is an error, since a
difference once sent cannot be taken back. A key's state, ``d`` numbers and a time, is kept for as long as the query runs: a difference
needs its predecessor however long ago that came, so the state grows with the number of keys (not with that of rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lagweave.errors import NumericalError, SpecificationError
from lagweave.operators.panel import SeriesSpec
from lagweave.session import ship


def stream_difference(df: DataFrame, spec: SeriesSpec, d: int = 1) -> DataFrame:
    """``(1 - L)^d`` of a streaming panel with one value column, in append mode."""
    spec.check(df)
    if d < 1 or len(spec.values) != 1 or not spec.keys:
        raise SpecificationError("a streaming difference needs d of at least 1, keys and one value column")
    ship(df.sparkSession)
    value, names = spec.values[0], [*spec.keys, spec.time]
    output = T.StructType([df.schema[c] for c in names] + [T.StructField(value, T.DoubleType())])
    state_type = T.StructType([T.StructField("last", T.ArrayType(T.DoubleType())), T.StructField("time", df.schema[spec.time].dataType)])

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, time = state.get if state.exists else ([], None)
        last = list(last)
        rows = pd.concat(list(batches)).sort_values(spec.time)
        out = []
        for t, y in zip(rows[spec.time].tolist(), rows[value].astype(float).tolist(), strict=True):
            if time is not None and t <= time:
                raise SpecificationError("[SpecificationError] a row that is not later than the last one of its series")
            if y != y or abs(y) == float("inf"):
                raise NumericalError("[NumericalError] values must be finite")
            time, current, orders = t, y, []
            for before in last:  # last[i]: the last value of order i
                orders.append(current)
                current = current - before
            if len(last) == d:
                out.append((*key, t, current))
                last = orders
            else:
                last = [*orders, current]
        state.update((last, time))
        yield pd.DataFrame(out, columns=output.names)

    return df.select(*names, value).groupBy(*spec.keys).applyInPandasWithState(advance, output, state_type, "append", GroupStateTimeout.NoTimeout)
