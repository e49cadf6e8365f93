import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs

from lagweave.errors import DimensionError, NumericalError, SpecificationError, translated
from lagweave.operators import transforms as tr
from lagweave.operators.panel import SeriesSpec

S = SeriesSpec(("k",), "t", ("y",))
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def panel(spark, **series):
    rows = [(k, t, None if v is None else float(v)) for k, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t int, y double").repartition(3)


def got(df, key="a", column="y", order="t"):
    return [r[column] for r in sorted(df.where(f"k = '{key}'").collect(), key=lambda r: r[order])]


def fails(kind, df):
    with pytest.raises(kind), translated():
        df.collect()


def test_difference(spark):
    df = panel(spark, a=[1, 3, 6, 10], b=[5])
    assert got(tr.difference(df, S)) == [2, 3, 4]
    assert got(tr.difference(df, S, 2)) == [1, 1]
    assert got(tr.difference(df, S, 0)) == [1, 3, 6, 10]
    assert tr.difference(df, S, 4).count() == 0 and got(tr.difference(df, S), "b") == []
    with pytest.raises(SpecificationError):
        tr.difference(df, S, -1)


def test_one_exchange_for_all_passes(spark):
    plan = tr.difference(panel(spark, a=[1.0, 2.0]).coalesce(1), S, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 1
    physical = tr.difference(panel(spark, a=[1.0, 2.0]), S, 3)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("hashpartitioning(k") == 1


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), float("-inf")])
def test_values_must_be_finite(spark, bad):
    df = panel(spark, a=[1, bad, 3])
    for out in (tr.difference(df, S), tr.seasonal_difference(df, S, 1), tr.log_transform(df, S), tr.standardize(df, S).values):
        fails(NumericalError, out)
    with pytest.raises(NumericalError):
        tr.difference(df, S, validate="eager")


def test_times_must_be_unique(spark):
    fails(SpecificationError, tr.difference(spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 2.0)], "k string, t int, y double"), S, 0))


def test_across_columns(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 3.0, 9.0)], "k string, t int, u double, v double, w double")
    spec = SeriesSpec(("k",), "t", ("u", "v", "w"))
    assert tuple(tr.difference(df, spec, axis=1).first()) == ("a", 0, 2.0, 6.0)
    assert tuple(tr.difference(df, spec, 2, axis=1).first()) == ("a", 0, 4.0)
    assert tuple(tr.seasonal_difference(df, spec, 2, axis=1).first()) == ("a", 0, 8.0)
    z = tr.standardize(df, spec, axis=1)
    assert z.values.first()["u"] == pytest.approx((1 - 13 / 3) / math.sqrt(((1 - 13 / 3) ** 2 + (3 - 13 / 3) ** 2 + (9 - 13 / 3) ** 2) / 3))


def test_seasonal_difference(spark):
    df = panel(spark, a=[1, 2, 4, 8, 16, 32])
    assert got(tr.seasonal_difference(df, S, 2)) == [3, 6, 12, 24]
    assert got(tr.seasonal_difference(df, S, 2, 2)) == [9, 18]
    assert got(tr.seasonal_difference(df, S, 2, 0)) == [1, 2, 4, 8, 16, 32]
    fails(DimensionError, tr.seasonal_difference(df, S, 3, 2))
    fails(DimensionError, tr.seasonal_difference(panel(spark, a=[1, 2]), S, 2))
    for s, d in ((0, 1), (1, -1)):
        with pytest.raises(SpecificationError):
            tr.seasonal_difference(df, S, s, d)


def test_logarithms(spark):
    df = panel(spark, a=[1, math.e, math.e**3])
    assert got(tr.log_transform(df, S)) == pytest.approx([0, 1, 3])
    assert got(tr.log_difference(df, S)) == pytest.approx([1, 2])
    for bad in (0, -1):
        fails(SpecificationError, tr.log_transform(panel(spark, a=[1, bad]), S))


def test_standardize(spark):
    df = panel(spark, a=[1, 2, 3], b=[2, 4, 9])
    z = tr.standardize(df, S)
    assert got(z.values) == pytest.approx([-1.224744871, 0, 1.224744871])
    assert {r["k"]: r["mean_y"] for r in z.parameters.collect()} == {"a": 2, "b": 5}
    assert got(z.inverse(), "b") == pytest.approx([2, 4, 9])
    assert got(tr.standardize(df, S, ddof=1).values) == pytest.approx([-1, 0, 1])
    fails(NumericalError, tr.standardize(panel(spark, a=[5, 5, 5]), S).values)
    fails(SpecificationError, tr.standardize(panel(spark, a=[5]), S, ddof=1).values)


def test_a_single_series_without_keys(spark):
    df = panel(spark, a=[1, 2, 3]).drop("k")
    spec = SeriesSpec((), "t", ("y",))
    assert sorted(r["y"] for r in tr.standardize(df, spec).inverse().collect()) == pytest.approx([1, 2, 3])


def anchors(spark, *values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, ord int, y double")


def test_undifference(spark):
    dx = panel(spark, a=[2, 3, 4])
    assert got(tr.undifference(dx, S, anchors(spark, 1)), order="pos") == [1, 3, 6, 10]
    two = panel(spark, a=[1, 1])
    assert got(tr.undifference(two, S, anchors(spark, 2, 1), d=2), order="pos") == [1, 3, 6, 10]
    with pytest.raises(SpecificationError):
        tr.undifference(dx, S, anchors(spark, 1), d=0)
    fails(SpecificationError, tr.undifference(dx, S, anchors(spark, 1, 2)))
    fails(NumericalError, tr.undifference(dx, S, anchors(spark, float("nan"))))
    with pytest.raises(DimensionError):
        tr.undifference(dx, S, anchors(spark, 1).drop("y"))


@SLOW
@given(values=hs.lists(hs.floats(-1e6, 1e6), min_size=4, max_size=12), d=hs.integers(1, 3))
def test_undifference_inverts_difference(spark, values, d):
    df, first, lower = panel(spark, a=values), [], values
    for _ in range(d):
        first.insert(0, lower[0])
        lower = [b - a for a, b in zip(lower, lower[1:], strict=False)]
    back = tr.undifference(tr.difference(df, S, d), S, anchors(spark, *first), d=d)
    assert got(back, order="pos") == pytest.approx(values, abs=1e-6 * 8**d)


@pytest.mark.parametrize("call", [
    lambda df, spec, v: tr.difference(df, spec, 1, axis=1, validate=v), lambda df, spec, v: tr.seasonal_difference(df, spec, 1, axis=1, validate=v),
    lambda df, spec, v: tr.log_difference(df, spec, axis=1, validate=v), lambda df, spec, v: tr.standardize(df, spec, axis=1, validate=v).values,
])
def test_validate_on_axis_1(spark, call):
    spec = SeriesSpec((), "t", ("a", "b", "c"))
    bad = spark.createDataFrame([(1, 1.0, float("nan"), 2.0)], "t int, a double, b double, c double")
    with pytest.raises(NumericalError):
        call(bad, spec, "eager")
    with pytest.raises(SpecificationError):
        call(bad, spec, "sometimes")
    call(bad, spec, "lazy")
