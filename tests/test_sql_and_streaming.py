import pytest
from pyspark.sql import functions as F

from lagweave.errors import SpecificationError
from lagweave.functions import sql
from lagweave.operators.panel import SeriesSpec
from lagweave.streaming.differences import stream_difference


def test_sql_functions(spark):
    assert "ar_stability" in sql.register(spark)
    row = spark.sql("""SELECT lag_from_ar(array(0.5D, -0.3D)) AS p, lag_ar_coeffs(array(1D, -0.5D)) AS a, lag_multiply(array(1D, -0.5D, 0.3D), array(1D, -1D)) AS m,
        lag_degree(array(1D, 0D)) AS d, lag_evaluate(array(1D, -0.5D, 0.3D), 1D) AS v, lag_companion(array(0.5D, -0.3D)) AS c, lag_companion(array(0.5D)) AS c1""").first()
    assert row["p"] == [1, -0.5, 0.3] and row["a"] == [0.5] and row["m"] == pytest.approx([1, -1.5, 0.8, -0.3])
    assert row["d"] == 1 and row["v"] == pytest.approx(0.8) and row["c"] == [[0.5, -0.3], [1, 0]] and row["c1"] == [[0.5]]
    got = spark.sql("SELECT ar_stability(a) AS s FROM VALUES (array(0.5D)), (array(1.5D)) AS t(a)").collect()
    assert sorted(r["s"]["is_stable"] for r in got) == [False, True]


@pytest.mark.parametrize(("call", "kind"), [
    ("lag_multiply(array(), array(1D))", "DimensionError"), ("lag_multiply(array(1D), array())", "DimensionError"), ("lag_companion(array())", "DimensionError"),
    ("lag_companion(array(double('NaN')))", "NumericalError"), ("lag_multiply(array(1e200D), array(1e200D))", "NumericalError"), ("lag_from_ar(array(double('Infinity')))", "NumericalError"),
    ("lag_ar_coeffs(array(2D, 1D))", "SpecificationError"), ("lag_ar_coeffs(array())", "DimensionError"), ("lag_evaluate(array(1D, NULL), 1D)", "NumericalError"), ("lag_degree(NULL)", "DimensionError"),
])
def test_sql_functions_have_the_guards(spark, call, kind):
    sql.register(spark)
    with pytest.raises(Exception, match=kind):
        spark.sql(f"SELECT {call} AS x").collect()


def test_streaming_difference(spark, tmp_path):
    values = {"a": [1, 3, 6, 10, 15], "b": [2, 2, 5]}
    rows = [(k, t, float(v)) for k, vs in values.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, t long, y double")
    folder = str(tmp_path / "in")
    for t in range(5):
        df.where(F.col("t") == t).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    spec = SeriesSpec(("k",), "t", ("y",))
    run = stream_difference(stream, spec, 2).writeStream.format("memory").queryName("second").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(r) for r in spark.table("second").collect()) == [("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 1.0), ("b", 2, 3.0)]
    with pytest.raises(SpecificationError):
        stream_difference(stream, spec, 0)
