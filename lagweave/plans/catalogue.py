"""Named queries over the driver's tables, one or more for each operation, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.functions import companion as co
from lagweave.functions import lagpoly as lp
from lagweave.functions import stability as st
from lagweave.operators import transforms as tr
from lagweave.operators.panel import SeriesSpec
from lagweave.session import ship
from lagweave.sources.tables import DAILY, MONTHLY, coefficients, daily_events, matrix, monthly_orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The same inputs as SQL.
M = "M AS (SELECT o_orderstatus AS g, strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y FROM orders GROUP BY 1, 2)"
E = "E AS (SELECT event_type AS g, strftime(ts, '%Y-%m-%d') AS m, sum(value::DECIMAL(18,2))::DOUBLE AS y FROM events GROUP BY 1, 2)"


def A(p: int, scale: float = 1.0) -> str:
    return f"A AS (SELECT vec_id, list_transform(embedding[1:{p}], lambda x: x::DOUBLE * {scale}) AS a FROM embeddings)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(c: Column | str, digits: int) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _series(df: DataFrame, digits: int) -> DataFrame:
    return df.select("g", "m", _round("y", digits).alias("y"))


# ---- transforms


@query(f"WITH {M}, d AS (SELECT g, m, y - lag(y) OVER (PARTITION BY g ORDER BY m) AS y FROM M) SELECT g, m, round(y, 2) + 0.0 AS y FROM d WHERE y IS NOT NULL")
def difference_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.difference(monthly_orders(spark, sf_dir), MONTHLY), 2)


@query(f"WITH {M}, d AS (SELECT g, m, y - lag(y) OVER (PARTITION BY g ORDER BY m) AS y FROM M), e AS (SELECT g, m, y - lag(y) OVER (PARTITION BY g ORDER BY m) AS y FROM d) SELECT g, m, round(y, 2) + 0.0 AS y FROM e WHERE y IS NOT NULL")
def difference_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.difference(monthly_orders(spark, sf_dir), MONTHLY, 2), 2)




@query("""WITH w AS (SELECT strftime(ts, '%Y-%m-%d') AS m, sum(value::DECIMAL(18,2))::DOUBLE AS v1, sum(user_id)::DOUBLE AS v2, count(*)::DOUBLE AS v3 FROM events GROUP BY 1)
SELECT m, round(v2 - v1, 2) + 0.0 AS v2, round(v3 - v2, 2) + 0.0 AS v3 FROM w""")
def difference_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wide = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("m")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v1"), F.sum("user_id").cast("double").alias("v2"), F.count("*").cast("double").alias("v3"))
    out = tr.difference(wide, SeriesSpec((), "m", ("v1", "v2", "v3")), 1, axis=1)
    return out.select("m", _round("v2", 2).alias("v2"), _round("v3", 2).alias("v3"))


def _seasonal_sql(source: str, name: str, s: int, times: int) -> str:
    steps = [f"s0 AS (SELECT g, m, y FROM {name})"] + [f"s{i} AS (SELECT g, m, y - lag(y, {s}) OVER (PARTITION BY g ORDER BY m) AS y FROM s{i - 1})" for i in range(1, times + 1)]
    return f"WITH {source}, {', '.join(steps)} SELECT g, m, round(y, 2) + 0.0 AS y FROM s{times} WHERE y IS NOT NULL"


@query(_seasonal_sql(M, "M", 12, 1))
def seasonal_diff_s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.seasonal_difference(monthly_orders(spark, sf_dir), MONTHLY, 12), 2)


@query(_seasonal_sql(M, "M", 12, 2))
def seasonal_diff_s12_D2(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return _series(tr.seasonal_difference(monthly_orders(spark, sf_dir), MONTHLY, 12, 2), 2)


@query(_seasonal_sql(E, "E", 7, 1))
def seasonal_diff_s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.seasonal_difference(daily_events(spark, sf_dir), DAILY, 7), 2)


@query(f"WITH {E} SELECT g, m, round(ln(y), 8) + 0.0 AS y FROM E")
def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.log_transform(daily_events(spark, sf_dir), DAILY), 8)


@query(f"WITH {E}, d AS (SELECT g, m, ln(y) - lag(ln(y)) OVER (PARTITION BY g ORDER BY m) AS y FROM E) SELECT g, m, round(y, 8) + 0.0 AS y FROM d WHERE y IS NOT NULL")
def log_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.log_difference(daily_events(spark, sf_dir), DAILY), 8)


def _standard_sql(kind: str) -> str:
    return f"WITH {M}, p AS (SELECT g, avg(y) AS a, {kind}(y) AS s FROM M GROUP BY g) SELECT g, m, round((y - a) / s, 8) + 0.0 AS y FROM M JOIN p USING (g)"


@query(_standard_sql("stddev_pop"))
def standardize_ddof0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.standardize(monthly_orders(spark, sf_dir), MONTHLY).values, 8)


@query(_standard_sql("stddev_samp"))
def standardize_ddof1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.standardize(monthly_orders(spark, sf_dir), MONTHLY, ddof=1).values, 8)


@query(f"WITH {M} SELECT g, m, round(y, 2) + 0.0 AS y FROM M")
def standardize_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.standardize(monthly_orders(spark, sf_dir), MONTHLY).inverse(), 2)


def _undifferenced(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    series = monthly_orders(spark, sf_dir)
    anchors = None
    for k in range(d):  # the first value of each order below d, the highest first
        lower = tr.difference(series, MONTHLY, d - 1 - k)
        first = lower.groupBy("g").agg(F.min_by("y", "m").alias("y")).select("g", F.lit(k).alias("ord"), "y")
        anchors = first if anchors is None else anchors.unionByName(first)
    back = tr.undifference(tr.difference(series, MONTHLY, d), MONTHLY, anchors, d=d)
    return back.select("g", F.col("pos").cast("long").alias("pos"), _round("y", 2).alias("y"))


_BACK = f"WITH {M} SELECT g, (row_number() OVER (PARTITION BY g ORDER BY m) - 1)::BIGINT AS pos, round(y, 2) + 0.0 AS y FROM M"


@query(_BACK)
def undifference_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _undifferenced(spark, sf_dir, 1)


@query(_BACK)
def undifference_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _undifferenced(spark, sf_dir, 2)


# ---- lag polynomials


def _long(df: DataFrame, c: Column, digits: int = 8) -> DataFrame:
    return df.select("vec_id", F.posexplode(c).alias("lag", "c")).select("vec_id", F.col("lag").cast("long").alias("lag"), _round("c", digits).alias("c"))


_FROM_AR = f"WITH {A(3)} SELECT vec_id, unnest(range(0, 4)) AS lag, round(unnest([1.0] || list_transform(a, lambda x: -x)), 8) + 0.0 AS c FROM A"


@query(_FROM_AR)
def poly_from_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3)
    return _long(df, lp.from_ar(df["a"]))


@query(f"WITH {A(3)} SELECT vec_id, unnest(range(0, 3)) AS lag, round(unnest(a), 8) + 0.0 AS c FROM A")
def poly_ar_coeffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3)
    return _long(df, lp.ar_coeffs(lp.from_ar(df["a"])))


@query(f"WITH {A(3)} SELECT vec_id, 3 AS degree, 1 AS dim, false AS is_matrix, 'LagPolynomial(degree=3, dim=1)' AS text, round(list_sum(a), 6) + 0.0 AS total FROM A")
def poly_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3)
    p = lp.LagPolynomial.from_ar_coeffs(df, "a")
    total = F.aggregate(p.coefficients, F.lit(1.0), lambda s, x: s - x)
    return df.select("vec_id", p.degree.alias("degree"), p.dim.alias("dim"), F.lit(p.is_matrix).alias("is_matrix"), p.describe().alias("text"), _round(total, 6).alias("total"))


@query("WITH A AS (SELECT vec_id, embedding[1:3] AS a, embedding[2:4] AS b, lead(embedding[1:3]) OVER (ORDER BY vec_id) AS c FROM embeddings) SELECT vec_id, true AS same, a = b AS moved FROM A")
def poly_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("a"), F.slice("embedding", 2, 3).cast("array<double>").alias("b"))
    a, b = (lp.LagPolynomial.from_ar_coeffs(df, c) for c in "ab")
    return df.select("vec_id", (a == a).alias("same"), (a == b).alias("moved"))


@query(f"""WITH {A(2)}, p AS (SELECT vec_id, unnest([0, 1, 2]) AS i, unnest([1.0] || list_transform(a, lambda x: -x)) AS c FROM A), q(j, d) AS (VALUES (0, 1.0::DOUBLE), (1, -1.0))
SELECT vec_id, (i + j)::BIGINT AS lag, round(sum(c * d), 8) + 0.0 AS c FROM p, q GROUP BY 1, 2""")
def poly_mul_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 2)
    return _long(df, lp.multiply(lp.from_ar(df["a"]), F.array(F.lit(1.0), F.lit(-1.0))))


def _matrix_product_sql(left: int, right: int) -> str:
    def side(name: str, at: int) -> str:
        cells = ", ".join(f"({i}, {j}, {at + 2 * i + j + 1})" for i in range(2) for j in range(2))
        return (f"{name} AS (SELECT vec_id, 0 AS l, i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM embeddings, (VALUES {cells}) AS x(i, j, k) "
                f"UNION ALL SELECT vec_id, 1, i, j, -embedding[k]::DOUBLE FROM embeddings, (VALUES {cells}) AS x(i, j, k))")
    return (f"WITH {side('a', left)}, {side('b', right)} SELECT a.vec_id, (a.l + b.l)::BIGINT AS lag, a.i::BIGINT AS i, b.j::BIGINT AS j, round(sum(a.v * b.v), 8) + 0.0 AS v "
            "FROM a JOIN b ON a.vec_id = b.vec_id AND a.j = b.i GROUP BY ALL")


def _matrix_product(spark: SparkSession, sf_dir: str, left: int, right: int) -> DataFrame:
    df = coefficients(spark, sf_dir, 8)
    a, b = (lp.from_ar(matrix(df["a"], 2, 1, at), True) for at in (left, right))
    rows = df.select("vec_id", F.posexplode(lp.multiply(a, b, True, True)).alias("lag", "m"))
    rows = rows.select("vec_id", "lag", F.posexplode("m").alias("i", "r")).select("vec_id", "lag", "i", F.posexplode("r").alias("j", "v"))
    return rows.select("vec_id", *[F.col(c).cast("long").alias(c) for c in ("lag", "i", "j")], _round("v", 8).alias("v"))


@query(_matrix_product_sql(0, 4))
def poly_mul_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix_product(spark, sf_dir, 0, 4)


@query(_matrix_product_sql(4, 0))
def poly_mul_matrix_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix_product(spark, sf_dir, 4, 0)


@query(f"WITH {A(3)}, z(z) AS (VALUES (-1.0::DOUBLE), (0.0), (0.5), (1.0), (2.0)) SELECT vec_id, z, round(1 - a[1] * z - a[2] * z * z - a[3] * z * z * z, 8) + 0.0 AS re FROM A, z")
def poly_eval_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3).withColumn("z", F.explode(F.array(*[F.lit(float(z)) for z in (-1, 0, 0.5, 1, 2)])))
    value = lp.evaluate(lp.from_ar(df["a"]), df["z"])
    return df.select("vec_id", "z", _round(value["re"], 8).alias("re"))


_GRID = [math.pi * k / 8 for k in range(9)]


@query(f"""WITH {A(3)}, w AS (SELECT unnest(range(0, 9)) AS k) SELECT vec_id, k, round(1 - a[1] * cos(pi() * k / 8) - a[2] * cos(2 * pi() * k / 8) - a[3] * cos(3 * pi() * k / 8), 7) + 0.0 AS re,
round(a[1] * sin(pi() * k / 8) + a[2] * sin(2 * pi() * k / 8) + a[3] * sin(3 * pi() * k / 8), 7) + 0.0 AS im FROM A, w""")
def poly_eval_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    w = F.lit(math.pi) * df["k"] / 8
    value = lp.evaluate(lp.from_ar(df["a"]), F.cos(w), -F.sin(w))
    return df.select("vec_id", "k", _round(value["re"], 7).alias("re"), _round(value["im"], 7).alias("im"))


_ROOTS = f"""WITH {A(2)}, q AS (SELECT vec_id, -a[1] AS b, -a[2] AS c, a[1] * a[1] + 4 * a[2] AS disc FROM A),
r AS (SELECT vec_id, unnest([1, -1]) AS s, b, c, disc FROM q)
SELECT vec_id, round(CASE WHEN disc >= 0 THEN (-b + s * sqrt(disc)) / (2 * c) ELSE -b / (2 * c) END, 4) + 0.0 AS re, round(CASE WHEN disc < 0 THEN s * sqrt(-disc) / (2 * c) ELSE 0 END, 4) + 0.0 AS im FROM r"""


def _roots_long(df: DataFrame, roots: Column) -> DataFrame:
    return df.select("vec_id", F.explode(roots).alias("z")).select("vec_id", _round("z.re", 4).alias("re"), _round("z.im", 4).alias("im"))


@query(_ROOTS)
def poly_roots_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 2)
    return _roots_long(df, lp.roots(lp.from_ar(df["a"])))


@query(_ROOTS)
def poly_roots_p2_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 2)
    return _roots_long(df, lp.roots_p2(lp.from_ar(df["a"])))


_WIDE = "W AS (SELECT strftime(ts, '%Y-%m-%d') AS m, sum(value::DECIMAL(18,2))::DOUBLE AS v1, sum(user_id)::DOUBLE AS v2, count(*)::DOUBLE AS v3, max(value)::DOUBLE AS v4 FROM events GROUP BY 1)"
_WIDE_SPEC = SeriesSpec((), "m", ("v1", "v2", "v3", "v4"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four daily measures of all events side by side."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("m")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v1"), F.sum("user_id").cast("double").alias("v2"), F.count("*").cast("double").alias("v3"), F.max("value").alias("v4"))


def _wide_out(df: DataFrame, names: tuple[str, ...], digits: int) -> DataFrame:
    return df.select("m", *[_round(v, digits).alias(v) for v in names])


@query(f"WITH {_WIDE} SELECT m, round(v3 - v1, 2) + 0.0 AS v3, round(v4 - v2, 2) + 0.0 AS v4 FROM W")
def seasonal_diff_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_out(tr.seasonal_difference(_wide(spark, sf_dir), _WIDE_SPEC, 2, axis=1), ("v3", "v4"), 2)


@query(f"WITH {_WIDE} SELECT m, round(ln(v2) - ln(v1), 8) + 0.0 AS v2, round(ln(v3) - ln(v2), 8) + 0.0 AS v3, round(ln(v4) - ln(v3), 8) + 0.0 AS v4 FROM W")
def log_difference_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_out(tr.log_difference(_wide(spark, sf_dir), _WIDE_SPEC, axis=1), ("v2", "v3", "v4"), 8)


def _standard_rows_sql(ddof: int) -> str:
    values = ", ".join(f"round((v{i} - a) / s, 7) + 0.0 AS v{i}" for i in range(1, 5))
    squares = " + ".join(f"(v{i} - a) * (v{i} - a)" for i in range(1, 5))
    return f"WITH {_WIDE}, a AS (SELECT *, (v1 + v2 + v3 + v4) / 4 AS a FROM W), s AS (SELECT *, sqrt(({squares}) / {4 - ddof}) AS s FROM a) SELECT m, {values} FROM s"


@query(_standard_rows_sql(0))
def standardize_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_out(tr.standardize(_wide(spark, sf_dir), _WIDE_SPEC, axis=1).values, _WIDE_SPEC.values, 7)


@query(_standard_rows_sql(2))
def standardize_axis1_ddof2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_out(tr.standardize(_wide(spark, sf_dir), _WIDE_SPEC, axis=1, ddof=2).values, _WIDE_SPEC.values, 7)


@query(f"WITH {M}, p AS (SELECT g, avg(y) AS a, stddev_pop(y) * sqrt(count(*) / (count(*) - 2)::DOUBLE) AS s FROM M GROUP BY g) SELECT g, m, round((y - a) / s, 8) + 0.0 AS y FROM M JOIN p USING (g)")
def standardize_ddof2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(tr.standardize(monthly_orders(spark, sf_dir), MONTHLY, ddof=2).values, 8)


# A real root below -2, one above 3 and a pair of modulus between 1 and 2; a zero coefficient behind the last one adds none.
_KNOWN = """K AS (SELECT vec_id, -2 - abs(embedding[1]::DOUBLE) AS r, 3 + abs(embedding[2]::DOUBLE) AS s, 1 + abs(embedding[3]::DOUBLE) / 2 AS x, 0.5 + abs(embedding[4]::DOUBLE) / 2 AS y FROM embeddings)"""


@query(f"""WITH {_KNOWN}, z AS (SELECT vec_id, unnest([r, s, x, x]) AS re, unnest([0.0, 0.0, y, -y]) AS im FROM K)
SELECT vec_id, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM z""")
def poly_roots_p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = F.transform(F.slice("embedding", 1, 4).cast("array<double>"), F.abs)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", e.alias("e"))
    at = lambda i: F.get("e", F.lit(i))
    one = F.lit(1.0)
    first, second = F.array(one, one / (2 + at(0))), F.array(one, -one / (3 + at(1)))
    x, y = 1 + at(2) / 2, 0.5 + at(3) / 2
    pair = F.array(one, -2 * x / (x * x + y * y), one / (x * x + y * y))
    product = lp.multiply(lp.multiply(first, second), pair)
    df = df.select("vec_id", F.concat(product, F.array(F.lit(0.0))).alias("c"))
    rows = df.select("vec_id", lp.roots(df["c"]).alias("roots"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    rows = rows.select("vec_id", F.get("roots", F.col("k")).alias("z")).where("z IS NOT NULL")
    return rows.select("vec_id", _round("z.re", 4).alias("re"), _round("z.im", 4).alias("im"))


@query(f"""WITH {A(8)}, c AS (SELECT vec_id, a, unnest(range(0, 4)) AS c FROM A), w AS (SELECT *, c // 2 AS i, c % 2 AS j, unnest(range(0, 5)) AS k FROM c)
SELECT vec_id, k, i, j, round(CASE WHEN i = j THEN 1 ELSE 0 END - a[c + 1] * cos(pi() * k / 4) - a[c + 5] * cos(2 * pi() * k / 4), 7) + 0.0 AS re,
round(a[c + 1] * sin(pi() * k / 4) + a[c + 5] * sin(2 * pi() * k / 4), 7) + 0.0 AS im FROM w""")
def poly_eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 8).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    w = F.lit(math.pi) * df["k"] / 4
    value = lp.evaluate(lp.from_ar(matrix(df["a"], 2, 2), True), F.cos(w), -F.sin(w), True)
    rows = df.select("vec_id", "k", F.posexplode(value).alias("i", "r")).select("vec_id", "k", F.col("i").cast("long").alias("i"), F.posexplode("r").alias("j", "z"))
    return rows.select("vec_id", "k", "i", F.col("j").cast("long").alias("j"), _round("z.re", 7).alias("re"), _round("z.im", 7).alias("im"))


@query(f"WITH {A(8)}, c AS (SELECT vec_id, a, unnest(range(0, 8)) AS c FROM A) SELECT vec_id, c // 4 AS lag, c % 4 // 2 AS i, c % 2 AS j, round(a[c + 1], 8) + 0.0 AS v FROM c")
def poly_ar_coeffs_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 8)
    rows = df.select("vec_id", F.posexplode(lp.ar_coeffs(lp.from_ar(matrix(df["a"], 2, 2), True), True)).alias("lag", "m"))
    rows = rows.select("vec_id", "lag", F.posexplode("m").alias("i", "r")).select("vec_id", "lag", "i", F.posexplode("r").alias("j", "v"))
    return rows.select("vec_id", *[F.col(c).cast("long").alias(c) for c in ("lag", "i", "j")], _round("v", 8).alias("v"))


@query("SELECT vec_id, 2 AS degree, 2 AS dim, true AS is_matrix, 'LagPolynomial(degree=2, dim=2)' AS text FROM embeddings")
def poly_meta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 8)
    df = df.select("vec_id", matrix(df["a"], 2, 2).alias("m"))
    p = lp.LagPolynomial.from_ar_coeffs(df, "m")
    return df.select("vec_id", p.degree.alias("degree"), p.dim.alias("dim"), F.lit(p.is_matrix).alias("is_matrix"), p.describe().alias("text"))


# ---- companion forms


def _cells(df: DataFrame, c: Column) -> DataFrame:
    rows = co.entries(df, "vec_id", c)
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _round("v", 8).alias("v"))


_COMPANION = f"""WITH {A(3)}, ij AS (SELECT i, j FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 3)) AS j))
SELECT vec_id, i, j, round(CASE WHEN i = 0 THEN a[j + 1] WHEN j = i - 1 THEN 1.0 ELSE 0.0 END, 8) + 0.0 AS v FROM A, ij"""


@query(_COMPANION)
def companion_p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3)
    return _cells(df, co.companion_matrix(df["a"]))


@query(_COMPANION)
def companion_from_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 3)
    return _cells(df, co.companion_from_polynomial(lp.from_ar(df["a"])))


_K2P2 = f"""WITH {A(8)}, ij AS (SELECT i, j FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j))
SELECT vec_id, i, j, round(CASE WHEN i < 2 THEN a[(j // 2) * 4 + i * 2 + j % 2 + 1] WHEN j = i - 2 THEN 1.0 ELSE 0.0 END, 8) + 0.0 AS v FROM A, ij"""


@query(_K2P2)
def companion_k2p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 8)
    return _cells(df, co.companion_matrix(matrix(df["a"], 2, 2), True))


@query(_K2P2)
def companion_from_poly_k2p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 8)
    return _cells(df, co.companion_from_polynomial(lp.from_ar(matrix(df["a"], 2, 2), True), True))


@query(_K2P2.replace("FROM A, ij", "FROM A, ij WHERE i < 2 OR j = i - 2"))
def companion_entries_k2p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = co.companion_entries(coefficients(spark, sf_dir, 8).withColumn("m", matrix(F.col("a"), 2, 2)), "vec_id", F.col("m"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _round("v", 8).alias("v"))


@query("""WITH kp(k, p) AS (VALUES (1, 1), (2, 3), (3, 2)), ij AS (SELECT k, p, unnest(range(0, k)) AS i FROM kp), c AS (SELECT k, p, i, unnest(range(0, k * p)) AS j FROM ij)
SELECT k, p, i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM c""")
def selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "k int, p int")
    rows = df.select("k", "p", F.posexplode(co.selector_matrix(F.col("k"), F.col("p"))).alias("i", "r"))
    return rows.select("k", "p", F.col("i").cast("long").alias("i"), F.posexplode("r").alias("j", "v")).select("k", "p", "i", F.col("j").cast("long").alias("j"), "v")


# ---- stability


def _verdict(df: DataFrame, result: Column) -> DataFrame:
    out = df.withColumn("s", result)
    return out.select("vec_id", _round("s.max_modulus", 7).alias("max_modulus"), "s.is_stable", F.col("s.n_unit_roots").alias("n_unit_roots"), F.col("s.n_explosive").alias("n_explosive"))


@query(f"WITH {A(1, 4)} SELECT vec_id, round(abs(a[1]), 7) + 0.0 AS max_modulus, abs(a[1]) < 1 - 1e-8 AS is_stable, 0 AS n_unit_roots, CASE WHEN abs(a[1]) > 1 + 1e-8 THEN 1 ELSE 0 END AS n_explosive FROM A")
def stability_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 1, 4.0)
    return _verdict(df, st.assess_stability(df["a"]))


@query(f"""WITH {A(2, 4)}, r AS (SELECT vec_id, a, a[1] * a[1] + 4 * a[2] AS disc FROM A),
m AS (SELECT vec_id, CASE WHEN disc >= 0 THEN (abs(a[1]) + sqrt(disc)) / 2 ELSE sqrt(-a[2]) END AS hi, CASE WHEN disc >= 0 THEN abs(abs(a[1]) - sqrt(disc)) / 2 ELSE sqrt(-a[2]) END AS lo FROM r)
SELECT vec_id, round(hi, 7) + 0.0 AS max_modulus, hi < 1 - 1e-8 AS is_stable, 0 AS n_unit_roots, (CASE WHEN hi > 1 + 1e-8 THEN 1 ELSE 0 END + CASE WHEN lo > 1 + 1e-8 THEN 1 ELSE 0 END) AS n_explosive FROM m""")
def stability_ar2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 2, 4.0)
    return _verdict(df, st.assess_stability(df["a"]))


@query(f"""WITH {A(4, 4)}, r AS (SELECT vec_id, a[1] + a[4] AS tr, a[1] * a[4] - a[2] * a[3] AS det FROM A), q AS (SELECT *, tr * tr - 4 * det AS disc FROM r),
m AS (SELECT vec_id, CASE WHEN disc >= 0 THEN (abs(tr) + sqrt(disc)) / 2 ELSE sqrt(det) END AS hi, CASE WHEN disc >= 0 THEN abs(abs(tr) - sqrt(disc)) / 2 ELSE sqrt(det) END AS lo FROM q)
SELECT vec_id, round(hi, 7) + 0.0 AS max_modulus, hi < 1 - 1e-8 AS is_stable, 0 AS n_unit_roots, (CASE WHEN hi > 1 + 1e-8 THEN 1 ELSE 0 END + CASE WHEN lo > 1 + 1e-8 THEN 1 ELSE 0 END) AS n_explosive FROM m""")
def stability_companion_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 4, 4.0)
    return _verdict(df, st.assess_stability_from_companion(F.get(matrix(df["a"], 2), F.lit(0))))


_VAR1 = f"""WITH {A(4, 4)}, r AS (SELECT vec_id, a[1] + a[4] AS tr, a[1] * a[4] - a[2] * a[3] AS det FROM A), q AS (SELECT *, tr * tr - 4 * det AS disc FROM r),
m AS (SELECT vec_id, CASE WHEN disc >= 0 THEN (abs(tr) + sqrt(disc)) / 2 ELSE sqrt(det) END AS hi, CASE WHEN disc >= 0 THEN abs(abs(tr) - sqrt(disc)) / 2 ELSE sqrt(det) END AS lo FROM q)
SELECT vec_id, round(hi, 7) + 0.0 AS max_modulus, hi < 1 - 1e-8 AS is_stable, 0 AS n_unit_roots, (CASE WHEN hi > 1 + 1e-8 THEN 1 ELSE 0 END + CASE WHEN lo > 1 + 1e-8 THEN 1 ELSE 0 END) AS n_explosive FROM m"""


@query(_VAR1)
def stability_var_k2p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 4, 4.0)
    return _verdict(df, st.assess_stability(matrix(df["a"], 2), True))


@query(f"""WITH {A(2, 4)}, r AS (SELECT vec_id, a, a[1] * a[1] + 4 * a[2] AS disc FROM A), s AS (SELECT *, unnest([1, -1]) AS s FROM r)
SELECT vec_id, round(CASE WHEN disc >= 0 THEN (a[1] + s * sqrt(disc)) / 2 ELSE a[1] / 2 END, 6) + 0.0 AS re, round(CASE WHEN disc < 0 THEN s * sqrt(-disc) / 2 ELSE 0 END, 6) + 0.0 AS im, 0.001::DOUBLE AS tol FROM s""")
def stability_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 2, 4.0)
    out = df.select("vec_id", st.assess_stability(df["a"], tol=1e-3).alias("s")).select("vec_id", F.explode("s.eigenvalues").alias("z"), F.col("s.tol").alias("tol"))
    return out.select("vec_id", _round("z.re", 6).alias("re"), _round("z.im", 6).alias("im"), "tol")


def _var2_sql(scale: float, name: str) -> str:
    """A two-series autoregression of two lags is stable if the determinant of its polynomial, a scalar one of degree 4, is."""
    determinant = ("[a[1] + a[4], a[5] + a[8] - a[1] * a[4] + a[2] * a[3], -(a[1] * a[8] + a[5] * a[4] - a[2] * a[7] - a[6] * a[3]), -(a[5] * a[8] - a[6] * a[7])]")
    return _step_down_sql(8, scale, name).replace("A AS (", "A0 AS (", 1).replace(", s AS (", f", A AS (SELECT vec_id, {determinant} AS a FROM A0), s AS (", 1)


def _step_down_sql(p: int, scale: float, name: str) -> str:
    return f"""WITH RECURSIVE {A(p, scale)}, s AS (
SELECT vec_id, list_transform(a, lambda x, i: x / pow(1 - 1e-8, i)) AS b, true AS ok FROM A
UNION ALL SELECT vec_id, list_transform(range(1, len(b)), lambda i: (b[i] + b[len(b)] * b[len(b) - i]) / (1 - b[len(b)] * b[len(b)])), abs(b[len(b)]) < 1 FROM s WHERE ok AND len(b) > 0)
SELECT vec_id, bool_and(ok) AS {name} FROM s GROUP BY vec_id"""


@query(_step_down_sql(8, 2.0, "is_stationary"))
def is_stationary_p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 8, 2.0)
    return df.select("vec_id", st.is_stationary(df["a"]).alias("is_stationary"))


@query(_step_down_sql(8, 2.0, "is_stationary"))
def is_stationary_p8_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 8, 2.0)
    return df.select("vec_id", st.is_stationary(df["a"], native=True).alias("is_stationary"))


@query(_step_down_sql(4, 4.0, "is_invertible"))
def is_invertible_p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 4, 4.0)
    return df.select("vec_id", st.is_invertible(df["a"]).alias("is_invertible"))


@query(_step_down_sql(4, 4.0, "is_invertible"))
def is_invertible_p4_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coefficients(spark, sf_dir, 4, 4.0)
    return df.select("vec_id", st.is_invertible(df["a"], native=True).alias("is_invertible"))


@query(_var2_sql(3.0, "is_stationary"))
def is_stationary_var_k2p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 8, 3.0)
    return df.select("vec_id", st.is_stationary(matrix(df["a"], 2, 2), True).alias("is_stationary"))


@query(_var2_sql(3.0, "is_invertible"))
def is_invertible_var_k2p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = coefficients(spark, sf_dir, 8, 3.0)
    return df.select("vec_id", st.is_invertible(matrix(df["a"], 2, 2), True).alias("is_invertible"))


@query("""SELECT * FROM (VALUES (1, false, 1, 0, true), (2, true, 0, 0, true), (3, false, 0, 1, false)) AS t(vec_id, is_stable, n_unit_roots, n_explosive, stable_with_unit_roots)""")
def unit_roots_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    df = spark.createDataFrame([(1, [1.0]), (2, [0.5]), (3, [1.5])], "vec_id int, a array<double>")
    strict, loose = st.assess_stability(df["a"]), st.assess_stability(df["a"], allow_unit_roots=True)
    return df.withColumn("s", strict).withColumn("u", loose).select("vec_id", "s.is_stable", "s.n_unit_roots", "s.n_explosive", F.col("u.is_stable").alias("stable_with_unit_roots"))
