"""Numbers as their SQL rounds and writes them, where a decimal text and a double say different things."""

from fractions import Fraction

from pyspark.sql import functions as F

from framelake.functions import display


def test_two_decimals_are_those_of_c(spark):
    values = [k / 1000 for k in range(0, 9000, 5)] + [k / 8 for k in range(64)] + [-2.675, 12345.675, 0.999, 59.995]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", display.two_decimals(F.col("x")).alias("s"), display.speed_label(F.greatest("x", F.lit(0.1))).alias("l")).collect()
    assert {r["x"]: r["s"] for r in got} == {v: f"{v:.2f}" for v in values}
    assert {r["x"]: r["l"] for r in got}[2.005] == "sped up 2.00×"


def test_rounding_goes_by_the_double(spark):
    import duckdb

    values = [v / n for n in (128, 640, 1280, 3200) for v in range(60 * n, 61 * n, 3)] + [-0.1234565, 0.0, 1e300]
    got = {r["x"]: r["r"] for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", display.rounded("x", 6).alias("r")).collect()}
    assert got == dict(duckdb.execute("SELECT x, round(x, 6) FROM (SELECT unnest($1) AS x)", [values]).fetchall())
    assert any(abs(Fraction(v) * 10**6 % 1 - Fraction(1, 2)) < Fraction(1, 10**7) for v in values)
    assert spark.sql("select cast(null as double) as x").select(display.rounded("x", 6)).first()[0] is None
