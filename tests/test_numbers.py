import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabscope.functions.numbers import null_tokens, percent, round_percent, to_number


def rounded(spark, values):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r["r"] for r in rows.select("i", round_percent(F.col("v")).alias("r")).orderBy("i").collect()]


def test_round_percent_equals_python_round(spark):
    chance = random.Random(7)
    values = [2.675, 0.125, 0.375, 0.625, 0.875, 0.0, 100.0, 0.005, 1.005, 99.995, 20.125, 12.345]
    values += [k / 8 for k in range(800)]
    values += [c / n * 100 for n in range(1, 60) for c in range(n + 1)]
    values += [chance.uniform(0, 100) for _ in range(5000)]
    values += [round(chance.uniform(0, 100), 3) for _ in range(5000)]
    assert rounded(spark, values) == [round(v, 2) for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=100), min_size=1, max_size=50))
def test_round_percent_property(spark, values):
    assert rounded(spark, values) == [round(v, 2) for v in values]


def test_percent_of_empty_table_is_null(spark):
    assert spark.range(1).select(percent(F.lit(0), F.lit(0)).alias("p")).first()["p"] is None


def test_to_number_and_tokens(spark):
    texts = ["7", " 7 ", "1d", "", " ", "1e3", "-.5", "abc", "NaN", None, "5.", "+2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in rows.select("i", to_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [7.0, 7.0, None, None, None, 1000.0, -0.5, None, None, None, 5.0, 2.0]
    kept = [r["n"] for r in rows.select("i", null_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    assert kept == ["7", " 7 ", "1d", None, " ", "1e3", "-.5", "abc", None, None, "5.", "+2"]


def test_infinity_is_a_number(spark):
    texts = ["inf", "-Infinity", " +INF ", "info"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in rows.select("i", to_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [float("inf"), float("-inf"), float("inf"), None]
