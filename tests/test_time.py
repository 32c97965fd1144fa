from fractions import Fraction

from pyspark.sql import functions as F

from framewright.functions import exact_time as X


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_rationals_reduce_and_keep_the_sign_in_num(spark):
    df = rows(spark, [(6, -4), (0, 5), (1, 0), (None, 3), (-(2**62), 2**62)], "n long, d long")
    got = [r[0] and (r[0].num, r[0].den) for r in df.select(X.rational(F.col("n"), F.col("d"))).collect()]
    assert got == [(-3, 2), (0, 1), None, None, (-1, 1)]


def test_decimal_text_is_exact(spark):
    data = ["7200.123456", "-0.5", "1e3", "2.5E-1", ".5", "5.", "", "n/a", "1.2.3", "99999999999999999999", "1e19"]
    got = [r[0] and Fraction(r[0].num, r[0].den) for r in rows(spark, [(d,) for d in data], "s string").select(X.from_decimal(F.col("s"))).collect()]
    assert got == [Fraction("7200.123456"), Fraction(-1, 2), 1000, Fraction(1, 4), Fraction(1, 2), 5, None, None, None, None, None]


def test_overflow_is_null(spark):
    big = 2**62 + 1
    df = rows(spark, [(big, 1, 3, 1), (1, big, 1, 3)], "a long, b long, c long, d long")
    p = X.multiply(X.rational(F.col("a"), F.col("b")), X.rational(F.col("c"), F.col("d")))
    assert [r[0] for r in df.select(p).collect()] == [None, None]


def test_rounding_is_half_away_from_zero(spark):
    df = rows(spark, [(5, 2), (-5, 2), (7, 3), (-1, 3)], "n long, d long")
    assert [r[0] for r in df.select(X.round_half_away(X.rational(F.col("n"), F.col("d")))).collect()] == [3, -3, 2, 0]


def test_film_rate_is_recovered(spark):
    df = rows(spark, [(23.976023976,), (-0.25,), (float("nan"),), (0.0,)], "v double")
    got = [tuple(r[0]) for r in df.select(X.approximate(F.col("v"), 1001)).collect()]
    assert got[0] == (24000, 1001) and got[1] == (-1, 4) and got[2] == (0, 1) and got[3] == (0, 1)


def test_hms(spark):
    df = rows(spark, [(3661.5,), (-1.0,), (float("inf"),)], "s double")
    assert [r[0] for r in df.select(X.format_hms(F.col("s"))).collect()] == ["01:01:01.500", "--:--:--.---", "--:--:--.---"]


def test_fnv(spark):
    df = rows(spark, [(b"",), (b"a",), (b"foobar",)], "b binary")
    assert [r[0] for r in df.select(X.fnv1a64(F.col("b"))).collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
