"""Line fits against a plain computation with fractions, and merged co-moments."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tradelens.operators.trend import co_moments, fit_line, line_of_moments, merge_co_moments


def plain(pairs):
    pairs = [(Fraction(x), Fraction(y)) for x, y in pairs if x is not None and y is not None]
    n = len(pairs)
    if not n:
        return None, None
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    sxx = sum((x - mx) ** 2 for x, _ in pairs)
    if not sxx:
        return None, None
    slope = sum((x - mx) * (y - my) for x, y in pairs) / sxx
    return slope, my - slope * mx


def fitted(spark, pairs, schema):
    r = fit_line(spark.createDataFrame([("k", *p) for p in pairs], f"k string, {schema}").repartition(4), ["k"], "x", "y").first()
    return r.slope, r.intercept


def close(got, want, tolerance=1e-9):
    for a, b in zip(got, want):
        assert (a is None) == (b is None), (got, want)
        assert a is None or abs(a - b) <= tolerance * max(1, abs(b)), (got, [float(w) for w in want])


@pytest.mark.parametrize("pairs, schema", [
    ([(i / 2, 3 * i / 2) for i in range(9)], "x double, y double"),                    # real x
    ([(i, i / 1000) for i in range(9)], "x int, y double"),                            # tiny y
    ([(i, 2 * i + 1) for i in range(5)] + [(9, None)], "x int, y int"),                # NULL y
    ([(i, 2 * i + 1) for i in range(5)] + [(None, 100)], "x int, y int"),              # NULL x
    ([(10 ** 9 + i, 7 * i + 10 ** 12) for i in range(50)], "x long, y long"),          # large offsets
    ([(1e9 + i / 4, 1e7 + 5 * i) for i in range(50)], "x double, y double"),
    ([(Decimal(i) / 8, Decimal(i * i) / 1000) for i in range(50)], "x decimal(10,3), y decimal(20,6)"),
    ([(3, 1), (3, 2)], "x int, y int"), ([(3, 1)], "x int, y int"), ([(None, 1), (2, None)], "x int, y int"),
    ([(3.5, 1.0), (3.5, 2.0)], "x double, y double"),
], ids=["real", "tiny", "null-y", "null-x", "offsets", "real-offsets", "decimals", "equal-x", "one", "none", "equal-real-x"])
def test_lines(spark, pairs, schema):
    got = fitted(spark, pairs, schema)
    close(got, plain(pairs))
    df = spark.createDataFrame(pairs, schema).selectExpr("cast(x as double) x", "cast(y as double) y")
    built_in = df.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
    close([g for g, b in zip(got, built_in) if b is not None], [b for b in built_in if b is not None])


def test_whole_numbers_are_exact(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randint(0, 600), Decimal(rnd.randint(-10 ** 9, 10 ** 9)) / 100) for _ in range(500)]
    first = fitted(spark, pairs, "x int, y decimal(18,2)")
    close(first, plain(pairs), 1e-15)
    rnd.shuffle(pairs)
    assert fitted(spark, pairs, "x int, y decimal(18,2)") == first  # whatever the order


def test_sums_past_38_digits_use_co_moments(spark):
    pairs = [(10 ** 17 + i * 10 ** 15, Decimal(10 ** 26 + i * 10 ** 24)) for i in range(40)]
    slope, intercept = fitted(spark, pairs, "x long, y decimal(38,0)")
    assert abs(slope - 10 ** 9) < 1e-4 and abs(intercept) < 1e-12 * 10 ** 26


def test_merged_states_equal_one_pass(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), d, 1e8 + rnd.random() * 50, rnd.choice([None, -4e6 + rnd.gauss(0, 9)])) for d in range(30) for _ in range(20)]
    df = spark.createDataFrame(rows, "k string, day int, x double, y double")
    whole = {r.k: r for r in co_moments(df, ["k"], "x", "y").collect()}
    daily = co_moments(df, ["k", "day"], "x", "y")
    weekly = merge_co_moments(daily.withColumn("week", F.floor(F.col("day") / 7)), ["k", "week"])
    for states in (daily, weekly):
        merged = merge_co_moments(states, ["k"])
        for r in merged.collect():
            assert r.n == whole[r.k].n
            for c in ("mean_x", "mean_y", "m2_x", "m2_y", "c_xy"):
                assert abs(r[c] - whole[r.k][c]) <= 1e-7 * max(1, abs(whole[r.k][c])), (r.k, c)
        lines = {r.k: (r.slope, r.intercept) for r in line_of_moments(merged, ["k"]).collect()}
        for k, line in lines.items():
            close(line, plain([(x, y) for kk, _, x, y in rows if kk == k]), 1e-6)
    total = merge_co_moments(daily, []).first()
    assert total.n == sum(r.n for r in whole.values())
