"""Column helpers: exact rounding, half-open ranges, fractional days."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelens.functions import mean_days, round_ratio, safe_div


def test_round_ratio_matches_decimal_half_up(spark):
    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=200))
    def check(pairs):
        df = spark.createDataFrame([(Decimal(a) / 100, b) for a, b in pairs], "num decimal(18,2), den long")
        got = [r.x for r in df.select(round_ratio("num", "den", 2).alias("x")).collect()]
        want = []
        for a, b in pairs:
            # exact quotient, rounded half away from zero (sign applied after rounding)
            r = (Decimal(abs(a)) / 100 / Decimal(b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            want.append(float(r if a >= 0 else -r))
        assert got == want
    check()


def test_safe_div_and_mean_days(spark):
    df = spark.createDataFrame([(1, 0), (None, 2), (3, 2)], "a int, b int")
    assert [r.x for r in df.select(safe_div("a", "b").alias("x")).collect()] == [None, None, 1.5]
    us = spark.createDataFrame([(86_400_000_000,), (43_200_000_000,), (None,)], "u long")
    assert us.agg(mean_days("u").alias("d")).first().d == 0.75


def test_cluster_conf_sizes_shuffles():
    from tradelens.session import cluster_conf
    big = cluster_conf(100 << 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert cluster_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "24"


def test_elapsed_micros_ignores_session_time_zone(spark):
    import datetime as dt

    from tradelens.functions import elapsed_micros
    # a daylight-saving change in America/Sao_Paulo falls inside this pair
    df = spark.createDataFrame([(dt.datetime(1999, 10, 2, 12, 0), dt.datetime(1999, 10, 4, 12, 0, 0, 250))],
                               "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert df.select(elapsed_micros("a", "b").alias("u")).first().u == 2 * 86_400_000_000 + 250
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_ratio_units_exact_and_mean(spark):
    from decimal import Decimal

    from tradelens.functions import mean_of_units, ratio_units
    df = spark.createDataFrame([(Decimal("10.00"), 3), (Decimal("0.05"), 2), (None, 1)], "s decimal(18,2), n long")
    got = [r.u for r in df.select(ratio_units("s", "n", 10 ** 8).alias("u")).collect()]
    assert got == [Decimal(333333333), Decimal(2500000), None]
    mean = df.agg(mean_of_units(ratio_units("s", "n", 10 ** 8), 10 ** 8).alias("m")).first().m
    assert mean == (333333333 + 2500000) / 2 / 10 ** 8
