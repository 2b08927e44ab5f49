import random

from pyspark.sql import functions as F

from tradelens.operators.distribution import (box_stats, expand_positions, group_median, group_quantiles,
                                              histogram)


def test_group_median_modes(spark):
    rows = [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 4),
            ("c", None), ("c", 1), ("c", 3), ("d", None), ("d", None), ("d", 5)]
    df = spark.createDataFrame(rows, "g string, w int")
    low = {r.g: r.median for r in group_median(df, ["g"], "w", "lowest").collect()}
    skip = {r.g: r.median for r in group_median(df, ["g"], "w", "skip").collect()}
    assert low == {"a": 2.0, "b": 2.5, "c": 1.0, "d": None}
    assert skip == {"a": 2.0, "b": 2.5, "c": 2.0, "d": 5.0}


def test_quantiles_match_percentile(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), rnd.random() * 100 if rnd.random() > 0.05 else None) for _ in range(3000)]
    rows += [("x", 50.0)] * 500   # heavy tie
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q1, r.med, r.q3) for r in
           group_quantiles(df, ["g"], "v", {"q1": .25, "med": .5, "q3": .75}).collect()}
    want = {r.g: tuple(r.p) for r in
            df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("p")).collect()}
    for g in want:
        for a, b in zip(got[g], want[g]):
            assert abs(a - b) <= 1e-9 * max(1.0, abs(b))


def test_box_stats_whiskers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "g string, v double")
    r = box_stats(df, ["g"], "v").collect()[0]
    assert (r.q1, r.median, r.q3) == (3.0, 5.0, 7.0)
    assert r.whisker_low == 1.0 and r.whisker_high == 8.0 and r.n == 9


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    assert [r["count"] for r in histogram(df, "v", 2).orderBy("bin").collect()] == [1, 2]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["count"] for r in histogram(same, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_expand_positions_chunked(spark):
    hist = spark.createDataFrame([("a", None, 2), ("a", 5, 7), ("a", 9, 1), ("b", 1, 3)], "g string, w int, c long")
    out = expand_positions(hist, ["g"], "w", "c", chunk=3).collect()
    got = sorted((r.g, r.position, r.w, r.group_count) for r in out)
    want = sorted([("a", i + 1, None, 10) for i in range(2)] + [("a", 3 + i, 5, 10) for i in range(7)]
                  + [("a", 10, 9, 10)] + [("b", i + 1, 1, 3) for i in range(3)])
    assert got == want


def test_order_statistics_random_against_python(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tradelens.operators.distribution import order_statistics, value_counts

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 40))),
                    min_size=1, max_size=300))
    def check(rows):
        df = spark.createDataFrame(rows, "g string, v int")
        targets = {"lo": lambda n, z: F.lit(1).cast("long"), "mid": lambda n, z: F.ceil(n / 2).cast("long"),
                   "hi": lambda n, z: n, "out": lambda n, z: n + 1}
        got = {r.g: (r.lo, r.mid, r.hi, r.out) for r in order_statistics(value_counts(df, ["g"], "v"), ["g"], "v", targets).collect()}
        for g in {x for x, _ in rows}:
            vals = sorted(v for x, v in rows if x == g and v is not None)
            n = len(vals)
            want = (vals[0], vals[(n + 1) // 2 - 1], vals[-1], None) if n else (None, None, None, None)
            assert got[g] == want
    check()


def test_null_groups_keep_their_values(spark):
    rows = [(None, 1.0), (None, 3.0), (None, None), ("a", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r.g: r.median for r in group_median(df, ["g"], "v", "skip").collect()} == {None: 2.0, "a": 7.0}
    assert {r.g: r.median for r in group_median(df, ["g"], "v", "lowest").collect()} == {None: 1.0, "a": 7.0}
    box = {r.g: (r.n, r.q1, r.q3, r.whisker_low, r.whisker_high) for r in box_stats(df, ["g"], "v").collect()}
    assert box == {None: (2, 1.5, 2.5, 1.0, 3.0), "a": (1, 7.0, 7.0, 7.0, 7.0)}
    hist = spark.createDataFrame([(None, 2, 3), ("a", 1, 1), ("a", None, 1)], "g string, w int, c long")
    rows = sorted(((r.g or "", r.position, r.w, r.group_count) for r in expand_positions(hist, ["g"], "w", "c").collect()), key=str)
    assert rows == sorted([("", 1, 2, 3), ("", 2, 2, 3), ("", 3, 2, 3), ("a", 1, None, 2), ("a", 2, 1, 2)], key=str)


def test_counted_rows_stand_for_many(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), rnd.choice([None, 100, 200, 200, 300, 500, 900])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, w int")
    counted = df.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n"))
    for fn in (lambda d, **k: group_median(d, ["g"], "w", "lowest", **k),
               lambda d, **k: group_median(d, ["g"], "w", "skip", **k),
               lambda d, **k: box_stats(d, ["g"], "w", **k)):
        assert sorted(fn(counted, count="n").collect()) == sorted(fn(df).collect())


def test_histogram_leaves_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 4.0, float("nan"), float("inf"), float("-inf"), None)], "v double")
    rows = histogram(df, "v", 2).orderBy("bin").collect()
    assert [(r.bin_low, r.bin_high, r["count"]) for r in rows] == [(0.0, 2.0, 2), (2.0, 4.0, 1)]
    empty = histogram(df.where("v is null"), "v", 2).orderBy("bin").collect()
    assert [(r.bin_low, r["count"]) for r in empty] == [(None, 0), (None, 0)]
