import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradelens.operators.ranking import RFM_RULES, ntile_score, segment_label


def _check(spark, rows, k, descending, schema="id long, v long"):
    df = spark.createDataFrame(rows, schema)
    got = ntile_score(df, "v", k, "id", descending=descending, out="t")
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    want = df.withColumn("t", F.ntile(k).over(Window.orderBy(order, F.col("id"))))
    a = sorted(got.select("id", "t").collect())
    b = sorted(want.select("id", "t").collect())
    assert a == b


@pytest.mark.parametrize("k", [1, 3, 5, 7])
@pytest.mark.parametrize("descending", [True, False])
def test_ntile_matches_window_heavy_ties(spark, k, descending):
    rnd = random.Random(k * 10 + descending)
    rows = []
    for i in range(700):
        r = rnd.random()
        v = 1 if r < 0.6 else (None if r < 0.65 else rnd.randint(2, 40))
        rows.append((i * 3 + 1, v))
    _check(spark, rows, k, descending)


def test_ntile_small_inputs(spark):
    _check(spark, [(i, 10) for i in range(7)], 5, True)   # sizes 2,2,1,1,1
    _check(spark, [(i, i) for i in range(3)], 5, True)    # fewer rows than tiles
    _check(spark, [(1, 5)], 5, False)


def test_ntile_distinct_values_many_buckets(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 10_000)) for i in range(2000)]
    _check(spark, rows, 5, True)


def test_rfm_rules_cover_all_cells(spark):
    cells = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = spark.createDataFrame(cells, "r int, f int, m int").withColumn("lab", segment_label("r", "f", "m"))
    assert df.filter(F.col("lab").isNull()).count() == 0
    assert df.select("lab").distinct().count() == 11
    assert len({lab for lab, _, _ in RFM_RULES}) == 11


def test_grouped_ntile_matches_partitioned_window(spark):
    from tradelens.operators.ranking import grouped_ntile
    rnd = random.Random(11)
    rows = [(g, i, rnd.choice([1, 1, 1, 2, 3, rnd.randint(4, 99)])) for g in ("a", "b", "c") for i in range(300)]
    rows += [("d", i, 7) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    got = grouped_ntile(df, ["g"], "v", 5, "id", out="t")
    want = df.withColumn("t", F.ntile(5).over(Window.partitionBy("g").orderBy(F.desc("v"), "id")))
    assert sorted(got.select("g", "id", "t").collect()) == sorted(want.select("g", "id", "t").collect())


def test_ntile_string_tie_key(spark):
    rows = [(f"id{i:04d}", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, v long")
    got = ntile_score(df, "v", 4, "id", out="t")
    want = df.withColumn("t", F.ntile(4).over(Window.orderBy(F.desc("v"), F.xxhash64("id"), "id")))
    assert sorted(got.select("id", "t").collect()) == sorted(want.select("id", "t").collect())


def test_null_group_is_tiled(spark):
    from tradelens.operators.ranking import grouped_ntile
    rows = [(None, i, i % 4) for i in range(6)] + [("a", i, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    got = grouped_ntile(df, ["g"], "v", 3, "id", out="t")
    want = df.withColumn("t", F.ntile(3).over(Window.partitionBy("g").orderBy(F.desc("v"), "id")))
    assert sorted(map(str, got.select("g", "id", "t").collect())) == sorted(map(str, want.select("g", "id", "t").collect()))


def test_many_tiles(spark):
    from tradelens.operators.ranking import ntile_score
    df = spark.createDataFrame([(i, i % 5) for i in range(12)], "id long, v long")
    got = ntile_score(df, "v", 100, "id", out="t")
    want = df.withColumn("t", F.ntile(100).over(Window.orderBy(F.desc("v"), "id")))
    assert sorted(got.collect()) == sorted(want.collect())
