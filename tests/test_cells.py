"""Cells of bounded size: splitters are refined where the rows are."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradelens.operators.distribution import order_statistics, value_counts
from tradelens.operators.keys import with_cells
from tradelens.operators.ranking import grouped_ntile, prefix_counts


def cells(df, groups, key, bound):
    out, cut = with_cells(df, groups, F.col(key), bound)
    return out, cut, {tuple(r)[:-1]: r["count"] for r in out.groupBy(*groups, "_cell").count().collect()}


def test_one_outlier_among_many_values(spark):
    """Equal widths alone would put all other values into one cell."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").alias("v")).unionAll(
        spark.createDataFrame([("g", 10 ** 15)], "g string, v long"))
    out, cut, sizes = cells(df, ["g"], "v", 1 << 11)
    assert cut and max(sizes.values()) <= 1 << 11 and len(sizes) < 400
    hist = df.withColumn("c", F.lit(1).cast("long"))
    starts = prefix_counts(hist, ["g"], "v", "c", cell_rows=1 << 11)
    wrong = starts.where((F.col("_start") != F.least("v", F.lit(100_000))) | (F.col("_n") != 100_001))
    assert wrong.count() == 0


@pytest.mark.parametrize("values", [
    [10.0 ** i for i in range(-300, 300)],                                # every scale
    [i * 1e-9 for i in range(500)] + [1e9 + i for i in range(500)],       # two clusters far apart
    [float("-inf"), float("inf"), float("nan"), -1e308, 1e308, 0.0, None, *map(float, range(40))],
    [5e-324 * i for i in range(60)],                                      # the smallest numbers there are
], ids=["scales", "clusters", "infinite", "denormal"])
def test_cells_are_ordered_and_small(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("small", 1.0), (None, 2.0), (None, None)], "g string, v double")
    out, cut, sizes = cells(df, ["g"], "v", 10)
    assert out.count() == len(values) + 3
    placed = [(r.v, r._cell) for r in out.where("g = 'g' and v is not null").collect()]
    placed.sort(key=lambda x: (x[0] != x[0], x[0]))  # NaN last
    assert [c for _, c in placed] == sorted(c for _, c in placed)
    assert out.where("v is null and _cell is not null or v is not null and _cell is null").count() == 0
    assert max(n for (g, _), n in sizes.items() if g == "g") <= 12  # infinities share the cell of the largest numbers


def test_results_do_not_depend_on_the_bound(spark):
    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([None, 7, 7, rnd.randint(0, 400), 10 ** rnd.randint(1, 15)])) for g in ("a", "b", None) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    window = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id")
    want = sorted(df.withColumn("t", F.ntile(5).over(window)).select("g", "id", "t").collect(), key=str)
    targets = {f"r{i}": lambda n, z, i=i: F.lit(i).cast("long") for i in (1, 2, 300, 555)} | {"last": lambda n, z: n, "none": lambda n, z: n + 1}
    hist = value_counts(df, ["g"], "v")
    plain = sorted(order_statistics(hist, ["g"], "v", targets).collect(), key=str)
    for bound in (7, 1 << 18):
        assert sorted(grouped_ntile(df, ["g"], "v", 5, "id", out="t", cell_rows=bound).select("g", "id", "t").collect(), key=str) == want
        assert sorted(order_statistics(hist, ["g"], "v", targets, cell_rows=bound).collect(), key=str) == plain
    for r in plain:
        values = sorted(v for g, _, v in rows if g == r.g and v is not None)
        assert (r.r1, r.r300, r["last"], r.none) == (values[0], values[299], values[-1], None)


def test_an_empty_table_has_no_cells(spark):
    df = spark.createDataFrame([], "g string, v long")
    out, cut, sizes = cells(df, ["g"], "v", 10)
    assert not cut and sizes == {} and grouped_ntile(df.withColumn("id", F.lit(1)), ["g"], "v", 3, "id").collect() == []
