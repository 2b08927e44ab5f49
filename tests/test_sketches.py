"""Stored sketches: error bounds against the exact path, and merging."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tradelens.operators.sketches import (common_count, distinct_count, distinct_states, merged_distinct, merged_quantiles,
                                          quantile_states, rank_error)
from tradelens.operators.text import term_frequency, top_terms
from tradelens.plans import reports as R
from tradelens.plans.catalog import TEST_PARAMS as P
from tradelens.plans.catalog import tables_for

PROBS = {"p1": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}


def test_quantiles_of_merged_days_are_within_their_rank_error(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(g, i % 30, v) for g, draw in (("normal", lambda: rnd.gauss(0, 1)), ("skewed", lambda: rnd.paretovariate(1.1)),
                                           ("ties", lambda: float(rnd.randint(0, 9)))) for i in range(20_000) for v in [draw()]]
    rows += [("few", 0, 1.0), ("few", 1, 3.0), ("few", 2, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(6)
    quantile_states(df, ["g", "day"], "v").write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))  # the rows are not read again
    values = {}
    for g, _, v in rows:
        values.setdefault(g, []).extend([] if v is None else [v])
    for r in merged_quantiles(states, ["g"], PROBS).collect():
        own = sorted(values[r.g])
        assert r.n == len(own)
        for name, p in PROBS.items():
            if not own:
                assert r[name] is None
                continue
            low, high = bisect_left(own, r[name]) / len(own), bisect_right(own, r[name]) / len(own)
            assert low - 2 * rank_error() - 1 / len(own) <= p <= high + 2 * rank_error() + 1 / len(own), (r.g, name, low, high)
    assert rank_error() < 0.006


def test_weight_quantiles_near_the_exact_ones(spark):
    t = tables_for(spark, SF_SMALL)
    got = {r.category: r for r in R.weight_quantiles_sketched(t, P).collect()}
    weights = {}
    for r in t.items.join(t.products.join(t.category_names, "category_code"), "product_id").select("category", "weight_g").collect():
        weights.setdefault(r.category, []).append(r.weight_g)
    assert set(got) == set(weights)
    for c, own in weights.items():
        own = sorted(w for w in own if w is not None)
        assert got[c].item_count == len(own)
        for name, p in (("q1", .25), ("median", .5), ("q3", .75)):
            low, high = bisect_left(own, got[c][name]) / len(own), bisect_right(own, got[c][name]) / len(own)
            assert low - 0.02 <= p <= high + 0.02


def test_distinct_counts_and_intersections_of_merged_states(spark, tmp_path):
    a = spark.range(0, 120_000).select(F.col("id").alias("v"), (F.col("id") % 40).alias("day"))
    b = spark.range(60_000, 100_000).select(F.col("id").alias("v"))
    distinct_states(a.union(a), ["day"], "v", 12).write.parquet(str(tmp_path / "a"))
    states = spark.read.parquet(str(tmp_path / "a"))
    weeks = merged_distinct(states.withColumn("week", F.floor(F.col("day") / 7)), ["week"], 12)
    both = merged_distinct(weeks, [], 12).select(F.col("sketch").alias("x"), distinct_states(b, [], "v", 12).select("sketch").scalar().alias("y"))
    r = both.select(distinct_count("x").alias("n"), common_count("x", "y").alias("common")).first()
    error = 4 * 2 ** -6
    assert abs(r.n - 120_000) <= error * 120_000
    assert abs(r.common - 40_000) <= error * (120_000 / 40_000) ** 0.5 * 40_000
    exact = distinct_states(a.where("v < 5000"), [], "v").select(distinct_count("sketch")).first()[0]
    assert exact == 5000


def test_sketched_conversion_is_exact_for_few_leads(spark):
    t = tables_for(spark, SF_SMALL)
    exact = {r.origin: (r.qualified_leads, r.closed_leads, r.conversion_rate) for r in R.lead_conversion(t, P).collect()}
    got = {r.origin: (r.qualified_leads, r.closed_leads, r.conversion_rate) for r in R.lead_conversion_sketched(t, P).collect()}
    total = got.pop("all origins")
    assert got == exact and total[0] == sum(v[0] for v in exact.values())


def test_top_terms_equal_the_full_count(spark):
    rnd = random.Random(7)
    rows = [(" ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.randint(0, 60))),) for _ in range(300)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string").repartition(5)
    counts = Counter(w for (t,) in rows for w in (t or "").split())
    want = sorted(((w, n) for w, n in counts.items()), key=lambda x: (-x[1], x[0]))
    for top, classes in ((1, 1 << 16), (10, 1 << 16), (10, 16), (200, 512), (10_000, 512)):
        assert [tuple(r) for r in top_terms(df, "t", top, classes=classes).collect()] == want[:top]
    assert sorted(map(tuple, term_frequency(df, "t").collect())) == sorted(want)
    assert top_terms(df.where("t is null"), "t", 5).collect() == []
