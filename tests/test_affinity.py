"""Pairs against brute force; hash classes lose no pair and shrink what is shuffled."""

import random
from collections import Counter
from itertools import combinations

import pytest

from tests.conftest import SF_SMALL
from tradelens.operators.affinity import basket_pairs, co_purchase_pairs, in_frequent_classes
from tradelens.plans.catalog import tables_for


def brute(rows, least, allowed):
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    counts = Counter(p for items in baskets.values() for p in combinations(sorted(items & allowed), 2))
    return sorted((a, b, n) for (a, b), n in counts.items() if n > least)


@pytest.mark.parametrize("classes", [64, 1 << 10, 1 << 22])
def test_classes_lose_no_pair(spark, classes):
    rnd = random.Random(classes)
    rows = [(rnd.randint(0, 300), int(rnd.paretovariate(0.7)) % 60) for _ in range(3000)] + [(999, i) for i in range(60)]
    items = spark.createDataFrame(rows, "basket long, item long")
    allowed = set(range(0, 55))
    candidates = spark.createDataFrame([(i,) for i in allowed], "item long")
    for least in (0, 5):
        for prune in (True, None):
            got = co_purchase_pairs(items, "basket", "item", candidates, least, pairs_per_task=200, prune=prune, classes=classes)
            assert sorted(map(tuple, got.collect())) == brute(rows, least, allowed)


def test_selective_thresholds_shuffle_few_pairs(spark):
    t = tables_for(spark, SF_SMALL)
    all_items = t.items.select("product_id").distinct()
    pairs = basket_pairs(t.items, "order_id", "product_id", all_items, 2)
    before = pairs.distinct().count()
    after = in_frequent_classes(pairs, 2).distinct().count()
    assert after * 10 < before, (before, after)


def test_no_pairs_at_all(spark):
    items = spark.createDataFrame([(1, 1), (2, 2)], "basket long, item long")
    for prune in (False, True):
        assert co_purchase_pairs(items, "basket", "item", items.select("item"), 0, prune=prune).collect() == []
