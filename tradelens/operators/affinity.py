"""Product affinity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators.keys import dealt_by


def frequent_items(items: DataFrame, key: str, basket: str, min_count: int, out: str = "item_count") -> DataFrame:
    """Items occurring in more than ``min_count`` item rows (O13; strict ``>``)."""
    return items.groupBy(key).agg(F.count(basket).alias(out)).filter(F.col(out) > min_count)


#: Pairs of one basket that one task forms at most (about).
PAIRS_PER_TASK = 1_000_000
#: Hash classes in which pairs are counted before the pairs themselves (a bitmap of 512 KB).
PAIR_CLASSES = 1 << 22
#: The least threshold for which that is worth a second pass over the pairs.
PRUNE_FROM = 5


def basket_pairs(items: DataFrame, basket: str, key: str, candidates: DataFrame, min_common: int,
                 pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """``_a, _b`` (``_a < _b``): the pairs of candidate items, once for each basket that holds both.

    Baskets lie together, sorted by item, so repeated rows follow each other and an item meets those before it.
    Only baskets of more than ``pairs_per_task`` pairs are dealt to several tasks.
    """
    in_basket = Window.partitionBy(basket).orderBy(key)
    rows = dealt_by(items.select(basket, key).where(F.col(key).isNotNull()), basket)
    bi = rows.withColumn("_before", F.lag(key).over(in_basket)).where("_before is null or _before <> " + f"`{key}`").drop("_before")
    support = bi.groupBy(key).agg(F.count(F.lit(1)).alias("_sup")).filter(F.col("_sup") > min_common)
    wanted = support.select(key).join(candidates.select(key), key, "left_semi")
    sized = dealt_by(bi.join(wanted, key, "left_semi"), basket).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(basket)))
    n = F.col("_size").cast("double")
    sized = sized.withColumn("_parts", F.ceil(n * n / F.lit(float(pairs_per_task))).cast("int"))
    before = F.collect_list(key).over(in_basket.rowsBetween(Window.unboundedPreceding, -1))
    usual = (sized.where("_parts = 1 and _size > 1").select(F.col(key).alias("_b"), before.alias("_others"))
             .select(F.explode("_others").alias("_a"), "_b"))
    dealt = sized.where("_parts > 1")
    left = dealt.select(F.col(basket).alias("_bk1"), F.col(key).alias("_a"),
                        F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_p1"))
    right = dealt.select(F.col(basket).alias("_bk2"), F.col(key).alias("_b"),
                         F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p2"))
    large = left.join(right, (F.col("_bk1") == F.col("_bk2")) & (F.col("_p1") == F.col("_p2")) & (F.col("_a") < F.col("_b")))
    return usual.union(large.select("_a", "_b"))


def in_frequent_classes(pairs: DataFrame, min_common: int, classes: int = PAIR_CLASSES) -> DataFrame:
    """The rows of ``pairs`` whose hash class has more than ``min_common`` rows.

    A pair has no more rows than its class, so no pair above the threshold is lost.  Classes are counted
    in the tasks and then added up: at most ``classes`` rows a task, whatever the number of pairs.  The
    classes above the threshold are one bitmap of ``classes`` bits, a constant of the second pass.
    """
    slot = F.pmod(F.xxhash64("_a", "_b"), F.lit(classes)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)))
    above = pairs.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_common)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot").bitwiseAND(F.lit(63)))
    words = above.groupBy(F.shiftright("_slot", 6).cast("long").alias("id")).agg(F.bit_or(one).alias("_bits"))
    table = pairs.sparkSession.range(max(1, classes >> 6)).join(words, "id", "left").select("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"))
    bitmap = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_bits"))), lambda w: w["_bits"])).scalar()
    return pairs.filter(bitmap[F.shiftright(slot, 6)].bitwiseAND(bit) != 0)


def co_purchase_pairs(items: DataFrame, basket: str, key: str, candidates: DataFrame, min_common: int,
                      pairs_per_task: int = PAIRS_PER_TASK, out: str = "common_orders_count",
                      prune: bool | None = None, classes: int = PAIR_CLASSES) -> DataFrame:
    """Unordered item pairs bought in more than ``min_common`` distinct baskets.

    * ``(basket, item)`` is deduplicated first, so counting pairs counts distinct baskets and a hot item
      is one row per basket.
    * Only candidate items take part (semi join), and a pair can only pass if
      both its items are in more than ``min_common`` distinct baskets, so
      items below that are dropped before any pair is formed.
    * An item of a basket meets the basket's smaller items; this is the
      definition of the result, and its cost is the number of co-occurrences.
      A basket of n items with ``n * n`` above ``pairs_per_task`` is joined with itself and split into ``ceil(n * n / pairs_per_task)`` parts: the left side is dealt to the parts by
      a hash of the item and the right side is sent to every part, so each pair is formed exactly once and
      the work of a task is bounded whatever the basket's size.  Baskets of usual size are not joined.
    * Pairs in hash classes that cannot reach the threshold are dropped before the shuffle on the pair
      (:func:`in_frequent_classes`); this forms the pairs twice, from the same shuffled baskets.  ``prune`` says whether,
      by default from a threshold of ``PRUNE_FROM`` on; it changes no result.
    * Pair counts are combined map-side before the shuffle on the pair.
    """
    pairs = basket_pairs(items, basket, key, candidates, min_common, pairs_per_task)
    if min_common >= PRUNE_FROM if prune is None else prune:
        pairs = in_frequent_classes(pairs, min_common, classes)
    return (pairs.groupBy(F.col("_a").alias(f"{key}1"), F.col("_b").alias(f"{key}2"))
            .agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > min_common))


def affinity_graph(vertices: DataFrame, edges: DataFrame, key: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Graph of frequently co-bought items.

    ``vertices`` has one row per item (``key`` plus attributes), ``edges`` has
    ``{key}1, {key}2, weight``.  Returns (vertices touched by an edge with their
    degree and weighted degree, edges).  Items without an edge are dropped.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col(f"{key}1").alias(key), F.col(weight).alias("w")),
        F.struct(F.col(f"{key}2").alias(key), F.col(weight).alias("w")))).alias("e")).select("e.*")
    degree = ends.groupBy(key).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"))
    return vertices.join(degree, key), edges
