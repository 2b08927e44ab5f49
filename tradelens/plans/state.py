"""Report state: partial aggregates by day that are stored, replaced day by day, and rolled up.

A refresh computes the days it names from the facts of these days only, writes them beside what is there, and then
publishes a new version: a list of the refresh that holds each day.  Readers use the newest list, which appears as one
file, so they see a whole state, before or after a refresh, and never half of one.  Days without rows are dropped from
the list.  Refreshes that no list of the newest ``keep`` versions names can be deleted (:meth:`ReportState.clean`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.plans.reports import Params
from tradelens.session import cut_lineage, shared_folder
from tradelens.sources.tables import Tables, items_of_orders, partition_facts_by_month, purchased_between

_LIST = "version long, day string, refresh string"


def daily_facts(t: Tables, p: Params, first: str, end: str) -> DataFrame:
    """``day, category, orders, items, sales`` of the purchases from ``first`` up to ``end`` (exclusive).

    The bounds are comparisons on the purchase time, so Parquet skips other days, and other months are not read where the
    facts are stored by month.  A row with a null category counts all
    orders of the day; the others its items by category.  All measures add up over days but ``orders``, which
    adds up over days in the rows with a null category only (an order may hold several categories).
    """
    months = ["month"] if "month" in t.orders.columns else []  # of facts stored by month
    orders = purchased_between(t.orders, first, end).select("order_id", F.date_format("purchased", "yyyy-MM-dd").alias("day"), *months)
    every = orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders")).select(
        "day", F.lit(None).cast("string").alias("category"), "orders", F.lit(0).cast("long").alias("items"),
        F.lit(0).cast("decimal(28,2)").alias("sales"))
    named = t.products.join(t.category_names, "category_code").select("product_id", "category")
    items = items_of_orders(t.items, orders).select("order_id", "product_id", "price", "day").join(named, "product_id")
    return every.unionByName(items.groupBy("day", "category").agg(
        F.count_distinct("order_id").alias("orders"), F.count(F.lit(1)).alias("items"),
        F.sum("price").cast("decimal(28,2)").alias("sales")))


class ReportState:
    """Daily rows below one folder (path or URI)."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _lists(self) -> DataFrame:
        return self.spark.read.schema(_LIST).parquet(f"{self.root}/versions/*")

    def _current(self) -> list[tuple[str, str]]:
        """``(day, refresh)`` of the newest version: one row a day."""
        if not self._version():
            return []
        newest = self._lists().filter(F.col("version") == self._version())
        return [(r.day, r.refresh) for r in newest.collect() if r.day is not None]

    def read(self) -> DataFrame:
        """All days of the newest version."""
        current = self._current()
        if not current:
            return self.spark.createDataFrame([], self.schema)
        folders = sorted({f"{self.root}/days/{refresh}" for _, refresh in current})
        stored = self.spark.read.schema(f"{self.schema}, refresh string").parquet(*folders)
        listed = self.spark.createDataFrame(current, "day string, refresh string")
        return stored.join(listed, ["day", "refresh"], "left_semi").drop("refresh")

    def replace_days(self, rows: DataFrame, first: str, end: str) -> None:
        """Makes ``rows`` (all of days from ``first`` up to ``end``) the state of these days; the others stay."""
        refresh, day = uuid.uuid4().hex, F.col("day")
        own = rows.filter((day >= first) & (day < end)).withColumn("refresh", F.lit(refresh))
        own.repartitionByRange("day").write.parquet(f"{self.root}/days/{refresh}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/days/{refresh}").select("day").distinct().collect()
        entries = [(d, r) for d, r in self._current() if not first <= d < end] + [(r.day, refresh) for r in written]
        version = self._version() + 1
        listed = [(version, d, r) for d, r in entries] or [(version, None, None)]
        self.spark.createDataFrame(listed, _LIST).coalesce(1).write.parquet(f"{self.root}/versions/{version:08d}-{uuid.uuid4().hex}")

    def _version(self) -> int:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return 0
        return self._lists().agg(F.max("version")).first()[0] or 0

    def clean(self, keep: int = 2) -> int:
        """Deletes refreshes of which the newest ``keep`` versions name no day; returns their number."""
        lists = self._lists().filter(F.col("refresh").isNotNull())
        named = {r.refresh for r in lists.filter(F.col("version") > self._version() - keep).select("refresh").distinct().collect()}
        gone = [r.refresh for r in lists.select("refresh").distinct().collect() if r.refresh not in named]
        for refresh in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/days/{refresh}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)


STATE_SCHEMA = "day string, category string, orders long, items long, sales decimal(28,2)"


def refresh(state: ReportState, t: Tables, p: Params, first: str, end: str) -> None:
    """Brings the days from ``first`` up to ``end`` (exclusive) up to date, reading the facts of these days only."""
    state.replace_days(daily_facts(t, p, first, end), first, end)


def orders_by_month(state: DataFrame) -> DataFrame:
    """Orders per month, rolled up from the daily state."""
    return state.filter(F.col("category").isNull()).groupBy(F.substring("day", 1, 7).alias("month")).agg(F.sum("orders").alias("order_count"))


def sales_by_month(state: DataFrame) -> DataFrame:
    """Items and sales per month and category, rolled up from the daily state."""
    return state.filter(F.col("category").isNotNull()).groupBy(F.substring("day", 1, 7).alias("month"), "category").agg(
        F.sum("items").alias("items"), F.sum("sales").cast("double").alias("sales"))


def monthly_sales_from_state(t: Tables, p: Params) -> DataFrame:
    """Monthly sales by category from a state that is built in two refreshes, the second of which corrects the last week
    of the first; the folder is deleted once the rows are kept."""
    spark = t.orders.sparkSession
    state = ReportState(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", STATE_SCHEMA)
    refresh(state, t, p, p.daily_start, p.state_until)
    refresh(state, t, p, p.state_again_from, p.daily_end)
    out = cut_lineage(sales_by_month(state.read()))
    path = spark._jvm.org.apache.hadoop.fs.Path(state.root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def quarter_sales_of_monthly_facts(t: Tables, p: Params) -> DataFrame:
    """Daily sales by category of the last quarter of the analysed range, from facts stored by month: the folders of
    three months are read, of orders and of items.  The facts are deleted once the rows are kept."""
    spark = t.orders.sparkSession
    root = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    facts = daily_facts(partition_facts_by_month(t, root), p, p.quarter_start, p.daily_end)
    out = cut_lineage(facts.filter(F.col("category").isNotNull()).select("day", "category", "items", F.col("sales").cast("double").alias("sales")))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
