"""Canonical table model and loaders.

Every operator works on these canonical frames (column names fixed here):

==============  ==========================================================================
orders          order_id, customer_id, status, purchased, approved, to_carrier, delivered, estimated
customers       customer_id, person_id, city, zip
items           order_id, product_id, seller_id, price, freight
products        product_id, category_code, weight_g
category_names  category_code, category
payments        order_id, payment
reviews         order_id, score
comments        review_id, score, comment
geo             zip, lat, lng
sellers         seller_id
leads           lead_id, origin
closed          lead_id
==============  ==========================================================================

Two loaders produce them:

* :func:`marketplace_tables` reads a marketplace export laid out as one Parquet
  (or CSV) dataset per table with the export's own column names.
* :func:`star_tables` derives every table deterministically from the TPC-H-like
  star schema used for testing (the adapter definitions are in FIXTURES.md).

Tables are opened when a report first uses them, so an export needs only the tables that its reports
read.  Frames are lazy; opening one reads Parquet footers at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.timecols import between_half_open

MONEY = "decimal(18,2)"
TABLE_NAMES = ("orders", "customers", "items", "products", "category_names", "payments", "reviews", "comments", "geo",
               "sellers", "leads", "closed")


class Tables:
    """The canonical frames as attributes: each given as a DataFrame, or as a function that opens it on first use."""

    orders: DataFrame
    customers: DataFrame
    items: DataFrame
    products: DataFrame
    category_names: DataFrame
    payments: DataFrame
    reviews: DataFrame
    comments: DataFrame
    geo: DataFrame
    sellers: DataFrame
    leads: DataFrame
    closed: DataFrame

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]):
        unknown = set(sources) - set(TABLE_NAMES)
        if unknown:
            raise TypeError(f"no such tables: {sorted(unknown)}")
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._sources:
            raise AttributeError(f"the table {name} was not given")
        source = self._sources[name]
        frame = source if isinstance(source, DataFrame) else source()
        self.__dict__[name] = frame
        return frame

    def replaced(self, **frames: DataFrame) -> Tables:
        """The same tables, some of them replaced."""
        return Tables(**(self._sources | frames))


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", schema: str | None = None,
               layout: str = "{name}.{fmt}", free_text: bool = True) -> DataFrame:
    """One table of a folder, by path or URI; only Spark looks at the path.

    ``layout`` is the table's place below ``root``, e.g. ``"{name}"`` for a folder per table.  CSV has a header and
    doubles quotes within quotes.  With ``free_text``, quoted values may hold line breaks, and a CSV file is one
    task; without, a row is a line and large files are split.
    """
    path = f"{root.rstrip('/')}/{layout.format(name=name, fmt=fmt)}"
    reader = spark.read
    if fmt == "csv":
        # a null is an empty field without quotes; the token stands for it while reading, and is in no text
        reader = reader.options(header=True, multiLine=free_text, quote='"', escape='"', nullValue="\x00\x00", emptyValue="")
        if schema:
            # columns are found by name, so a file may have them in another order, or more
            return reader.option("inferSchema", False).csv(path).select(
                *[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in _columns(schema)])
        return reader.csv(path)
    frame = reader.format(fmt).load(path)
    return frame.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in _columns(schema)]) if schema else frame


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split(None, 1)) for c in schema.split(", ")]


# ---------------------------------------------------------------------------
# Marketplace export layout
# ---------------------------------------------------------------------------

# The export's tables and the columns that reports use, with their types.
EXPORT_SCHEMAS = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
              "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
              "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "customers": "customer_id string, customer_unique_id string, customer_city string, customer_state string, "
                 "customer_zip_code_prefix int",
    "order_items": "order_id string, product_id string, seller_id string, price decimal(18,2), freight_value decimal(18,2)",
    "products": "product_id string, product_category_name string, product_weight_g double",
    "product_category_name_translation": "product_category_name string, product_category_name_english string",
    "order_payments": "order_id string, payment_value decimal(18,2)",
    "order_reviews": "review_id string, order_id string, review_score int, review_comment_message string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double",
    "sellers": "seller_id string",
    "leads_qualified": "mql_id string, origin string",
    "leads_closed": "mql_id string",
}


#: Tables of the export whose values may hold line breaks.
FREE_TEXT = ("order_reviews",)


def marketplace_tables(spark: SparkSession, root: str, fmt: str = "parquet", layout: str = "{name}.{fmt}") -> Tables:
    """Canonical tables from a marketplace export (one dataset per source table; see :func:`read_table`).

    ``customers`` has the state beside the city, for ``Params(city_keys=("city", "state"))``; an export without it
    has a null state.
    """
    def t(name):
        schema, free_text = EXPORT_SCHEMAS[name], name in FREE_TEXT
        if name == "customers":
            there = read_table(spark, root, name, fmt, layout=layout, free_text=free_text).columns
            if "customer_state" not in there:
                schema = schema.replace("customer_state string, ", "")
                return read_table(spark, root, name, fmt, schema, layout, free_text).withColumn("customer_state", F.lit(None).cast("string"))
        return read_table(spark, root, name, fmt, schema, layout, free_text)

    def renamed(name, **columns):
        return lambda: t(name).select(*[F.col(source).alias(c) for c, source in columns.items()])

    return Tables(
        orders=renamed("orders", order_id="order_id", customer_id="customer_id", status="order_status",
                       purchased="order_purchase_timestamp", approved="order_approved_at",
                       to_carrier="order_delivered_carrier_date", delivered="order_delivered_customer_date",
                       estimated="order_estimated_delivery_date"),
        customers=renamed("customers", customer_id="customer_id", person_id="customer_unique_id", city="customer_city",
                          state="customer_state", zip="customer_zip_code_prefix"),
        items=renamed("order_items", order_id="order_id", product_id="product_id", seller_id="seller_id", price="price",
                      freight="freight_value"),
        products=renamed("products", product_id="product_id", category_code="product_category_name",
                         weight_g="product_weight_g"),
        category_names=renamed("product_category_name_translation", category_code="product_category_name",
                               category="product_category_name_english"),
        payments=renamed("order_payments", order_id="order_id", payment="payment_value"),
        reviews=renamed("order_reviews", order_id="order_id", score="review_score"),
        comments=renamed("order_reviews", review_id="review_id", score="review_score", comment="review_comment_message"),
        geo=renamed("geolocation", zip="geolocation_zip_code_prefix", lat="geolocation_lat", lng="geolocation_lng"),
        sellers=renamed("sellers", seller_id="seller_id"),
        leads=renamed("leads_qualified", lead_id="mql_id", origin="origin"),
        closed=renamed("leads_closed", lead_id="mql_id"))


# ---------------------------------------------------------------------------
# Test star schema adapters (FIXTURES.md part B)
# ---------------------------------------------------------------------------

def star_orders(orders: DataFrame) -> DataFrame:
    oid, cid = F.col("o_orderkey"), F.col("o_custkey")
    purchased = F.timestamp_add("SECOND", (oid * 7919) % 86400, F.col("o_orderdate").cast("timestamp_ntz"))
    base = orders.select(oid.alias("order_id"), cid.alias("customer_id"),
                         F.col("o_orderstatus").alias("status"), purchased.alias("purchased"))
    o, c, p = F.col("order_id"), F.col("customer_id"), F.col("purchased")
    return base.select(
        "order_id", "customer_id", "status", "purchased",
        F.when(o % 97 != 0, F.timestamp_add("HOUR", o % 48, p)).alias("approved"),
        F.when(o % 53 != 0, F.timestamp_add("HOUR", 72 + c % 96, p)).alias("to_carrier"),
        F.when(o % 31 != 0, F.timestamp_add("HOUR", 168 + o % 240, p)).alias("delivered"),
        F.timestamp_add("DAY", F.lit(25), F.to_date(p).cast("timestamp_ntz")).alias("estimated"))


def star_tables(spark: SparkSession, root: str) -> Tables:
    def t(name):
        return read_table(spark, root, name)

    def customers():
        customer, nation = t("customer"), t("nation")
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
            F.col("c_custkey").alias("customer_id"),
            (F.col("c_custkey") - F.col("c_custkey") % 2).alias("person_id"),
            F.col("n_name").alias("city"), F.col("c_nationkey").alias("zip"))

    def items():
        return t("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast(MONEY).alias("price"),
            F.col("l_quantity").cast(MONEY).alias("freight"))

    def products():
        pk = F.col("p_partkey")
        return t("part").select(
            pk.alias("product_id"),
            F.when(pk % 50 != 0, F.col("p_brand")).alias("category_code"),
            F.when(pk % 40 != 7, F.col("p_size") * 100).alias("weight_g"))

    def category_names():
        return (t("part").filter(F.col("p_brand") != "Brand#25")
                .select(F.col("p_brand").alias("category_code"), F.lower("p_brand").alias("category")).distinct())

    def payments():
        return t("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast(MONEY).alias("payment"))

    def reviews():
        orders, ok = t("orders"), F.col("o_orderkey")
        return (orders.filter(ok % 10 != 0)
                .select(ok.alias("order_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("score"))
                .unionByName(orders.filter(ok % 20 == 1).select(ok.alias("order_id"), F.lit(1).alias("score"))))

    def comments():
        return t("documents").join(t("labels"), "doc_id").select(
            F.col("doc_id").alias("review_id"),
            F.when(F.col("quality") == 0, 1 + F.col("toxic")).otherwise(4 + F.col("toxic")).alias("score"),
            F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("comment"))

    def geo():
        return t("supplier").select(F.col("s_nationkey").alias("zip"), F.col("s_acctbal").cast(MONEY).alias("lat"),
                                    F.col("s_suppkey").cast(MONEY).alias("lng"))

    def sellers():
        return t("supplier").select(F.col("s_suppkey").alias("seller_id")).unionByName(
            spark.range(1).select(F.lit(-1).cast("bigint").alias("seller_id")))

    def leads():
        return t("customer").select(F.col("c_custkey").alias("lead_id"),
                                    F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("origin"))

    def closed():
        urgent = F.col("o_orderpriority") == "1-URGENT"
        late = F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00"))
        return t("orders").filter(urgent & late).select(F.col("o_custkey").alias("lead_id"))

    return Tables(orders=lambda: star_orders(t("orders")), customers=customers, items=items, products=products,
                  category_names=category_names, payments=payments, reviews=reviews, comments=comments, geo=geo,
                  sellers=sellers, leads=leads, closed=closed)


# ---------------------------------------------------------------------------
# Co-located storage
# ---------------------------------------------------------------------------

ORDER_KEYED = ("orders", "items", "payments", "reviews")


def colocate_order_facts(tables: Tables, location: str, buckets: int, database: str = "tradelens") -> Tables:
    """Store the order-keyed tables bucketed and sorted by ``order_id`` with one bucket count.

    Joins and aggregations on ``order_id`` between these tables then read matching
    buckets side by side and need no shuffle.  The tables are external tables of
    ``database`` in the session's catalog, with their files under ``location``
    (a shared folder on a cluster); returns the same canonical model reading them.
    Worth it when the facts are queried repeatedly.
    """
    spark = tables.orders.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    stored = {}
    for name in ORDER_KEYED:
        full = f"{database}.{name}"
        (getattr(tables, name).write.mode("overwrite").bucketBy(buckets, "order_id").sortBy("order_id")
         .option("path", f"{location.rstrip('/')}/{name}").saveAsTable(full))
        stored[name] = spark.table(full)
    return tables.replaced(**stored)


# ---------------------------------------------------------------------------
# Facts by month
# ---------------------------------------------------------------------------

def partition_facts_by_month(tables: Tables, location: str) -> Tables:
    """Store orders and items below ``location`` (path or URI) in one folder for each month of purchase.

    Items get the month of their order, so a range of purchase times prunes the folders of both
    (:func:`purchased_between`, :func:`items_of_orders`).  A month is written by several tasks, cut by order.  Orders without
    a purchase time, and items without an order, are in the folder of the null month.  Returns the same canonical
    model with ``month`` beside the other columns of both.
    """
    spark = tables.orders.sparkSession
    root = location.rstrip("/")
    orders = tables.orders.withColumn("month", F.date_format("purchased", "yyyy-MM"))
    orders.repartitionByRange("month", "order_id").write.partitionBy("month").parquet(f"{root}/orders")
    stored = spark.read.schema(orders.schema).parquet(f"{root}/orders")
    items = tables.items.join(stored.select("order_id", "month"), "order_id", "left").select(*tables.items.columns, "month")
    items.repartitionByRange("month", "order_id").write.partitionBy("month").parquet(f"{root}/items")
    return tables.replaced(orders=stored, items=spark.read.schema(items.schema).parquet(f"{root}/items"))


def purchased_between(orders: DataFrame, first: str, end: str) -> DataFrame:
    """Orders purchased from the date ``first`` up to ``end`` (exclusive); other months' folders are not read."""
    rows = orders.filter(between_half_open("purchased", first, end))
    return rows.filter(F.col("month").between(first[:7], end[:7])) if "month" in orders.columns else rows


def items_of_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with the columns of their orders.  Where both know the month it is joined too: Spark carries the bounds on
    the orders' month over to the items', whose other folders are not read either."""
    keys = ["order_id", "month"] if "month" in items.columns and "month" in orders.columns else ["order_id"]
    return items.join(orders, keys)
