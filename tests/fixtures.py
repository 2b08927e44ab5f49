"""Literal canonical tables for edge-case tests (FIXTURES.md part C)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tradelens.sources.tables import Tables

SCHEMAS = {
    "orders": "order_id long, customer_id long, status string, purchased timestamp_ntz, approved timestamp_ntz, "
              "to_carrier timestamp_ntz, delivered timestamp_ntz, estimated timestamp_ntz",
    "customers": "customer_id long, person_id long, city string, zip int",
    "items": "order_id long, product_id long, seller_id long, price decimal(18,2), freight decimal(18,2)",
    "products": "product_id long, category_code string, weight_g int",
    "category_names": "category_code string, category string",
    "payments": "order_id long, payment decimal(18,2)",
    "reviews": "order_id long, score int",
    "comments": "review_id long, score int, comment string",
    "geo": "zip int, lat double, lng double",
    "sellers": "seller_id long",
    "leads": "lead_id long, origin string",
    "closed": "lead_id long",
}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def order(oid, cid, purchased, status="delivered", approved=None, to_carrier=None, delivered=None, estimated=None):
    conv = lambda x: ts(x) if isinstance(x, str) else x
    return (oid, cid, status, conv(purchased), conv(approved), conv(to_carrier), conv(delivered), conv(estimated))


def make_tables(spark, **rows) -> Tables:
    frames = {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}
    return Tables(**frames)
