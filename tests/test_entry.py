"""Driver contract of __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_and_keys_match(spark):
    mod = _module()
    df = mod.entry(spark)
    assert df.columns == ["rfm_bucket", "avg_days_since_purchase", "avg_sales_per_customer", "customer_count"]
    assert df.count() > 0
    from tradelens.plans.catalog import queries
    from tradelens.plans.oracle import WITHOUT_SQL
    assert set(queries()) - WITHOUT_SQL <= set(mod.oracle_sql()) <= set(mod.queries()) - WITHOUT_SQL
    for sql in mod.oracle_sql().values():
        assert sql.lstrip().lower().startswith(("with", "select"))
