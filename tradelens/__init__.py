"""tradelens: commerce analytics as Spark DataFrame plans.

Layout
------
sources/    table loaders (canonical model), sinks, previews
functions/  column-level helpers (time arithmetic, exact ratios)
operators/  reusable DataFrame operators (aggregates, ranking, quantiles, trends, affinity, text)
plans/      named reports built from the operators, the query registry and the DuckDB oracles
"""

from tradelens.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
