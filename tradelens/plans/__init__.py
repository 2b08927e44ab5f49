"""Named reports, the query registry and the DuckDB oracles."""
