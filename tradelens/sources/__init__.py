from tradelens.sources.sinks import preview, write_report, write_text_lines
from tradelens.sources.tables import Tables, marketplace_tables, read_table, star_tables

__all__ = ["Tables", "marketplace_tables", "preview", "read_table", "star_tables", "write_report",
           "write_text_lines"]
