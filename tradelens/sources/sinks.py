"""Sinks and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(df: DataFrame, n: int = 5, columns: Sequence[int | str] | None = None,
            order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows of a table, optionally a subset of columns (by name or position).

    ``order_by`` makes the preview repeatable; Spark plans ``orderBy + limit`` as a
    distributed top-k (TakeOrderedAndProject), so only ``n`` rows per task move.
    """
    if columns is not None:
        names = [df.columns[c] if isinstance(c, int) else c for c in columns]
        df = df.select(*names)
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                 mode: str = "overwrite") -> None:
    """Write a report: one file per task, CSV with a header or Parquet; optional partition columns."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # quotes in values are doubled, line breaks kept and empty texts quoted, so read_table gets the same back
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_text_lines(df: DataFrame, column: str, path: str, order_by: Sequence[str] | None = None) -> None:
    """Write one text column as lines, globally ordered when ``order_by`` is given.

    The part files read in order form one document: this is how a very long
    concatenation of texts is materialised without building it in one task.
    """
    out = df.select(F.col(column).cast("string").alias("value")
                    , *[F.col(c) for c in (order_by or [])])
    if order_by:
        out = out.orderBy(*order_by)
    out.select("value").write.mode("overwrite").text(path)
