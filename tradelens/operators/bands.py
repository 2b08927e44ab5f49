"""Volume bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_labels(edges: Sequence[int], unit: str = "orders") -> list[str]:
    """Labels for bands starting at each edge: 'lo-hi unit' and 'last+ unit'."""
    labels = [f"{lo}-{hi - 1} {unit}" for lo, hi in zip(edges, edges[1:])]
    return labels + [f"{edges[-1]}+ {unit}"]


def volume_band(count: Column | str, edges: Sequence[int], unit: str = "orders", below: str = "none") -> Column:
    """Label a count by the band it falls in; counts under the first edge get ``below``."""
    c = F.col(count) if isinstance(count, str) else count
    labels = band_labels(edges, unit)
    expr = F.when(c.isNull() | (c < edges[0]), F.lit(below))
    for lo, hi, label in zip(edges, edges[1:], labels):
        expr = expr.when(c.between(lo, hi - 1), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))
