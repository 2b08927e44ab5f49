"""Global tiling and RFM labels.

``ntile_score`` computes exactly what ``NTILE(k) OVER (ORDER BY value [DESC], tie)`` computes, but without Spark's
window over the whole table (which moves every row into a single partition):

1. Rows are counted per distinct value, and a prefix sum over these counts (:func:`prefix_counts`) gives each value's first
   rank.  From it and the count follow the tiles of the value's first and last row.
2. Where both are the same tile, that is the tile of all its rows.
3. At most ``k - 1`` values straddle an edge.  Their rows (there may be many) are dealt to cells of the tie
   key, the cells are added up, and rows are numbered inside their cell only.

Cells are ranges of a key with a bounded number of rows (:func:`tradelens.operators.keys.with_cells`).  Building the plan
materialises the input, the counts and the cells' bounds (checkpoints); everything else is lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators.keys import CELL_ROWS, join_null_safe, with_cells
from tradelens.session import cut_lineage

_EPOCH = "1970-01-01 00:00:00"


def monotone_key(col: Column, dtype: T.DataType, allow_hash: bool = False) -> Column:
    """A numeric column that never decreases when ``col`` increases (for quantile cuts)."""
    if isinstance(dtype, T.TimestampNTZType):
        from tradelens.functions.timecols import elapsed_micros

        return elapsed_micros(F.to_timestamp_ntz(F.lit(_EPOCH)), col)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.DateType):
        return F.unix_date(col)
    if isinstance(dtype, T.BooleanType):
        return col.cast("int")
    if isinstance(dtype, T.NumericType):
        return col
    if allow_hash:
        return F.xxhash64(col)
    raise TypeError(f"cannot order-bucket a column of type {dtype.simpleString()}")


def offsets_of_cells(counted: DataFrame, groups: list[str], count: str, descending: bool = False) -> DataFrame:
    """``groups, _cell, _off``: rows (the sum of ``count``) in the cells of a group before this one.

    The window of a group has a row for each of its cells, which hold so many rows each that it stays short.
    """
    cell = F.col("_cell")
    before = Window.partitionBy(*groups).orderBy(cell.desc_nulls_last() if descending else cell.asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = counted.groupBy(*groups, "_cell").agg(F.sum(count).alias("_k"))
    return totals.select(*groups, "_cell", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))


def prefix_counts(hist: DataFrame, groups: list[str], value: str, count: str, descending: bool = False,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """For a histogram (one row per ``groups`` + distinct ``value``, with a row ``count``),
    add ``_start`` = rows of the same group ordered before this value and ``_n`` = rows
    of the group.  NULL values sort first ascending, last descending; groups may be NULL.

    A distributed prefix sum: each group's range of values is cut into cells of at most ``cell_rows`` values, a window
    partitioned by (group, cell) sums inside each cell and a table of cell totals gives the offsets.  No window
    holds more rows of a group than that.  ``hist`` is read several times: materialise it before.
    """
    g = list(groups)
    if not g:
        raise ValueError("prefix_counts needs at least one group column")
    v = F.col(value)
    key = monotone_key(v, {f.name: f.dataType for f in hist.schema.fields}[value])
    dealt, cut = with_cells(hist, g, key, cell_rows)
    order = v.desc_nulls_last() if descending else v.asc_nulls_first()
    if not cut:  # each group is small enough for one window
        in_group = Window.partitionBy(*g)
        before = in_group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return hist.select(*hist.columns, F.sum(count).over(in_group).alias("_n"),
                           F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_start"))
    before = Window.partitionBy(*g, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum(count).over(before), F.lit(0)))
    n = hist.groupBy(*g).agg(F.sum(count).alias("_n"))
    out = join_null_safe(join_null_safe(summed, offsets_of_cells(dealt, g, count, descending), [*g, "_cell"]), n, g)
    return out.select(*hist.columns, "_n", (F.col("_off") + F.col("_in")).alias("_start"))


def _tile(rank: Column, n: Column, k: int) -> Column:
    """The NTILE tile of a 1-based rank among n rows: the first ``n % k`` tiles have a row more."""
    size, more = F.call_function("div", n, F.lit(k)), n % k
    long = more * (size + 1)  # rows in the longer tiles
    return F.when(rank <= long, F.call_function("div", rank - 1, size + 1)).otherwise(
        more + F.coalesce(F.call_function("div", rank - 1 - long, F.nullif(size, F.lit(0))), F.lit(0))).cast("int") + 1


def grouped_ntile(df: DataFrame, groups: list[str], value: str, k: int, tie: str, descending: bool = True,
                  out: str = "tile", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``out`` = NTILE(``k``) OVER (PARTITION BY groups ORDER BY value [DESC], tie).

    Each group may be arbitrarily large and may be NULL.  ``tie`` must be unique inside a group; string
    ties are ordered by ``(xxhash64(tie), tie)``.  No window holds more than ``cell_rows`` rows of a group.
    """
    if k < 1:
        raise ValueError("k must be positive")
    g, unit = list(groups), [*groups, value]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    natural = not isinstance(kinds[tie], (T.StringType, T.BinaryType))
    tie_key = monotone_key(F.col(tie), kinds[tie], allow_hash=True)
    df = cut_lineage(df)
    hist = cut_lineage(df.groupBy(*unit).agg(F.count(F.lit(1)).alias("_c")))
    values = prefix_counts(hist, g, value, "_c", descending, cell_rows).select(
        *unit, "_start", "_n", _tile(F.col("_start") + 1, F.col("_n"), k).alias("_first"),
        _tile(F.col("_start") + F.col("_c"), F.col("_n"), k).alias("_last"))
    rows = join_null_safe(df, values, unit)
    plain = rows.filter(F.col("_first") == F.col("_last")).withColumn(out, F.col("_first"))

    cut = rows.filter(F.col("_first") < F.col("_last")).withColumn("_tie", tie_key)
    dealt, several = with_cells(cut, unit, F.col("_tie"), cell_rows)
    own = Window.partitionBy(*unit, "_cell").orderBy(*([F.col("_tie")] if natural else [F.col("_tie"), F.col(tie)]))
    numbered = dealt.withColumns({"_i": F.row_number().over(own), "_off": F.lit(0)})
    if several:
        offsets = offsets_of_cells(dealt.withColumn("_one", F.lit(1)), unit, "_one")
        numbered = join_null_safe(numbered.drop("_off"), offsets, [*unit, "_cell"])
    numbered = numbered.withColumn(out, _tile(F.col("_start") + F.col("_off") + F.col("_i"), F.col("_n"), k))
    cols = [*df.columns, out]
    return plain.select(*cols).unionByName(numbered.select(*cols))


def ntile_score(df: DataFrame, value: str, k: int, tie: str, descending: bool = True, out: str = "tile") -> DataFrame:
    """Add ``out`` = NTILE(``k``) OVER (ORDER BY value [DESC], tie) over the whole frame: one group."""
    tiled = grouped_ntile(df.withColumn("_all", F.lit(0)), ["_all"], value, k, tie, descending, out)
    return tiled.drop("_all")


# RFM segment rules (first match wins), by recency score and
# s = frequency score + monetary score.  Label spellings are part of the output.
RFM_RULES = [
    ("Champions", [1], range(1, 5)),
    ("Can't Lose Them", [4, 5], range(1, 3)),
    ("Hibernating", [4, 5], range(3, 7)),
    ("Lost", [4, 5], range(7, 11)),
    ("Loyal Customers", [2, 3], range(1, 5)),
    ("Needs Attention", [3], range(5, 7)),
    ("Recent Users", [1], range(7, 9)),
    ("Potentital Loyalists", [1], range(5, 7)),
    ("Potentital Loyalists", [2], range(5, 9)),
    ("Price Sensitive", [1], range(9, 11)),
    ("Promising", [2], range(9, 11)),
    ("About to Sleep", [3], range(7, 11)),
]


def segment_label(recency: str, frequency: str, monetary: str) -> Column:
    """RFM segment from three 1..5 scores (O12); NULL if no rule matches."""
    s = F.col(frequency) + F.col(monetary)
    expr = None
    for label, rec, sums in RFM_RULES:
        cond = F.col(recency).isin(list(rec)) & s.isin(list(sums))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr
