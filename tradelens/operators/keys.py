"""Keys, cells and NULL-safe joins shared by the distribution and ranking operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.session import cut_lineage


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys appear once, from the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = None
    for k in keys:
        cond = left[k].eqNullSafe(renamed[f"_right_{k}"])
        on = cond if on is None else on & cond
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """The rows with a ``key``, dealt by it to all of the session's shuffle partitions.

    Spark merges small partitions up to a size of compressed bytes; sorted ids shrink so well that a merged one
    holds millions of rows, which tasks that sort and count them have in memory.  These partitions stay apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where(F.col(key).isNotNull()).repartition(n, key)


#: Rows that a cell of :func:`with_cells` holds at most, and the window task that reads it.
CELL_ROWS = 1 << 18
#: Parts that a cell is cut into at once, at most.
CELL_PARTS = 1 << 12
#: Rounds of cuts after which cells stay as they are (see :func:`with_cells`).
CELL_ROUNDS = 12

_LARGEST = 1.7976931348623157e308


def _scaled(x: Column, logarithm: bool) -> Column:
    """An increasing function of finite doubles whose differences do not overflow: half, or the signed logarithm."""
    if not logarithm:
        return x / 2
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))  # at least 26 for the smallest number


def with_cells(rows: DataFrame, groups: Sequence[str], key: Column, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, bool]:
    """Adds ``_cell``, a double by which every group is cut into ranges of ``key`` of at most ``cell_rows`` rows, and says
    whether any group was cut.

    Rows in a smaller cell have a smaller key; rows of equal keys are in one cell; null keys have the null cell.
    A cell is named by its smallest key (any number if no group was cut).

    Splitters are refined where the rows are: a cell with too many rows is cut into parts of equal width between
    its own least and greatest key, parts that still hold too many are cut again, and so on.  An outlier so costs
    one round, not the balance of all other rows.  Every second round has parts of equal width of the key's logarithm, for
    values of many scales.  A round is one aggregation of the rows in cells still too large, to a few numbers a
    part; it is read by the next one (checkpoint), and its rows meet their parts in a join.

    A cell keeps more rows only if its keys are equal as doubles (for instance decimals that agree in their first
    fifteen digits) or if ``CELL_ROUNDS`` rounds were not enough; results are right then, too.
    """
    g = list(groups)
    x = key.cast("double")
    # infinities and NaN, which sorts last, move next to the largest numbers
    finite = F.when(F.isnan(x) | (x > _LARGEST), _LARGEST).when(x < -_LARGEST, -_LARGEST).otherwise(x)
    rows = rows.withColumn("_key", finite)
    measures = [F.count(F.lit(1)).alias("_rows"), F.min("_key").alias("_cell"), F.max("_key").alias("_top")]
    known = F.col("_key").isNotNull()
    cells = cut_lineage(rows.filter(known).groupBy(*g).agg(*measures))
    half_width = F.col("_top") / 2 - F.col("_cell") / 2  # halves: the width itself may pass the largest double
    large = (F.col("_rows") > cell_rows) & (half_width > 0)
    if cells.filter(large).isEmpty():  # every group is one cell
        return rows.drop("_key").withColumn("_cell", F.when(key.isNotNull(), F.lit(0.0))), False
    placed = join_null_safe(rows, cells, g, "left")
    for i in range(CELL_ROUNDS):
        parts = F.least(F.lit(CELL_PARTS), F.ceil(F.col("_rows") * 2 / F.lit(cell_rows)).cast("int") + 1)
        x, low, high = (_scaled(F.col(c), i % 2 == 1) for c in ("_key", "_cell", "_top"))
        share = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
        part = F.least(F.greatest(F.floor(share * parts).cast("int"), F.lit(0)), parts - 1)
        placed = placed.withColumn("_part", F.when(known & large, part))
        inner = cut_lineage(placed.filter(F.col("_part").isNotNull()).groupBy(*g, F.col("_cell").alias("_outer"), "_part").agg(*measures))
        to = inner.withColumnsRenamed({"_rows": "_rows_in", "_cell": "_cell_in", "_top": "_top_in"})
        placed = join_null_safe(placed.withColumn("_outer", F.col("_cell")), to, [*g, "_outer", "_part"], "left")
        placed = placed.withColumns({c: F.coalesce(f"{c}_in", c) for c in ("_rows", "_cell", "_top")}).drop(
            "_outer", "_part", "_rows_in", "_cell_in", "_top_in")
        if inner.filter(large).isEmpty():
            break
    return placed.withColumn("_cell", F.when(known, F.col("_cell"))).drop("_key", "_rows", "_top"), True
