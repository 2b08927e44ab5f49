"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the bitmaps that sort out rows before a shuffle, whatever the input (512 KB).
BITMAP_BITS = 22

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark only (the path may be any URI)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)`` with null texts as empty; all other columns are left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this library where it lies (a session may be started from any folder).

    On a cluster whose nodes do not share that place, ship the library with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    return spark


def bit_of(slot: Column) -> Column:
    """The bit of a number in its word of 64 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def bitmap_slot(*columns: Column | str) -> Column:
    """A place in a bitmap, from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITMAP_BITS)).cast("int")


def bitmap(slots: DataFrame) -> Column:
    """A bitmap of the numbers in ``slot``: a constant array of longs, added up by Spark, of fixed length.

    It sorts out most rows that a join would drop, before they are shuffled for it; the join drops the others.
    """
    words = slots.groupBy(F.shiftright("slot", 6).cast("long").alias("id")).agg(F.bit_or(bit_of(F.col("slot"))).alias("bits"))
    table = (slots.sparkSession.range(1 << (BITMAP_BITS - 6)).join(words, "id", "left")
             .select("id", F.coalesce("bits", F.lit(0)).cast("long").alias("bits")))
    return table.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda e: e["bits"])).scalar()


def in_bitmap(words: Column, slot: Column) -> Column:
    return words[F.shiftright(slot, 6)].bitwiseAND(bit_of(slot)) != 0


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that an operator wrote, on any filesystem that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list[dict] | dict | pa.RecordBatch],
                schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns a dict of columns in schema order."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch), schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL schema."""
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(","))])
