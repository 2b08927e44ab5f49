"""Best-fit packing of documents into sequences, under conflicts.

A bin holds at most ``capacity`` units, at most one piece of a source and at most one of a duplicate
cluster.  Bins are kept in the order of their residual room and carry bitmaps of their sources and
clusters.  A piece goes to the tightest bin it fits: the search starts at the successor of its size and
goes on to roomier bins until one has no conflict.

Documents are measured in UTF-8 bytes plus one separator and cut into pieces of at most ``capacity``;
full pieces are bins of their own, the others are packed in descending size.

How it runs: pieces are dealt to shards of about ``shard_pieces`` by a hash of their document and
place, so that hot sources and clusters spread evenly; a shard is packed in one task and its size does not grow with
the input.  Sources and clusters that hold a large share of a shard (``HOT_SHARE``) have their own ordered lists of the
bins without them, so that the search does not walk over bins that are sure to conflict.

Cases: null and empty texts are a separator only; a null source never conflicts; equal texts are a cluster
unless a cluster column is given (null: none); long texts become several pieces (of one source, so never
together unless the source is null); repeated rows are pieces like any other, told apart by their order; a
null doc_id is a document like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import arrow_schema
from tradelens.session import cut_lineage

CAPACITY = 8192
SHARD_PIECES = 16_384
HOT_SHARE = 1 / 16


class Bins:
    """The open bins of one shard, in the order of their residual room."""

    def __init__(self, capacity: int, hot_sources: set[int] = frozenset(), hot_clusters: set[int] = frozenset()):
        self.capacity = capacity
        self.room: list[int] = []
        self.sources: list[int] = []  # bitmap of each bin
        self.clusters: list[int] = []
        # ordered lists of (room << 32 | bin): all bins, and for each hot source or cluster the bins without it
        self.order: list[int] = []
        self.without_source: dict[int, list[int]] = {s: [] for s in hot_sources}
        self.without_cluster: dict[int, list[int]] = {c: [] for c in hot_clusters}

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The bin with the least room that fits and does not conflict (of equal ones the oldest)."""
        order = self.without_source.get(source)
        if order is None:
            order = self.without_cluster.get(cluster, self.order)
        for at in range(bisect_left(order, size << 32), len(order)):
            b = order[at] & 0xFFFFFFFF
            if not (source >= 0 and self.sources[b] >> source & 1) and not (cluster >= 0 and self.clusters[b] >> cluster & 1):
                return b
        return None

    def _lists(self, b: int):
        yield self.order
        for s, order in self.without_source.items():
            if not self.sources[b] >> s & 1:
                yield order
        for c, order in self.without_cluster.items():
            if not self.clusters[b] >> c & 1:
                yield order

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Places a piece; its bin and its offset there."""
        b = self.tightest(size, source, cluster)
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            key = self.room[b] << 32 | b
            for order in self._lists(b):
                del order[bisect_left(order, key)]
        offset = self.capacity - self.room[b]
        self.room[b] -= size
        if source >= 0:
            self.sources[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        if self.room[b]:
            key = self.room[b] << 32 | b
            for order in self._lists(b):
                insort(order, key)
        return b, offset


def _conflicting(values: list) -> tuple[list[int], set[int]]:
    """Small numbers for values that occur more than once (-1 for others and nulls), and the hot ones."""
    distinct: dict = {}
    for v in values:
        if v is not None:
            distinct[v] = distinct.get(v, 0) + 1
    number = {v: i for i, v in enumerate(v for v, n in distinct.items() if n > 1)}
    hot = {i for v, i in number.items() if distinct[v] > max(32, HOT_SHARE * len(values))}
    return [number.get(v, -1) for v in values], hot


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, placed in the given order."""
    source, hot_sources = _conflicting(sources)
    cluster, hot_clusters = _conflicting(clusters)
    bins = Bins(capacity, hot_sources, hot_clusters)
    placed = [bins.put(*piece) for piece in zip(sizes, source, cluster)]
    return [b for b, _ in placed], [o for _, o in placed]


_RESULT = ("doc_id long, piece long, start long, size long, source string, cluster long, bin_id long, bin_start long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
                   cluster_col: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, size, source, cluster, bin_id, bin_start``.

    ``start`` is the piece's offset in the document's bytes, ``bin_start`` its offset in the bin; a
    document's last piece ends with the separator.
    """
    text = docs["text"].cast("string")
    cluster = docs[cluster_col].cast("long") if cluster_col else F.when(F.length(text) > 0, F.xxhash64(text))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("length"),
                       docs["source"].cast("string").alias("source"), cluster.alias("cluster"))
    last = F.floor((F.col("length") - 1) / capacity).cast("long")
    pieces = (rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
              .withColumn("start", F.col("piece") * capacity)
              .withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("start")))
              .select("doc_id", "piece", "start", "size", "source", "cluster"))
    pieces = cut_lineage(pieces)
    shards = max(1, -(-pieces.count() // shard_pieces))
    # equal rows would hash alike, so a number from the row's place in its stored partition is added
    pieces = pieces.withColumn("salt", F.monotonically_increasing_id())
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)).cast("long"))
    schema = arrow_schema(_RESULT)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "size", "source", "cluster", "salt")}
        order = np.lexsort((columns["salt"], columns["piece"], [-1 if d is None else d for d in columns["doc_id"]],
                            -np.array(columns["size"])))
        columns = {c: [v[i] for i in order] for c, v in columns.items() if c != "salt"}
        bins, offsets = best_fit(columns["size"], columns["source"], columns["cluster"], capacity)
        first = key[0].as_py() << 32
        return pa.table(columns | {"bin_id": [first + b for b in bins], "bin_start": offsets}, schema=schema)

    return dealt.groupBy("shard").applyInArrow(pack, _RESULT)


def op8(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
