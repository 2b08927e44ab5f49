"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``2**ring_bits`` cells; a key (doc_id) hashes to
a cell and belongs to the first virtual node clockwise.  A shard holds at most its capacity: keys
that overflow a full shard continue clockwise to the next virtual node whose shard has room.

How it runs: one small aggregation counts the rows of each cell (at most ``2**ring_bits`` counts,
whatever the input), the ring walk turns these counts into intervals of ranks per cell, and every
row finds its interval by its rank in its cell.  The walk sees counts only, never rows.

Cases: null or repeated ids are keys like any other (rows that are equal in every respect are
interchangeable); a null text has size 0 plus the overhead; an empty table gives no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_OVERHEAD = 16


def ring_points(n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of every virtual node, in ring order.

    A shard's points do not depend on the number of shards, but for the rare point whose cell is
    taken: it moves to the next free cell.
    """
    cells = 1 << ring_bits
    if n_shards < 1 or n_shards * vnodes * 4 > cells:
        raise ValueError("a ring needs 1 shard or more and 4 cells for each virtual node; raise ring_bits")
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for replica in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            cell = int.from_bytes(digest, "big") >> (64 - ring_bits)
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def capacities(n_rows: int, n_shards: int, load_factor: float | None) -> list[int]:
    """Rows that each shard may hold.  ``None``: the tightest bound, counts at most one apart."""
    if load_factor is None:
        return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    if load_factor < 1:
        raise ValueError("load_factor must be 1 or more")
    return [-int(-load_factor * n_rows // n_shards)] * n_shards


def walk_ring(counts: dict[int, int], points: list[tuple[int, int]], caps: list[int],
              ring_bits: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals ``(cell, first_rank, end_rank, shard, first_slot)`` that cover all counted rows.

    First each shard takes the rows of its own arcs, in ring order, while it has room; then the
    rows left over continue clockwise, in ring order.  At most one more interval than there are
    cells per shard that fills up, so the list is bounded by the ring, not by the rows.
    """
    starts = [cell for cell, _ in points]
    room, used, plan, left = list(caps), [0] * len(caps), [], []

    def take(cell: int, first: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            plan.append((cell, first, first + got, shard, used[shard]))
            room[shard] -= got
            used[shard] += got
        return got

    at = 0
    for cell in sorted(counts):
        while at < len(starts) and starts[at] < cell:
            at += 1
        home = at % len(starts)
        got = take(cell, 0, counts[cell], points[home][1])
        if got < counts[cell]:
            left.append((cell, got, counts[cell], home))
    follow = list(range(len(points)))  # the next point clockwise that may have room

    def open_point(i: int) -> int:
        path = []
        while True:
            if room[points[i][1]]:
                break
            path.append(i)
            step = follow[i] if follow[i] != i else (i + 1) % len(points)
            i = step
            if len(path) > 2 * len(points):
                raise ValueError("the shards have less room than there are rows")
        for j in path:
            follow[j] = i
        return i

    for cell, first, end, home in left:
        i = home
        while first < end:
            i = open_point(i)
            first += take(cell, first, end - first, points[i][1])
    return plan


def ring_shards(docs: DataFrame, n_shards: int = 40, vnodes: int = 64, ring_bits: int = 16,
                load_factor: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, cell, home_shard, shard, slot``.

    ``slot`` numbers the rows of a shard from 0 without gaps.  ``home_shard`` owns the row's arc;
    it differs from ``shard`` where the row overflowed.
    """
    spark = docs.sparkSession
    position = F.xxhash64(docs[id_col].cast("long"))
    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(position, 64 - ring_bits).cast("int").alias("cell"),
        position.alias("_position"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # 2**ring_bits rows at most
    points = ring_points(n_shards, vnodes, ring_bits)
    plan = walk_ring(counts, points, capacities(sum(counts.values()), n_shards, load_factor), ring_bits)
    homes = _homes(points, counts)
    plan_df = spark.createDataFrame(
        [(c, a, b, s, o, homes[c]) for c, a, b, s, o in plan],
        "_cell int, _first long, _end long, shard int, _slot long, home_shard int")
    order = Window.partitionBy("cell").orderBy("_position", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    # the plan has at most 2**ring_bits + n_shards rows, so the broadcast is bounded by the parameters
    return (ranked.join(F.broadcast(plan_df), (F.col("cell") == F.col("_cell")) & (F.col("_rank") >= F.col("_first"))
                        & (F.col("_rank") < F.col("_end")))
            .select("doc_id", "size", "text_crc32", "cell", "home_shard", "shard",
                    (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot")))


def _homes(points: list[tuple[int, int]], cells) -> dict[int, int]:
    out, at = {}, 0
    for cell in sorted(cells):
        while at < len(points) and points[at][0] < cell:
            at += 1
        out[cell] = points[at % len(points)][1]
    return out


def op9(docs: DataFrame) -> DataFrame:
    """The query: 40 shards under the law ``rows``."""
    out = ring_shards(docs, n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard")
