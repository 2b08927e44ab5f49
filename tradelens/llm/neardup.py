"""Near-duplicate documents by SetSketch registers, with every link confirmed on full sets.

A document's set holds its distinct word shingles.  Register i of its sketch is the smallest of
exponentially distributed hashes of the set's elements, on a logarithmic scale and truncated to a
small whole number: ``floor(1 - log_b(min))``.  Sketches of unions merge by the larger register, and two
registers agree about as often as the sets overlap.

1. Documents with equal sets form a class, a node with a number of its own; doc_ids name no nodes.
2. The registers of a representative are cut into bands; equal bands put documents into one bucket.
   With ``rows`` registers a band and ``bands`` bands, a pair at similarity s meets in some bucket
   but for a chance of (1 - s**rows)**bands; :func:`banding` chooses both so that it is at most 3e-7 at the threshold.
3. Every member of a bucket is paired with the bucket's smallest node.  The joint likelihood of both
   sketches, with the exact set sizes, estimates the similarity; pairs far below the threshold go
   (``slack`` is four and a half standard deviations).  The others are confirmed on full sets.  Components follow.
4. Buckets that still hold several components are searched once more: block against block, their
   members' registers are compared, and the likely pairs across components are confirmed, but for those
   that other links of the same block connect already.  So a link is missed only where the first chance or
   an estimate that is off by over four and a half deviations strikes.

Hot groups: copies are one representative; near copies are linked to one member, not to each other; a
bucket's rows are joined with its minimum (a join whose skew Spark splits) and searched in blocks of
bounded size.  No links, components or sketches reach the driver.

Cases: A-Z are lower-cased, words are runs of anything but ASCII white space; a text with fewer words
than a shingle has its whole word sequence as its one element; null and empty texts and texts without
words have no set and are linked with nothing; long texts are read whole; repeated rows are copies of each
other; a row is known by its doc_id and the hash of its text, so texts that share a null or repeated
doc_id are told apart.  Of each component one row is kept: that of the smallest doc_id, then of the smallest
hash, and one of equal rows.  Rows with a null doc_id take part but never name a component: without others,
their component is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import arrow_schema, bitmap, bitmap_slot, in_bitmap, map_batches, spare, texts_of
from tradelens.llm.graph import components
from tradelens.session import cut_lineage

SHINGLE = 5
#: Registers of a sketch at most, and the chance at which a pair at the threshold may meet in no bucket.
REGISTERS = 192
MISS = 3e-7
#: Base and rate of the registers' scale, and their largest value.
BASE = 1.001
RATE = 20.0
TOP = 65_534
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(717)
_BYTE_VALUES = _rng.integers(0, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWERED = _BYTE_VALUES[_LOWER]
_ODD = int(_rng.integers(0, 2 ** 63, dtype=np.uint64)) * 2 + 1
_WORD_ODD = np.uint64(int(_rng.integers(0, 2 ** 63, dtype=np.uint64)) * 2 + 1)
_MULTIPLY = _rng.integers(0, 2 ** 31, 4096, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2 ** 32, 4096, np.uint32)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64 (tables grow by doubling)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _POWERS[:] = []
        for b in (_ODD, pow(_ODD, -1, 1 << 64)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(b, len(table), 1 << 64))])
            _POWERS.append(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's words."""
    data = np.frombuffer(text.encode(), np.uint8)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWERED[data] * power[:-1], out=sums[1:])
    words = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = out * _WORD_ODD + words[i:i + n]
    return np.unique(_mix(out + np.uint64(min(width, len(words)))))


def registers(elements: np.ndarray, m: int) -> np.ndarray:
    """The SetSketch registers of a set of 64-bit hashes (m values of 16 bits); empty sets have zeros."""
    if not len(elements):
        return np.zeros(m, np.uint16)
    low, high = (elements & np.uint64(0xFFFFFFFF)).astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    half = m // 2
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(elements), 256):  # pieces that stay in the processor's cache
        for part, own in ((low, slice(0, half)), (high, slice(half, m))):
            values = part[a:a + 256, None] * _MULTIPLY[own] + _ADD[own]
            np.minimum(least[own], values.min(axis=0), out=least[own])
    exponential = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _log_likelihood(j: np.ndarray, u: np.ndarray, above: np.ndarray, below: np.ndarray, m: int) -> np.ndarray:
    """Of similarity j, given the first set's share u of both sizes and how many of the m registers of its
    sketch are above and below those of the second."""
    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
    return above * np.log(more) + below * np.log(less) + (m - above - below) * np.log(np.clip(1 - more - less, 1e-12, 1))


def joint_estimate(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, m: int) -> np.ndarray:
    """The similarity of greatest likelihood of two sketches, given the set sizes."""
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = _log_likelihood(low + third, u, above, below, m) < _log_likelihood(high - third, u, above, below, m)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def reaches(cutoff: float, n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, m: int) -> np.ndarray:
    """Whether ``joint_estimate`` is at least the cutoff: the likelihood still rises there."""
    u = n_a / (n_a + n_b)
    step = 1e-6
    rises = (_log_likelihood(np.full(len(u), cutoff + step), u, above, below, m)
             >= _log_likelihood(np.full(len(u), cutoff), u, above, below, m))
    return rises & (np.minimum(u / (1 - u), (1 - u) / u) >= cutoff)


def slack(threshold: float, m: int) -> float:
    """Four and a half standard deviations of an estimate at the threshold (a chance of 3e-6)."""
    return 4.5 * float(np.sqrt(threshold * (1 - threshold) / m))


def banding(percent: int, m: int = REGISTERS, miss: float = MISS) -> tuple[int, int]:
    """Bands and registers a band: the longest bands that miss a pair at the threshold with a chance of ``miss`` at most."""
    for rows in range(m, 0, -1):
        if (1 - (percent / 100) ** rows) ** (m // rows) <= miss:
            return m // rows, rows
    return m, 1


def sketch_documents(docs: DataFrame, bands: int, rows: int, width: int = SHINGLE) -> DataFrame:
    """``doc_id, row, n_shingles, signature, sketch`` of ``doc_id, text, row``; equal sets have equal 128-bit signatures."""
    m = bands * rows

    def fn(batch: pa.RecordBatch) -> dict:
        sizes, signatures, sketches = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingle_set(text, width)
            sizes.append(len(found))
            both = np.array([found.sum(dtype=np.uint64), _mix(found * _WORD_ODD).sum(dtype=np.uint64)], np.uint64)
            signatures.append(both.tobytes())
            sketches.append(registers(found, m).tobytes())
        return {"doc_id": batch.column(0), "row": batch.column(2), "n_shingles": sizes, "signature": signatures, "sketch": sketches}

    return map_batches(docs, fn, "doc_id long, row long, n_shingles long, signature binary, sketch binary")


def _bucket_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """``id, bucket, band`` for each band of each representative."""
    width = 2 * rows  # bytes of a band
    parts = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(bands)])
    return reps.select("id", F.posexplode(parts).alias("band", "bucket"))


def _likely(pairs: DataFrame, reps: DataFrame, cutoff: float, m: int) -> DataFrame:
    """``a, b`` of the pairs whose estimated similarity reaches the cutoff."""
    side = reps.select("id", "n", "sketch")
    full = (pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
            .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"))

    def fn(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("sketch_a", "sketch_b"))
        n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        keep = reaches(cutoff, n_a, n_b, (x > y).sum(axis=1), (x < y).sum(axis=1), m)
        return {"a": batch.column("a").to_numpy()[keep], "b": batch.column("b").to_numpy()[keep]}

    return map_batches(full, fn, "a long, b long")


def _full_sets(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``id, elements`` of the ``nodes`` (``id, doc_id, row``); of equal rows one is read.

    A bitmap of fixed size drops most other texts before they are shuffled.
    """
    def sets(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "elements": [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]}

    # structs are equal where nulls in them meet; the join shares the shuffle of the aggregation
    place = F.struct("doc_id", "row").alias("place")
    slot = bitmap_slot("doc_id", "row")
    wanted = texts.where(in_bitmap(bitmap(nodes.select(slot.alias("slot"))), slot))
    found = wanted.groupBy(place).agg(F.first("text").alias("text")).join(nodes.select("id", place), "place")
    return map_batches(found.select("id", "text"), sets, "id long, elements binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    full = (pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b"))

    def check(batch: pa.RecordBatch) -> dict:
        keep = np.array([_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                         for x, y in zip(batch.column(2), batch.column(3))], bool)
        return {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    return map_batches(full, check, "a long, b long").distinct()


def _candidates(table: pa.Table, key: tuple, percent: int, cutoff: float, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the likely pairs of one block pair, across components.

    A pair that shares several buckets belongs to that of its first common band.
    """
    m = bands * rows
    ids, component, n, block = (table.column(c).to_numpy() for c in ("id", "component", "n", "block"))
    regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, m)
    x, y, band = (k.as_py() for k in key[1:])
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    earlier = regs[:, :band * rows].reshape(len(regs), band, rows)
    out_a, out_b = [], []
    for at in range(0, len(left), 16):
        part = left[at:at + 16]
        small, large = np.minimum(n[part][:, None], n[right]), np.maximum(n[part][:, None], n[right])
        fits = (component[part][:, None] != component[right]) & (100 * small >= percent * large)
        if x == y:
            fits &= ids[part][:, None] < ids[right]
        i, j = np.nonzero(fits)
        i, j = part[i], right[j]
        for b in range(band):
            new = ~(earlier[i, b] == earlier[j, b]).all(axis=1)
            i, j = i[new], j[new]
        if len(i):
            hit = reaches(cutoff, n[i].astype(float), n[j].astype(float), (regs[i] > regs[j]).sum(axis=1),
                          (regs[i] < regs[j]).sum(axis=1), m)
            out_a.append(i[hit])
            out_b.append(j[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


_PLACED = ["bucket", "x", "y", "band", "block", "id", "component", "n", "sketch"]


def _across(buckets: DataFrame, reps: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, cutoff: float,
            bands: int, rows: int) -> DataFrame:
    """Links ``a, b`` between different components within the buckets, enough to connect all that are linked.

    Members of a bucket meet in pairs of bounded blocks.  A first pass compares registers and keeps the members
    of likely pairs; the second has their full sets and confirms the pairs that confirmed links of
    its block have not connected yet.
    """
    own = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (own.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("c0"),
                                       F.max("component").alias("c1"))
             .where("c0 < c1").select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    placed = (own.join(mixed, "bucket")
              .withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
              .join(reps.select("id", "n", "sketch"), "id").select(*_PLACED))
    kinds = ("bucket long, x int, y int, band int, block int, id long, component long, n long, sketch binary")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = _candidates(table, key, percent, cutoff, bands, rows)
        return table.take(pa.array(np.union1d(i, j))).cast(arrow_schema(kinds))

    by = ["bucket", "x", "y", "band"]
    likely = cut_lineage(placed.groupBy(*by).applyInArrow(compare, kinds))

    def confirm(key: tuple, table: pa.Table) -> pa.Table:
        i, j = _candidates(table, key, percent, cutoff, bands, rows)
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        elements = [np.frombuffer(e.as_buffer(), np.uint64) for e in table.column("elements")]
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while c in above:
                c = above[c]
            return c

        links = []
        for p, q in zip(i.tolist(), j.tolist()):
            c, d = root(component[p]), root(component[q])
            if c != d and _linked(elements[p], elements[q], percent):
                above[c] = d
                links.append((ids[p], ids[q]))
        return pa.table({"a": [min(x) for x in links], "b": [max(x) for x in links]}, schema=arrow_schema("a long, b long"))

    return likely.join(sets, "id").groupBy(*by).applyInArrow(confirm, "a long, b long")


def _decided(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, n_shingles, class_id, component_id, kept`` of every row; ``row`` is the hash of its text."""
    bands, rows = banding(percent)
    m, threshold = bands * rows, percent / 100
    cutoff = threshold - slack(threshold, m)
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    sketched = cut_lineage(sketch_documents(texts, bands, rows, width).withColumn("number", F.monotonically_increasing_id()))
    first_row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "number")
    classes = (sketched.where("n_shingles > 0").groupBy("signature")
               .agg(F.min(F.struct(first_row.alias("at"), F.col("n_shingles").alias("n"), "sketch")).alias("r"))
               .select("signature", "r.*"))
    # numbered once, in the files that all later steps read
    reps = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    buckets = cut_lineage(_bucket_rows(reps, bands, rows))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("members")).where("members > 1")
    buckets = cut_lineage(buckets.join(shared.select("bucket", "a"), "bucket"))
    nodes = cut_lineage(reps.select("id", "at.doc_id", "at.row").join(buckets.select("id").distinct(), "id", "left_semi"))
    sets = cut_lineage(_full_sets(texts, nodes, width))
    stars = buckets.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = cut_lineage(_confirmed(_likely(stars, reps, cutoff, m), sets, percent))
    first = cut_lineage(components(links))
    more = _across(buckets.select("bucket", "band", "id"), reps, first, sets, percent, cutoff, bands, rows)
    joined = components(links.union(more))
    ids = cut_lineage(reps.select("signature", "id", "at").join(joined, "id", "left")
                      .select("signature", "at", F.coalesce("component", "id").alias("component")))
    heads = ids.groupBy("component").agg(F.min("at").alias("head"))
    ids = ids.join(heads, "component").select("signature", F.col("at.doc_id").alias("class_id"), "head")
    out = (sketched.select("doc_id", "row", "number", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("signature")).alias("signature"))
           .join(ids, "signature", "left"))
    alone = F.col("head").isNull()  # no set
    return out.select("doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
                      (alone | (F.col("number") == F.col("head.number"))).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` of every row.

    Documents are linked where ``100 * intersection >= percent * union``; ``class_id`` is the smallest
    doc_id with an equal set, ``component_id`` the smallest reachable by links.  One row of each component
    is kept, and every row without words.
    """
    return _decided(docs, percent, width, id_col, text_col).drop("row")


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: one row of each component, all columns unchanged.

    Rows without words stay; rows with a null or repeated doc_id are decided by their texts.
    """
    place, whole = (spare(docs, c) for c in ("_place", "_whole"))
    marks = _decided(docs, percent, SHINGLE, "doc_id", "text")
    kept = marks.where("kept and n_shingles > 0").select(F.struct("doc_id", "row").alias(place))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    words = text.rlike("[^\\x20\\x09-\\x0D]")
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("row"))
    # equal rows meet before the shuffle, which the join shares
    rows = (docs.where(words).groupBy(own.alias(place)).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(whole))
            .join(kept, place, "left_semi"))
    return rows.select(F.col(f"{whole}.*")).unionByName(docs.where(~words))


def op4(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, percent=85)
    # the contract's word for it is by doc_id, whatever the number of rows that share one
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
), elements as (
  select doc_id, len(s) as n, unnest(s) as x from sets
), links as (
  select a.doc_id as a, b.doc_id as b
  from elements a join elements b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges as (
  select a, b from links union all select b, a from links
), reach(doc_id, root) as (
  select doc_id, doc_id from sets union select edges.b, reach.root from reach join edges on edges.a = reach.doc_id
)
select sets.doc_id, len(any_value(s)) as n_shingles, min(root) as component_id, min(root) = sets.doc_id as kept
from sets join reach on reach.doc_id = sets.doc_id group by sets.doc_id
"""
