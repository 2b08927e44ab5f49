"""Document fingerprints from prefix polynomial hashes.

``H[i]`` is the sum of ``(c[j] + 1) * B**j`` over the first i code points, modulo the prime 2**31 - 1.
With the array ``H`` the hash of any span follows from two entries, so spans are compared without
reading them, and the longest common extension of two positions is found by binary search.  The array
of an edited text is spliced from the arrays of its parts.

A fingerprint is ``length-hash-sketch``: two whole-text hashes with different bases, and the smallest
window hash of each of ``BINS`` classes.  Windows are the spans of ``WINDOW`` code points (the whole
text, if shorter).  The likeness of two fingerprints is the share of classes with equal minima, an
estimate of the Jaccard similarity of the texts' windows; it is 1 for equal fingerprints only.

How it runs: documents are dealt to ranges of doc_id (cut at approximate quantiles; the first document
of each range is copied to the range above), sorted there, and read in descending order, so every
document meets the next one.  The whole texts are shuffled once.

Cases: null texts are empty; the fingerprint of the empty text is likened 1 to itself and 0 to others; ties
of doc_id are ordered by text; null ids come last; a single document is its own next one; texts are
read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import arrow_schema, texts_of

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 48_271)
WINDOW = 20
BINS = 64
NO_VALUE = "____"
_EDGES = (np.arange(BINS, dtype=np.uint64) << 26).astype(np.uint32)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // PRIME) * np.uint64(PRIME)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse (tables grow by doubling)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        tables = []
        for b in (base, pow(base, -1, PRIME)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, _mod(table * np.uint64(pow(b, len(table), PRIME)))])
            tables.append(table)
        have = _POWERS[base] = (tables[0], tables[1])
    return have[0][:n], have[1][:n]


class PrefixHashes:
    """Prefix arrays of one text for every base."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        out = []
        for base in BASES:
            h = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_mod(codes * powers(base, len(codes))[0]), out=h[1:])
            out.append(_mod(h))
        return cls(out)

    def __len__(self) -> int:
        return len(self.arrays[0]) - 1

    def spliced(self, kept: int, tail: PrefixHashes, taken: int) -> PrefixHashes:
        """The arrays of the first ``kept`` code points followed by the first ``taken`` of ``tail``."""
        out = []
        for base, a, b in zip(BASES, self.arrays, tail.arrays):
            shift = np.uint64(pow(base, kept, PRIME))
            out.append(np.concatenate([a[:kept + 1], _mod(a[kept] + _mod(b[1:taken + 1] * shift))]))
        return PrefixHashes(out)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of a span, the same wherever the span lies."""
        return tuple((int(h[end]) + PRIME - int(h[start])) * pow(base, -start, PRIME) % PRIME
                     for base, h in zip(BASES, self.arrays))

    def whole(self) -> tuple[int, ...]:
        return tuple(int(h[-1]) for h in self.arrays)

    def windows(self, width: int) -> np.ndarray:
        """The first base's hashes of all spans of a width, or of the whole text if it is shorter."""
        n = len(self)
        if n <= width:
            return self.arrays[0][-1:] if n else self.arrays[0][:0]
        h = self.arrays[0]
        return _mod(_mod(h[width:] + np.uint64(PRIME) - h[:-width]) * powers(BASES[0], n - width + 1)[1])


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The length of the longest common extension of position i of one text and j of another."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        half = (low + high + 1) // 2
        if a.span(i, i + half) == b.span(j, j + half):
            low = half
        else:
            high = half - 1
    return low


def common_prefix(a: PrefixHashes, b: PrefixHashes) -> int:
    """``common_extension`` of both beginnings, where prefix entries are compared as they are."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if all(x[half] == y[half] for x, y in zip(a.arrays, b.arrays)):
            low = half
        else:
            high = half - 1
    return low


def sketch(windows: np.ndarray) -> list[str]:
    """The minima of the window hashes in each class, as 16 bits each."""
    mixed = np.sort(((windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32))
    at = np.searchsorted(mixed, _EDGES)
    ends = np.append(at[1:], len(mixed))
    least = mixed[np.minimum(at, max(len(mixed) - 1, 0))] if len(mixed) else np.zeros(BINS, np.uint32)
    short = ((least.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).tolist()
    return [f"{v:04x}" if full else NO_VALUE for v, full in zip(short, (ends > at).tolist())]


def fingerprint(h: PrefixHashes) -> str:
    return f"{len(h):x}-{''.join(f'{x:08x}' for x in h.whole())}-{''.join(sketch(h.windows(WINDOW)))}"


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = a.rpartition("-")[2], b.rpartition("-")[2]
    pairs = [(x[i:i + 4], y[i:i + 4]) for i in range(0, 4 * BINS, 4)]
    used = [p for p in pairs if p != (NO_VALUE, NO_VALUE)]
    same = sum(p == q for p, q in used)
    return min(same / len(used), 1 - 0.5 / BINS) if used else 0.0


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, next_doc_id long, same_prefix long")


def neighbours_in_order(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (doc_id, text) dealt to ranges of doc_id and sorted, with ``_range`` and ``_copy``.

    Within a range, rows come in descending doc_id; copies of the next range's first row follow them.
    """
    ids = rows.select(F.col("doc_id").cast("double").alias("_d"), "doc_id")
    cuts = ids.approxQuantile("_d", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = [-float("inf"), *sorted(set(cuts)), float("inf")]

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("_d", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
        if len(cuts) == 2:
            return df.withColumn("_range", F.lit(0)).drop("_d")
        return (Bucketizer(splits=cuts, inputCol="_d", outputCol="_r").transform(df)
                .withColumn("_range", F.col("_r").cast("int")).drop("_d", "_r"))

    # at most ``ranges`` rows: the first document of each range
    heads = sorted(((r["_range"], r["head"]) for r in dealt(rows.select("doc_id")).groupBy("_range")
                    .agg(F.max("doc_id").alias("head")).collect()), key=lambda x: x[0])
    places = [r for r, _ in heads]
    above = [(r, head, places[(i + 1) % len(places)]) for i, (r, head) in enumerate(heads)]
    plan = rows.sparkSession.createDataFrame(above, "_range int, _head long, _above int")
    out = dealt(rows).join(F.broadcast(plan), "_range")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("_head")),
                    F.array(F.struct(F.col("_range"), F.lit(False).alias("_copy")),
                            F.struct(F.col("_above").alias("_range"), F.lit(True).alias("_copy")))
                    ).otherwise(F.array(F.struct(F.col("_range"), F.lit(False).alias("_copy"))))
    out = out.select("doc_id", "text", F.explode(copies).alias("_at")).select("doc_id", "text", "_at.*")
    return (out.repartitionById(ranges, F.col("_range"))  # a partition for each range
            .sortWithinPartitions("_range", "_copy", F.col("doc_id").desc_nulls_last(), "text"))


def document_fingerprints(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """One row per document: see ``_RESULT``.  ``same_prefix`` is the longest common prefix of the text
    and its edited form, by binary search in their prefix arrays."""
    rows = texts_of(docs, id_col, text_col)
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the document whose next one has not come yet
        for batch in batches:
            out = []
            for doc_id, text, place, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_copy"))):
                if copy and (last is None or last[0] != place):
                    continue  # a further copy, of an id that occurs again
                h = PrefixHashes.of(text)
                own = fingerprint(h)
                if last is not None and last[0] == place:
                    out.append(compared(*last[1:], doc_id, text, h, own))
                last = None if copy else (place, doc_id, text, h, own)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))), schema=schema)

    return neighbours_in_order(rows, ranges).mapInArrow(run, _RESULT)


def compared(doc_id, text: str, h: PrefixHashes, own: str, next_id, next_text: str, next_h: PrefixHashes,
             next_print: str) -> tuple:
    cut = len(text) // 3
    taken = min(cut, len(next_text))
    edited = text[:len(text) - cut] + next_text[:taken]
    edited_h = h.spliced(len(text) - cut, next_h, taken)
    edited_print = fingerprint(edited_h)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, edited_print,
            likeness(own, edited_print), likeness(own, next_print), next_id, common_prefix(h, edited_h))


def op3(docs: DataFrame) -> DataFrame:
    return document_fingerprints(docs)
