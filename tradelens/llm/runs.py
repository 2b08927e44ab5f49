"""Periodic run detection: online dyadic square catching over the words of a document.

A run is a stretch of words with smallest period q (words q apart are the same), at least
``max(least, times * q)`` words long, that no neighbouring word extends keeping the period.

Words are appended one at a time.  Over every completed block of ``2**k`` words that starts at a multiple of its
length stands a catcher: it waits for the block to come back ``p`` words later, for the periods ``p`` of its
level, ``(2 b - 1) / (times - 1) <= p < (4 b - 1) / (times - 1)`` with ``b = 2**k``.  The levels share out all
periods, and at most one catcher of a level listens at any word.  Where the appended word is the last of such a block,
the last ``p`` words are compared with the ``p`` words before them: by one word, by prefix hashes, then word by word.  If
they are equal, a square ends here.  It becomes an open run of period ``p``, extended to the left once and by
every further word that keeps the period; the first word that does not closes it.

Why nothing is missed: a run of period q and ``times * q`` words has, among its first ``(times - 1) * q`` words, a
whole block of the level of q whose copy ends behind its first ``2 q`` words (``times >= 3``).  Squares of a multiple of
the period of an open run that covers them are that run and are left out.  At most a logarithm of runs of
exponent 2 and more with different smallest periods end at one word, so appending a word takes logarithmic time.

Cases: words are ``[^\\x20\\x09-\\x0D]+``, compared as they are; null, empty and blank texts have no words and no runs;
long texts are taken whole (memory grows with the one text in hand); repeated rows give equal results; an empty
table gives no rows; null doc_ids are kept; other columns are not read (``collapse_documents`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import texts_of

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
LEAST = 6
TIMES = 4

Run = tuple[int, int, int]  # start, length, period

_MODULUS = (1 << 61) - 1
_BASE = 0x5DEECE66D1234567 % _MODULUS


class RunCatcher:
    """Finds the runs of a sequence of hashable items, read item by item."""

    def __init__(self, least: int = LEAST, times: int = TIMES):
        if times < 3:
            raise ValueError("catchers over single blocks need runs of three periods or more")
        self.least, self.times = least, times
        self.items: list = []
        self.prefix = [0]  # polynomial hash of the first i items, as far as it was needed
        self.powers = [1]
        self.open: dict[int, int] = {}  # period -> start of the run that is being extended
        self.found: list[Run] = []
        self.levels: list[tuple[int, int]] = []  # of blocks of 2**k items: smallest period, number of further periods
        #: last item of a block -> its catchers: the first and the last place that they listen at, and the block's end
        self.waiting: dict[object, list[tuple[int, int, int]]] = {}

    def _level(self, b: int) -> tuple[int, int]:
        """The periods that a catcher over ``b`` items answers for."""
        low, high = -(-(2 * b - 1) // (self.times - 1)), -(-(4 * b - 1) // (self.times - 1)) - 1
        return low, high - low

    def extend(self, items) -> None:
        """Appends items one after the other."""
        t, open_runs, waiting, levels = self.items, self.open, self.waiting, self.levels
        n = len(t)
        for item in items:
            t.append(item)
            if open_runs:
                ended = [p for p in open_runs if t[n - p] != item]
                if ended:
                    self._close(ended, n)
            catchers = waiting.get(item)
            if catchers:  # the item may end a copy of their blocks
                late = False
                for first, last, end in reversed(catchers):
                    if first <= n <= last:
                        p = n - end
                        if p < 2 or t[n - 1] == t[end - 1]:
                            self._compare(n, p)
                    late |= last <= n
                if late:
                    catchers[:] = [c for c in catchers if c[1] > n]
            n += 1
            b, k = 1, 0
            while not n & (b - 1) and b <= n:  # the blocks that this item completes
                if k == len(levels):
                    levels.append(self._level(b))
                low, more = levels[k]
                if more >= 0:
                    waiting.setdefault(item, []).append((n - 1 + low, n - 1 + low + more, n - 1))
                b, k = 2 * b, k + 1

    def _hash(self, first: int, end: int) -> int:
        """Hash of the items from ``first`` up to ``end``."""
        t, prefix, powers = self.items, self.prefix, self.powers
        for i in range(len(prefix) - 1, end):
            prefix.append((prefix[i] * _BASE + hash(t[i])) % _MODULUS)
        while len(powers) <= end - first:
            powers.append(powers[-1] * _BASE % _MODULUS)
        return (prefix[end] - prefix[first] * powers[end - first]) % _MODULUS

    def _compare(self, n: int, p: int) -> None:
        """Opens a run if a square of period ``p`` ends at item ``n``."""
        first = n + 1 - 2 * p
        if first < 0 or p in self.open:
            return
        if any(p % q == 0 and start <= first for q, start in self.open.items()):
            return  # a multiple of an open run's period
        t, middle = self.items, first + p
        if self._hash(middle, n + 1) != self._hash(first, middle) or t[middle:n + 1] != t[first:middle]:
            return
        step = 1
        while first:  # to the left by growing steps, then item by item
            step = min(step, first)
            if t[first - step:first] == t[first - step + p:first + p]:
                first -= step
                step *= 2
            elif step == 1:
                break
            else:
                step //= 2
        self.open[p] = first

    def _close(self, ended: list[int], n: int) -> None:
        runs = []
        for p in sorted(ended):
            start = self.open.pop(p)
            # equal stretches of a multiple of the period are the same run
            if n - start >= max(self.least, self.times * p) and not any(p % q == 0 and s == start for s, _, q in runs):
                runs.append((start, n - start, p))
        self.found += runs

    def runs(self) -> list[Run]:
        """All runs of what was appended, by start, then period.  Runs that reach the end count; more may be appended."""
        going, known = dict(self.open), len(self.found)
        self._close(list(self.open), len(self.items))
        out = sorted(self.found, key=lambda r: (r[0], r[2]))
        self.open.update(going)
        del self.found[known:]
        return out


def find_runs(items, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs of a whole sequence, by start, then period."""
    catcher = RunCatcher(least, times)
    catcher.extend(items)
    return catcher.runs()


def collapsed(items: list, runs: list[Run]) -> list:
    """The items that no run holds after its first period."""
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > at:
            out += items[at:max(at, a)]
            at = b
    return out + items[at:]


def document_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, collapsed``: the runs of every document (by
    start, then period) and its words outside their repetitions, joined by one space."""
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, rest = [], [], []
            for text in batch.column(1).to_pylist():
                words = WORDS.findall(text)
                found = find_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
                rest.append(" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return texts_of(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse_documents(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents with repetitions inside runs taken out; texts without runs, and all other columns but
    ``n_chars``, stay as they are."""
    place = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                words = WORDS.findall(text or "")
                found = find_runs(words, least, times)
                texts.append(" ".join(collapsed(words, found)) if found else text)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def repeated_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the query: a tenth of the documents, told by the hash of their doc_id, gets a periodic end.

    Documents without words or with a null doc_id stay as they are.
    """
    rows = texts_of(docs)
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumn("_g", F.floor(h / 10).cast("long")).withColumn(
        "_words", F.when(h % 10 == 0, words))
    n = F.size("_words").cast("long")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rows = rows.withColumn("_p", F.lit(1) + F.call_function("div", n - F.col("_a"), 3 + F.col("_g") % 8))

    def word(i: Column) -> Column:
        back = F.col("_a") + (i - F.col("_a")) % F.col("_p")
        return F.get("_words", F.when(i < F.col("_a"), i).otherwise(back).cast("int"))

    edited = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    out = document_runs(repeated_texts(docs))

    def better(x: Column, y: Column) -> Column:
        """Greatest exponent first, then smallest start, then period; products of word numbers fit a long."""
        gap = y["length"] * x["period"] - x["length"] * y["period"]
        gap = F.when(gap != 0, gap).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
        return F.signum(gap).cast("int")

    best = F.get(F.array_sort("runs", better), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return (out.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
                    F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
                    F.call_function("div", F.col("_best.length") * 1000, F.col("_best.period")).alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
