"""Phrase collocation mining by SETM: sorted occurrence relations, merge-joins, group counts, semi-joins.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``.
Relation R1 holds an occurrence of every word, sorted by piece and position; Rk those of phrases of k words.  Both are
one number, the ``place``: it grows by one from word to word of a piece and by two or more from piece to piece.

1. Group counts: occurrences of each phrase, added up in the tasks and then by Spark; groups under ``least`` go.
2. Semi-join: occurrences of the groups that are left stay in the relation, which is written again, as long as they
   have a neighbour to be joined with.
3. Merge-join: an occurrence of k words meets one at the next position of the same piece (``place + 1``); both
   make an occurrence of k + 1 words.  Then 1. again.

How it runs: a row of a stored relation holds the occurrences of one text in order, as a line of words for each stretch of
occurrences at neighbouring places (phrases of such a line overlap but for a word).  So the relation is never larger
than the texts, merge-joins stay within a row and nothing is shuffled for them; tasks take rows of some MB at once
and join them as arrays of places.  Only counted groups are shuffled, combined before.  The semi-join goes through a bitmap of the groups' hashes, whose size is bounded
(``MAX_BITS``) and checked; a hash that meets another one lets occurrences through that the next group count drops
exactly, so it costs time but changes no result.  Group counts are exact and kept as strings, not as hashes.

Scoring and pruning are joins of the counted groups with themselves.

Cases: null languages are ``und``; null and empty texts have no words; long texts and pieces are taken whole; repeated
rows count each time; an empty table gives no rows; other columns, also of clashing names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.llm.common import delete_folder
from tradelens.session import cut_lineage, shared_folder

LEAST = 30
LONGEST = 4
#: Bytes of text that a task takes at once (one longer text is taken whole).
BLOCK_BYTES = 1 << 21
#: Rows of a batch that goes back to Spark (larger ones pile up outside its heap).
BATCH_ROWS = 4096
#: Bits of the bitmap of the semi-join for each group, and its bounds (16 MB at most).
GROUP_BITS, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 27

_BREAK, _GAP = 0x0A, 0x20
_FOLD = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + b".,;:!?\x0b\x0c\x0d\x09",
                        bytes(range(ord("a"), ord("z") + 1)) + bytes([_BREAK] * 9 + [_GAP]))
_SEED = 42  # of Spark's xxhash64

RELATION = "lang string, text string"
_ARROW_RELATION = pa.schema([("lang", pa.string()), ("text", pa.string())])
GROUPS = "lang string, phrase string, a long"


class Occurrences:
    """The words of some texts, sorted by text and place.

    ``place`` tells the pieces of all texts apart; ``word`` are indices of ``vocabulary``.
    """

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        data = b"\n".join(texts).translate(_FOLD)
        code = np.frombuffer(data, np.uint8)
        breaks = code == _BREAK
        inside = ~breaks & (code != _GAP)
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(end - first, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(code[inside].tobytes()))
        named = words.dictionary_encode()
        self.vocabulary = named.dictionary.cast(pa.string())
        self.word = named.indices.to_numpy(zero_copy_only=False)
        self.place = np.arange(len(first)) + np.searchsorted(np.flatnonzero(breaks), first)  # a break before a word adds one
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")

    def merge_join(self, start: np.ndarray) -> np.ndarray:
        """For each occurrence but the last, whether the next one is at the next position of the same piece.

        Places are sorted, so the partner of an occurrence is the one behind it or there is none.
        """
        at = self.place[start]
        return at[1:] == at[:-1] + 1

    def starts(self, k: int) -> np.ndarray:
        """Where the phrases of k words start: k - 1 merge-joins, each of the last relation with itself."""
        start = np.arange(len(self.word))
        for _ in range(k - 1):
            start = start[:-1][self.merge_join(start)] if len(start) else start
        return start

    def groups(self, start: np.ndarray, k: int) -> tuple[pa.StringArray, np.ndarray]:
        """The distinct phrases of k words at ``start``, and which of them each start has."""
        named = pa.array(self.word[start]).dictionary_encode()
        phrases = self.vocabulary.take(named.dictionary)
        group = named.indices.to_numpy(zero_copy_only=False)
        for i in range(1, k):
            named = pa.array(group.astype(np.int64) * len(self.vocabulary) + self.word[start + i]).dictionary_encode()
            before, last = np.divmod(named.dictionary.to_numpy(zero_copy_only=False), max(1, len(self.vocabulary)))
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(before)), self.vocabulary.take(pa.array(last)), " ")
            group = named.indices.to_numpy(zero_copy_only=False)
        return phrases, group

    def counted(self, start: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        phrases, group = self.groups(start, k)
        yield from _groups(self.lang, phrases, np.bincount(group, minlength=len(phrases)))

    def semi_join(self, start: np.ndarray, k: int, bits: np.ndarray) -> pa.RecordBatch | None:
        """Rows with the occurrences of the groups in the bitmap, but for those without a neighbour."""
        phrases, group = self.groups(start, k)
        seed, digest = xxhash.xxh64_intdigest(self.lang.encode(), _SEED), xxhash.xxh64_intdigest
        slots = np.fromiter((digest(p, seed) for p in phrases.cast(pa.binary()).to_pylist()), np.uint64, len(phrases)) & np.uint64(64 * len(bits) - 1)
        known = bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)
        start = start[known[group].astype(bool)]
        joined = self.merge_join(start)
        if not joined.any():
            return None
        edge = np.diff(joined.view(np.int8), prepend=np.int8(0), append=np.int8(0))  # stretches of neighbours
        first, last = start[np.flatnonzero(edge == 1)], start[np.flatnonzero(edge == -1)]
        return self._rows(first, last - first + k)

    def _rows(self, first: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        """A row for each text with the stretches of words that begin at ``first``, as lines."""
        ends = np.cumsum(length)
        words = np.arange(ends[-1]) + np.repeat(first - ends + length, length)
        gap = np.full(len(words), " ")
        gap[ends - 1] = "\n"
        lines = pc.binary_join_element_wise(self.vocabulary.take(pa.array(self.word[words])), pa.array(gap), "")
        data, place = lines.buffers()[2], np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1)
        texts, begins = np.unique(self.text[words], return_index=True)
        offsets = np.append(place[begins], place[len(lines)]).astype(np.int32)
        rows = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), data)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(texts), pa.string()), rows], schema=_ARROW_RELATION)


def _groups(lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), BATCH_ROWS):
        part = phrases.slice(i, BATCH_ROWS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part), pa.string()), "phrase": part,
                                          "a": pa.array(counts[i:i + BATCH_ROWS].astype(np.int64))})


def _blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring rows whose sizes add up to about ``most``."""
    if len(sizes):
        block = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Occurrences]:
    """The occurrences in ``lang, text`` batches, of texts or of a stored relation."""
    for batch in batches:
        named, sizes = batch.column(0).dictionary_encode(), pc.binary_length(batch.column(1))
        code, sizes = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (named.indices, sizes))
        for i, lang in enumerate(named.dictionary.to_pylist()):
            own = np.flatnonzero(code == i)
            for part in _blocks(sizes[own], BLOCK_BYTES):
                yield Occurrences(lang, batch.column(1).take(pa.array(own[part])).cast(pa.binary()).to_pylist())
        pa.default_memory_pool().release_unused()


def _count(partial: DataFrame, least: int) -> DataFrame:
    return cut_lineage(partial.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
                       .where(F.col("phrase").isNull() | (F.col("a") >= least)))


def _bitmap(groups: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``lang, phrase``: at most ``MAX_BITS``, whatever the number of groups."""
    n = groups.count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (n * GROUP_BITS).bit_length()))
    slot = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = groups.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(one).alias("bits")).collect()  # MAX_BITS / 64 at most
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r.i] = r.bits
    return out.view(np.uint64)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang",
                  text_col: str = "text") -> DataFrame:
    """``lang, phrase, k, a``: all phrases of up to ``longest`` words with at least ``least`` occurrences, and per
    language one row with a null phrase, k = 0 and the number of words as ``a``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    folder = f"{shared_folder(spark)}/occurrences-{uuid.uuid4().hex}"

    def counted(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                yield from r.counted(r.starts(k), k)
                if k == 1:
                    yield from _groups(r.lang, pa.nulls(1, pa.string()), np.array([len(r.word)]))
        return run

    def kept(k: int, bits):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                left = r.semi_join(r.starts(k), k, bits.value)
                if left is not None:
                    yield left
        return run

    relation = texts
    counts = _count(relation.mapInArrow(counted(1), GROUPS), least)
    out = counts.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(1).alias("k"), "a")
    for k in range(2, longest + 1):
        bits = spark.sparkContext.broadcast(_bitmap(counts.where("phrase is not null")))
        relation.mapInArrow(kept(k - 1, bits), RELATION).write.parquet(f"{folder}/r{k - 1}")
        relation = spark.read.schema(RELATION).parquet(f"{folder}/r{k - 1}")
        counts = _count(relation.mapInArrow(counted(k), GROUPS), least)
        out = out.unionByName(counts.select("lang", "phrase", F.lit(k).alias("k"), "a"))
    delete_folder(spark, folder)
    return out


def _part(words: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def scored_phrases(counts: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of every phrase of two words or more: the lowest score over its cuts.

    The score is ``floor(2000000 a / (l + r))`` in decimals of 38 digits; of equal scores the earliest cut counts.
    """
    known = counts.where("k > 0").select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "k", "a", "cut", _part(words, F.lit(1), F.col("cut")).alias("_left"),
        _part(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"))
    left = known.select(F.col("lang").alias("_ll"), F.col("phrase").alias("_left"), F.col("a").alias("l"))
    right = known.select(F.col("lang").alias("_rl"), F.col("phrase").alias("_right"), F.col("a").alias("r"))
    both = (cuts.join(left, (F.col("lang") == F.col("_ll")) & (cuts["_left"] == left["_left"]))
            .join(right, (F.col("lang") == F.col("_rl")) & (cuts["_right"] == right["_right"])))
    wide = "decimal(20,0)"
    score = F.call_function("div", F.col("a").cast(wide) * F.lit(2000000).cast("decimal(7,0)"), F.col("l").cast(wide) + F.col("r").cast(wide))
    return (both.select("lang", "phrase", "k", "a", F.struct(score.cast("long").alias("score"), "cut", "l", "r").alias("s"))
            .groupBy("lang", "phrase", "k", "a").agg(F.min("s").alias("s"))
            .select("lang", "phrase", "k", "a", "s.l", "s.r", "s.score"))


def contained(counts: DataFrame, percent: int = 80) -> DataFrame:
    """``lang, phrase`` of the phrases whose words lie together in a longer phrase with at least ``percent`` of
    their occurrences."""
    words, wide = F.split("phrase", " "), "decimal(38,0)"
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    inner = (counts.where("k > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    return (counts.where("k > 1").join(inner, ["lang", "phrase"])
            .where(F.col("longer").cast(wide) * 100 >= F.col("a").cast(wide) * percent).select("lang", "phrase"))


def mine_phrases(docs: DataFrame, top: int | None = None, least: int = LEAST, longest: int = LONGEST, percent: int = 80,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases that no longer one stands for, the first ``top`` of each
    language by score, then occurrences (both descending), then the phrase's bytes."""
    counts = phrase_counts(docs, least, longest, lang_col, text_col)
    totals = counts.where("k = 0").select("lang", F.col("a").alias("n"))
    left = scored_phrases(counts).join(contained(counts, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)  # cut in every task before the rows of a language meet
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return mine_phrases(docs, top=2000)


ORACLE_SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), pieces as (
  select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from texts
), starts as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), grams as (
  select lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase, k, count(*) as a
  from starts, (select unnest([1, 2, 3, 4]) as k) ks
  where i + k - 1 <= len(w) group by all
), totals as (
  select lang, sum(a)::bigint as n from grams where k = 1 group by lang
), often as (
  select lang, phrase, k, a, string_split(phrase, ' ') as w from grams where a >= 30
), cuts as (
  select lang, phrase, k, a, w, unnest(range(1, k)) as cut from often where k > 1
), scored as (
  select c.lang, c.phrase, c.k, c.a, x.a as l, y.a as r, c.cut,
         ((2000000::hugeint * c.a) // (x.a::hugeint + y.a))::bigint as score
  from cuts c
  join often x on x.lang = c.lang and x.phrase = list_aggregate(c.w[1:c.cut], 'string_agg', ' ')
  join often y on y.lang = c.lang and y.phrase = list_aggregate(c.w[c.cut + 1:], 'string_agg', ' ')
), best as (
  select *, row_number() over (partition by lang, phrase order by score, cut) as place from scored
), inner_of as (
  select lang, phrase as longer, a, w, k, unnest(range(2, k)) as m from often where k > 2
), spans as (
  select lang, a, w, m, unnest(range(1, k - m + 2)) as i from inner_of
), covers as (
  select lang, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') as phrase, max(a) as longer from spans group by all
), kept as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score from best b left join covers c on c.lang = b.lang and c.phrase = b.phrase
  where place = 1 and (c.longer is null or 100::hugeint * c.longer < 80::hugeint * b.a)
), ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, score from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
