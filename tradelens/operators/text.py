"""Text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.session import cut_lineage

# Letters and digits of any script; everything else separates words.
WORD_PATTERN = r"[\p{L}\p{N}]+"


def _words(df: DataFrame, text: str, stopwords: Sequence[str], min_length: int, pattern: str) -> DataFrame:
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 0)).alias("word"))
    if min_length > 1:
        words = words.filter(F.length("word") >= min_length)
    if stopwords:
        words = words.filter(~F.col("word").isin(list(stopwords)))
    return words


def term_frequency(df: DataFrame, text: str, top: int | None = None, stopwords: Sequence[str] = (),
                   min_length: int = 1, pattern: str = WORD_PATTERN) -> DataFrame:
    """Lower-cased word counts over whole texts (the data a word cloud draws).

    Words are extracted per row, exploded and counted with a map-side partial
    aggregation; nothing is concatenated.  Every word counts, unless a caller asks for longer ones (``min_length``).  ``top`` keeps the most frequent words
    (ties by word) through a distributed top-k.
    """
    words = _words(df, text, stopwords, min_length, pattern)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    if top is not None:
        counts = counts.orderBy(F.desc("count"), F.asc("word")).limit(top)
    return counts


def top_terms(df: DataFrame, text: str, top: int, stopwords: Sequence[str] = (), min_length: int = 1,
              pattern: str = WORD_PATTERN, classes: int = 1 << 16) -> DataFrame:
    """The ``top`` most frequent words with their counts (ties by word): the first rows of :func:`term_frequency`, without
    counting every word.

    1. Words are counted by a hash of ``classes`` classes: a summary of bounded size, added up from the tasks.
    2. The words of the fullest classes are counted.  The ``top``-th largest of these counts is a floor: no word below it
       can be among the first.
    3. A word has no more occurrences than its class, so all words above the floor lie in classes that reach it.  The
       words of these classes are counted: the result is exact and complete.  If step 2 found fewer words than asked
       for, the floor is 0 and all classes are counted.

    Only words of the chosen classes are shuffled; the texts are read three times.
    """
    words = _words(df, text, stopwords, min_length, pattern).withColumn("_class", F.pmod(F.xxhash64("word"), F.lit(classes)))
    sizes = cut_lineage(words.groupBy("_class").agg(F.count(F.lit(1)).alias("_size")))
    fullest = sizes.orderBy(F.desc("_size"), "_class").limit(4 * top)
    first = words.join(fullest, "_class", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    first = first.orderBy(F.desc("count"), "word").limit(top)
    floor = first.agg(F.when(F.count(F.lit(1)) == top, F.min("count")).otherwise(F.lit(0))).scalar()
    counts = (words.join(sizes.filter(F.col("_size") >= floor), "_class", "left_semi")
              .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(top)
