"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram binds its letters: each letter's vector is
rotated by its place in the n-gram and the vectors are multiplied.  A text bundles (adds) the vectors
of its n-grams, a language prototype bundles all texts of the language, and a text is given to the
prototype with the largest cosine.  All sums are whole numbers, so prototypes do not depend on the
order of the rows.

How it runs: learning counts n-grams per language within each partition, few texts at once, turns the
counts into one vector per language and partition, and adds these up in two levels; prediction is one pass over the
texts.  Prototypes are one vector per language; ``max_languages`` checks that bound before they are
sent out.

Cases: letters are what Unicode calls alphabetic, in lower case; anything else separates.  Null texts
and texts without letters are ``und`` with score 0; so is everything if nothing can be learned from.
Texts are read whole; ties go to the first language by name; negative cosines score 0; a null doc_id
counts as the empty text for the fold; repeated rows count as often as they occur; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import arrow_schema, spare

DIM = 1024
NGRAM = 3
SEED = 20240229
UNDETERMINED = "und"
_GRAMS_AT_ONCE = 1024
_DOCS_AT_ONCE = 256
_BYTES_AT_ONCE = 1 << 20
_GRAMS_HELD = 1 << 17
_SUMS = "lang string, bundle binary"
_STATE: dict[str, np.ndarray | dict] = {}


def letter_classes() -> np.ndarray:
    """For each code point whether it is a letter."""
    if "letters" not in _STATE:
        _STATE["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _STATE["letters"]


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The +1/-1 vector of a letter, drawn from the letter alone, so every worker has the same."""
    known = _STATE.setdefault(f"vectors{dim}", {})
    if code not in known:
        if len(known) > 20_000:
            known.clear()
        known[code] = np.random.default_rng([SEED, code]).integers(0, 2, dim).astype(np.float32) * 2 - 1
    return known[code]


def ngrams(text: str) -> np.ndarray:
    """Codes of the text's n-grams over letters and single separators, one for each occurrence."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letter_classes()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    line = np.full(len(codes) + 2, 32, np.int64)
    line[1:-1] = np.where(letter, codes, 32)
    line = line[np.r_[True, (line[1:] != 32) | (line[:-1] != 32)]]
    return (line[:-2] << 42) | (line[1:-1] << 21) | line[2:]


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bound vector of every n-gram: rotated letter vectors, multiplied."""
    out = np.ones((len(grams), dim), np.float32)
    for place in range(NGRAM):
        codes = (grams >> (21 * place)) & 0x1FFFFF
        distinct, where = np.unique(codes, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c), dim), place) for c in distinct])[where]
    return out


def bundle(counts: list[tuple[np.ndarray, np.ndarray]], dim: int = DIM) -> np.ndarray:
    """One row per text: the sum of its n-gram vectors, from (grams, counts) of each text."""
    total = np.zeros((len(counts), dim))
    if not sum(len(g) for g, _ in counts):
        return total
    grams, column = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    row = np.repeat(np.arange(len(counts)), [len(g) for g, _ in counts])
    times = np.concatenate([n for _, n in counts])
    for a in range(0, len(grams), _GRAMS_AT_ONCE):
        part = (column >= a) & (column < a + _GRAMS_AT_ONCE)
        table = np.zeros((len(counts), min(_GRAMS_AT_ONCE, len(grams) - a)), np.float32)
        table[row[part], column[part] - a] = times[part]
        total += table @ gram_vectors(grams[a:a + _GRAMS_AT_ONCE], dim)
    return total


def _sum_bundles(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("bundle"))
    return pa.table({"lang": [key[0].as_py()], "bundle": [total.tobytes()]}, schema=arrow_schema(_SUMS))


def _slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, few at once; longer texts, fewer."""
    ends = np.cumsum(pc.binary_length(batch.column(place)).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BYTES_AT_ONCE, "right"))
        b = min(max(a + 1, b), a + _DOCS_AT_ONCE)
        yield batch.slice(a, b - a)
        a = b


def _bundles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """``lang, bundle`` of batches of ``lang, text``; what is held does not grow with the batches."""
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    sums: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pydict(
            {"lang": list(sums), "bundle": [v.tobytes() for v in sums.values()]}, schema=arrow_schema(_SUMS))
        sums.clear()
        return rows

    def add() -> Iterator[pa.RecordBatch]:
        for lang, found in counted.items():
            exact = bundle_counts(*found, dim)
            sums[lang] = sums[lang] + exact if lang in sums else exact
            if len(sums) > 256:
                yield flush()
        counted.clear()

    for batch in batches:
        for part in _slices(batch, 1):
            grams: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                grams.setdefault(lang, []).append(ngrams(text))
            for lang, parts in grams.items():
                found = np.unique(np.concatenate(parts), return_counts=True)
                counted[lang] = _merged(counted[lang], found) if lang in counted else found
            if sum(len(g) for g, _ in counted.values()) + len(counted) > _GRAMS_HELD:
                yield from add()
    yield from add()
    if sums:
        yield flush()


def _merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of both with the sums of their counts."""
    grams, place = np.unique(np.concatenate([one[0], other[0]]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    for part, times in ((place[:len(one[0])], one[1]), (place[len(one[0]):], other[1])):
        counts[part] += times
    return grams, counts


def learn_prototypes(labelled: DataFrame, dim: int = DIM, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Language -> bundled vector, from ``lang, text``; rows without either teach nothing."""
    rows = labelled.select(labelled["lang"].cast("string").alias("lang"), labelled["text"].cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    parts = rows.mapInArrow(lambda batches: _bundles(batches, dim), _SUMS)
    level = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    level = level.groupBy("lang", "part").applyInArrow(_sum_bundles, _SUMS)
    found = level.groupBy("lang").applyInArrow(_sum_bundles, _SUMS).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if that many are meant")
    learned = {r.lang: np.frombuffer(bytes(r.bundle), np.int64) for r in found}
    return {k: v for k, v in sorted(learned.items()) if v.any()}


def bundle_counts(grams: np.ndarray, counts: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The exact sum of n-gram vectors as whole numbers, for counts of any size."""
    total = np.zeros(dim, np.int64)
    for a in range(0, len(grams), _GRAMS_AT_ONCE):
        part = counts[a:a + _GRAMS_AT_ONCE].astype(np.float64)
        total += (part @ gram_vectors(grams[a:a + _GRAMS_AT_ONCE], dim)).astype(np.int64)
    return total


def predict_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
                      rejects: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` (cosine, 0 to 1) appended.  With ``rejects``, rows go whose
    text has no letters or scores less than :func:`least_score` asks of so many n-grams.

    Columns of these names that are already there are replaced.
    """
    dim = len(next(iter(prototypes.values()))) if prototypes else DIM
    names = list(prototypes)
    units = np.stack([v / np.linalg.norm(v) for v in prototypes.values()]) if names else np.zeros((0, dim))
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, _DOCS_AT_ONCE):
                batch = whole.slice(a, _DOCS_AT_ONCE)
                counts = [np.unique(ngrams(t or ""), return_counts=True) for t in batch.column(place).to_pylist()]
                sums = bundle(counts, dim)
                norms = np.linalg.norm(sums, axis=1)
                cosines = sums @ units.T / np.where(norms > 0, norms, 1)[:, None]
                known = np.array([len(g) > 0 for g, _ in counts]) & (len(names) > 0)
                best = cosines.argmax(axis=1) if names else np.zeros(len(counts), int)
                pred = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
                score = [float(min(1.0, max(0.0, cosines[i, b]))) if k else 0.0
                         for i, (b, k) in enumerate(zip(best, known))]
                out = pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*batch.schema.names, "lang_pred", "score"])
                if rejects:
                    distinct = np.array([len(g) for g, _ in counts])
                    out = out.filter(pa.array(known & (np.array(score) >= least_score(distinct, dim))))
                yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, then predict every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"),
                       docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    prototypes = learn_prototypes(rows.where(~F.col("held_out")).select("lang", "text"), dim)
    return predict_languages(rows.drop("lang"), prototypes)


def least_score(n: np.ndarray, dim: int = DIM, few: int = 8, enough: int = 72, deviations: float = 4.0) -> np.ndarray:
    """The cosine that a text of ``n`` distinct n-grams must reach with some language.

    The cosine of a text with a language it shares nothing with is chance, with a standard deviation of ``dim ** -0.5``.
    That of a text in the language grows with the number of its n-grams, about as their root; with ``few`` of them it
    may be none.  So the bound rises evenly from 0 there to ``deviations`` of chance at ``enough`` n-grams: on the
    test documents it is at most half the least score of a text of as many n-grams.
    """
    return deviations * dim ** -0.5 * np.clip((n - few) / (enough - few), 0, 1)


def keep_recognised(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """The rows whose text has letters and reaches :func:`least_score` with some language, all columns unchanged.

    Prototypes are learned from the labelled rows outside the held-out fold.  Without any prototype there is nothing to
    compare with, and all rows with letters stay.  Null texts go; repeated rows and rows of equal doc_id are judged
    each by their own text; an empty table gives no rows.
    """
    labelled = docs.where(~held_out(docs["doc_id"])).select(docs["lang"].alias("lang"), docs["text"].alias("text"))
    prototypes = learn_prototypes(labelled, dim)
    if not prototypes:
        return docs.where(F.col("text").rlike("\\p{L}"))
    ours = {c: spare(docs, f"own_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    kept = predict_languages(docs.withColumnsRenamed(ours), prototypes, rejects=True)
    return kept.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in ours.items()})


def op6(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
