"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped on reading.

Layout of a folder, one pair of files for each range of documents:

* ``part-00000.bin``: the ids of its documents one after the other, little-endian unsigned integers of 16 bits if
  all ids fit, else of 32 bits.  Every document ends with the end id.
* ``part-00000.idx``: ``TOKENIDX``, then as little-endian 64-bit integers: bytes per id, number of documents, number of
  leading documents with a null id; the ``documents + 1`` offsets (counted in ids); the document ids.
* ``manifest/``: Parquet, one row a part: its place, name, documents, ids, and the sums of both over all parts before it.

Documents are sorted by doc_id over all parts (nulls first, rows of equal doc_id by the hash of their text), so part p
starts at its bases and any document is found by its offset without reading what lies before.

How it runs: Spark sorts the documents by ranges; a task tokenizes and writes a part as its documents arrive, under a
name of its own attempt, and renames it when it is whole, so a repeated task puts the same file in place of
its like.  Bases are prefix sums over one row a part.  Readers map a part and touch the pages they use.

Where: a folder that the driver and all executors reach, a path or a URI that Arrow's filesystems open
(``file:``, ``hdfs:``, ``s3:``, ``gs:``).  Mapping needs a mounted folder; elsewhere the same bytes are read in ranges.

Cases: null and empty texts have only the end id; long texts are tokenized whole; strings that look like special
tokens are ordinary text; repeated rows are repeated in the files; an empty table gives no parts and no rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.common import delete_folder, texts_of
from tradelens.session import cut_lineage, shared_folder

MAGIC = b"TOKENIDX"
#: Pieces, and words between spaces, whose ids a worker keeps before it starts afresh, and the longest that is kept.
CACHE_PIECES = 500_000
CACHE_PIECE_CHARS = 32
#: Ids that a task holds before it writes them out.
WRITE_IDS = 1 << 20


#: A space before anything that might count as white space, or before the end.
_OPEN_SPACE = re.compile(" (?:[\\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]|\\Z)")


_STOPS = (".", ",", ";", ":", "!", "?")


class PieceEncoder:
    """Ids of texts by a file of the ``tokenizers`` library, with no special tokens.

    Where the file splits texts by the byte-level pattern, the pieces are cut here and each distinct piece is
    merged once by the library while it stays in a bounded cache; other files go through the library's ``encode``.
    The pattern has a cut before every space that is followed by something else than white space, and what lies
    between two such cuts is split on its own.  So most texts are cut at their spaces, and the pattern only sees words
    that are not in the cache.
    """

    def __init__(self, path: str, pattern: str | None, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        top = max(max(self.whole.get_vocab(with_added_tokens=True).values()), end_id)
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        pre = self.whole.pre_tokenizer
        by_pieces = (pattern and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
                     and self.whole.normalizer is None)
        self.split = regex.compile(pattern).findall if by_pieces else None
        self.model = self.whole.model
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        self.shown = {b: b if b in plain else next(others) for b in range(256)}  # the library's byte-to-character table
        self.end = np.array([end_id], self.dtype).tobytes()
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]  # of array(); files are little-endian, as all of Spark's platforms
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # what follows a space, up to the next one -> ids with the space

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece, as bytes of the file's type."""
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece.encode().decode("latin-1").translate(self.shown)
            ids = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(piece) <= CACHE_PIECE_CHARS:
                if len(self.pieces) > CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _by_pattern(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.split(text)])

    def _letters(self, space: str, word: str) -> bytes | None:
        """The ids of letters, one piece with the space before them, and of a stop behind them, another; else nothing."""
        if word.isalpha():
            return self._piece(space + word)
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return self._piece(space + word[:-1]) + self._piece(word[-1])
        return None

    def _word(self, word: str) -> bytes:
        """The ids of a space and what follows it up to the next one; a line end between words is a piece of its own."""
        head, line_end, tail = word.partition("\n")
        ids = self._letters(" ", head)
        if line_end and ids:
            rest = self._letters("", tail)
            ids = rest and ids + self._piece(line_end) + rest
        return ids or self._by_pattern(" " + word)

    def encode(self, text: str) -> bytes:
        """The ids of a text and the end id, as bytes of the file's type."""
        if self.split is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes() + self.end
        if _OPEN_SPACE.search(text):
            return self._by_pattern(text) + self.end
        first, *words = text.split(" ")
        known, passing = self.words, {}
        ids, at = list(map(known.get, words)), -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            word = words[at]
            # two words with a line end between them seldom come again, their pieces do
            kept = known if len(word) <= CACHE_PIECE_CHARS and "\n" not in word else passing
            ids[at] = kept.get(word)
            if ids[at] is None:
                if len(known) > CACHE_PIECES:
                    known.clear()
                kept[word] = ids[at] = self._word(word)
        return self._by_pattern(first) + b"".join(ids) + self.end


_LOADED: dict[tuple, PieceEncoder] = {}


def loaded(path: str, pattern: str | None, end_id: int) -> PieceEncoder:
    """The worker's own encoder (one is kept)."""
    key = (path, pattern, end_id)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceEncoder(*key)
    return _LOADED[key]


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's filesystem and path for a folder given as a path or URI."""
    return pafs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else os.path.abspath(folder))


class PartWriter:
    """Writes one part; nothing is seen under its name before :meth:`close`."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, attempt: str):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.dtype = f"{path}/{name}", dtype
        self.trial = f"{path}/_{name}-{attempt}"
        self.bin = self.fs.open_output_stream(f"{self.trial}.bin")
        self.held: list[bytes] = []
        self.held_bytes, self.sizes, self.doc_ids = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.sizes.append(len(ids) // self.dtype.itemsize)
        self.doc_ids.append(doc_id)
        if self.held_bytes >= WRITE_IDS * self.dtype.itemsize:
            self._flush()

    def _flush(self) -> None:
        self.bin.write(b"".join(self.held))
        self.held, self.held_bytes = [], 0

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        self._flush()
        self.bin.close()
        nulls = sum(i is None for i in self.doc_ids)
        offsets = np.zeros(len(self.sizes) + 1, "<u8")
        np.cumsum(self.sizes, out=offsets[1:])
        with self.fs.open_output_stream(f"{self.trial}.idx") as out:
            out.write(MAGIC + np.array([self.dtype.itemsize, len(self.sizes), nulls], "<i8").tobytes())
            out.write(offsets.tobytes())
            out.write(np.array([0 if i is None else i for i in self.doc_ids], "<i8").tobytes())
        for kind in ("bin", "idx"):
            self.fs.move(f"{self.trial}.{kind}", f"{self.path}.{kind}")
        return len(self.sizes), int(offsets[-1])


class PartReader:
    """One part, mapped into memory."""

    def __init__(self, folder: str, name: str):
        fs, path = filesystem(folder)
        self.idx, self.bin = self._open(fs, f"{path}/{name}.idx"), self._open(fs, f"{path}/{name}.bin")
        head = self.idx.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path}/{name}.idx is not a token index")
        size, self.n_docs, self.n_nulls = (int(x) for x in np.frombuffer(head[8:], "<i8"))
        self.dtype = np.dtype(f"<u{size}")

    @staticmethod
    def _open(fs: pafs.FileSystem, path: str):
        if isinstance(fs, pafs.LocalFileSystem) and os.path.getsize(path):
            return pa.memory_map(path)
        return fs.open_input_file(path)

    def offsets(self, first: int, count: int) -> np.ndarray:
        """The offsets of ``count`` documents from ``first`` on, and the one behind them."""
        return np.frombuffer(self.idx.read_at(8 * (count + 1), 32 + 8 * first), "<u8")

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        ids = np.frombuffer(self.idx.read_at(8 * count, 32 + 8 * (self.n_docs + 1 + first)), "<i8").tolist()
        return [None if first + i < self.n_nulls else x for i, x in enumerate(ids)]

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids at places ``first`` to ``end`` of the part."""
        size = self.dtype.itemsize
        return np.frombuffer(self.bin.read_at(size * (end - first), size * first), self.dtype)

    def documents(self, block: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``doc_id, first place, ids`` of every document."""
        for first in range(0, self.n_docs, block):
            count = min(block, self.n_docs - first)
            offsets = self.offsets(first, count).tolist()
            for i, doc_id in enumerate(self.doc_ids(first, count)):
                yield doc_id, offsets[i], self.ids(offsets[i], offsets[i + 1])


def part_name(part: int) -> str:
    return f"part-{part:05d}"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, pattern: str | None = None,
                      parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents, then the manifest, and returns it: ``part, name, n_docs, n_ids, first_doc, first_id``.

    ``parts``: number of ranges, by default the session's shuffle partitions.  The row number makes rows that agree
    in all else distinct, so a doc_id that a third of the rows share is dealt to many parts.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    rows = texts_of(docs, id_col, text_col).withColumns(
        {"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, task = loaded(path, pattern, end_id), None, TaskContext.get()
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = PartWriter(folder, part_name(task.partitionId()), encoder.dtype, uuid.uuid4().hex)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer.add(doc_id, encoder.encode(text))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()),
                                              "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    written = dealt.mapInArrow(write, "part long, n_docs long, n_ids long")
    counts = sorted((r.part, r.n_docs, r.n_ids) for r in written.collect())  # three numbers a part
    first_doc = accumulate((c[1] for c in counts), initial=0)
    first_id = accumulate((c[2] for c in counts), initial=0)
    manifest = spark.createDataFrame(
        [(p, part_name(p), d, n, a, b) for (p, d, n), a, b in zip(counts, first_doc, first_id)],
        "part long, name string, n_docs long, n_ids long, first_doc long, first_id long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, name string, n_docs long, n_ids long, first_doc long, first_id long").parquet(
        f"{folder}/manifest")


def _by_part(manifest: DataFrame, folder: str, fn, schema: str) -> DataFrame:
    """``fn(reader, first_id)`` yields record batches for every part; one task a part."""
    spark = manifest.sparkSession
    parts = [(r.name, r.first_id) for r in manifest.orderBy("part").collect()]  # one row a part
    n = max(1, len(parts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, first_id = parts[i]
                yield from fn(PartReader(folder, name), first_id)

    return spark.range(0, len(parts), 1, n).mapInArrow(read, schema)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids array<long>`` of every document; ``start`` counts the ids of all documents before it."""
    def rows(part: PartReader, first_id: int) -> Iterator[pa.RecordBatch]:
        for doc_id, at, ids in part.documents():
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([doc_id], pa.int64()), "start": pa.array([first_id + at], pa.int64()),
                "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})
    return _by_part(read_manifest(spark, folder), folder, rows, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, folder: str, block: int = 4096) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    def rows(part: PartReader, first_id: int) -> Iterator[pa.RecordBatch]:
        for first in range(0, part.n_docs, block):
            count = min(block, part.n_docs - first)
            offsets = part.offsets(first, count).tolist()
            crcs = [zlib.crc32(part.ids(a, b).astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
            places = np.array(offsets, np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(part.doc_ids(first, count), pa.int64()), "start": pa.array(places[:-1] + first_id),
                "n_tokens": pa.array(np.diff(places)), "ids_crc32": pa.array(crcs, pa.int64())})
    return _by_part(read_manifest(spark, folder), folder, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The query: writes the files to the shared folder, reads them back, and deletes them once the rows are kept."""
    import public_tokenizers

    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path or public_tokenizers.path("byte_bpe_50k.json"), end_id=2,
                      pattern=pattern or public_tokenizers.PATTERN)
    out = cut_lineage(token_digests(spark, folder))
    delete_folder(spark, folder)
    return out
