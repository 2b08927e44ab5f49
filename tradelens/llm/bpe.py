"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A text is split by the public pattern, every piece becomes a string of stand-in characters (one
for each byte) and is merged by ``tokenizers``.  The rank file is the only input; merges follow
from it: any two tokens whose concatenation is a token may merge, by the rank of the result.
Decoding turns tokens back into bytes by the reversed byte table and joins the bytes before it
decodes UTF-8, so characters that were split over several tokens come back whole.

Distinct pieces are encoded once per worker while they stay in a bounded cache; the cache changes
speed only.

Cases: a null text counts as empty and gives no ids; every character is encoded (there are no
special tokens and no unknown token); long texts are encoded whole; repeated rows give equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tradelens.llm.common import map_batches, texts_of

#: Pieces that a worker's cache may hold before it starts afresh.
CACHE_PIECES = 200_000
#: Longer pieces are encoded but not kept, so that the cache's memory is bounded.
CACHE_PIECE_CHARS = 64


def byte_table() -> list[str]:
    """The stand-in character of each byte: printable Latin-1 characters stand for themselves, the
    other bytes take the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder for one rank file.  Built once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        self.table = byte_table()
        self.byte_of = {c: b for b, c in enumerate(self.table)}
        shown = {token: "".join(self.table[b] for b in token) for token in ranks}
        merges = sorted((rank, ranks[token[:i]], ranks[token[i:]], shown[token[:i]], shown[token[i:]])
                        for token, rank in ranks.items() for i in range(1, len(token))
                        if token[:i] in ranks and token[i:] in ranks)
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[m[3:] for m in merges],
                           ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.token_bytes = {r: bytes(self.byte_of[c] for c in shown[t]) for t, r in ranks.items()}
        #: piece -> (number of ids, ids as decimal text, decoded bytes)
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def encode_pieces(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces, through the library in one call."""
        listed = list(pieces)
        return {p: tuple(e.ids) for p, e in
                zip(listed, self.tokenizer.encode_batch_fast(listed, add_special_tokens=False))}

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        ids = self.encode_pieces(set(pieces))
        return [i for p in pieces for i in ids[p]]

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Character spans of the tokens.  A token that holds a part of a character spans the
        whole character, so neighbouring spans may overlap."""
        starts = [i for i, c in enumerate(text) for _ in c.encode()]
        out, at = [], 0
        for i in ids:
            end = at + len(self.token_bytes[i])
            out.append((starts[at], starts[end - 1] + 1))
            at = end
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no character (a cut sequence of ids) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """The worker's own encoder for a rank file (one file at a time is kept)."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(path, pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>[, starts array<int>, ends array<int>]`` of whole texts; offsets are
    code points, end exclusive."""
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [bpe.encode(t) for t in texts]
            columns = {"doc_id": batch.column(0), "ids": pa.array(ids, kind)}
            if with_offsets:
                spans = [bpe.offsets(t, i) for t, i in zip(texts, ids)]
                columns |= {"starts": pa.array([[a for a, _ in s] for s in spans], kind),
                            "ends": pa.array([[b for _, b in s] for s in spans], kind)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give an empty text."""
    def fn(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path, pattern)
        return {"doc_id": batch.column(0), "text": [bpe.decode(i or ()) for i in batch.column(1).to_pylist()]}
    return map_batches(encoded.select("doc_id", "ids"), fn, "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per document the number of ids, the digest of the ids, and that of the bytes decoded from them."""
    def fn(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path, pattern)
        known = bpe.cache
        counts, id_digests, byte_digests = [], [], []
        for text in batch.column(1).to_pylist():
            pieces = bpe.split(text)
            missing = {p for p in pieces if p not in known}
            if missing:
                known.update((p, (len(ids), ",".join(map(str, ids)), bpe.decode_bytes(ids)))
                             for p, ids in bpe.encode_pieces(missing).items())
            parts = [known[p] for p in pieces]
            counts.append(sum([p[0] for p in parts]))
            id_digests.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
            byte_digests.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
            for p in missing:
                if len(p) > CACHE_PIECE_CHARS:
                    del known[p]
            if len(known) > CACHE_PIECES:
                known.clear()
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": id_digests,
                "decoded_sha256": byte_digests}

    return map_batches(texts_of(docs, id_col, text_col), fn,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The query, with the public multi-language vocabulary unless another file is given."""
    import public_tokenizers

    return encoding_digests(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            pattern or public_tokenizers.PATTERN)
