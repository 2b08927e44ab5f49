"""BPE ids against the tiktoken library, round trips, offsets."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tradelens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def digests(reference, rows):
    out = []
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_documents_as_tiktoken(spark, reference, small_docs, odd_docs):
    rows = [(d["doc_id"], d["text"]) for d in small_docs]
    got = bpe.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == digests(reference, rows)
    rows, df = odd_docs
    assert sorted(map(tuple, bpe.op5(df).collect()), key=str) == digests(reference, rows)
    assert bpe.op5(df.limit(0)).collect() == []


def test_random_strings_as_tiktoken(reference):
    own, rnd = bpe.loaded(PATH, P.PATTERN), random.Random(4)
    parts = [" ", "\n", "\t", "a", "b", "é", "'s", "'re", "1", "²", "-", "=", "日", "　", "​", "\u0085", "\x1c",
             "\xa0", "😀", "́", "ſ", "th", "ing", "\r", "\x00", "'l"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) * rnd.choice([1, 1, 2, 3, 7, 40]) for _ in range(rnd.randint(0, 12)))
        ids = own.encode(s)
        assert ids == reference.encode_ordinary(s)
        assert own.decode(ids) == s
        spans = own.offsets(s, ids)
        for (a, b), i in zip(spans, ids):
            assert own.token_bytes[i] in s[a:b].encode()
        assert not s or (spans[0][0] == 0 and spans[-1][1] == len(s))


def test_encode_then_decode_documents(spark, odd_docs):
    rows, df = odd_docs
    encoded = bpe.encode_documents(df, PATH, P.PATTERN, with_offsets=True)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    back = bpe.decode_documents(encoded, PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_small_cache_changes_nothing(spark, reference, small_docs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(bpe, "CACHE_PIECE_CHARS", 4)
    own = bpe.ByteBpe(PATH, P.PATTERN)
    for d in small_docs[:20]:
        assert own.encode(d["text"]) == reference.encode_ordinary(d["text"])
    assert own.decode(own.encode("日")[:1] * 2).endswith("\ufffd") or len(own.encode("日")) == 1
