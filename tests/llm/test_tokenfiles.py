"""Token files against the tokenizers library, their layout, and reading back."""

import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tradelens.llm import tokenfiles

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def expected(reference, rows):
    """Rows in the order of the files; rows of equal doc_id are compared by their own digests only."""
    out = []
    for doc_id, text in rows:
        ids = reference(text)
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def check(got, reference, rows):
    got = sorted((tuple(r) for r in got), key=lambda r: r[1])
    want = expected(reference, rows)
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted(want, key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_query_as_the_library(spark, reference, small_docs, odd_docs):
    rows = [(d["doc_id"], d["text"]) for d in small_docs]
    check(tokenfiles.op13(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), reference, rows)
    rows, df = odd_docs
    check(tokenfiles.op13(df).collect(), reference, [r[:2] for r in rows])
    assert tokenfiles.op13(df.limit(0)).collect() == []
    texts = [(i, "tail <|endoftext|> end") for i in range(3)]
    check(tokenfiles.op13(spark.createDataFrame(texts, "doc_id long, text string")).collect(), reference, texts)


def test_random_strings_as_the_library(reference, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHE_PIECES", 300)
    monkeypatch.setattr(tokenfiles, "CACHE_PIECE_CHARS", 6)
    own, rnd = tokenfiles.PieceEncoder(PATH, P.PATTERN, 2), random.Random(13)
    assert own.split is not None and own.dtype == np.dtype("<u2")
    parts = [" ", "\n", "\t", "a", "b", "é", "'s", "'re", "1", "²", "-", "=", "日", "　", "​", "\u0085", "\x1c", "\x1f",
             "\xa0", "😀", "́", "ſ", "th", "ing", "\r", "\x00", "'l", "᠎", " ", "٣", "Ⅷ", "ª", "्"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) * rnd.choice([1, 1, 2, 3, 7, 40]) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(own.encode(s), own.dtype).tolist() == reference(s), repr(s)
    whole = tokenfiles.PieceEncoder(PATH, None, 70_000)
    assert whole.dtype == np.dtype("<u4") and np.frombuffer(whole.encode("one two"), "<u4").tolist() == [*reference("one two")[:-1], 70_000]


def test_layout_and_reading(spark, tmp_path, reference):
    rnd = random.Random(1)
    rows = [(i if i % 9 else 4, " ".join(rnd.choices(["alpha", "beta", "gamma delta", "é"], k=rnd.randint(0, 30)))) for i in range(300)]
    rows += [(None, "null id"), (None, None)]
    folder = str(tmp_path / "ids")
    manifest = tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, 2, P.PATTERN, parts=7)
    parts = manifest.orderBy("part").collect()
    assert len(parts) == 7 and sum(p.n_docs for p in parts) == len(rows)
    assert [p.first_id for p in parts] == np.cumsum([0] + [p.n_ids for p in parts])[:-1].tolist()
    assert [p.first_doc for p in parts] == np.cumsum([0] + [p.n_docs for p in parts])[:-1].tolist()
    for p in parts:  # flat integers, offsets from 0 to the number of ids
        assert os.path.getsize(f"{folder}/{p.name}.bin") == 2 * p.n_ids
        raw = open(f"{folder}/{p.name}.idx", "rb").read()
        assert raw[:8] == tokenfiles.MAGIC and len(raw) == 32 + 8 * (2 * p.n_docs + 1)
        offsets = np.frombuffer(raw, "<u8", p.n_docs + 1, 32)
        assert offsets[0] == 0 and offsets[-1] == p.n_ids
    assert not [f for f in os.listdir(folder) if f.startswith("_")]
    back = sorted(tokenfiles.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r.doc_id), list(r.ids)) for r in back) == sorted((str(i), reference(t)) for i, t in rows)
    part = tokenfiles.PartReader(folder, parts[3].name)  # one document, without what lies before it
    first, end = part.offsets(5, 1).tolist()
    assert part.ids(first, end).tolist() == list(back[parts[3].first_doc + 5].ids)


def test_one_id_in_many_parts(spark, tmp_path):
    rows = [(7, "same text") for _ in range(600)] + [(i, "other") for i in range(100)]
    folder = f"file://{tmp_path}/hot"
    parts = tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, PATH, 2,
                                         P.PATTERN, parts=8).collect()
    assert max(p.n_docs for p in parts) < 200


def test_a_repeated_task_replaces_its_file(tmp_path):
    for attempt in ("a", "b"):
        w = tokenfiles.PartWriter(str(tmp_path), "part-00000", np.dtype("<u2"), attempt)
        w.add(1, np.array([5, 6, 2], "<u2").tobytes())
        assert w.close() == (1, 3)
    unfinished = tokenfiles.PartWriter(str(tmp_path), "part-00001", np.dtype("<u2"), "c")
    unfinished.add(2, b"\x01\x00")
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith("_")) == ["part-00000.bin", "part-00000.idx"]
    assert [(d, a, i.tolist()) for d, a, i in tokenfiles.PartReader(str(tmp_path), "part-00000").documents()] == [(1, 0, [5, 6, 2])]


def test_files_are_deleted(spark, odd_docs):
    from tradelens.session import shared_folder
    rows, df = odd_docs
    before = set(os.listdir(shared_folder(spark).removeprefix("file://")))
    assert tokenfiles.op13(df).count() == len(rows)
    after = set(os.listdir(shared_folder(spark).removeprefix("file://"))) - before
    assert not [f for f in after if f.startswith("token-files")]


def test_line_ends_between_words_are_pieces_of_their_own():
    encoder = tokenfiles.PieceEncoder(PATH, P.PATTERN, 2)
    text = ("one two.\nThree four\nfive six\n\nseven eight\n nine ten\r\neleven x1.\nTwelve a\n b\n1 c.\n\td é.\nÉtat end,\nof\n"
            + " " + "w" * 40 + ".\nAgain again.\nAgain " + "w" * 40 + ".\nAgain don't.\nDon't z​\ny z\xa0\ny z\n　y z\x85\ny")
    for part in (text, text[:30], *text.split("\n\n"), *text.split("\r")):
        ids = np.frombuffer(encoder.encode(part), encoder.dtype).tolist()
        assert ids == encoder.whole.encode(part, add_special_tokens=False).ids + [2]
    known = tokenfiles.PieceEncoder(PATH, P.PATTERN, 2)
    known.encode("one two.\nThree four\nfive six")
    assert set(known.words) == {"six"}  # not what has a line end within, which seldom comes again
