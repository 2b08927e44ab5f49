"""Fingerprints against plain recomputation."""

import hashlib
import random

import pytest

from tradelens.llm import fingerprints as fp


def plain(rows):
    docs = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (i, text), (j, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        prints = [fp.fingerprint(fp.PrefixHashes.of(t)) for t in (text, edited, after)]
        same = next((k for k, (a, b) in enumerate(zip(text, edited)) if a != b), min(len(text), len(edited)))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1],
                    fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2]), j, same))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in fp.document_fingerprints(df, **kw).collect()), key=str)


def test_documents(spark, small_docs):
    rows = [(d["doc_id"], d["text"]) for d in small_docs]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert got(df) == want and got(df, ranges=1) == want and got(df, ranges=60) == want
    # a third replaced by foreign text is still alike, another document is not
    long = [r for r in want if r[1] > 300]
    assert sum(r[5] for r in long) / len(long) > 0.4 and sum(r[6] for r in long) / len(long) < 0.1


def test_odd_documents(odd_docs, spark):
    rows, df = odd_docs
    for ranges in (1, 3, 8):
        assert got(df, ranges=ranges) == plain(rows)
    assert got(df.limit(0)) == []
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert got(one) == plain([(5, "abcdef")])


@pytest.mark.parametrize("alphabet", ["ab", "a日😀\x00"])
def test_spans_and_extensions(alphabet):
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in "ab")
        x, y = fp.PrefixHashes.of(a), fp.PrefixHashes.of(b)
        i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        want = 0
        while a[i:i + want + 1] == b[j:j + want + 1] and i + want < len(a) and j + want < len(b):
            want += 1
        assert fp.common_extension(x, i, y, j) == want
        n = rnd.randint(0, min(len(a) - i, len(b) - j))
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i:i + n] == b[j:j + n])
        k, t = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        spliced, direct = x.spliced(k, y, t), fp.PrefixHashes.of(a[:k] + b[:t])
        assert [v.tolist() for v in spliced.arrays] == [v.tolist() for v in direct.arrays]


def test_likeness_of_equal_and_empty():
    empty, some = (fp.fingerprint(fp.PrefixHashes.of(t)) for t in ("", "x" * 100))
    assert fp.likeness(empty, empty) == 1 and fp.likeness(some, some) == 1 and fp.likeness(empty, some) == 0
