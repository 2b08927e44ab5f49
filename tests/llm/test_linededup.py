"""Line dedup against brute force."""

import random
import re

from tradelens.llm import linededup


def brute(rows, percent=80):
    lines = []
    for i, text, *_ in rows:
        for k, line in enumerate((text or "").split("\n")):
            lines.append((i, k, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)))
    out = {}
    for i, k, s in lines:
        hit = any(s and t and ((j is None and i is not None) or (i is not None and j is not None and j < i) or (j == i and m < k))
                  and 100 * len(s & t) >= percent * len(s | t) for j, m, t in lines)
        out.setdefault(i, {})[k] = out.get(i, {}).get(k, False) or hit
    return lines, out


def check(rows, df):
    lines, want = brute(rows)
    out = {r.doc_id: r for r in linededup.op1(df).collect()}
    assert set(out) == set(want)
    for i, marks in want.items():
        assert out[i].n_lines == sum(a == i for a, _, _ in lines)
        assert {int(x) for x in filter(None, out[i].removed_lines.split(","))} == {k for k, hit in marks.items() if hit}


def family_rows(seed, n=60):
    rnd, rows = random.Random(seed), []
    bases = [[f"w{rnd.randint(0, 80 if b % 2 else 3000)}" for _ in range(rnd.choice([3, 9, 10, 14, 30, 70]))] for b in range(12)]
    for i in range(n):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            words = list(rnd.choice(bases))
            for _ in range(rnd.randint(0, 1 + len(words) // 8)):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10 ** 6)}" if rnd.random() < .7 else rnd.choice(words)
            lines.append(" ".join(words).title() if rnd.random() < .2 else "\t".join(words))
        rows.append((rnd.randint(0, 10 ** 6), "\n".join(lines)))
    return rows


def test_families_of_similar_lines(spark):
    for seed in (1, 2, 3):
        rows = family_rows(seed)
        check(rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_documents(odd_docs, spark):
    rows, df = odd_docs
    rows = [r for r in dict.fromkeys(rows)]
    df = df.dropDuplicates(["doc_id", "text"])
    check(rows, df)
    assert linededup.op1(df.limit(0)).collect() == []


def test_documents_without_their_removed_lines(odd_docs, spark):
    rows = [(1, "A b c d e\nkeep one", 0, "p"), (2, "a b c d e\nkeep two here", 0, "q"), (3, "a b  c d e", 0, "r"),
            (4, None, None, "s"), (5, "", 0, "t"), (6, "other\n\nwords", 99, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _text string")
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(
        [rows[0], (2, "keep two here", 13, "q"), rows[3], rows[4], rows[5]], key=lambda r: r[0])


def test_rows_that_share_a_null_or_repeated_id_lose_their_own_lines_only(spark):
    for i in (None, 7):
        rows = [(i, "a b c\nx"), (i, "y\na b c"), (i, "y\na b c"), (i, "p q r s t u\nfirst here"), (i, "p q r s t u\nsecond there"),
                (9, "k l m n o p q\nalone"), (9, "some\nk l m n o p z"), (9, "other\nk l m n o p q")]
        out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        texts = sorted(r.text for r in out if r.doc_id == i)
        assert texts.count("y") == 2 and "a b c\nx" in texts
        assert sum("p q r s t u" in t for t in texts) == 1
        assert {line for t in texts for line in t.split("\n")} == {"a b c", "x", "y", "p q r s t u", "first here", "second there"}
        assert sorted(r.text for r in out if r.doc_id == 9) == ["k l m n o p q\nalone", "other", "some\nk l m n o p z"]


def test_op1_reports_rows_of_one_id_as_its_sql(spark):
    # lines of one id: of those that agree in line number none is earlier; words are compared within their own rows
    rows = [(1, "a b c d e f g h i j\nu1"), (1, "k l m n o p\na b c d e f g h i j z"), (1, "k l m n o p\nu2"), (2, "v\nk l m n o p")]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_weights_are_a_constant_and_not_in_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = linededup.line_sets(docs, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction((scalar-subquery" in plan


def test_no_python_in_the_plan(spark, small_docs):
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in small_docs[:5]], "doc_id long, text string")
    plan = linededup.op1(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_a_class_is_first_held_against_one_earlier_class(spark, monkeypatch):
    # near copies that share no two rarest words: each could be held against all others
    words = [f"common{k}" for k in range(40)]
    rows = [(i, " ".join(words + [f"own{i}a", f"own{i}b"])) for i in range(24)]
    verified, counts = linededup._verified, []

    def counting(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(linededup, "_verified", counting)
    check(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert counts and max(counts) <= len(rows)


def test_near_copies_make_pairs_in_proportion_to_their_number(spark, monkeypatch):
    # each is the same text with some words of its own, so that no two share their rarest words
    ordered, counts = linededup._ordered, []

    def counting(pairs, *rest):
        out = ordered(pairs, *rest)
        counts[-1] += out[0].count()
        return out

    monkeypatch.setattr(linededup, "_ordered", counting)
    for members in (100, 300):
        rnd, rows = random.Random(5), []
        for i in range(members):
            words = [f"common{k}" for k in range(60)]
            for k in range(rnd.randint(2, 5)):
                words[rnd.randrange(60)] = f"own{i}x{k}"
            rows.append((i, " ".join(words)))
        counts.append(0)
        check(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert counts[1] < 300 * 299 / 2 / 4, counts


def test_long_lines_that_share_few_words_make_no_pairs(spark, monkeypatch):
    # each shares rare words with many others, but they are no copies; two are
    of_prefixes, counts = linededup._of_prefixes, []

    def counting(*args):
        out = of_prefixes(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(linededup, "_of_prefixes", counting)
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(150, 160)))) for i in range(200)]
    rows += [(300, rows[7][1] + " one two"), (301, "x y " + rows[8][1])]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert counts and counts[0] < len(rows)
