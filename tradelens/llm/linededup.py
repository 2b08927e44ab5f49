"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its distinct words; a line is removed if an earlier line (smaller doc_id, or the
same document and a smaller line number) has a Jaccard similarity of at least ``percent / 100`` to it.
All earlier lines count, whether they are removed themselves or not, so the result does not depend on
the order of the work.

1. Words are ordered by rarity.  How often a word occurs is counted over all lines by a hash of
   2**18 classes, so the table that every task needs has a fixed size; any order that is the same for
   all lines gives exact results, a better one only fewer candidates.
2. Equal sets form a class.  Its earliest line stands for it and all others are removed.  From here on there is one
   row a class; texts are read again only for the lines of candidate pairs.
3. Similar sets share a word among the first ``n - ceil(t n) + 1`` of each (prefix filter); lengths and positions rule out
   most pairs inside the join, whose rows hold a few numbers.
   So does the parity of their words in 128 classes, which bounds the symmetric difference from below.
4. Large families of near copies would make pairs by the square of their size.  So a class is in three families, by two
   words of its prefix each, and is first held against the earliest of these, the one whose prefix is most alike; those
   that match are decided and no longer look for partners (they remain partners of others).  Then the undecided are held
   against the leaders, at most eight classes of each family, with which they share any prefix word.
5. All pairs of a later undecided class and any earlier one that share a prefix word are left.  Candidates whose prefixes
   share too few words are dropped; the others are verified on the lines' words.

Joins meet hot words, families and copies without a repartition of their own, so Spark splits skewed ones.  Tables that
the steps share lie in the shared folder and are deleted at the end.

A class is known by 96 bits of hashes of its words' codes of 64 bits; among 1e11 distinct lines two share them with a
chance of 1e-7.

Cases: words are runs of anything but ASCII white space, in lower case; lines without words are never
removed; null and empty texts have one line without words; long lines and texts are taken whole; an
equal line in the same document counts; null doc_ids come first; an empty table gives no rows; other
columns are not read.  A row is known by its doc_id and the hash of its text, so texts that share a null or
repeated doc_id are told apart.  ``op1`` reports by doc_id, and as in its SQL, of lines that agree in doc_id
and line number none is earlier; ``dedup_lines`` decides between those by the hash of the text, and only rows
that agree in doc_id and text are treated alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.common import bit_of, bitmap, bitmap_slot, delete_folder, in_bitmap, spare, texts_of
from tradelens.session import cut_lineage, shared_folder

CLASS_BITS = 18

_BLANKS = "\x09\x0b\x0c\x0d"


def _words(text: Column, blanks: str = _BLANKS) -> Column:
    """Words in lower case, with empty ones between neighbouring blanks."""
    for blank in blanks:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(F.lower(text), " ")


def _hashes(line: Column) -> Column:
    """Hashes of a line's distinct words."""
    words = F.transform(_words(line), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))


def _lines(texts: DataFrame) -> DataFrame:
    rows = texts.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def rarity(spark: SparkSession, hashes: DataFrame) -> DataFrame:
    """One row: an array with the weight of each word class, in the high bits of a long.

    ``hashes`` has one row per word (``h long``).  The weight is the logarithm of the class's count.
    """
    mask = F.lit((1 << CLASS_BITS) - 1)
    counts = hashes.groupBy(F.col("h").bitwiseAND(mask).alias("id")).count()
    weight = F.shiftleft(F.floor(F.log2(F.coalesce("count", F.lit(0)) + 1) * 32).cast("long"), 52)
    table = spark.range(1 << CLASS_BITS).join(counts, "id", "left").select("id", weight.alias("weight"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "weight")))
    return table.agg(F.transform(ordered, lambda e: e["weight"]).alias("weights"))


def _needed(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100)"""
    return F.floor((n * percent + 99) / 100).cast("int")


def line_sets(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, row, line_no, key, check, n, prefix, bits, odd`` of every line with words; ``key`` and ``check`` tell sets
    apart, ``prefix`` has numbers for the rarest words, ``bits`` the parity of the words' codes in 64 classes, ``odd`` that
    of every second class of 128 (with ``bits``, that of all 128)."""
    spark, lines = docs.sparkSession, _lines(docs).where(F.col("line").rlike("[^\\x20\\x09-\\x0d]"))
    # whole texts: any weights do, and so rows of words need no lines, sets or functions of arrays
    words = docs.select(F.explode(_words(F.col("text"), _BLANKS + "\n")).alias("word")).where("word != ''")
    weights = rarity(spark, words.select(F.xxhash64("word").alias("h"))).scalar()
    mask = F.lit((1 << CLASS_BITS) - 1)
    # the optimizer puts the one-row table, as a constant, where it is used once (tested: it is in no row)
    lines = lines.select("doc_id", "row", "line_no", "line", weights.alias("weights"))
    code = F.sort_array(F.transform(_hashes(F.col("line")), lambda h: F.col("weights")[h.bitwiseAND(mask).cast("int")]
                                    .bitwiseOR(F.shiftrightunsigned(h, 12))))
    coded = lines.select("doc_id", "row", "line_no", code.alias("codes"))
    n = F.size("codes")
    bits, odd = (F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit_of(c)))
                 for codes in (F.col("codes"), F.filter("codes", lambda c: c.bitwiseAND(F.lit(64)) != 0)))
    rarest = F.slice("codes", 1, n - _needed(n, percent) + 1)
    return coded.select("doc_id", "row", "line_no", F.xxhash64("codes").alias("key"), F.hash("codes").alias("check"), n.alias("n"),
                        F.transform(rarest, lambda c: c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"), bits.alias("bits"), odd.alias("odd"))


def _fits(n: Column, m: Column, bits: Column, odd: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar; ``bits`` and ``odd`` are where the two sets' parities differ.

    Each word that only one has turns one bit.  Of 64 bits half differ between any two long lines, which is no more than
    similar lines of about 150 words may; so there are 128.  ``odd`` has half of them, ``bits`` both halves on each other.
    """
    differ = F.bit_count(odd) + F.bit_count(bits.bitwiseXOR(odd))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


_PLACE = ("doc_id", "row", "line_no")


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` may be among ``ids``, by a bitmap: for a join with them that shuffles little."""
    slot = bitmap_slot("id")
    return rows.where(in_bitmap(bitmap(ids.select(slot.alias("slot"))), slot))


def _ordered(pairs: DataFrame, classes: DataFrame, percent: int, by_row: bool) -> tuple[DataFrame, DataFrame]:
    """``id, o_id, n, m, apart`` of the pairs (``id, o_id``) that can be similar, ``o_id`` the earlier class, and ``id`` with
    the places of these classes.

    In the set whose prefix ends first all shared prefix words are in the other's prefix too, so the prefixes bound the
    shared words from above (words of a prefix that share a number count as shared).  The smaller ``apart``, the more
    alike the prefixes are.
    """
    pairs = cut_lineage(pairs.distinct())
    ids = pairs.select(F.explode(F.array("id", "o_id")).alias("id")).distinct()
    # the joins' rows have little to compute: long code is not compiled
    wanted = cut_lineage(_named(classes.select("id", *_PLACE, "n", "prefix"), ids).join(ids, "id", "left_semi")
                         .withColumn("rest", F.col("n") - F.size("prefix"))
                         .withColumn("alike", F.size("prefix") - F.size(F.array_distinct("prefix"))))
    other = wanted.drop("alike").toDF("o_id", "o_doc", "o_row", "o_line", "m", "o_prefix", "o_rest")
    shared = F.size(F.array_intersect("prefix", "o_prefix")) + F.col("alike")
    can_be = (shared + F.greatest("rest", "o_rest")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    first, then = ("doc_id", "line_no", "row"), ("o_doc", "o_line", "o_row")
    ends = (F.when(_earlier(first, then, by_row), F.struct(F.col("o_id").alias("id"), F.col("id").alias("o_id")))
            .when(_earlier(then, first, by_row), F.struct("id", "o_id")))
    apart = F.floor(F.lit(-1000) * shared / (F.col("n") + F.col("m") - F.col("rest") - F.col("o_rest"))).cast("int")
    both = cut_lineage(pairs.join(wanted, "id").join(other, "o_id").where(can_be).select(ends.alias("ends"), "n", "m", apart.alias("apart")))
    return both.where("ends is not null").select("ends.*", "n", "m", "apart"), wanted.select("id", *_PLACE)


def _verified(pairs: DataFrame, places: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``id`` of every class that is similar to the earlier one of a pair (``id, o_id, n, m``).

    The lines are read from the texts again, once, and go to the earlier class of their pairs.  Bitmaps of fixed size
    drop most texts that no pair names before they are cut into lines, and most such lines before they are shuffled; where
    they let others pass, the join drops them.  Of equal rows one is read.
    """
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    # without an own size, a line is the one that others are held against
    asked = pairs.select("id", "o_id", (F.col("n") + F.col("m")).alias("sizes")).union(
        pairs.select(F.col("o_id").alias("id"), "o_id", F.lit(None).cast("int")).distinct())
    # keys without nulls, so that the join shares the shuffle of the aggregation
    place = {"place_id": F.coalesce("doc_id", F.lit(0).cast("long")), "nameless": F.col("doc_id").isNull(), "place_row": F.col("row"),
             "place_line": F.col("line_no").cast("int")}
    asked = cut_lineage(places.join(asked, "id").select("id", "o_id", "sizes", *_PLACE))
    slot = bitmap_slot("doc_id", "row", F.col("line_no").cast("int"))
    named = in_bitmap(bitmap(asked.select(slot.alias("slot"))), slot)
    rows = bitmap_slot(F.xxhash64("text"))
    texts = texts.where(in_bitmap(bitmap(asked.select(bitmap_slot("row").alias("slot"))), rows))
    lines = _lines(texts).where(named).withColumns(place).groupBy(*place).agg(F.first("line").alias("line"))
    found = lines.join(asked.withColumns(place).select("id", "o_id", "sizes", *place), list(place)).select("id", "o_id", "sizes", "line")
    found.write.parquet(f"{folder}/lines")
    found = spark.read.schema(found.schema).parquet(f"{folder}/lines")
    heads = found.where("sizes is null").select("o_id", F.col("line").alias("o_line"))
    shared = F.size(F.array_intersect(_hashes(F.col("line")), _hashes(F.col("o_line"))))
    similar = shared * (100 + percent) >= F.col("sizes") * percent
    matched = cut_lineage(found.where("sizes is not null").join(heads, "o_id").where(similar).select("id").distinct())
    delete_folder(spark, folder)
    return matched


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, by_row: bool, best: bool = False) -> DataFrame:
    """``id`` of the later class of every pair of similar classes; with ``best``, each is held against the one most alike only."""
    ordered, places = _ordered(pairs, classes, percent, by_row)
    if best:
        ordered = cut_lineage(ordered.groupBy("id").agg(F.min(F.struct("apart", "o_id", "n", "m")).alias("best")).select("id", "best.*"))
    return _verified(ordered, places, texts, percent)


def _earlier(at: tuple[str, str, str], than: tuple[str, str, str], by_row: bool) -> Column:
    """Whether the line at ``doc_id, line_no, row`` comes before another one; without ``by_row``, by the first two only."""
    (doc, line, row), (than_doc, than_line, than_row) = ([F.col(c) for c in names] for names in (at, than))
    first = F.when(doc.isNull() | than_doc.isNull(), doc.isNull() & than_doc.isNotNull()).otherwise(doc < than_doc)
    within = (line < than_line) | ((line == than_line) & (row < than_row)) if by_row else line < than_line
    return first | (doc.eqNullSafe(than_doc) & within)


def _families(classes: DataFrame) -> DataFrame:
    """``family, id, doc_id, n, bits, odd``: a class is in three families, by two words of its prefix each: the smallest and the
    largest two by number, which have nothing to do with rarity, and the two most frequent.  Families of one are left out.

    Near copies share most words of their prefixes, so they meet in some family though each has rare words of its own.
    """
    order = F.array_sort("prefix")
    keys = F.transform(F.array(F.slice(order, 1, 2), F.reverse(F.slice(F.reverse(order), 1, 2)), F.reverse(F.slice(F.reverse("prefix"), 1, 2))),
                       lambda two, k: F.xxhash64(two, k))
    rows = classes.select("id", "doc_id", "n", "bits", "odd", F.explode(keys).alias("family"))
    slot = bitmap_slot("family")
    shared = rows.groupBy("family").count().where("count > 1")
    return rows.where(in_bitmap(bitmap(shared.select(slot.alias("slot"))), slot))


def _of_families(families: DataFrame, percent: int) -> DataFrame:
    """``id, o_id``: the members of each family against the one of the smallest doc_id."""
    heads = families.groupBy("family").agg(F.min(F.struct("doc_id", "id", "n", "bits", "odd")).alias("h")).select(
        F.col("family").alias("o_family"), F.col("h.id").alias("o_id"), F.col("h.n").alias("m"), F.col("h.bits").alias("o_bits"),
        F.col("h.odd").alias("o_odd"))
    near = _fits(F.col("n"), F.col("m"), F.col("bits").bitwiseXOR(F.col("o_bits")), F.col("odd").bitwiseXOR(F.col("o_odd")), percent)
    return (families.join(heads, (F.col("family") == F.col("o_family")) & (F.col("id") != F.col("o_id")) & near)
            .select(F.least("id", "o_id").alias("id"), F.greatest("id", "o_id").alias("o_id")))


def _leaders(families: DataFrame) -> DataFrame:
    """``id`` of at most eight classes of each family of four and more: the smallest doc_ids of eight shares of it."""
    heads = families.groupBy("family", F.pmod(F.xxhash64("id"), F.lit(8)).alias("share")).agg(
        F.min(F.struct("doc_id", "id")).alias("h"), F.count("*").alias("members"))
    return (heads.groupBy("family").agg(F.collect_list("h.id").alias("ids"), F.sum("members").alias("members"))
            .where("members > 3").select(F.explode("ids").alias("id")).distinct())


def _marked(classes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The classes with a flag ``name``: whether they are among ``ids``."""
    columns, slot = classes.columns, bitmap_slot("id")
    maybe = in_bitmap(bitmap(ids.select(slot.alias("slot"))), slot)
    marked = classes.where(maybe).join(ids.select("id", F.lit(True).alias(name)), "id", "left")
    return classes.where(~maybe).select(*columns, F.lit(False).alias(name)).union(
        marked.select(*columns, F.col(name).isNotNull().alias(name)))


def _index(classes: DataFrame) -> DataFrame:
    """``word, id, at, bits, odd, pack``: a row for each prefix word of the classes with a flag ``done``."""
    # size, position and mark in one number: a row for each prefix word is what the join costs
    return classes.select("id", "n", "bits", "odd", "done", F.coalesce("doc_id", F.lit(-1 << 63)).alias("at"),
                          F.posexplode("prefix").alias("place", "word")).select(
        "word", "id", "at", "bits", "odd", (F.shiftleft(F.col("n").cast("long"), 32) + F.shiftleft(F.col("place").cast("long"), 1)
                                             + F.col("done").cast("int")).alias("pack"))


def _met(left: DataFrame, right: DataFrame, percent: int, once: bool) -> DataFrame:
    """``id, o_id`` of rows of two indexes that share a prefix word at positions from which their classes can still be
    similar, if the one that may be later is not done.  ``once``: both are the same index."""
    left, right = (index.select(*[F.col(c).alias(f"{side}_{c}") for c in index.columns]) for side, index in (("l", left), ("r", right)))

    def unpacked(side: str) -> tuple[Column, Column, Column]:
        pack = F.col(f"{side}_pack")
        return F.shiftright(pack, 32), F.shiftright(pack.bitwiseAND(F.lit((1 << 32) - 1)), 1), pack.bitwiseAND(F.lit(1))

    (n, at, done), (m, o_at, o_done) = unpacked("l"), unpacked("r")
    least_shared = F.floor(((n + m) * percent + 99 + percent) / (100 + percent))  # ceil(t / (1 + t) * (n + m))
    in_reach = F.least(n - at, m - o_at) >= least_shared
    asks = ((done == 0) & (F.col("l_at") >= F.col("r_at"))) | ((o_done == 0) & (F.col("r_at") >= F.col("l_at")))
    other = F.col("l_id") < F.col("r_id") if once else F.col("l_id") != F.col("r_id")
    bits, odd = (F.col(f"l_{c}").bitwiseXOR(F.col(f"r_{c}")) for c in ("bits", "odd"))
    met = left.join(right, (F.col("l_word") == F.col("r_word")) & other & asks & in_reach & _fits(n, m, bits, odd, percent))
    return met.select(F.least("l_id", "r_id").alias("id"), F.greatest("l_id", "r_id").alias("o_id"))


_INDEXED = ("id", "doc_id", "n", "bits", "odd", "prefix")


def _of_leaders(classes: DataFrame, decided: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """``id, o_id``: undecided classes and the leaders that share a prefix word with them."""
    slot = bitmap_slot("word")
    led = cut_lineage(_index(_named(classes.select(*_INDEXED), leaders).join(leaders, "id", "left_semi").withColumn("done", F.lit(True))))
    open_ = _index(_marked(classes.select(*_INDEXED), decided, "done").where("not done"))
    return _met(open_.where(in_bitmap(bitmap(led.select(slot.alias("slot"))), slot)), led, percent, False)


def _of_prefixes(classes: DataFrame, decided: DataFrame, percent: int) -> DataFrame:
    """``id, o_id``: classes that share a prefix word, the later one undecided."""
    index = _index(_marked(classes.select(*_INDEXED), decided, "done"))
    # two projections alike: the second reads the first one's shuffle
    return _met(index, index, percent, True)


def _gone(texts: DataFrame, percent: int, by_row: bool) -> DataFrame:
    """``doc_id, row, line_no`` of the removed lines of every row."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lines = stored(line_sets(texts, percent), "lines")
    classes = stored(lines.groupBy("key", "check").agg(
        F.min(F.struct("doc_id", "line_no", "row")).alias("at"), F.count("*").alias("members"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("odd").alias("odd"))
        .select(F.monotonically_increasing_id().alias("id"), "key", "check", "at.*", "members", "n", "prefix", "bits", "odd"), "classes")

    families = cut_lineage(_families(classes))
    decided = _similar(_of_families(families, percent), classes, texts, percent, by_row, best=True)
    led = _similar(_of_leaders(classes, decided, _leaders(families), percent), classes, texts, percent, by_row)
    decided = cut_lineage(decided.union(led).distinct())
    more = _similar(_of_prefixes(classes, decided, percent), classes, texts, percent, by_row)

    matched = cut_lineage(decided.union(more).distinct().withColumn("matched", F.lit(True)))
    slot = bitmap_slot("id")
    maybe = in_bitmap(bitmap(matched.select(slot.alias("slot"))), slot)
    touched = cut_lineage(classes.where(maybe | (F.col("members") > 1))
                          .select("id", "key", "check", "members", F.struct("doc_id", "line_no", "row").alias("at"))
                          .join(matched, "id", "left").where("members > 1 or matched")
                          .select("key", "check", F.col("at.doc_id").alias("r_doc"), F.col("at.line_no").alias("r_line"),
                                  F.col("at.row").alias("r_row"), F.coalesce("matched", F.lit(False)).alias("matched")))
    # lines of classes of one line that matches no earlier one are not shuffled (or few of them)
    held = in_bitmap(bitmap(touched.select(bitmap_slot("key").alias("slot"))), bitmap_slot("key"))
    copy = _earlier(("r_doc", "r_line", "r_row"), ("doc_id", "line_no", "row"), by_row)
    gone = cut_lineage(lines.select(*_PLACE, "key", "check").where(held).join(touched, ["key", "check"])
                       .where(F.col("matched") | copy).select(*_PLACE))
    delete_folder(spark, folder)
    return gone


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                  by_row: bool = False) -> DataFrame:
    """``doc_id, row, line_no, removed`` of every line of every row (``row``: the hash of its text).

    With ``by_row``, of lines that agree in doc_id and line number that of the smallest ``row`` is the earliest.
    """
    texts = texts_of(docs, id_col, text_col)
    place = F.struct(*_PLACE).alias("place")
    gone = _gone(texts, percent, by_row).select(place).distinct().withColumn("gone", F.lit(True))
    return (_lines(texts).select(*_PLACE, place).join(gone, "place", "left")
            .select(*_PLACE, F.col("gone").isNotNull().alias("removed")))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without their removed lines; all other columns but ``n_chars`` stay as they are.

    Documents that lose all their lines with words go.  Documents without removed lines are not
    touched; each row loses its own lines, also where several share a doc_id or have none.
    """
    own, row, gone, left = (spare(docs, c) for c in ("_id", "_row", "_gone", "_left"))
    marks = (_gone(texts_of(docs), percent, by_row=True).groupBy(F.col("doc_id").alias(own), F.col("row").alias(row))
             .agg(F.collect_set("line_no").alias(gone)))
    same = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == marks[row]
    rows = docs.join(marks, docs["doc_id"].eqNullSafe(marks[own]) & same, "left")
    untouched = F.col(gone).isNull()
    kept = F.filter(F.split(docs["text"], "\n"), lambda line, i: ~F.array_contains(gone, i))
    rows = rows.withColumn(left, F.when(untouched, F.col("text")).otherwise(F.array_join(kept, "\n")))
    rows = rows.where(untouched | F.col(left).rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(untouched, F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    """Per document the number of its lines, of those removed, and their numbers."""
    texts = texts_of(docs)
    sizes = texts.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.lit(None).cast("int").alias("line_no"))
    gone = _gone(texts, 80, False).select("doc_id", F.lit(0).cast("long").alias("lines"), "line_no")
    listed = F.array_join(F.array_sort(F.collect_list("line_no")).cast("array<string>"), ",")
    return sizes.union(gone).groupBy("doc_id").agg(F.sum("lines").alias("n_lines"), F.count("line_no").alias("n_removed"),
                                                   listed.alias("removed_lines"))


ORACLE_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no,
         unnest(string_split(coalesce(text, ''), chr(10))) as line
  from documents
), sets as (
  select doc_id, line_no, list_sort(list_distinct(list_filter(
           regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as words
  from lines
), classes as (
  select words, len(words) as n, min((doc_id, line_no)) as first, row_number() over () as id
  from sets where len(words) > 0 group by words
), freq as (
  select w, count(*) as df from (select unnest(words) as w from classes) group by w
), ranked as (
  select id, n, t.w as w, row_number() over (partition by id order by df, t.w) as place
  from (select id, n, unnest(words) as w from classes) t join freq on freq.w = t.w
), prefix as (
  select id, w from ranked where place <= n - ceil(n * 80 / 100.0) + 1
), pairs as (
  select distinct a.id as a, b.id as b from prefix a join prefix b on a.w = b.w and a.id <> b.id
), matched as (
  select distinct y.id
  from pairs join classes x on x.id = pairs.a join classes y on y.id = pairs.b
  where x.first < y.first and least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
    and 180 * len(list_intersect(x.words, y.words)) >= 80 * (x.n + y.n)
), marks as (
  select s.doc_id, s.line_no, coalesce(c.first < (s.doc_id, s.line_no) or m.id is not null, false) as removed
  from sets s left join classes c on c.words = s.words left join matched m on m.id = c.id
)
select doc_id, count(*) as n_lines, count(*) filter (removed) as n_removed,
       coalesce(string_agg(line_no, ',' order by line_no) filter (removed), '') as removed_lines
from marks group by doc_id
"""
