"""Term counts, document frequencies and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from toposcope.functions.text import alphabetic_words, let, term_counts
from toposcope.settings import checkpointed, stored

KEY = ("doc_id", "para_no")
MAX_TERMS = 1 << 18  # the vector models' default vocabulary size


def count_terms(paragraphs: DataFrame, words: str = "words") -> DataFrame:
    """Replace ``words`` by ``terms``, an array of (term, tf) per row. No shuffle."""
    return paragraphs.withColumn("terms", term_counts(F.col(words))).drop(words)


def term_frequency(paragraphs: DataFrame, key: tuple[str, ...] = KEY, words: str = "words") -> DataFrame:
    """``(key, term, tf)``, one row per document and term. Counted inside each document's row."""
    return paragraphs.select(*key, F.inline(term_counts(F.col(words))))


def listed_terms(counted: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``(key, term, tf)`` of counted rows (see ``count_terms``)."""
    return counted.select(*key, F.inline("terms"))


def contained_terms(counted: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``(key, term)`` of counted rows; the counts are not read."""
    return counted.select(*key, F.explode("terms.term").alias("term"))


def group_term_frequency(words: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``(key, term, tf)`` of a table with one word per row, for groups that span rows."""
    return words.groupBy(*key, "term").agg(F.count("*").alias("tf"))


def document_frequency(doc_term: DataFrame, min_df: int = 2) -> DataFrame:
    """``(term, df, cf)``: documents with the term and its total count, for terms in ``min_df`` or more.

    Counted per task before the shuffle, so a term that is in every document sends one row per task.
    """
    return (
        doc_term.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        .where(F.col("df") >= min_df)
    )


def vocabulary(doc_freq: DataFrame, max_terms: int | None = MAX_TERMS) -> DataFrame:
    """``(term_id, term, df, cf)``, ids from 0 by falling total count, then by term.

    With ``max_terms`` the first terms of that order are kept, as vector models need a bounded width.
    ``None`` keeps every term and numbers them with ``number_rows``.
    """
    order = [F.desc("cf"), F.asc("term")]
    if max_terms is None:
        return number_rows(doc_freq, order, "term_id").select("term_id", "term", "df", "cf")
    kept = most_frequent(doc_freq, "cf", max_terms)
    # At most max_terms rows reach the ranking task.
    return kept.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("term_id"), "term", "df", "cf")


def most_frequent(doc_freq: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` terms with the greatest ``by``, ties by term.

    A limit over a sort lets every task send n rows to one. A coarse histogram (a few hundred rows)
    gives a frequency that at least n terms reach, so that little more than n rows are sent in all.
    The frequencies are stored first: they are read twice, and may rest on a pass over all texts.
    """
    doc_freq = stored(doc_freq)
    level = F.floor(F.log2(F.col(by)) * 16).cast("int")
    from_top = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = doc_freq.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    needed = levels.withColumn("above", F.coalesce(F.sum("n").over(from_top), F.lit(0))).where(F.col("above") < n)
    lowest = needed.agg(F.min("level")).scalar()
    return doc_freq.where(level >= lowest).orderBy(F.desc(by), F.asc("term")).limit(n)


def sizes(table: DataFrame, level: Column) -> list[Row]:
    """``(level, n)``: the rows of each level, the highest first."""
    return table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()


def common_rows(table: DataFrame, by: str, n: int = MAX_TERMS) -> Column:
    """Condition that holds for at most ``n`` rows of a stored table, those with the greatest ``by`` (at least 1).

    Whole levels of ``by`` (16 a power of two) from the top, counted first. Terms and forms follow Zipf's law, so these
    few rows meet most tokens: they can be shared with the tasks, and only the tokens of the others need a shuffle.
    """
    level = F.floor(F.log2(F.col(by)) * 16).cast("int")
    lowest = None
    for row in sizes(table, level):
        n -= row["n"]
        if n < 0:
            break
        lowest = row["level"]
    return F.lit(False) if lowest is None else level >= lowest


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number the rows of a total order from 0 without bringing them into one task.

    The rows are range-sorted and checkpointed with their partition-wise positions; the first number
    of each partition follows from one count per partition.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_position", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_position", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.col("_position").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_part", "_offset", "_position")
    )


def least_frequent(doc_freq: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` terms with the smallest ``by`` (at least 1), ties by term; exactly those of a sort and a limit.

    A sort with a limit lets every task send n rows to one. Here the rows are narrowed by counts first, each
    step a histogram over the rows still undecided, of keys that follow the order (``by``, ``term``): levels of
    ``by`` (16 a power of two), then ``by`` itself, then term prefixes of one more character each time. Rows
    whose key is below the bucket of the n-th row are taken; the rows of that bucket stay undecided. Steps end
    when that bucket holds at most n rows, so at most 2n rows reach the sort. Each histogram has at most as many
    rows as there are levels, values in a level, or characters after a prefix.
    """
    doc_freq = stored(doc_freq)
    if n <= 0:
        return doc_freq.limit(0)
    level = F.floor(F.log2(F.greatest(F.col(by), F.lit(1))) * 16).cast("long")
    keys = [level, F.col(by)]
    taken, rest, need = F.lit(False), F.lit(True), n
    longest = None
    step = 0
    while True:
        if step < len(keys):
            key = keys[step]
        else:
            if longest is None:
                longest = doc_freq.where(rest).agg(F.max(F.length("term"))).first()[0] or 0
            if step - len(keys) + 1 > longest:
                break
            key = F.substring("term", 1, step - len(keys) + 1)
        counts = doc_freq.where(rest).groupBy(key.alias("k")).count().orderBy("k").collect()
        below = 0
        for row in counts:
            if below + row["count"] >= need:
                break
            below += row["count"]
        else:
            taken = taken | rest  # fewer than n rows in all
            break
        taken = taken | (rest & (key < F.lit(row["k"])))
        rest = rest & (key == F.lit(row["k"]))
        need -= below
        step += 1
        if row["count"] <= n:
            break
    return doc_freq.where(taken | rest).orderBy(F.asc(by), F.asc("term")).limit(n)


def hashed_terms(doc_freq: DataFrame, bits: int) -> DataFrame:
    """``(term, slot, sign, df, cf)``: signed feature hashing of every term, as the alternative to cutting rare ones.

    ``slot`` is the first 32 bits of the MD5 of the term (UTF-8) modulo 2^bits, ``sign`` +1 or -1 by the lowest bit
    of the next four. A vector over slots adds sign × weight, so that colliding terms cancel on average.
    """
    digest = F.md5(F.col("term"))
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (1 << bits)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return doc_freq.select("term", slot.alias("slot"), sign.alias("sign"), "df", "cf")


def collision_ledger(hashed: DataFrame) -> DataFrame:
    """``(slot, n_terms, cf, lost_cf, signed_cf)`` of every slot that two terms or more share.

    ``lost_cf`` is the count of all but the heaviest term (the mass a slot lends to others), ``signed_cf`` what
    the signs leave of the slot's count. One aggregation, summed per task before its shuffle.
    """
    found = hashed.groupBy("slot").agg(
        F.count("*").alias("n_terms"), F.sum("cf").alias("cf"), F.max("cf").alias("most"), F.sum(F.col("sign") * F.col("cf")).alias("signed_cf")
    )
    return found.where("n_terms >= 2").select("slot", "n_terms", "cf", (F.col("cf") - F.col("most")).alias("lost_cf"), "signed_cf")


def trim_vocabulary(doc_freq: DataFrame, n: int, keep: str = "most") -> DataFrame:
    """The ``n`` terms with the highest (``most``) or lowest (``least``) document frequency."""
    if keep == "most":
        return most_frequent(doc_freq, "df", n)
    return least_frequent(doc_freq, "df", n)


def filter_extremes(
    doc_freq: DataFrame, n_docs: int | Column, no_below: int = 11, no_above: float = 0.5, keep_n: int | None = None
) -> DataFrame:
    """Terms in at least ``no_below`` documents and at most a share ``no_above``; with ``keep_n`` its most frequent ones only."""
    kept = doc_freq.where((F.col("df") >= no_below) & (F.col("df") <= F.lit(n_docs) * no_above))
    return kept if keep_n is None else most_frequent(kept, "df", keep_n)


def normalise_words(docs: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """``(key, words)`` with lower-cased alphabetic words, used for the dictionary and for look-ups alike."""
    return docs.select(*key, alphabetic_words(F.col(text)).alias("words"))


def min_nonzeros(
    doc_term: DataFrame, terms: DataFrame, minimum: int = 0, key: tuple[str, ...] = KEY
) -> DataFrame:
    """``(key, n_terms)`` of the documents with more than ``minimum`` different vocabulary terms.

    The terms are stored first, so that AQE can split a frequent one in a shuffle join.
    """
    return (
        doc_term.join(stored(terms.select("term")), "term")
        .groupBy(*key)
        .agg(F.count("*").alias("n_terms"))
        .where(F.col("n_terms") > minimum)
    )


def inconsistent_terms(doc_term: DataFrame, paragraphs: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Counted terms that do not occur in the document's words, or have no count; expected empty."""
    words = paragraphs.select(*key, F.explode(F.array_distinct("words")).alias("term"))
    absent = doc_term.join(words, [*key, "term"], "left_anti")
    return absent.unionByName(doc_term.where(F.col("tf") <= 0))


def inconsistent_counts(words: Column, counted: Column) -> Column:
    """The same inside a row: those (term, tf) of ``counted`` whose term isn't among ``words`` or has no count."""
    absent = F.array_except(counted["term"], words)
    return let(absent, lambda a: F.filter(counted, lambda t: F.array_contains(a, t["term"]) | (t["tf"] <= 0)))
