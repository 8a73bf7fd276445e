"""Paragraph segmentation and stop-word removal.

A paragraph is a run of lines between separator lines (speaker names, numbers, dots, blank lines).
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toposcope.functions.text import is_separator, line_tokens, lines_of, paragraphs_of
from toposcope.settings import small, stored

BUCKET_LINES = 65_536


def tagged_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, line_no, tokens, is_separator)`` of every line."""
    lines = docs.select(doc, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    tokens = lines.select(doc, "line_no", line_tokens(F.col("line")).alias("tokens"))
    return tokens.withColumn("is_separator", is_separator(F.col("tokens")))


def segment_documents(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    keep_trailing: bool = False,
    emit: str = "separator",
    drop_words: list[str] | None = None,
    strip: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Paragraphs ``(doc, carry, para_no, words)`` of a table with one text per row.

    All of a document's lines are in its row, so no line is shuffled. For texts that come as rows of
    lines use ``segment_lines``.
    """
    found = paragraphs_of(lines_of(F.col(text)), keep_trailing, emit, drop_words, strip)
    return docs.select(doc, *carry, F.posexplode(found).alias("para_no", "words"))


def segment_lines(
    lines: DataFrame,
    doc: str = "doc_id",
    order: str = "line_no",
    line: str = "line",
    keep_trailing: bool = False,
    emit: str = "separator",
    bucket_lines: int = BUCKET_LINES,
    strip: bool = False,
) -> DataFrame:
    """Paragraph lines ``(doc, para_no, order, words)`` of a table of lines, one row per kept line.

    One document may hold most of the lines, so it is never sorted in one task: lines are grouped into
    buckets of ``bucket_lines`` numbers, each bucket counts the paragraphs that start in it, and a
    running sum over the bucket rows (one per bucket) gives every bucket its first paragraph number.
    The single shuffle of lines is on (doc, bucket). ``order`` must be a whole number.
    """
    text = F.trim(F.col(line)) if strip else F.col(line)
    rows = lines.select(
        doc, order, F.floor(F.col(order) / bucket_lines).alias("bucket"), line_tokens(text).alias("words")
    ).withColumn("separator", is_separator(F.col("words")))

    inside = Window.partitionBy(doc, "bucket")
    ordered = inside.orderBy(order)
    after_separator = F.coalesce(F.lag("separator").over(ordered), F.lit(False))
    rows = rows.withColumn("opens", (~F.col("separator") & after_separator).cast("long"))
    rows = rows.withColumn("opened", F.sum("opens").over(ordered)).withColumn(
        "last_text", F.max(F.when(~F.col("separator"), F.col(order))).over(inside)
    )
    in_tail = F.col("separator") & (F.col("last_text").isNull() | (F.col(order) > F.col("last_text")))
    buckets = rows.groupBy(doc, "bucket").agg(
        F.min_by("separator", order).alias("first_separator"),
        F.max_by("separator", order).alias("last_separator"),
        F.sum("opens").alias("inner_opens"),
        F.count_if(in_tail).alias("tail"),
        F.bool_or(~F.col("separator")).alias("has_text"),
    )

    of_doc = Window.partitionBy(doc)
    by_bucket = of_doc.orderBy("bucket")
    fresh = F.coalesce(F.lag("last_separator").over(by_bucket), F.lit(True))
    buckets = buckets.withColumn("carry", (~F.col("first_separator") & fresh).cast("long")).withColumn(
        "last_text_bucket", F.max(F.when(F.col("has_text"), F.col("bucket"))).over(of_doc)
    )
    starts = F.col("inner_opens") + F.col("carry")
    buckets = buckets.select(
        doc,
        "bucket",
        (
            F.coalesce(F.sum(starts).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            + F.col("carry")
        ).alias("first_para"),
        F.sum(starts).over(of_doc).alias("n_paras"),
        F.sum(F.when(F.col("bucket") >= F.col("last_text_bucket"), F.col("tail"))).over(of_doc).alias("doc_tail"),
    )

    lines_needed = {"separator": 1, "next_line": 2}[emit]
    para_no = F.col("first_para") + F.col("opened") - 1
    closed = (para_no < F.col("n_paras") - 1) | (F.col("doc_tail") >= lines_needed)
    return (
        rows.where(~F.col("separator"))
        .join(buckets, [doc, "bucket"])
        .where(F.lit(keep_trailing) | closed)
        .select(doc, para_no.cast("int").alias("para_no"), order, "words")
    )


def assemble_paragraphs(paragraph_lines: DataFrame, doc: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Paragraphs ``(doc, para_no, words)`` from paragraph lines; a paragraph becomes one row."""
    line = F.struct(F.col(order), F.col("words"))
    return (
        paragraph_lines.groupBy(doc, "para_no")
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
        .select(doc, "para_no", F.flatten("lines.words").alias("words"))
    )


def remove_stop_words(
    paragraphs: DataFrame, stop_words: list[str], case_sensitive: bool = False, drop_empty: bool = True
) -> DataFrame:
    """Drop stop words from ``words``, then rows without a word left. Repeated words stay repeated.

    The list is a parameter of the run (hundreds of words); it is looked up in a hash set per word.
    """
    remover = StopWordsRemover(
        inputCol="words", outputCol="kept", stopWords=stop_words, caseSensitive=case_sensitive, locale="en_US"
    )
    out = remover.transform(paragraphs).drop("words")
    others = [c for c in out.columns if c != "kept"]
    if not drop_empty:
        return out.withColumnRenamed("kept", "words")
    # A plain filter on the size would make Spark look every word up twice, once for the filter.
    full = F.filter(F.array("kept"), lambda w: F.size(w) > 0)
    return out.select(*others, F.explode(full).alias("words"))


def stop_list(words: DataFrame, max_words: int = 100_000) -> list[str]:
    """A stop-word table as a Python list; refuses tables that are no parameter any more."""
    found = [r[0] for r in words.select("word").distinct().limit(max_words + 1).collect()]
    if len(found) > max_words:
        raise ValueError(f"more than {max_words} stop words; use remove_stop_words_by_join")
    return sorted(found)


def remove_stop_words_by_join(doc_term: DataFrame, words: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Long-table form for stop lists of any size: anti join on the (lower-cased) term."""
    # A stop list of checked size is broadcast. Beyond it the list, stored, lets AQE split frequent words.
    if case_sensitive:
        return doc_term.join(small(stored(words.select(F.col("word").alias("term")).distinct())), "term", "left_anti")
    folded = small(stored(words.select(F.lower("word").alias("_folded")).distinct()))
    return doc_term.join(folded, F.lower(doc_term["term"]) == folded["_folded"], "left_anti")
