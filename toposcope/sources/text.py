"""Corpus readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.functions.text import lines_of
from toposcope.settings import checkpointed, small


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``doc_id`` (the file's address) and ``text``. For many small files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def document_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, line_no, line)`` of a table with one text per row. No shuffle."""
    return docs.select(doc, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, line_no, line)`` of text files that may each be far larger than one task's memory.

    A file is read in splits. Within a split Spark keeps the line order, so a line's number is its
    place in the split plus the number of lines in the splits before it. Those offsets come from one
    row per split, not from a sort of the lines. The tagged lines are checkpointed first: the split
    borders must be the same for the offsets and for the lines.
    """
    tagged = checkpointed(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("doc_id"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("position"),
            F.col("value").alias("line"),
        )
    )
    before = Window.partitionBy("doc_id").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        tagged.groupBy("doc_id", "split_start")
        .agg(F.count("*").alias("n_lines"), F.min("position").alias("first_position"))
        .select(
            "doc_id",
            "split_start",
            "first_position",
            F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("offset"),
        )
    )
    return tagged.join(small(checkpointed(splits)), ["doc_id", "split_start"]).select(
        "doc_id", (F.col("position") - F.col("first_position") + F.col("offset")).alias("line_no"), "line"
    )
