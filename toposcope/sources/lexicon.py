"""Lexicon and tag tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.sources.text import read_lines

# Treebank tag -> lexicon tag.
TREEBANK_TAGS = {
    "NC": "nc", "VPP": "v", "VINF": "v", "N": "nc", "V": "v", "VS": "v", "PRO": "pro", "ADJ": "adj",
    "VPR": "v", "NPP": "nc", "DETWH": "det", "PROREL": "prel", "VIMP": "v", "ADV": "adv", "P": "prep",
    "DET": "det", "CS": "csu", "CLO": "pro", "I": "nc", "C": "pri", "CLS": "pro", "PUNC": "puncts",
    "CC": "coo", "ET": "nc", "ADVWH": "pri", "ADJWH": "det", "PROWH": "prel", "CL": "cla", "CLR": "clr",
}

# Lexicon tags whose tokens are dropped.
STOP_TAGS = ["det", "pro", "prel", "puncts", "cla", "clr", "prep", "csu", "adv", "coo", "pri"]

# Punctuation that ends a sentence.
SENTENCE_ENDS = [".", "...", "?", "!"]


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(form, pos, lemma, line_no)`` of a tab-separated lexicon; the line number decides precedence."""
    field = F.split("line", "\t")
    return read_lines(spark, path).select(
        field[0].alias("form"), field[1].alias("pos"), field[2].alias("lemma"), "line_no"
    )


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """``(tag, pos)`` of a tab-separated file, to replace the built-in map."""
    return spark.read.csv(path, sep="\t", schema="tag string, pos string")
