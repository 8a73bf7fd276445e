"""Train and held-out documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposcope.operators.terms import KEY

BUCKETS = 1000


def split_bucket(key: tuple[str, ...], seed: int = 1) -> Column:
    """A bucket in 0..999 that depends on the document key and the seed only."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % BUCKETS


def train_held_out(
    df: DataFrame, fraction: float = 0.8, key: tuple[str, ...] = KEY, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together hold every row.

    The draw is a hash of the key: the same document falls into the same part in every run and every
    recomputation, and the complement needs no set difference.
    """
    bucket = split_bucket(key, seed)
    return df.where(bucket < fraction * BUCKETS), df.where(bucket >= fraction * BUCKETS)


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Random sample without replacement."""
    return df.sample(False, fraction, seed)


def rows_not_in(df: DataFrame, other: DataFrame) -> DataFrame:
    """Set difference over whole rows; like the SQL operator it also removes duplicate rows."""
    return df.subtract(other)
