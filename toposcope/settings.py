"""Session helpers: where checkpoints go, and when a table may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BROADCAST_ROWS = 1_000_000
SPREAD_BYTES = 256 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named in ``spark.checkpoint.dir``; only a local session may go without one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="toposcope-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared checkpoint folder, so that values such as row positions stay fixed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table_folder(spark: SparkSession) -> str:
    """A new folder for a table beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete the files of a table that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_stored(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote."""
    for folder in {found[0] for file in df.inputFiles() if (found := re.match(r".*/tables/[0-9a-f]{32}(?=/)", file))}:
        discard(df.sparkSession, folder)


def collected(spark: SparkSession) -> None:
    """Have the shuffle files of tables that are gone deleted now, not when the driver happens to collect its garbage."""
    spark._jvm.System.gc()


@contextmanager
def tasks_as_laid(spark: SparkSession) -> Iterator[None]:
    """While a table is written: every part of a union has its own task, and shuffle files go with the write."""
    held = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = spark.conf.getAll
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in held:
            if name in before:
                spark.conf.set(name, before[name])
            else:
                spark.conf.unset(name)


def stored(df: DataFrame, vectors: tuple[str, ...] = ()) -> DataFrame:
    """Write a large intermediate table as parquet beside the checkpoints and read it back.

    For tables that several later passes read, each with few columns: the lineage ends here, a lost
    executor costs a read, and unused columns are not read. Columns named in ``vectors`` hold the fields of
    an ML vector and come back as ML vectors: their files have the same columns.
    """
    spark = df.sparkSession
    path = table_folder(spark)
    df.write.parquet(path)
    schema = StructType([StructField(f.name, VectorUDT()) if f.name in vectors else f for f in df.schema])
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Spread a small table with fewer splits than cores over all cores.

    Text work costs far more per byte than reading, so one file's few splits would leave cores idle. A table
    of more than ``SPREAD_BYTES`` on disk is never shuffled: its splits follow ``spark.sql.files.*``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(df) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)


def planned_bytes(df: DataFrame) -> int:
    """Size of a plan's rows by Spark's own estimate; that of a scan is the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def computed_once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Add a costly column (a vector transform, say) so that later uses do not compute it again.

    Spark merges neighbouring projections and repeats the expression for each use; it does not merge
    across a generator. (An outer generator, as for others Spark adds a filter on the array.)
    """
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(column)).alias(name))


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows`` rows; otherwise leave the join to AQE.

    Meant for narrow parameter tables (stop words, lexicon, labels). Beyond the bound the join is a
    shuffle join with adaptive skew handling, with the same result.
    """
    counted = df.limit(max_rows + 1).count()
    return F.broadcast(df) if counted <= max_rows else df


def row_count(df: DataFrame) -> Column:
    """Row count as a scalar subquery, so that a plan that needs it stays one lazy plan."""
    return df.agg(F.count("*")).scalar()


def term_table(spark: SparkSession, terms: list[str], matrix: np.ndarray | None = None, name: str = "vec") -> DataFrame:
    """``(term_id, term)`` of a fitted model's vocabulary, with the rows of a parameter matrix as ``name``."""
    columns = {"term_id": pa.array(np.arange(len(terms), dtype=np.int32)), "term": pa.array(terms, pa.string())}
    if matrix is not None:
        flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel())
        offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int64) * matrix.shape[1])
        columns[name] = pa.LargeListArray.from_arrays(offsets, flat)
    return spark.createDataFrame(pa.table(columns))
