"""Approximate nearest neighbours by an adaptive dimension scan over an inverted-file index.

Index: k-means centres (Spark ML, fitted on a sample of at most ``FIT_ROWS`` rows) split all rows into
``ceil(sqrt(n))`` lists; every usable row is assigned to its nearest centre, and a query probes the
``probes(lists)`` lists of its nearest centres. Vectors are turned by one random orthogonal matrix, which keeps
distances, so that every block of dimensions carries about the same share of a distance.

Scan: per probed list, a candidate's squared distance is summed one column block (``STEP`` dimensions) at a
time. After ``d`` of ``D`` dimensions, ``partial * D / d`` estimates the full distance; a hypothesis test drops
the candidate when that estimate exceeds the query's current k-th best by the factor ``(1 + EPS / sqrt(d))^2``,
so most far candidates stop after a block or two. Candidates that reach ``D`` dimensions enter the top k.

Spark: lists are cut into member blocks and their queries into query blocks by hash, with block counts from
the counted size of each list, so a list holding a third of all rows becomes many (list, member block, query
block) groups of bounded size, co-grouped and scanned in Arrow batches. Each group returns at most k rows per
query; a windowed top k (limited per partition before the exchange) merges them, and the reported score is the
Euclidean distance of the original vectors, summed left to right in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toposcope.llm.codes import usable
from toposcope.settings import stored

K = 10
EVERY = 100
FIT_ROWS = 50_000  # rows of the k-means sample (bounded; every row is still indexed)
PROBE_SHARE = 0.6  # share of lists a query probes: recall 0.96 on sf0.1, 0.97 on check_s (near-uniform vectors)
LEAST_PROBES = 8
STEP = 8
EPS = 2.1
MEMBER_BLOCK = 4096
QUERY_BLOCK = 512
SEED = 17


def probes(lists: int) -> int:
    return min(lists, max(LEAST_PROBES, math.ceil(PROBE_SHARE * lists)))


def usable_rows(df: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """``(vec_id, v)`` of rows that take part, and their width.

    A row takes part when its id is not null and its vector is not null, holds no null, NaN or infinite
    component and not only zeros. The width is that of the smallest such id (then the least vector); rows of
    another width take no part. Other columns are not read.
    """
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    first = rows.orderBy("vec_id", "v").select(F.size("v")).limit(1).collect()
    width = first[0][0] if first else 0
    return rows.where(F.size("v") == width), width


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two equally long double arrays, summed from the first component on."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _lists(v: np.ndarray, centres: np.ndarray, probed: int) -> np.ndarray:
    """Nearest centre of each row (``probed`` = 0), else the ``probed`` nearest; rows × centres numbers at a time."""
    near = (centres**2).sum(axis=1)[None, :] - 2 * v @ centres.T
    return near.argmin(axis=1)[:, None] if not probed else np.argsort(near, axis=1, kind="stable")[:, :probed]


def _index(centres: np.ndarray, turn: np.ndarray, probed: int):
    """Per batch: each row's nearest list and turned vector; with ``probed``, one row per probed list instead."""

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            v = np.stack(frame["v"].to_numpy())
            lists = np.concatenate([_lists(v[low : low + 1024], centres, probed) for low in range(0, len(v), 1024)])
            at = np.repeat(np.arange(len(v)), lists.shape[1])
            turned = list(v @ turn)
            yield pd.DataFrame(
                {
                    "vec_id": frame["vec_id"].to_numpy()[at],
                    "list_id": lists.ravel().astype(np.int32),
                    "r": [turned[i] for i in at],
                    "v": [frame["v"].iloc[i] for i in at],
                }
            )

    return run


def scan(queries: np.ndarray, query_ids: np.ndarray, members: np.ndarray, member_ids: np.ndarray, k: int = K) -> list[tuple[int, int]]:
    """``(query, member)`` index pairs of each query's k nearest members found by the adaptive scan.

    Exact ties are kept in id order; a member with the query's id is skipped.
    """
    width = members.shape[1] if members.ndim == 2 else 0
    found = []
    if not len(members) or not len(queries):
        return found
    for i, (q, qid) in enumerate(zip(queries, query_ids)):
        alive = np.flatnonzero(member_ids != qid)
        best_d, best_j = np.zeros(0), np.zeros(0, int)
        for low in range(0, len(alive), 512):
            idx, part = alive[low : low + 512], np.zeros(min(512, len(alive) - low))
            threshold = best_d[k - 1] if len(best_d) >= k else np.inf
            for d in range(0, width, STEP):
                block = members[idx, d : d + STEP] - q[d : d + STEP]
                part += np.einsum("ij,ij->i", block, block)
                seen = min(d + STEP, width)
                if seen < width and np.isfinite(threshold):
                    keep = part * width / seen <= threshold * (1 + EPS / math.sqrt(seen)) ** 2
                    idx, part = idx[keep], part[keep]
                    if not len(idx):
                        break
            if len(idx):
                d_all, j_all = np.concatenate([best_d, part]), np.concatenate([best_j, idx])
                top = np.lexsort((member_ids[j_all], d_all))[:k]
                best_d, best_j = d_all[top], j_all[top]
        found.extend((i, j) for j in best_j)
    return found


def _scanned(k: int):
    def run(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "qv": pd.Series([], dtype=object), "cv": pd.Series([], dtype=object)})
        x, q = np.stack(members["r"].to_numpy()), np.stack(asked["r"].to_numpy())
        pairs = scan(q, asked["vec_id"].to_numpy(), x, members["vec_id"].to_numpy(), k)
        qi, mi = (np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
        qv, cv = asked["v"].to_numpy(), members["v"].to_numpy()
        return pd.DataFrame({"query_id": asked["vec_id"].to_numpy()[qi], "vec_id": members["vec_id"].to_numpy()[mi], "qv": pd.Series([qv[i] for i in qi], dtype=object), "cv": pd.Series([cv[i] for i in mi], dtype=object)})

    return run


def nearest(df: DataFrame, column: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for every usable row whose id is divisible by 100.

    Candidates are all usable rows but those with the query's id; the score is the Euclidean distance of the
    original vectors, ranks run from 1 by score, then vec_id. Fewer than k candidates: all of them. A repeated
    query id asks once, with its least vector; a repeated candidate id is a candidate per row. No usable rows:
    no result.
    """
    spark = df.sparkSession
    rows, width = usable_rows(df, column)
    rows = stored(rows)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(math.ceil(math.sqrt(n)), FIT_ROWS // 16))
    sample = rows.sample(fraction=min(1.0, FIT_ROWS / n), seed=SEED).select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists, seed=SEED, maxIter=20, initSteps=2).fit(sample)
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    probed = probes(len(centres))
    schema = "vec_id long, list_id int, r array<double>, v array<double>"
    ask = rows.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    turn = rotation(width)
    listed = stored(rows.mapInPandas(_index(centres, turn, 0), schema))
    probing = stored(ask.mapInPandas(_index(centres, turn, probed), schema))
    m = dict(listed.groupBy("list_id").count().collect())  # one row per list: at most FIT_ROWS / 16
    q = dict(probing.groupBy("list_id").count().collect())
    blocks = spark.createDataFrame([(i, -(-m.get(i, 0) // MEMBER_BLOCK) or 1, -(-q.get(i, 0) // QUERY_BLOCK) or 1) for i in m.keys() | q.keys()], "list_id int, nm int, nq int")
    blocks = F.broadcast(blocks)
    cut = lambda n_: F.pmod(F.xxhash64("vec_id"), F.col(n_)).cast("int")
    members = listed.join(blocks, "list_id").select("list_id", cut("nm").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "vec_id", "r", "v")
    asked = probing.join(blocks, "list_id").select("list_id", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), cut("nq").alias("qb"), "vec_id", "r", "v")
    found = members.groupBy("list_id", "mb", "qb").cogroup(asked.groupBy("list_id", "mb", "qb")).applyInPandas(_scanned(k), "query_id long, vec_id long, qv array<double>, cv array<double>")
    found = found.select("query_id", "vec_id", distance(F.col("qv"), F.col("cv")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
