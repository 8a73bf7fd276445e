"""Truncated SVD by randomised subspace iteration, with V as a distributed table and no bound on the vocabulary.

A is documents × terms, given as rows ``(key, ids, weights)``. With ``width = rank + oversample``:

1. ``Y = A Ω``: Ω is a Gaussian test matrix (terms × width) whose entries are hashes of (term, column), made in
   the tasks where a term occurs; it is never stored or sent.
2. Power steps: ``Y = A Aᵀ Q`` with ``Q`` the orthonormalised ``Y`` of the step before, so that the leading singular
   directions dominate ``Y``.
3. With ``Q`` from the last ``Y``, the QR of ``Aᵀ Q`` gives ``R``; the SVD ``R = U S Wᵀ`` gives ``σ = S``, and
   ``V = Aᵀ (Q W S⁻¹)`` is computed where the terms are.

Orthonormalisation is a tall-skinny QR by a tree: every task reduces its rows to a width × width ``R``; groups
of ``FAN_IN`` such ``R`` are stacked and reduced again, until one is left; ``Q = Y R⁻¹`` is then applied in the
rows. There are many more terms than documents in a corpus with names and misspelt words, so what is as tall as the
terms never leaves a task: the terms lie in blocks, about one per core, each document in one piece per block. Columns are
worked through in panels, as many at a time as ``PANEL_BYTES`` hold rows of ``Q`` for all documents and of ``Aᵀ Q`` for a
block's terms. A block's task reads the panel of ``Q`` and its own pieces twice straight from their files, first to make
``Aᵀ Q``, then to multiply by A; what blocks add to a document is summed over the only shuffle, one panel's. Panels lie
by groups of documents, so that a group's rows are put together in one task. Tables go as soon as the next is made.
Steps before the last send single precision, as they only have to find the space; the last one is in double precision.
The QR of ``Aᵀ Q`` is that of its Gram matrix ``Qᵀ A Aᵀ Q``, taken twice: the second is made from the columns that the first has
scaled, and so corrects what squaring lost (Cholesky QR 2). As A Aᵀ squares them, directions with σ below a millionth of
the largest are dropped. The driver holds width × width matrices only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.functions.vectors import norm
from toposcope.operators.nearest import top_rows
from toposcope.settings import collected, computed_once, discard, stored, table_folder, tasks_as_laid

OVERSAMPLE = 10
POWER_STEPS = 4
BLOCK_ENTRIES = 64_000_000
LEAST_ENTRIES = 200_000  # fewer are not split further over idle cores
LEAST_DOCS = 2_000  # as few documents a group
PIECE = 16_384  # entries multiplied at once
PANEL = 32  # columns of a panel at most, more where a group of documents holds what the blocks add
PANEL_BYTES = 160 << 20  # of Q's rows and a block's terms, columns of one panel
GROUP_BYTES = 64 << 20  # of one group of documents, all columns, or what blocks add to a panel of it
FAN_IN = 16
LEAST_ROOT = 2.5e-13  # of a Gram matrix's largest eigenvalue: σ half a millionth of the largest
SEED = 0x2545F4914F6CDD1D


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def test_rows(ids: np.ndarray, width: int, seed: int = SEED, columns: slice = slice(None)) -> np.ndarray:
    """Rows ``ids`` of the hashed Gaussian test matrix (len(ids) × width): the same numbers in every task."""
    cell = ids.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)[None, columns]
    with np.errstate(over="ignore"):
        a, b = _mixed(cell + np.uint64(seed)), _mixed(cell ^ np.uint64(seed * 3 % (1 << 64)))
    u1 = ((a >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    u2 = (b >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)


def _flat(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, in its own precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's entries begin (and the end of all), term ids and weights of ``(ids, weights)`` rows."""
    ids, weights = rows["ids"].combine_chunks(), rows["weights"].combine_chunks()
    lengths = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(lengths, dtype=np.int64)], ids.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)


def _sums(begin: np.ndarray, at: np.ndarray, weight: np.ndarray | None, table: np.ndarray) -> np.ndarray:
    """Row r is the sum of ``weight * table[at]`` over the entries from ``begin[r]`` to ``begin[r + 1]``; some
    ``PIECE`` entries at a time, one row at least."""
    out, low, n = np.zeros((len(begin) - 1, table.shape[1])), 0, len(begin) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + PIECE, side="right")) - 1)
        first, last = begin[low], begin[high]
        own = low + np.flatnonzero(np.diff(begin[low : high + 1]))
        if len(own):
            part = np.take(table, at[first:last], axis=0).astype(np.float64, copy=False)
            if weight is not None:
                part *= weight[first:last, None]
            out[own] = np.add.reduceat(part, begin[own] - first, axis=0)
        low = high
    return out


def _grouped(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries ordered by ``at`` (0 to n - 1), and where each value's begin."""
    return np.argsort(at, kind="stable"), np.r_[0, np.cumsum(np.bincount(at, minlength=n), dtype=np.int64)]


def _bytes(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """One binary value per row: the numbers from ``begin[r]`` to ``begin[r + 1]``."""
    offsets = pa.py_buffer((begin * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column without nulls, and where each row's begin (and the end of all)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size, data = np.dtype(kind).itemsize, column.buffers()[2]
    n = int(offsets[-1] - offsets[0]) // size
    return np.frombuffer(data, kind, n, int(offsets[0])) if n else np.zeros(0, kind), (offsets - offsets[0]) // size


def _rows(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    return _bytes(values, np.arange(len(values) + 1, dtype=np.int64) * values.shape[1])


def _in_turn(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``(kind, rows)`` by rising ``kind``, of which there are ``sizes`` rows each; what comes early waits."""
    early, left, now = [[] for _ in sizes], list(sizes), 0
    for batch in batches:
        kinds = batch["kind"].to_numpy()
        for low, high in pairwise(np.r_[0, np.flatnonzero(np.diff(kinds)) + 1, len(kinds)]):
            if high > low:
                early[kinds[low]].append(batch.slice(low, high - low))
        while now < len(sizes):
            for part in early[now]:
                left[now] -= part.num_rows
                yield now, part
            early[now] = []
            if left[now] > 0:
                break
            now += 1


def tsqr(df: DataFrame, column: str, width: int) -> np.ndarray:
    """``R`` (width × width, upper triangular) of the QR of the rows ``column``, reduced by a tree of tasks."""

    def local(batches):
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack([r, _flat(batch.column(0), width)]), mode="r")
        if len(r):
            yield pa.record_batch({"r": _lists(np.pad(r, ((0, width - len(r)), (0, 0))).ravel()[None, :], width * width)})

    level = df.select(column).mapInArrow(local, "r array<double>")
    while True:
        level = stored(level)
        n = level.count()
        if n <= 1:
            break

        def merged(frame: pd.DataFrame) -> pd.DataFrame:
            stacked = np.vstack([np.asarray(x).reshape(width, width) for x in frame["r"]])
            return pd.DataFrame({"r": [np.linalg.qr(stacked, mode="r").ravel()]})

        groups = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(math.ceil(n / FAN_IN)))
        level = level.groupBy(groups.alias("g")).applyInPandas(merged, "r array<double>")
    rows = level.select("r").collect()
    return np.asarray(rows[0][0]).reshape(width, width) if rows else np.zeros((width, width))


def _inverse(r: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of ``R``: directions with a diagonal below 1e-12 of the largest are dropped (rank defect)."""
    return np.linalg.pinv(r, rcond=1e-12)


PANEL_SCHEMA = "doc_idx long, z binary, panel int, part int"


@dataclass
class Panels:
    """``width`` numbers for each of ``n_docs`` documents, stored in panels of ``columns`` columns, each ``(doc_idx, z)`` by
    groups (``part``) of documents."""

    spark: SparkSession
    folder: str
    width: int
    columns: int
    kind: type
    groups: int
    n_docs: int

    @property
    def slices(self) -> list[slice]:
        return [slice(c, min(c + self.columns, self.width)) for c in range(0, self.width, self.columns)]

    def table(self) -> DataFrame:
        return self.spark.read.schema(PANEL_SCHEMA).parquet(self.folder)

    def drop(self) -> None:
        discard(self.spark, self.folder)

    def mapped(self, run: Callable[..., Iterator[pa.RecordBatch]], schema: str, *others: Panels) -> DataFrame:
        """What ``run(part, doc_idx, rows, rows of others…)`` yields for each group of documents, put together in one task."""
        panels = [self, *others]
        tables = [p.table().withColumn("which", F.lit(i)) for i, p in enumerate(panels)]
        layout = [(p.slices, p.kind, p.width) for p in panels]

        def local(batches):
            found = [[[] for _ in slices] for slices, _, _ in layout]
            part = None
            for batch in batches:
                where = batch["which"].to_numpy() * (1 << 20) + batch["panel"].to_numpy()
                for low, high in pairwise(np.r_[0, np.flatnonzero(np.diff(where)) + 1, len(where)]):
                    if high > low:
                        part = batch["part"][0].as_py()
                        rows = batch.slice(low, high - low)
                        found[where[low] >> 20][where[low] & 0xFFFFF].append((rows["doc_idx"].to_numpy(), _numbers(rows["z"], layout[where[low] >> 20][1])[0]))
            if part is None:
                return
            whole, names = [], None
            for (slices, kind, width), parts in zip(layout, found, strict=True):
                matrix = None
                for cut, pieces in zip(slices, parts, strict=True):
                    ids = np.concatenate([x for x, _ in pieces])
                    order = np.argsort(ids, kind="stable")
                    names = ids[order] if names is None else names
                    if not np.array_equal(ids[order], names):
                        raise RuntimeError(f"part {part}: panels of different documents")
                    matrix = np.empty((len(ids), width), dtype=kind) if matrix is None else matrix
                    matrix[:, cut] = np.concatenate([x for _, x in pieces]).reshape(len(ids), -1)[order]
                    pieces.clear()
                whole.append(matrix)
            yield from run(part, names, *whole)

        united = reduce(DataFrame.union, tables)
        parts = [united.where(F.col("part") == g).coalesce(1) for g in range(self.groups)]
        return reduce(DataFrame.union, parts).mapInArrow(local, schema)

    def triangle(self) -> np.ndarray:
        """``R`` of the QR of the rows."""

        def run(part, names, rows):
            r = np.zeros((0, rows.shape[1]))
            for low in range(0, len(rows), PIECE):
                r = np.linalg.qr(np.vstack([r, rows[low : low + PIECE]]), mode="r")
            yield pa.record_batch({"y": _lists(r, rows.shape[1])})

        with tasks_as_laid(self.spark):
            return tsqr(stored(self.mapped(run, "y array<double>")), "y", self.width)

    def turned(self, turn: np.ndarray, kind: type = np.float64) -> Panels:
        """The rows times ``turn``."""
        out = Panels(self.spark, table_folder(self.spark), turn.shape[1], self.columns, kind, self.groups, self.n_docs)
        slices = out.slices

        def run(part, names, rows):
            for i, cut in enumerate(slices):
                for low in range(0, len(rows), PIECE):
                    z = (rows[low : low + PIECE] @ turn[:, cut]).astype(kind, copy=False)
                    n = len(z)
                    yield pa.record_batch({"doc_idx": names[low : low + PIECE], "z": _rows(z), "panel": np.full(n, i, np.int32), "part": np.full(n, part, np.int32)})

        with tasks_as_laid(self.spark):
            self.mapped(run, PANEL_SCHEMA).write.partitionBy("panel", "part").parquet(out.folder)
        return out

    def products(self, other: Panels) -> DataFrame:
        """``(g, sizes)`` per group of documents, stored: the products of these columns with the other's, and the squared lengths of the other's."""

        def run(part, names, mine, theirs):
            yield pa.record_batch({"g": _lists((mine.T.astype(np.float64, copy=False) @ theirs).reshape(1, -1), mine.shape[1] * theirs.shape[1]), "sizes": _lists((theirs**2).sum(axis=0)[None, :], theirs.shape[1])})

        with tasks_as_laid(self.spark):
            return stored(self.mapped(run, "g array<double>, sizes array<double>", other))


@dataclass
class Matrix:
    """Pieces ``(doc_idx, ids, weights)`` by ``block``, stored once: a document's terms of each block of terms, numbered in the block."""

    pieces: DataFrame
    n_docs: int
    n_used: int
    n_terms: int
    blocks: int
    rows: dict[int, int]

    @classmethod
    def of(cls, weighted: DataFrame, n_terms: int) -> Matrix:
        spark, length = weighted.sparkSession, F.size("ids")
        nnz, n_docs, n_used = weighted.agg(F.coalesce(F.sum(length), F.lit(0)), F.count("*"), F.count_if(length > 0)).first()
        cores = spark.sparkContext.defaultParallelism
        blocks = max(1, math.ceil(nnz / BLOCK_ENTRIES), min(cores, math.ceil(nnz / LEAST_ENTRIES)))

        def cut(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = pa.Table.from_batches([batch.slice(low, 512)])
                    begin, term, weight = _entries(part)
                    if not len(term):
                        continue
                    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                    where = row * blocks + term % blocks  # ids follow the frequency, so blocks are alike
                    order = np.argsort(where, kind="stable")
                    found, first = np.unique(where[order], return_index=True)
                    ends = np.r_[first, len(term)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_idx"].combine_chunks().take(pa.array(found // blocks)), _bytes((term[order] // blocks).astype(np.int32), ends), _bytes(weight[order], ends), pa.array((found % blocks).astype(np.int32))],
                        names=["doc_idx", "ids", "weights", "block"],
                    )

        folder, schema = table_folder(spark), "doc_idx long, ids binary, weights binary, block int"
        rows = weighted.select(F.monotonically_increasing_id().alias("doc_idx"), F.col("ids").cast("array<int>").alias("ids"), F.col("weights").cast("array<double>").alias("weights"))
        rows.mapInArrow(cut, schema).write.partitionBy("block").parquet(folder)
        pieces = spark.read.schema(schema).parquet(folder)
        sizes = pieces.groupBy("block").count().collect()
        return cls(pieces, n_docs, n_used, n_terms, blocks, {r["block"]: r["count"] for r in sizes})

    @property
    def spark(self) -> SparkSession:
        return self.pieces.sparkSession

    def _panels(self, width: int) -> Panels:
        """Empty panels: as many columns as one task may hold, groups as large as one may put together."""
        most = max(PANEL, GROUP_BYTES // (8 * self.blocks * self.n_used))  # a small table needs few panels
        columns = max(1, min(width, most, PANEL_BYTES // (8 * (self.n_used + math.ceil(self.n_terms / self.blocks)))))
        held = 8 * self.n_used * max(width, self.blocks * columns)
        groups = max(1, math.ceil(held / GROUP_BYTES), min(self.spark.sparkContext.defaultParallelism, self.n_used // LEAST_DOCS))
        return Panels(self.spark, table_folder(self.spark), width, columns, np.float64, groups, self.n_used)

    def _by_block(self, z: Panels | None, panel: int, run, schema: str, passes: int) -> DataFrame:
        """``run(block, parts)`` in one task per block: ``parts`` gives its panel of ``z``, then its pieces ``passes`` times."""
        n, counted = self.n_used if z is not None else 0, self.rows
        columns = ["kind", "block", "doc_idx", "a", "b"]
        pieces = self.pieces.select("block", "doc_idx", F.col("ids").alias("a"), F.col("weights").alias("b"))
        rows = None if z is None else z.table().where(F.col("panel") == panel).select(F.lit(0).alias("kind"), "doc_idx", F.col("z").alias("a"), F.lit(b"").alias("b"))

        def local(batches):
            first = next((b for b in batches if b.num_rows), None)
            if first is None:
                return
            block = first["block"][0].as_py()

            def same():
                for batch in (x for some in ([first], batches) for x in some):
                    if batch.num_rows and (batch["block"].to_numpy() != block).any():
                        raise RuntimeError("blocks of terms share a task")
                    yield batch

            yield from run(block, _in_turn(same(), [n, *[counted[block]] * passes]))

        laid = []
        for b in sorted(counted):
            own = [pieces.where(F.col("block") == b).withColumn("kind", F.lit(k + 1)).select(columns) for k in range(passes)]
            if rows is not None:
                own = [rows.withColumn("block", F.lit(b)).select(columns), *own]
            laid.append(reduce(DataFrame.union, own).coalesce(1))
        return reduce(DataFrame.union, laid).mapInArrow(local, schema)

    def _add(self, parts: DataFrame, out: Panels, panel: int, kind: type) -> None:
        """Store what the blocks add to each document as a panel."""
        cut, groups = out.slices[panel], out.groups
        width = cut.stop - cut.start

        def added(parts: pa.Table) -> pa.Table:
            names, at = np.unique(parts["doc_idx"].to_numpy(), return_inverse=True)
            order, starts = _grouped(at, len(names))
            table = np.concatenate([_numbers(x, kind)[0] for x in parts["z"].chunks]).reshape(-1, width)
            return pa.table({"doc_idx": names, "z": _rows(_sums(starts, order, None, table)), "part": np.full(len(names), parts["part"][0].as_py(), np.int32)})

        part = F.pmod(F.xxhash64("doc_idx"), F.lit(groups)).cast("int").alias("part")
        summed = parts.select("doc_idx", "z", part).groupBy("part").applyInArrow(added, "doc_idx long, z binary, part int")
        summed.write.partitionBy("part").parquet(f"{out.folder}/panel={panel}")

    def times_test(self, width: int) -> Panels:
        """A Ω."""
        out, blocks, n_terms = self._panels(width), self.blocks, self.n_terms
        for panel, cut in enumerate(out.slices):

            def run(block, parts, cut=cut):
                terms = np.arange(block, n_terms, blocks)
                table = np.empty((len(terms), cut.stop - cut.start), dtype=np.float32)
                for low in range(0, len(terms), PIECE):
                    table[low : low + PIECE] = test_rows(terms[low : low + PIECE], width, columns=cut)
                for _, rows in parts:
                    ids, begin = _numbers(rows["a"], np.int32)
                    yield pa.record_batch({"doc_idx": rows["doc_idx"], "z": _rows(_sums(begin, ids, _numbers(rows["b"], np.float64)[0], table))})

            with tasks_as_laid(self.spark):
                self._add(self._by_block(None, 0, run, "doc_idx long, z binary", 1), out, panel, np.float64)
        return out

    def _transposed(self, z: Panels, panel: int) -> Callable[[int, Iterator], tuple[np.ndarray, tuple | None]]:
        """Reads one panel of ``z`` and the pieces once: Aᵀ Z for a block's terms, and the first part of the next kind."""
        cut, n, kind, n_terms, blocks = z.slices[panel], self.n_used, z.kind, self.n_terms, self.blocks
        width = cut.stop - cut.start

        def run(block, parts):
            names, table, at, order = np.empty(n, np.int64), np.empty((n, width), dtype=kind), 0, None
            found = np.zeros((len(range(block, n_terms, blocks)), width))
            for which, rows in parts:
                if which == 0:
                    names[at : at + rows.num_rows] = rows["doc_idx"].to_numpy()
                    table[at : at + rows.num_rows] = _numbers(rows["a"], kind)[0].reshape(-1, width)
                    at += rows.num_rows
                    continue
                if which == 2:
                    return found, (which, rows)
                if order is None:
                    order = np.argsort(names, kind="stable")
                    names = names[order]
                ids, begin = _numbers(rows["a"], np.int32)
                weight = _numbers(rows["b"], np.float64)[0]
                mine = order[np.searchsorted(names, rows["doc_idx"].to_numpy())]
                turn = np.sort((ids.astype(np.int64) << 32) | np.arange(len(ids)))  # by term, the fastest sort there is
                ids, turn = turn >> 32, turn & 0xFFFFFFFF
                starts = np.r_[np.flatnonzero(np.diff(ids, prepend=-1)), len(ids)]
                found[ids[starts[:-1]]] += _sums(starts, np.repeat(mine, np.diff(begin))[turn], weight[turn], table)
            return found, None

        return run

    def normal_times(self, z: Panels, exact: bool) -> Panels:
        """A Aᵀ Z. ``exact`` sends sums in double precision."""
        out = replace(z, folder=table_folder(self.spark), kind=np.float64)
        for panel in range(len(z.slices)):
            self._normal_panel(z, panel, exact, out, panel)
        return out

    def _normal_panel(self, z: Panels, panel: int, exact: bool, out: Panels, to: int) -> None:
        """One panel of A Aᵀ Z, stored as panel ``to`` of ``out``."""
        transposed, kind = self._transposed(z, panel), np.float64 if exact else np.float32

        def run(block, parts):
            table, left = transposed(block, parts)
            for _, rows in (x for some in ([left] if left else [], parts) for x in some):
                ids, begin = _numbers(rows["a"], np.int32)
                sums = _sums(begin, ids, _numbers(rows["b"], np.float64)[0], table).astype(kind, copy=False)
                yield pa.record_batch({"doc_idx": rows["doc_idx"], "z": _rows(sums)})

        with tasks_as_laid(self.spark):
            self._add(self._by_block(z, panel, run, "doc_idx long, z binary", 2), out, to, kind)

    def transpose_times(self, z: Panels, concepts: int) -> DataFrame:
        """``(term_id, first, vec)``: the columns of Aᵀ Z below ``concepts``, a panel (from column ``first``) in a row; stored."""
        parts, blocks, n_terms = [], self.blocks, self.n_terms
        for panel, cut in enumerate(z.slices):
            if cut.start >= concepts:
                break
            transposed, width = self._transposed(z, panel), min(cut.stop, concepts) - cut.start

            def run(block, parts, transposed=transposed, width=width, first=cut.start):
                table, _ = transposed(block, parts)
                terms = np.arange(block, n_terms, blocks, dtype=np.int32)
                for low in range(0, len(terms), PIECE):
                    some = terms[low : low + PIECE]
                    yield pa.record_batch({"term_id": some, "first": np.full(len(some), first, np.int32), "vec": _lists(table[low : low + PIECE, :width], width)})

            with tasks_as_laid(self.spark):
                parts.append(stored(self._by_block(z, panel, run, "term_id int, first int, vec array<double>", 1)))
        return reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class Gram:
    """``Zᵀ A Aᵀ Z``, width × width, and the squared lengths of the columns of ``A Aᵀ Z``."""

    products: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, a: Matrix, z: Panels) -> Gram:
        """Made a panel at a time, so that ``A Aᵀ Z`` is never stored whole."""
        products, lengths = np.empty((z.width, z.width)), np.empty(z.width)
        for panel, cut in enumerate(z.slices):
            width = cut.stop - cut.start
            product = replace(z, folder=table_folder(z.spark), width=width, columns=width)
            a._normal_panel(z, panel, True, product, 0)
            met = z.products(product).select(Summarizer.sum(array_to_vector("g")), Summarizer.sum(array_to_vector("sizes"))).first()
            products[:, cut], lengths[cut] = met[0].toArray().reshape(z.width, width), met[1].toArray()
            product.drop()
        return cls((products + products.T) / 2, lengths)


@dataclass
class RandomisedDecomposition:
    """Singular values on the driver; right vectors ``(term_id, vec)`` as a table, made from ``source`` (a row per document)
    where the terms are; ``(term_id, term)`` names."""

    sigma: np.ndarray
    source: Panels | None
    vocab: DataFrame
    matrix: Matrix

    @classmethod
    def of(cls, weighted: DataFrame, vocab: DataFrame, rank: int = 200, power_steps: int = POWER_STEPS, oversample: int = OVERSAMPLE) -> RandomisedDecomposition:
        """Rank ``rank`` (at most the smaller side) of the rows ``(ids, weights)``; ``vocab`` has ``term_id, term``."""
        return cls.of_matrix(Matrix.of(weighted, vocab.count()), vocab, rank, power_steps, oversample)

    @classmethod
    def of_matrix(cls, a: Matrix, vocab: DataFrame, rank: int = 200, power_steps: int = POWER_STEPS, oversample: int = OVERSAMPLE) -> RandomisedDecomposition:
        if not (a.n_used and a.n_terms):
            return cls(np.zeros(0), None, vocab, a)
        width = max(1, min(rank + oversample, a.n_docs, a.n_terms))
        collected(a.spark)
        z = a.times_test(width)
        for step in range(power_steps):
            q = _replaced(z, _inverse(z.triangle()), np.float32)
            z = a.normal_times(q, exact=step == power_steps - 1)
            q.drop()
        for _ in range(2):  # once more, as R of A Aᵀ Q may be far from well conditioned
            z = _replaced(z, _inverse(z.triangle()))
        # R of Aᵀ Z = V̂ R, first by the roots of its Gram matrix, then by what is left between the scaled columns.
        values, w = np.linalg.eigh(Gram.of(a, z).products)
        values, w = values[::-1], w[:, ::-1]
        s = np.sqrt(values[: int((values > max(values[0], 0) * LEAST_ROOT).sum())])
        w = w[:, : len(s)]
        if not len(s):
            return cls(s, None, vocab, a)
        z = _replaced(z, w / s)
        _, sigma, wt = np.linalg.svd(np.linalg.cholesky(Gram.of(a, z).products).T * s, full_matrices=False)  # in the basis w
        keep = min(rank, len(sigma))
        return cls(sigma[:keep], _replaced(z, (wt.T * s[:, None])[:, :keep] / sigma[None, :keep]), vocab, a)

    @cached_property
    def v(self) -> DataFrame:
        """``(term_id, vec)``; stored when it is asked for, far larger than what it is made from."""
        if not self.rank:
            return self.vocab.select("term_id", F.array().cast("array<double>").alias("vec")).limit(0)
        parts = self.matrix.transpose_times(self.source, self.rank)
        v = parts
        if len(self.source.slices) > 1:
            v = parts.groupBy("term_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("first", "vec")))["vec"]).alias("vec"))
        v = v.select("term_id", "vec")
        # Vectors are defined up to sign: make the sum of each one's components positive.
        sums = v.agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("s")).scalar()
        v = computed_once(v, sums, "sums")
        return v.select("term_id", F.zip_with("vec", "sums", lambda x, g: F.when(g < 0, -x).otherwise(x)).alias("vec"))

    @property
    def rank(self) -> int:
        return len(self.sigma)

    def values(self, spark: SparkSession) -> DataFrame:
        """``(concept, sigma)`` in falling order."""
        return spark.createDataFrame([(i, float(x)) for i, x in enumerate(self.sigma)], "concept int, sigma double")

    def topics(self, concepts: int, n: int = 10) -> DataFrame:
        """``(topic, rank, term_id, term, weight)``: terms with the largest absolute component; ties by term."""
        if not self.rank:
            long = self.vocab.select("term_id", "term", F.lit(0).alias("topic"), F.lit(0.0).alias("w")).limit(0)
        else:
            parts = self.matrix.transpose_times(self.source, min(concepts, self.rank))
            long = parts.select("term_id", "first", F.posexplode("vec").alias("at", "w")).select("term_id", (F.col("first") + F.col("at")).alias("topic"), "w")
            long = long.join(self.vocab, "term_id")
        long = long.withColumn("weight", F.abs("w"))
        return top_rows(long, "topic", [F.desc("weight"), "term"], n).select("topic", "rank", "term_id", "term", "weight")

    @cached_property
    def _gram(self) -> Gram:
        """V'V = Sᵀ (A V), as V = Aᵀ S of ``source`` S; and the squared lengths of A V."""
        return Gram.of(self.matrix, self.source)

    def gram_defect(self) -> np.ndarray:
        """Per concept: the largest deviation of a row of VᵀV from the identity, summed over all terms."""
        k = self.rank
        if not k:
            return np.zeros(0)
        return np.abs(self._gram.products - np.eye(k)).max(axis=1)

    def left_sizes(self) -> DataFrame:
        """``(concept, u_size)``: squared length of ``A v / sigma`` summed over all documents (1 for an exact pair)."""
        sizes = [(i, float(n / x**2)) for i, (n, x) in enumerate(zip(self._gram.lengths, self.sigma, strict=True))] if self.rank else []
        return self.vocab.sparkSession.createDataFrame(sizes, "concept int, u_size double")


def _replaced(z: Panels, turn: np.ndarray, kind: type = np.float64) -> Panels:
    turned = z.turned(turn, kind)
    z.drop()
    return turned


def energy(weighted: DataFrame) -> float:
    """Squared Frobenius norm of the rows."""
    return weighted.agg(F.coalesce(F.sum(norm(F.col("weights")) ** 2), F.lit(0.0))).first()[0]
