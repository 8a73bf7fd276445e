"""Benchmark decontamination by templates.

Texts become template tokens: numbers, names and units turn into typed placeholders, all else is
lower-cased; a capital that opens a sentence is read both as a word and as a name. Windows of template tokens of the benchmark are hash-joined with those of all documents. Where
windows of an item line up in a document, the slots behind the placeholders are compared inside those windows:
equal values are a verbatim leak; values that differ, but so that one benchmark value always became the same
other value (two may become the same one), are a re-parameterised question; contradictory values are no leak.
Windows with few literals are found by their exact values, or in line with a window found by its template; so an
item with few literals throughout is found verbatim, but not with other values.

Benchmark windows are handed to the tasks in blocks of at most ``block_windows``; every block meets all
documents, so the benchmark may have any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.llm import words as W

WINDOW = 8
LEAST_TOKENS = 5
LEAST_LITERALS = 4
BLOCK_WINDOWS = 1 << 20
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion"
)
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "mph kmh degree degrees celsius fahrenheit volt volts watt watts joule joules meter meters metre metres"
)
NUMBER, UNIT, NAME = 1, 2, 3
_TEMPLATE, _EXACT = np.uint64(0), np.uint64(0x5851F42D4C957F2D)
_PLACE = np.array([0, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03], dtype=np.uint64)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def _hash_list(text: str) -> np.ndarray:
    parts = text.encode().split()
    ends = np.cumsum([len(p) for p in parts])
    return np.sort(W.span_hashes(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends))


class Templates:
    """Template tokens of a chunk: hash of the literal word, slot type (0: literal), byte span, first token of each row."""

    def __init__(self, column: pa.Array) -> None:
        data, self.offsets = W.raw(column)
        kind = _KIND[data]
        inner = np.flatnonzero((data == 46) | (data == 44))
        inner = inner[(inner > 0) & (inner < len(data) - 1)]
        kind[inner[(_KIND[data[inner - 1]] == 1) & (_KIND[data[inner + 1]] == 1)]] = 1
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.offsets] = True
        change = np.r_[True, kind[1:] != kind[:-1]] if len(data) else np.zeros(0, bool)
        begins = (kind > 0) & (change | edge[:-1])
        ends = (kind > 0) & np.r_[change[1:] | edge[1:-1], [True] * (len(data) > 0)].astype(bool)
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        lower = _LOWER[data]
        accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        lower[accent] += 32
        self.lower = lower
        self.hashes = W.span_hashes(lower, self.start, self.end)
        row_head = np.zeros(len(self.start) + 1, dtype=bool)
        row_head[self.first] = True
        row_head = row_head[:-1]
        number = (kind[self.start] == 1) | np.isin(self.hashes, _hash_list(NUMBER_WORDS))
        unit = np.isin(self.hashes, _hash_list(UNITS)) & np.r_[False, number[:-1]] & ~row_head
        stops = np.r_[0, np.cumsum(_STOP[data])]
        before = np.r_[0, self.end[:-1]]
        opens = row_head | (stops[self.start] > stops[before])
        capital = lower[self.start] != data[self.start]
        second = np.minimum(self.start + 1, max(len(data) - 1, 0))
        capital |= (data[self.start] == 0xC3) & (lower[second] != data[second]) if len(data) else False
        small_end = lower[self.end - 1] == data[self.end - 1]
        name = capital & small_end & (self.end - self.start > 1) & ~number & ~unit
        fixed = np.where(number, NUMBER, np.where(unit, UNIT, 0)).astype(np.int8)
        # A capital that opens a sentence may be a name or not; open_slot takes it for one.
        self.open_slot = np.where(name, np.int8(NAME), fixed)
        self.slot = np.where(opens, fixed, self.open_slot)

    def windows(self, width: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hash, first token, number of literals)`` of all windows within rows, tokens read as ``slot`` tells."""
        token = np.where(slot > 0, _PLACE[slot], self.hashes)
        at = np.arange(max(0, len(token) - width + 1))
        at = at[at + width <= np.repeat(self.first[1:], np.diff(self.first))[: len(at)]]
        literal = np.r_[0, np.cumsum(slot == 0)]
        return W.window_hashes(token, width)[at] if len(at) else np.zeros(0, np.uint64), at, literal[at + width] - literal[at]


class Block:
    """Windows of some benchmark items, for tasks: sorted hashes with the (item, offset) pairs behind each.

    Every window is a key by its exact values; those of ``LEAST_LITERALS`` literals or more also by their templates,
    with sentence-opening capitals as words, as names, and without names. A window of placeholders alone would be
    any table of numbers.
    """

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        column = pa.array([(t or "").encode() for t in texts], pa.large_binary())
        self.ids, self.tokens = ids, Templates(column)
        sizes = np.diff(self.tokens.first)
        self.widths = sorted({int(min(n, WINDOW)) for n in sizes if n >= LEAST_TOKENS})
        self.tables = {}
        for width in self.widths:
            parts = []
            fixed = np.where(self.tokens.slot == NAME, 0, self.tokens.slot)
            for slot, exact in ((self.tokens.slot, False), (self.tokens.open_slot, False), (fixed, False), (np.zeros_like(fixed), True)):
                hashes, at, literals = self.tokens.windows(width, slot)
                item = np.searchsorted(self.tokens.first, at, side="right") - 1
                keep = (exact | (literals >= LEAST_LITERALS)) & (np.minimum(sizes[item], WINDOW) == width)
                parts.append((hashes[keep] ^ (_EXACT if exact else _TEMPLATE), item[keep].astype(np.int32), (at - self.tokens.first[item])[keep].astype(np.int32)))
            hashes, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((offset, item, hashes))
            hashes, item, offset = hashes[order], item[order], offset[order]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1]) | (offset[1:] != offset[:-1])] if len(hashes) else np.zeros(0, bool)
            self.tables[width] = hashes[new], item[new], offset[new]


def _compare(docs: Templates, bench: Templates, item: int, offsets: np.ndarray, places: np.ndarray) -> tuple[int, int, bool]:
    """Slots, changed slots and whether the changes are consistent, for an item's tokens laid over document tokens."""
    slots = changed = 0
    consistent = True
    to: dict[tuple[int, int], int] = {}
    for k, d in zip((offsets + bench.first[item]).tolist(), places.tolist(), strict=True):
        kind = int(bench.open_slot[k])
        if not kind:
            continue
        x, y = int(bench.hashes[k]), int(docs.hashes[d])
        slots += bool(bench.slot[k]) or x != y
        changed += x != y
        consistent &= to.setdefault((kind, x), y) == y
    return slots, changed, consistent


def _in_line(docs: Templates, bench: Templates, row: int, item: int, base: int, width: int) -> np.ndarray:
    """Mask of the item's tokens in windows that agree with the document's row from ``base``, however few literals they have."""
    low, n = int(bench.first[item]), int(bench.first[item + 1] - bench.first[item])
    a, b = max(0, int(docs.first[row]) - base), min(n, int(docs.first[row + 1]) - base)
    x, y = slice(low + a, low + b), slice(base + a, base + b)
    equal = np.zeros(n, dtype=bool)
    equal[a:b] = (bench.hashes[x] == docs.hashes[y]) | ((bench.open_slot[x] == docs.open_slot[y]) & (bench.open_slot[x] > 0))
    sums = np.r_[0, np.cumsum(equal)]
    return W.covered(n, np.flatnonzero(sums[width:] - sums[:-width] == width), width)


def _occurrences(docs: Templates, bench: Templates, row: int, item: int, base: np.ndarray, offset: np.ndarray, width: int, coverage: int) -> tuple | None:
    """The best occurrence of an item in a row, from its windows found: ``(rank, match)``.

    An occurrence is the base with most tokens and those up to half the item's length beside it, where words were
    put in or left out; each token of the item and of the document counts once. Bases join in falling order, first
    with the windows found, then also with those in line that have few literals, as long as the rank gets better.
    """
    n = int(bench.first[item + 1] - bench.first[item])
    heads = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
    bases = base[heads]
    masks = [W.covered(n, own, width) for own in np.split(offset, heads[1:])]
    best = None
    left = np.array([m.sum() for m in masks])
    order = np.argsort(-left, kind="stable")
    for lead in order.tolist():
        if not left[lead]:
            continue
        near = order[(np.abs(bases[order] - bases[lead]) <= n // 2) & (left[order] > 0)]
        left[near] = 0
        for wide in (False, True):
            places = np.full(n, -1)
            for k in near.tolist():
                own = np.flatnonzero((_in_line(docs, bench, row, item, int(bases[k]), width) if wide else masks[k]) & (places < 0))
                own = own[~np.isin(own + bases[k], places)]
                places[own] = own + bases[k]
                offsets = np.flatnonzero(places >= 0)
                got = len(offsets)
                if not len(own) or 100 * got < coverage * n:
                    continue
                slots, changed, consistent = _compare(docs, bench, item, offsets, places[offsets])
                kind = "verbatim" if not changed else "reparameterised" if consistent else "inconsistent"
                rank = (kind != "inconsistent", got, -changed)
                if best is None or rank > best[0]:
                    begin, end = int(places[offsets].min()), int(places[offsets].max())
                    best = rank, (row, item, 100 * got // n, slots, changed, kind, int(docs.start[begin] - docs.offsets[row]), int(docs.end[end] - docs.offsets[row]))
                if got == n:
                    break
        if best is not None and best[0] == (True, n, 0):
            break
    return best


def _matches(chunk: pa.RecordBatch, block: Block, coverage: int) -> Iterator[tuple]:
    """``(row, item, percent, slots, changed, kind, byte start, byte end)`` of each document and item that line up."""
    docs = Templates(chunk.column("text"))
    bench = block.tokens
    found = []
    for width in block.widths:
        keys, items, offsets = block.tables[width]
        hits = []
        for slot, salt in ((docs.slot, _TEMPLATE), (docs.open_slot, _TEMPLATE), (np.zeros_like(docs.slot), _EXACT)):
            hashes, at, _ = docs.windows(width, slot)
            hashes ^= salt
            low = np.searchsorted(keys, hashes)
            hit = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == hashes)) if len(keys) else np.zeros(0, int)
            high = np.searchsorted(keys, hashes[hit], side="right")
            times = high - low[hit]
            entry = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            token = np.repeat(at[hit], times)
            hits.append((np.searchsorted(docs.first, token, side="right") - 1, items[entry], token - offsets[entry], offsets[entry]))
        row, item, base, offset = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((offset, base, item, row))
        row, item, base, offset = row[order], item[order], base[order], offset[order]
        heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]) if len(row) else []
        for a, b in zip(heads, [*heads[1:], len(row)], strict=True) if len(row) else ():
            best = _occurrences(docs, bench, int(row[a]), int(item[a]), base[a:b], offset[a:b], width, coverage)
            if best is not None:
                found.append(best[1])
    yield from sorted(found)


def _find(batches: Iterator[pa.RecordBatch], block: object, coverage: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "coverage", "n_slots", "n_changed", "kind", "byte_start", "byte_end"]
    for chunk in W.text_chunks(batches):
        found = list(_matches(chunk, block.value, coverage))
        if found:
            ids = chunk.column("doc_id").to_pylist()
            rows = [dict(zip(names, (ids[f[0]], block.value.ids[f[1]], *f[2:]), strict=True)) for f in found]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string() if n == "kind" else pa.int64()) for n in names]))


def _blocks(benchmark: DataFrame, block_windows: int) -> Iterator[object]:
    """Broadcast blocks of the benchmark; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    n = -(-size // (2 * block_windows))  # a window starts at a token, a token has two bytes with its separator
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Block([r.item_id for r in rows], [r.text for r in rows]))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: int = 60, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``(doc_id, item_id, coverage, n_slots, n_changed, kind, byte_start, byte_end, contaminated)``.

    One row for each document and benchmark item of which at least ``coverage`` percent of the template tokens
    line up in the document (its best occurrence; words may be put in or left out in it, up to half the item's
    length). Slots are counted and compared in the windows that line up, and
    the bytes are those from the first of them to the last. ``kind`` is verbatim, reparameterised or inconsistent;
    only the first two are contaminated. Items of fewer than 5 tokens are not searched, those of fewer than 8 as one
    window; those with fewer than 4 literals in each window only with their exact values. Null or empty texts match nothing, null item ids are skipped, null document ids stay null. Repeated
    rows give a row each. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage long, n_slots long, n_changed long, kind string, byte_start long, byte_end long"
    out = rows.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, block_windows):
        out = out.unionByName(rows.mapInArrow(partial(_find, block=block, coverage=coverage), schema))
    return out.withColumn("contaminated", F.col("kind") != "inconsistent")


def _clean(batches: Iterator[pa.RecordBatch], block: object, coverage: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = 0
        for chunk in W.text_chunks([batch]):
            bad = {m[0] for m in _matches(chunk, block.value, coverage) if m[5] != "inconsistent"}
            yield batch.slice(low, chunk.num_rows).filter(pa.array([r not in bad for r in range(chunk.num_rows)], pa.bool_()))
            low += chunk.num_rows


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: int = 60, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Rows of ``docs``, all columns, without those that ``leaks`` calls contaminated."""
    for block in _blocks(benchmark, block_windows):
        docs = docs.mapInArrow(partial(_clean, block=block, coverage=coverage), docs.schema)
    return docs
