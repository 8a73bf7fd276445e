"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

All segmentations of a text into pieces of a given model form a lattice. A forward pass sums the weights of
all paths to each position; a backward pass then draws pieces from the end, each with the probability that
the sums give it (forward filtering, backward sampling). Random numbers are hashes of the row's key, the
place in its text and the seed, so a row gets the same segmentation on any cluster.

Pieces only begin with the space sign, so the lattice falls apart before every run of spaces: each distinct
unit (spaces and a word) of a chunk is filtered once, and all its occurrences are sampled together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.llm import words as W

SPACE = 0x2581
CHUNK = 1 << 20
LONGEST_UNIT = 256
_SLOTS = 1 << 20
_HINTS = 1 << 21
_BLOCK = 1 << 16  # numbers that a core's cache holds


def _code_points(text: bytes) -> np.ndarray:
    """Code points; bytes that aren't UTF-8 become U+DC80 to U+DCFF."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class PieceModel:
    """A model's pieces for tasks: a hash table by length in characters, log weights and the bytes of each."""

    longest: int
    hashes: np.ndarray
    slots: list[np.ndarray]
    weight: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    hints: np.ndarray

    def hint(self, h: np.ndarray) -> np.ndarray:
        """Per hash of some characters: 1 if longer pieces may begin with them, plus 2 if they may be a piece."""
        return self.hints[(h & np.uint64(len(self.hints) - 1)).astype(np.int64)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id per hash, -1 for none."""
        out = np.full(len(h), -1, dtype=np.int32)
        rest = np.arange(len(h))
        for k, slots in enumerate(self.slots):
            got = slots[((h >> np.uint64(20 * k)) & np.uint64(_SLOTS - 1)).astype(np.int64)]
            same = (got >= 0) & (self.hashes[got] == h)
            out[rest[same]] = got[same]
            rest, h = rest[~same], h[~same]
        return out


def load_model(path: str, smoothing: float = 10.0) -> PieceModel:
    """Read a SentencePiece model on the driver. Its scores give ranks; piece number r weighs 1 / (r + smoothing)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = np.full(256, -1, dtype=np.int32)
    surface = [b""] * size
    for i in range(size):
        if model.is_byte(i):
            byte_ids[int(pieces[i][1:-1], 16)] = i
            surface[i] = bytes([int(pieces[i][1:-1], 16)])
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so decoding could lose characters")
    hashes, weight, hints = np.zeros(size, dtype=np.uint64), np.zeros(size), np.zeros(_HINTS, dtype=np.uint8)
    scores = np.array([model.get_score(i) for i in range(size)])
    rank = np.empty(size)
    rank[np.argsort(-scores, kind="stable")] = np.arange(size)
    for i in plain:
        surface[i] = pieces[i].replace("▁", " ").encode()
        sums = W.prefix_sums(W.mix(_code_points(pieces[i].encode()).astype(np.uint64)))
        begun = W.mix(sums[1:]) + np.arange(1, len(sums), dtype=np.uint64)  # its first character, its first two, and so on
        hashes[i] = begun[-1]
        np.bitwise_or.at(hints, (begun & np.uint64(_HINTS - 1)).astype(np.int64), np.r_[np.ones(len(begun) - 1, np.uint8), np.uint8(2)])
    weight[:] = -np.log(rank + smoothing)
    slots, left = [], list(plain)
    for k in range(3):
        table, rest = np.full(_SLOTS, -1, dtype=np.int32), []
        for i in left:
            s = (int(hashes[i]) >> (20 * k)) & (_SLOTS - 1)
            if table[s] < 0:
                table[s] = i
            else:
                rest.append(i)
        slots.append(table)
        left = rest
    if left:
        raise ValueError("too many pieces for the hash table")
    return PieceModel(max(len(pieces[i]) for i in plain), hashes, slots, weight, surface, byte_ids, hints)


def _units(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units, and the row of each: before a run of spaces, around line breaks, at rows, every 256 characters."""
    n = len(points)
    space, line = points == SPACE, points == 10
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[offsets] = True
    start = np.flatnonzero(cut[:n])
    long_ = np.flatnonzero(np.diff(np.r_[start, n]) > LONGEST_UNIT)
    if len(long_):
        ends = np.r_[start, n]
        start = np.union1d(start, np.concatenate([np.arange(ends[k], ends[k + 1], LONGEST_UNIT) for k in long_]))
    return start, np.searchsorted(offsets, start, side="right") - 1


def _sample(points: np.ndarray, raw_space: np.ndarray, offsets: np.ndarray, keys: np.ndarray, model: PieceModel, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(piece ids, ids per row)``; ``points`` have U+2581 for spaces, ``raw_space`` marks real U+2581 characters."""
    rows = len(offsets) - 1
    start, row = _units(points, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    end = np.r_[start[1:], len(points)]
    values = W.mix(np.where(raw_space, np.uint64(1 << 40), points.astype(np.uint64)))

    # Distinct units, their characters one after the other.
    up = W.span_hashes_of(values, start, end)
    _, first, unit = np.unique(up, return_index=True, return_inverse=True)
    size = (end - start)[first]
    base = np.r_[0, np.cumsum(size)]
    take = np.arange(base[-1]) + np.repeat(start[first] - base[:-1], size)
    own, chars, real = values[take], points[take], raw_space[take]
    n, longest = len(own), min(model.longest, int(size.max()))

    # Characters by place in their unit, longer units first: the units with a place t are the first reach[t], so that
    # character t of unit number k of that order is steps[t] + k, and steps over all units go through whole slices.
    ranked = np.argsort(-size, kind="stable")
    reach = len(size) - np.searchsorted(np.sort(size), np.arange(size.max()), side="right")
    steps = np.r_[0, np.cumsum(reach)]
    spot = np.concatenate([base[ranked[:m]] + t for t, m in enumerate(reach)])  # where it is in ``own``
    place_of = np.empty(n, dtype=np.int64)
    place_of[spot] = np.arange(n)
    left = np.repeat(base[1:], size) - np.arange(n)  # characters from here to the unit's end, by ``own``

    # Piece number + 1 by width and first character; a character goes on only while longer pieces begin like it.
    piece, widest = np.zeros((longest, n), dtype=np.int32), 1
    sums = W.prefix_sums(own)
    for low in range(0, n, _BLOCK):
        at = np.arange(low, min(n, low + _BLOCK))
        for width in range(1, longest + 1):
            hashes = W.window_hashes_at(sums, at, width) + np.uint64(width)
            hint = model.hint(hashes)
            some = np.flatnonzero(hint & 2)
            piece[width - 1, place_of[at[some]]] = model.find(hashes[some]) + 1
            widest = max(widest, width if len(some) else 0)
            at = at[(hint & 1).astype(bool) & (left[at] > width)]
    byte_cost = model.weight[model.byte_ids].mean()

    # Forward: log weight of all paths from the unit's start to behind each character. What is no piece has no
    # weight, but a single character has its bytes.
    weight, single = np.r_[-np.inf, model.weight], np.r_[2 * byte_cost, model.weight]
    sums = np.empty(n)
    # Cumulative chances of the widths of the piece that ends with a character, eight to a machine word.
    choice = np.full((n, -(-widest // 8) * 8), 2.0, dtype=np.float32)
    for t, m in enumerate(reach):
        widths = min(widest, t + 1)
        w = np.empty((widths, m))
        for width in range(1, widths + 1):
            begin = t + 1 - width
            ids = piece[width - 1, steps[begin] : steps[begin] + m]
            w[width - 1] = (single if width == 1 else weight)[ids]
            if begin:
                w[width - 1] += sums[steps[begin - 1] : steps[begin - 1] + m]
        top = w.max(axis=0)
        e = np.exp(w - top)
        total = e.sum(axis=0)
        sums[steps[t] : steps[t] + m] = top + np.log(total)
        chance = (np.cumsum(e, axis=0) / total).astype(np.float32)
        chance[chance >= 1] = 2.0  # a random number may round to 1
        choice[steps[t] : steps[t] + m, :widths] = chance.T

    # Backward: all occurrences step from their ends to their starts together.
    order_in_row = np.arange(len(start)) - np.searchsorted(row, np.arange(rows))[row]
    stream = W.mix(keys[row] + np.uint64(seed)) ^ W.mix(order_in_row.astype(np.uint64))
    number = np.empty(len(size), dtype=np.int64)
    number[ranked] = np.arange(len(size))
    last, lane, who, step = size[unit] - 1, number[unit], np.arange(len(start)), 0
    out_who, out_id, out_char = [], [], []
    while len(who):
        u = (W.mix(stream[who] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        passed = choice[steps[last] + lane] <= u[:, None].astype(np.float32)  # chances grow: the first not passed is their number
        begin = last - np.bitwise_count(passed.view(np.uint64)).sum(axis=1, dtype=np.int64)
        place = steps[begin] + lane
        out_who.append(who)
        out_id.append(piece[last - begin, place] - 1)
        out_char.append(spot[place])
        more = begin > 0
        last, lane, who, step = begin[more] - 1, lane[more], who[more], step + 1
    # Step k of an occurrence is its k-th piece from the end.
    drawn = np.zeros(len(start), dtype=np.int64)
    for w in out_who:
        drawn[w] += 1
    ends = np.cumsum(drawn)
    ids, char = np.empty(ends[-1], dtype=np.int32), np.empty(ends[-1], dtype=np.int64)
    for k, (w, i, c) in enumerate(zip(out_who, out_id, out_char, strict=True)):
        at = ends[w] - 1 - k
        ids[at], char[at] = i, c
    who = np.repeat(np.arange(len(start)), drawn)

    # Characters without a piece become their bytes.
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        parts = [_bytes_of(int(chars[c]), bool(real[c])) for c in char[bare]]
        times = np.ones(len(ids), dtype=np.int64)
        times[bare] = [len(p) for p in parts]
        spread = np.repeat(ids, times)
        spread[np.flatnonzero(np.repeat(ids < 0, times))] = model.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
        ids, who = spread, np.repeat(who, times)
    return ids, np.bincount(row[who], minlength=rows)


def _bytes_of(point: int, real: bool) -> bytes:
    if point == SPACE and not real:
        return b" "
    return chr(point).encode("utf-8", "surrogateescape")


def _decodes(ids: np.ndarray, ends: np.ndarray, column: pa.Array, model: PieceModel) -> np.ndarray:
    """Per row whether the bytes of its pieces are the row's text."""
    data, offsets = W.raw(column)
    length = np.array([len(x) for x in model.surface])
    flat, first = np.frombuffer(b"".join(model.surface), np.uint8), np.cumsum(length) - length
    sizes = length[ids]
    got = flat[np.repeat(first[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    total = W.row_sums(sizes, ends)
    if (total == np.diff(offsets)).all():
        return W.row_sums(got != data, offsets) == 0
    at = np.r_[0, np.cumsum(total)]
    return np.array([got[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)], dtype=bool)


def _encode(batches: Iterator[pa.RecordBatch], model: object, seed: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    pieces: PieceModel = model.value
    for chunk in W.text_chunks(batches, limit=CHUNK):
        texts = [t.as_buffer().to_pybytes() for t in chunk.column("text")]
        points = [_code_points(t) for t in texts]
        offsets = np.r_[0, np.cumsum([len(p) for p in points])]
        flat = np.concatenate(points)
        real = flat == SPACE
        flat = np.where(flat == 32, np.uint32(SPACE), flat)
        keys = chunk.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ids, counts = _sample(flat, real, offsets, keys, pieces, seed)
        ends = np.r_[0, np.cumsum(counts)]
        lossless = _decodes(ids, ends, chunk.column("text"), pieces)
        yield pa.RecordBatch.from_arrays(
            [*(chunk.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(counts, pa.int64()), pa.array(lossless)],
            names=[*keep, "piece_ids", "n_pieces", "lossless"],
        )


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``(doc_id, piece_ids, n_pieces, lossless)``: one sampled segmentation per row.

    ``lossless`` says that decoding gives the text back byte by byte; characters without a piece are spelled in
    byte pieces. Equal keys and texts get equal segmentations. Null and empty texts have no pieces. A null key
    counts as 0. A run of more than 256 characters without a space is cut every 256. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("row_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, model=model, seed=seed, keep=[key]), f"`{key}` long, piece_ids array<int>, n_pieces long, lossless boolean")


def _decode(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    surface = model.value.surface
    for batch in batches:
        at = batch.schema.get_field_index("piece_ids")
        texts = [None if ids is None else b"".join([surface[i] for i in ids if i is not None]) for ids in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """Replace ``piece_ids`` by the ``text`` they spell; null stays null, control pieces spell nothing."""
    model = rows.sparkSession.sparkContext.broadcast(load_model(model_path))
    rows = rows.select([c for c in rows.columns if c != "text"])
    schema = ", ".join("text string" if f.name == "piece_ids" else f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(partial(_decode, model=model), schema)
