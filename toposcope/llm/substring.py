"""Substring deduplication: windows of words that another document holds too are cut out.

Every window of ``width`` words is hashed (Rabin-Karp) and counted in Spark, one bucket of the hash space
per task. What travels is packed: per chunk of documents and bucket one row with the hashes, the word
positions and the documents' ids, about nine bytes a window. Within a chunk only the smallest document of
each window is sent on, so a passage that a third of all documents share costs a bucket one entry per
chunk. The answers (positions of repeated windows) go back to the chunk, merge into maximal intervals per
document, and meet the text in one join.

Hashes carry ``8 * hash_bytes`` bits plus those of the bucket; two different windows of n are taken for
equal with a chance of about n^2 / 2^(9 + 8 * hash_bytes + log2(buckets)). Use 8 bytes beyond 10^10 windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.llm import words as W

LAST = np.iinfo(np.int64).max
_ANSWER, _ROWS = 0, 1


def _send(batches: Iterator[pa.RecordBatch], width: int, buckets: int, hash_bytes: int) -> Iterator[pa.RecordBatch]:
    """Packed windows by bucket, and each chunk's table of documents with what it has settled by itself."""
    for chunk in W.text_chunks(batches):
        found = W.find_words(chunk.column("text"))
        ids = chunk.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        crc = chunk.column("text_crc32").to_numpy(zero_copy_only=False).astype(np.uint32)
        at = W.window_starts(found, width)
        if not len(at):
            continue
        hashes = W.window_hashes(W.word_hashes(found), width)[at]
        row = np.repeat(np.arange(len(ids), dtype=np.int32), found.counts)[at]
        order = np.argsort(hashes)
        heads = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        least = np.repeat(np.minimum.reduceat(ids[row[order]], heads), np.diff(np.r_[heads, len(order)]))
        settled = np.zeros(len(at), dtype=bool)
        settled[order] = ids[row[order]] > least
        del order, heads, least
        key = int.from_bytes(hashlib.blake2b(ids.tobytes() + crc.tobytes() + found.first.tobytes(), digest_size=8).digest(), "little", signed=True)
        open_ = np.flatnonzero(~settled)
        bucket = (((hashes[open_] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")
        open_, bucket = open_[order], bucket[order]
        low = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out_bucket, payload = [], []
        for a, b in zip(low, np.r_[low[1:], len(open_)], strict=True):
            own = open_[a:b]
            rows = row[own]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            head = np.array([len(first), len(own)], dtype=np.int64).tobytes()
            counts = np.diff(np.r_[first, len(own)]).astype(np.uint32)
            place = np.diff(at[own], prepend=0).astype(np.uint32)
            tail = np.ascontiguousarray(hashes[own].view(np.uint8).reshape(-1, 8)[:, :hash_bytes]).tobytes()
            out_bucket.append(int(bucket[a]))
            payload.append(head + W.planes(np.diff(ids[rows[first]], prepend=0)) + W.planes(counts) + W.planes(place) + tail)
        done = at[settled]
        table = np.array([len(ids), len(done)], dtype=np.int64).tobytes() + ids.tobytes() + crc.tobytes() + W.planes(found.counts) + W.planes(np.diff(done, prepend=0))
        n = len(payload)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*out_bucket, key % buckets], pa.int32()), pa.array([key] * (n + 1), pa.int64()), pa.array([_ANSWER] * n + [_ROWS], pa.int8()), pa.array([*payload, table], pa.binary())],
            names=["bucket", "chunk", "kind", "payload"],
        )


def _answer(batches: Iterator[pa.RecordBatch], hash_bytes: int) -> Iterator[pa.RecordBatch]:
    """One bucket: which windows also start in a document with a smaller id."""
    chunks, hashes, ids, places = [], [], [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        if (kinds == _ROWS).any():
            yield batch.filter(pa.array(kinds == _ROWS)).select(["chunk", "kind", "payload"])
        for key, kind, payload in zip(batch.column("chunk").to_pylist(), kinds, batch.column("payload"), strict=True):
            if kind == _ROWS:
                continue
            data = memoryview(payload.as_buffer())
            docs, n = np.frombuffer(data, np.int64, 2)
            low = 16 + 8 * docs
            own = np.cumsum(W.from_planes(data[16:], docs, np.int64))
            ids.append(np.repeat(own, W.from_planes(data[low:], docs, np.uint32)))
            places.append(np.cumsum(W.from_planes(data[low + 4 * docs :], n, np.uint32), dtype=np.uint32))
            full = np.zeros((n, 8), dtype=np.uint8)
            full[:, :hash_bytes] = np.frombuffer(data[low + 4 * docs + 4 * n :], np.uint8, n * hash_bytes).reshape(n, hash_bytes)
            hashes.append(full.reshape(-1).view(np.uint64))
            chunks.append(key)
    if not hashes:
        return
    sizes = np.array([len(x) for x in hashes])
    all_hashes, all_ids = np.concatenate(hashes), np.concatenate(ids)
    del hashes, ids
    order = np.argsort(all_hashes)
    all_hashes, all_ids = all_hashes[order], all_ids[order]
    heads = np.flatnonzero(np.r_[True, all_hashes[1:] != all_hashes[:-1]])
    del all_hashes
    late = order[all_ids > np.repeat(np.minimum.reduceat(all_ids, heads), np.diff(np.r_[heads, len(order)]))]
    del order, all_ids
    late.sort()
    ends = np.searchsorted(late, np.cumsum(sizes))
    low = base = 0
    for i, high in enumerate(ends):
        if high > low:
            own = places[i][late[low:high] - base]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunks[i]], pa.int64()), pa.array([_ANSWER], pa.int8()), pa.array([np.array([len(own)], np.int64).tobytes() + W.planes(np.diff(own, prepend=np.uint32(0)))], pa.binary())],
                names=["chunk", "kind", "payload"],
            )
        low, base = high, base + sizes[i]


def _intervals(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """All answers for a chunk merged into maximal word intervals per document."""
    for batch in batches:
        for parts in batch.column("parts").to_pylist():
            table = next((p["payload"] for p in parts if p["kind"] == _ROWS), None)
            data = memoryview(table)
            docs, settled = np.frombuffer(data, np.int64, 2)
            ids, crc = np.frombuffer(data[16:], np.int64, docs), np.frombuffer(data[16 + 8 * docs :], np.uint32, docs)
            counts = W.from_planes(data[16 + 12 * docs :], docs, np.int64)
            starts = [np.cumsum(W.from_planes(data[16 + 20 * docs :], settled, np.int64))]
            for p in parts:
                if p["kind"] == _ANSWER:
                    answer = memoryview(p["payload"])
                    starts.append(np.cumsum(W.from_planes(answer[8:], np.frombuffer(answer, np.int64, 1)[0], np.uint32).astype(np.int64)))
            first = np.r_[0, np.cumsum(counts)]
            gone = np.r_[False, W.covered(int(first[-1]), np.concatenate(starts), width), False]
            inner = np.zeros(len(gone), dtype=bool)
            inner[first[first < len(gone) - 1] + 1] = True
            begin = np.flatnonzero(gone[1:] & (~gone[:-1] | inner[1:]))
            end = np.flatnonzero(gone[:-1] & (~gone[1:] | inner[1:]))
            row = np.searchsorted(first, begin, side="right") - 1
            pairs = np.stack([begin - first[row], end - first[row]], axis=1).astype(np.int32)
            low = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            cut = np.r_[low, len(row)]
            if len(low):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[low]]), pa.array(crc[row[low]].astype(np.int64)), pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["doc_id", "text_crc32", "intervals"],
                )


def repeated_intervals(docs: DataFrame, width: int = 50, buckets: int | None = None, hash_bytes: int = 7) -> DataFrame:
    """``(doc_id, text_crc32, intervals)`` of the word intervals to remove, for documents that have any.

    ``docs`` has ``doc_id`` (no nulls here), ``text`` and ``text_crc32``; ``intervals`` holds pairs of int32
    (start, end). ``buckets`` (default: the shuffle partitions) is the number of tasks that count; each holds
    its share of all windows in memory.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("doc_id", "text", "text_crc32").mapInArrow(
        partial(_send, width=width, buckets=buckets, hash_bytes=hash_bytes), "bucket int, chunk long, kind byte, payload binary"
    )
    answers = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(partial(_answer, hash_bytes=hash_bytes), "chunk long, kind byte, payload binary")
    merged = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "payload")).alias("parts"))
    spans = merged.select("parts").mapInArrow(partial(_intervals, width=width), "doc_id long, text_crc32 long, intervals binary")
    # Repeated rows of one document stand in several chunks with the same intervals.
    return spans.groupBy("doc_id", "text_crc32").agg(F.first("intervals").alias("intervals"))


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in W.text_chunks(batches):
        n_words, removed, digest, kept, spans = [], [], [], [], []
        for text, gone in zip(batch.column("text"), batch.column("intervals"), strict=True):
            own = text.as_py().split()
            pairs = np.frombuffer(gone.as_py() or b"", dtype=np.int32).reshape(-1, 2).tolist()
            n_words.append(len(own))
            for a, b in reversed(pairs):
                del own[a:b]
            removed.append(n_words[-1] - len(own))
            left = b" ".join(own)
            digest.append(hashlib.sha256(left).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in pairs])
            if keep_text:
                kept.append(left)
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"]
        if keep_text:
            columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, width: int = 50, buckets: int | None = None, hash_bytes: int = 7, keep_text: bool = True) -> DataFrame:
    """Cut every word that lies in a window of ``width`` words which also starts in a document with a smaller ``doc_id``.

    Windows are judged on the input. Returns ``doc_id, n_words, n_removed, kept_sha256, intervals`` (maximal,
    in words) and, with ``keep_text``, the kept words joined by one space.

    Null text: no words. Fewer words than ``width``: nothing is removed. A null ``doc_id`` counts as larger
    than all others. Rows with the same ``doc_id`` don't repeat each other, whatever their text. An empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
        F.col("text").cast("string").alias("text"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"),
    )
    spans = repeated_intervals(rows, width, buckets, hash_bytes)
    joined = rows.join(spans, ["doc_id", "text_crc32"], "left").select(F.col("own_id").alias("doc_id"), "text", "intervals")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start: int, end: int>>"
    return joined.mapInArrow(partial(_cut, keep_text=keep_text), schema + (", kept_text string" if keep_text else ""))
