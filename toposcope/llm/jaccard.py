"""N-gram Jaccard join by a size-aware split into light and heavy sets.

Small (light) sets enumerate their subsets of the sizes that a link needs; two sets that share such a subset
are linked without a further look. Large (heavy) sets scan inverted lists of their rarest shingles and the
hits are checked on whole sets. The boundary is the size at which a set's subsets begin to cost more than
its list entries.

Equal sets are one node. A list doesn't emit all its pairs: its members are first checked against one of
them; when the components so found are known, only pairs of members in different components are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from toposcope.llm import words as W
from toposcope.llm.graph import components
from toposcope.settings import stored

KEY_BITS = 40  # of a shingle's hash, to count by; a clash only changes the order of shingles
LIST_COST = 8  # of a list entry with its share of the checks, against 1 for a subset
MOST_ENUMERATED = 40
FILTER_BITS = 1 << 24  # 2 MB
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def overlap_needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Subset sizes by which a set of ``n`` can meet a linked one; equal sets apart, they are one node."""
    partners = [m for m in range(-(-percent * n // 100), 100 * n // percent + 1)]
    if partners == [n] and overlap_needed(n, n, percent) == n:
        return []
    return sorted({overlap_needed(n, m, percent) for m in partners})


def boundary(histogram: dict[int, int], percent: int) -> int:
    """Largest light size: where enumerating up to it and scanning beyond costs least for these set sizes."""
    best, least, enumerate_, scan = 0, None, 0, sum(c * prefix_length(n, percent) * LIST_COST for n, c in histogram.items())
    for n in range(1, MOST_ENUMERATED + 1):
        count = histogram.get(n, 0)
        enumerate_ += count * sum(comb(n, o) for o in subset_sizes(n, percent))
        scan -= count * prefix_length(n, percent) * LIST_COST
        if least is None or enumerate_ + scan <= least:
            best, least = n, enumerate_ + scan
    return best


def _sets(chunk: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row sorted distinct shingle hashes: ``(hashes, offsets, set ids)``; the id of an empty set is 0."""
    found = W.find_words(chunk.column("text"))
    found.data = _LOWER[found.data]
    hashes = W.word_hashes(found)
    rows = np.arange(chunk.num_rows)
    at = W.window_starts(found, width)
    shingles, row = [W.window_hashes(hashes, width)[at]], [np.repeat(rows, found.counts)[at]]
    for few in range(1, width):
        own = rows[found.counts == few]
        if len(own):
            first = found.first[own]
            whole = W.window_hashes(np.concatenate([hashes[first[:, None] + np.arange(few)].reshape(-1)]), few)[:: few]
            shingles.append(W.mix(whole + np.uint64(few)))
            row.append(own)
    shingles, row = np.concatenate(shingles), np.concatenate(row)
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    new = np.r_[True, (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    shingles, row = shingles[new], row[new]
    offsets = np.searchsorted(row, np.arange(chunk.num_rows + 1))
    sums = np.zeros(len(shingles) + 1, dtype=np.uint64)
    np.cumsum(W.mix(shingles ^ np.uint64(0xA5A5A5A5)), out=sums[1:])
    sizes = np.diff(offsets)
    ids = W.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ W.mix(sizes.astype(np.uint64)))
    ids[sizes == 0] = 0
    return shingles, offsets, ids.view(np.int64)


def _distinct_sets(chunk: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_sets``, with one row for equal sets and none for empty ones."""
    shingles, offsets, ids = _sets(chunk, width)
    _, keep = np.unique(ids, return_index=True)
    keep = keep[np.diff(offsets)[keep] > 0]
    sizes = np.diff(offsets)[keep]
    out = np.r_[0, np.cumsum(sizes)]
    take = np.arange(out[-1]) + np.repeat(offsets[keep] - out[:-1], sizes)
    return shingles[take], out, ids[keep]


def _nodes(batches: Iterator[pa.RecordBatch], width: int, carry: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        _, offsets, ids = _sets(chunk, width)
        columns = [chunk.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids), *[chunk.column(c) for c in carry]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", *carry])


def _with_node(batches: Iterator[pa.RecordBatch], width: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = 0
        for chunk in W.text_chunks([batch]):
            _, offsets, ids = _sets(chunk, width)
            yield batch.slice(low, chunk.num_rows).append_column(name, pa.array(ids, pa.int64(), mask=np.diff(offsets) == 0))
            low += chunk.num_rows


def with_node(docs: DataFrame, width: int, name: str) -> DataFrame:
    """``docs``, all columns, with the ``node`` of ``similar_groups`` for each row's text as ``name``; null without shingles."""
    return docs.mapInArrow(partial(_with_node, width=width, name=name), StructType([*docs.schema.fields, StructField(name, LongType())]))


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return low, np.r_[low[1:], len(bucket)]


def _count_keys(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        keys, counts = np.unique(_distinct_sets(chunk, width)[0] >> np.uint64(64 - KEY_BITS), return_counts=True)
        if not len(keys):
            continue
        bucket = ((keys >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(KEY_BITS - 8)).astype(np.int32)
        low, high = _split(bucket)
        payload = [np.int64(b - a).tobytes() + W.planes(np.diff(keys[a:b], prepend=np.uint64(0))) + W.planes(counts[a:b].astype(np.uint32)) for a, b in zip(low, high, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[low]), pa.array(payload, pa.binary())], names=["bucket", "payload"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The packed payloads of a task, one bucket at a time: buckets that AQE put into one task are expanded one
    by one (a bucket's keys or tokens are its own), so a task holds one expanded bucket at most."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
            held.setdefault(bucket, []).append(payload)
    for bucket in sorted(held):
        yield held.pop(bucket)


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for payloads in _by_bucket(batches):
        keys, counts = [], []
        for payload in payloads:
            data = memoryview(payload.as_buffer())
            n = int(np.frombuffer(data, np.int64, 1)[0])
            keys.append(np.cumsum(W.from_planes(data[8:], n, np.uint64)))
            counts.append(W.from_planes(data[8 + 8 * n :], n, np.uint32))
        key, count = np.concatenate(keys), np.concatenate(counts)
        del keys, counts, payloads
        order = np.argsort(key)
        key, count = key[order], count[order].astype(np.int64)
        low, _ = _split(key)
        count = np.add.reduceat(count, low)
        much = count >= least
        yield pa.RecordBatch.from_arrays([pa.array(key[low][much].astype(np.int64)), pa.array(count[much])], names=["key", "count"])


def frequent_keys(texts: DataFrame, width: int, least: int, most_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash keys of shingles in ``least`` or more sets, and how often (as a power of two); sorted by key.

    All shingles of all sets are counted. If more than ``most_keys`` are frequent, ``least`` rises to the power
    of two that leaves so many, which bounds what goes to all tasks: later lists get longer, no link is lost.
    """
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(
        texts.mapInArrow(partial(_count_keys, width=width, buckets=buckets), "bucket int, payload binary")
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(partial(_frequent, least=least), "key long, count long")
    )
    levels = {r.level: r.n for r in counted.groupBy(F.floor(F.log2("count")).alias("level")).agg(F.count("*").alias("n")).collect()}
    lowest, total = 64, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most_keys:
            break
        lowest = level
    got = counted.where(F.floor(F.log2("count")) >= lowest).toPandas().sort_values("key")
    return got["key"].to_numpy(np.uint64), np.floor(np.log2(got["count"].to_numpy(np.float64).clip(1))).astype(np.int8)


def _entries(batches: Iterator[pa.RecordBatch], frequent: object, width: int, percent: int, light: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of inverted lists (the rarest shingles of a set) by bucket of the shingle, packed."""
    keys, powers = frequent.value
    for chunk in W.text_chunks(batches):
        shingles, offsets, ids = _distinct_sets(chunk, width)
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        rank = np.zeros(len(shingles), dtype=np.int8)
        if len(keys):
            key = shingles >> np.uint64(64 - KEY_BITS)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            rank = np.where(keys[at] == key, powers[at] + 1, 0).astype(np.int8)
        order = np.lexsort((shingles, rank, row))
        place = np.arange(len(order)) - offsets[row]
        length = np.where(sizes >= -(-percent * (light + 1) // 100), prefix_length(sizes, percent), 0)
        keep = place < length[row]
        token, row, place = shingles[order][keep], row[keep], place[keep].astype(np.uint32)
        if not len(token):
            continue
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        token, row, place, bucket = token[order], row[order], place[order], bucket[order]
        low, high = _split(bucket)
        payload = []
        for a, b in zip(low, high, strict=True):
            first, last = _split(row[a:b])
            own = row[a:b][first]
            payload.append(
                np.array([len(own), b - a], np.int64).tobytes() + ids[own].tobytes() + W.planes(sizes[own].astype(np.uint32))
                + W.planes((last - first).astype(np.uint32)) + W.planes(place[a:b]) + token[a:b].tobytes()
            )
        yield pa.RecordBatch.from_arrays([pa.array(bucket[low]), pa.array(payload, pa.binary())], names=["bucket", "payload"])


def _possible(one: str, other: str, percent: int) -> Column:
    """Whether the sets of two entries of a list can be linked, if it is the list of their first common shingle."""
    n, i, m, j = F.col(f"{one}.size"), F.col(f"{one}.place"), F.col(f"{other}.size"), F.col(f"{other}.place")
    needed = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - i - 1, m - j - 1) >= needed)


def _led(lists: DataFrame, percent: int) -> DataFrame:
    """Entries with the leader of their list, and whether the two ``fits``.

    The leader is the member with most entries in shared lists. The text that others are changed copies of has
    no shingles of its own among its rarest, so it leads, and one comparison each joins its copies.
    """
    weights = lists.groupBy("node").agg(F.count("*").alias("weight"))
    heads = lists.join(weights, "node").groupBy("token").agg(F.max(F.struct("weight", "node", "size", "place")).alias("head"))
    return stored(lists.join(stored(heads), "token").withColumn("own", F.struct("size", "place")).withColumn("fits", _possible("own", "head", percent)).withColumn("leader", F.col("head.node")).drop("own", "head"))


def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Inverted lists of each bucket: entries of lists with two nodes or more."""
    for payloads in _by_bucket(batches):
        yield from _bucket_lists(payloads)


def _bucket_lists(payloads: list) -> Iterator[pa.RecordBatch]:
    token, node, size, place = [], [], [], []
    for payload in payloads:
        data = memoryview(payload.as_buffer())
        sets, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
        at = 16 + 8 * sets
        counts = W.from_planes(data[at + 4 * sets :], sets, np.uint32)
        node.append(np.repeat(np.frombuffer(data[16:], np.int64, sets), counts))
        size.append(np.repeat(W.from_planes(data[at:], sets, np.uint32), counts))
        place.append(W.from_planes(data[at + 8 * sets :], n, np.uint32))
        token.append(np.frombuffer(data[at + 8 * sets + 4 * n :], np.uint64, n))
    if not token:
        return
    token, node, size, place = (np.concatenate(x) for x in (token, node, size, place))
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
    order, token, node = order[new], token[new], node[new]
    low, high = _split(token)
    length = np.repeat(high - low, high - low)
    more = length > 1
    size, place = size[order], place[order]
    for a in range(0, len(token), 1 << 18):
        m = more[a : a + (1 << 18)]
        own = np.flatnonzero(m) + a
        if len(own):
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[own].view(np.int64)), pa.array(node[own]), pa.array(size[own].astype(np.int32)), pa.array(place[own].astype(np.int32)), pa.array(length[own].astype(np.int32))],
                names=["token", "node", "size", "place", "length"],
            )


def _subsets(batches: Iterator[pa.RecordBatch], width: int, percent: int, light: int) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        shingles, offsets, ids = _distinct_sets(chunk, width)
        out_key, out_node, out_size, out_common = [], [], [], []
        for r in np.flatnonzero(np.diff(offsets) <= light):
            own = W.mix(shingles[offsets[r] : offsets[r + 1]])
            for o in subset_sizes(len(own), percent):
                picks = np.array(list(combinations(range(len(own)), o)))
                key = W.mix(own[picks].sum(axis=1) + np.uint64(o)).view(np.int64)
                out_key.append(key)
                out_node.append(np.full(len(key), ids[r]))
                out_size.append(np.full(len(key), len(own), np.int32))
                out_common.append(np.full(len(key), o, np.int32))
        if out_key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_key, out_node, out_size, out_common)], names=["key", "node", "size", "common"])


def light_links(texts: DataFrame, width: int, percent: int, light: int) -> DataFrame:
    """Links ``(a, b)`` among light sets, as stars: sets that share a subset large enough for both sizes.

    For a subset size and a set size, whatever sizes the partners have, the smallest set is their centre:
    of all sets with the subset, those of a size n link with every one of a size m iff common >= needed(n, m),
    so each size is joined to the smallest size it can link with, and that one to itself.
    """
    rows = stored(texts.mapInArrow(partial(_subsets, width=width, percent=percent, light=light), "key long, node long, size int, common int").distinct())
    heads = rows.groupBy("key", "common", "size").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    one, other = heads.alias("one"), heads.alias("other")
    need = F.ceil(F.lit(percent) * (F.col("one.size") + F.col("other.size")) / F.lit(100 + percent))
    sizes = (
        one.join(other, ["key", "common"])
        .where((F.col("common") >= need) & ((F.col("one.size") != F.col("other.size")) | (F.col("one.n") > 1)))
        .select("key", "common", F.col("one.size").alias("size"), F.col("other.head").alias("head"))
    )
    return rows.join(stored(sizes), ["key", "common", "size"]).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()


def _wanted_bits(ids: DataFrame, bits: int) -> np.ndarray:
    """A one-hash Bloom filter of ``bits`` bits over ``doc_id``, as bytes; its size doesn't grow with the data."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 64 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def _set_rows(batches: Iterator[pa.RecordBatch], wanted: object, width: int) -> Iterator[pa.RecordBatch]:
    words = wanted.value
    for batch in batches:
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        hit = (words[slot // 64].view(np.uint64) >> (slot % 64).astype(np.uint64)) & np.uint64(1) == 1
        yield from _sets_of(batch.filter(pa.array(hit)), width)


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks([batch]):
        shingles, offsets, ids = _sets(chunk, width)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([shingles[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["node", "shingles"])


def _check(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, other))
            both = np.concatenate([x, y])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _checked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose whole sets are linked.

    Whole texts stay where they are: a filter of fixed size tells the tasks that read them which documents
    (one per node) to make sets of; what it lets through by chance meets no pair.
    """
    pairs = stored(pairs)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi")
    bits = texts.sparkSession.sparkContext.broadcast(_wanted_bits(wanted, FILTER_BITS))
    slots = texts.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    sets = stored(slots.mapInArrow(partial(_set_rows, wanted=bits, width=width), "node long, shingles binary"))
    one, other = sets.toDF("a", "one"), sets.toDF("b", "other")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(partial(_check, percent=percent), "a long, b long").distinct()


def similar_groups(docs: DataFrame, width: int = 4, percent: int = 85, least_frequent: int = 32, most_keys: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_shingles, node, component_id)``, one row per document.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct ``width``-word
    shingles (A-Z lower-cased; fewer words: the whole sequence is one shingle). ``node`` identifies equal sets
    (64-bit hash), ``component_id`` is the smallest ``doc_id`` that links reach.

    Null and empty texts have no shingles, no node and their own component. Rows with a null ``doc_id`` keep a
    null component and link nothing. Repeated rows stay; equal ids with different texts each count by their
    text. Columns other than ``doc_id`` and ``text`` are not read.
    """
    return labelled_groups(docs, width, percent, least_frequent, most_keys).drop("label")


def labelled_groups(
    docs: DataFrame, width: int = 4, percent: int = 85, least_frequent: int = 32, most_keys: int = 1 << 20, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``similar_groups`` with ``label``, a node that tells components apart where an id has texts in several.

    The narrow columns named in ``carry`` (a row key, say) pass through to every row of the result.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    texts = every.where("doc_id is not null").select("doc_id", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in every.schema.fields if f.name in carry)
    nodes = stored(every.mapInArrow(partial(_nodes, width=width, carry=carry), "doc_id long, n_shingles long, node long" + (f", {kinds}" if kinds else "")))
    linked = nodes.where("n_shingles > 0 and doc_id is not null")
    histogram = {r.n: r["count"] for r in linked.where(F.col("n_shingles") <= 2 * MOST_ENUMERATED).groupBy(F.col("n_shingles").alias("n")).count().collect()}
    light = boundary(histogram, percent)
    frequent = spark.sparkContext.broadcast(frequent_keys(texts, width, least_frequent, most_keys))
    lists = stored(
        texts.mapInArrow(partial(_entries, frequent=frequent, width=width, percent=percent, light=light, buckets=buckets), "bucket int, payload binary")
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(partial(_lists, percent=percent), "token long, node long, size int, place int, length int")
    )
    lists = _led(lists, percent)
    near = lists.where("fits and node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = stored(light_links(texts, width, percent, light).unionByName(_checked(near, texts, linked, width, percent)))
    label = components(links)

    # Members of a list that are still apart, unless they have been compared.
    at = lists.where("length > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = stored(at.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most"))
    open_ = stored(at.join(apart, "token", "left_semi").select("token", "node", "size", "place", "label", "leader"))
    one, other = open_.alias("one"), open_.alias("other")
    rest = (
        one.join(other, "token")
        .where((F.col("one.label") < F.col("other.label")) & _possible("one", "other", percent) & (F.col("one.node") != F.col("other.leader")) & (F.col("other.node") != F.col("one.leader")))
        .select(F.least("one.node", "other.node").alias("a"), F.greatest("one.node", "other.node").alias("b")).distinct()
    )
    rest = stored(rest)
    if not rest.isEmpty():
        label = components(links.unionByName(_checked(rest, texts, linked, width, percent)))

    least = linked.groupBy("node").agg(F.min("doc_id").alias("least")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = least.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = stored(least.join(groups, "label").select("node", "component_id", "label"))
    return nodes.join(by_node, "node", "left").select(
        "doc_id", *carry, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"),
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).alias("label"),
    )


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their groups of near duplicates (``width``-word shingles,
    Jaccard similarity of ``percent`` or more): those whose id is the least of their component.

    Rows with a null id stay. Where one id has several rows in one component (repeated rows, or alike texts), the
    row whose text has the least (node, text hash) stays, so exactly one; unlike texts of one id are judged each
    for itself. Texts without shingles (null, empty, blank) link nothing: of one id's such rows one stays.

    Survivors are chosen on narrow rows (id, text hash, node, label) and stored; the wide rows meet them in one
    semi-join. Only rows that repeat both id and text hash are de-duplicated over their own small exchange.
    Extra columns of any name pass through unread.
    """
    key = "_near_key"
    while key in docs.columns:
        key += "_"
    text = F.col("text").cast("string")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")), text.isNull()))
    groups = labelled_groups(keyed, width, percent, carry=(key,)).where("doc_id is not null")
    head = groups.where("doc_id = component_id")
    chosen = head.groupBy("doc_id", "label").agg(F.min(F.struct("node", key)).alias("first")).select("doc_id", F.col("first")[key].alias(key))
    copies = groups.groupBy("doc_id", key).agg(F.count("*").alias("copies"))
    chosen = stored(chosen.join(copies, ["doc_id", key]))
    single = keyed.join(chosen.where("copies = 1").drop("copies"), ["doc_id", key], "left_semi")
    repeated = keyed.join(chosen.where("copies > 1").drop("copies"), ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return single.unionByName(repeated).select(*docs.columns).unionByName(docs.where("doc_id is null"))
