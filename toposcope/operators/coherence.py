"""Topic coherence from document co-occurrence and from word vectors.

Topic tables ``(topic, rank, term)`` have k topics of n terms, both chosen by the caller, so they are
broadcast. Only documents' hits on these terms are grouped, never all term pairs of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from toposcope.functions.vectors import cosine
from toposcope.operators.terms import KEY
from toposcope.settings import small

MASK_BITS = 62
IN_ROW_CELLS = 20_000  # topic terms whose bitmap goes with the plan; larger tables are joined instead


def topic_pairs(topics: DataFrame, with_self: bool = False) -> DataFrame:
    """``(topic, i, j, wi, wj)``: each term of a topic with every better-ranked term of it (and itself)."""
    later = topics.select("topic", F.col("rank").alias("i"), F.col("term").alias("wi"))
    earlier = topics.select("topic", F.col("rank").alias("j"), F.col("term").alias("wj"))
    return later.join(small(earlier), "topic").where("j <= i" if with_self else "j < i")


def topic_hits(topics: DataFrame, doc_term: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``(topic, ranks, n_docs)``: documents per topic and set of the topic's terms they contain.

    ``doc_term`` is either ``(key, term)`` rows or one row per document with ``term`` an array of its terms
    (repeats allowed). For the latter, and a topic table of at most ``IN_ROW_CELLS`` terms, each row folds its
    terms into the topics' masks itself (``row_hits``): no exchange before the count. Otherwise each document
    sends one row per topic it touches, its ranks as bits of as many numbers as the longest topic needs, and
    documents with the same set are counted per task before the second shuffle.
    """
    if isinstance(doc_term.schema["term"].dataType, ArrayType):
        table = topics.select("topic", "rank", "term").limit(IN_ROW_CELLS + 1).collect()
        if len(table) <= IN_ROW_CELLS:
            return row_hits(table, doc_term.select("term"))
        doc_term = doc_term.select(*key, F.explode("term").alias("term")).distinct()
    hits = doc_term.join(small(topics.select("topic", "rank", "term")), "term")
    longest = topics.agg(F.max("rank")).first()[0] or 0
    words = [f"mask{w}" for w in range(longest // MASK_BITS + 1)]
    bit = F.expr(f"shiftleft(1L, cast(rank % {MASK_BITS} AS int))")
    own = [F.bit_or(F.when(F.expr(f"rank div {MASK_BITS} = {w}"), bit).otherwise(F.lit(0).cast("long"))).alias(m) for w, m in enumerate(words)]
    counts = hits.groupBy(*key, "topic").agg(*own).groupBy("topic", *words).agg(F.count("*").alias("n_docs"))
    ranks = [_set_bits(m, w * MASK_BITS) for w, m in enumerate(words)]
    return counts.select("topic", F.concat(*ranks).alias("ranks"), "n_docs")


def row_hits(table: list, sets: DataFrame) -> DataFrame:
    """``(topic, ranks, n_docs)`` from rows whose ``term`` array holds a document's terms.

    ``table`` holds the topic table's ``(topic, rank, term)`` rows. An inverted bitmap maps each topic term to
    its (topic, mask word, bit) places; it travels with the plan as one map. Every row folds its terms into
    one mask per topic and word, inline, and sends a row per topic it touches to the only exchange: the
    count of documents per (topic, masks), partly summed in each task.
    """
    topics = sorted({r["topic"] for r in table}, key=lambda t: (t is None, str(t)))
    index = {t: i for i, t in enumerate(topics)}
    width = max((r["rank"] for r in table), default=0) // MASK_BITS + 1
    places: dict = {}
    for r in table:
        place = F.struct(F.lit(index[r["topic"]] * width + r["rank"] // MASK_BITS).alias("slot"), F.lit(1 << (r["rank"] % MASK_BITS)).cast("long").alias("bit"))
        places.setdefault(r["term"], []).append(place)
    if not places:
        return sets.sparkSession.createDataFrame([], "topic string, ranks array<int>, n_docs long")
    bitmap = F.create_map(*[x for term, found in places.items() for x in (F.lit(term), F.array(*found))])
    empty = F.array().cast("array<struct<slot:int,bit:bigint>>")
    # A map is searched key by key, so a hash set picks the topics' terms first.
    own = F.array_distinct(F.filter("term", lambda t: t.isin(list(places))))
    hits = F.flatten(F.transform(own, lambda t: F.coalesce(F.element_at(bitmap, t), empty)))
    start = F.array_repeat(F.lit(0).cast("long"), len(topics) * width)
    masks = F.aggregate(hits, start, lambda acc, h: F.transform(acc, lambda x, i: F.when(i == h["slot"], x.bitwiseOR(h["bit"])).otherwise(x)))
    per_topic = F.transform(F.sequence(F.lit(0), F.lit(len(topics) - 1)), lambda ti: F.struct(ti.alias("ti"), F.slice(masks, ti * width + 1, width).alias("words")))
    touched = F.filter(per_topic, lambda p: F.exists(p["words"], lambda w: w != 0))
    counts = sets.where(F.col("term").isNotNull()).select(F.inline(touched)).groupBy("ti", "words").agg(F.count("*").alias("n_docs"))
    names = F.array(*[F.lit(t) for t in topics])
    ranks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda r: F.getbit(F.element_at("words", w + 1), r) == 1), lambda r: r + w * MASK_BITS)))
    return counts.select(F.element_at(names, F.col("ti") + 1).alias("topic"), ranks.alias("ranks"), "n_docs")


def _set_bits(mask: str, base: int) -> Column:
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda r: F.getbit(mask, r) == 1)
    return F.transform(bits, lambda r: r + base)


def cooccurrence(topics: DataFrame, doc_term: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``(topic, i, j, wi, wj, n_both, n_wj)`` for the ranked pairs of each topic, zeros included."""
    hits = topic_hits(topics, doc_term, key)
    inner = F.transform(
        F.col("ranks"),
        lambda i: F.transform(
            F.filter(F.col("ranks"), lambda j: j <= i), lambda j: F.struct(i.alias("i"), j.alias("j"))
        ),
    )
    counted = (
        hits.select("topic", "n_docs", F.inline(F.flatten(inner)))
        .groupBy("topic", "i", "j")
        .agg(F.sum("n_docs").alias("n"))
    )
    # The pair (j, j) holds the documents of wj; reading it by a window keeps this one pass over the hits.
    alone = F.max(F.when(F.col("i") == F.col("j"), F.col("n"))).over(Window.partitionBy("topic", "j"))
    return (
        topic_pairs(topics, with_self=True)
        .join(counted, ["topic", "i", "j"], "left")
        .withColumn("n_wj", F.coalesce(alone, F.lit(0)))
        .where("i <> j")
        .select("topic", "i", "j", "wi", "wj", F.coalesce("n", F.lit(0)).alias("n_both"), "n_wj")
    )


def umass(topics: DataFrame, doc_term: DataFrame, key: tuple[str, ...] = KEY, eta: float = 1.0) -> DataFrame:
    """``(topic, umass, null_pairs)``: mean over n(n-1) of ln(D(wi,wj)+eta) - ln D(wj).

    A pair whose wj is in no document has no value; such pairs are left out of the sum and counted.
    """
    value = F.when(F.col("n_wj") > 0, F.log(F.col("n_both") + eta) - F.log("n_wj"))
    size = topics.groupBy("topic").agg(F.count("*").alias("n"))
    sums = (
        cooccurrence(topics, doc_term, key)
        .groupBy("topic")
        .agg(F.sum(value).alias("total"), F.count_if(value.isNull()).alias("null_pairs"))
    )
    return size.join(sums, "topic", "left").select(
        "topic",
        (F.coalesce("total", F.lit(0.0)) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("umass"),
        F.coalesce("null_pairs", F.lit(0)).alias("null_pairs"),
    )


def embedding_coherence(
    topics: DataFrame, word_vectors: DataFrame, norm: str = "reference", pairs: int = 45
) -> DataFrame:
    """``(topic, coherence, unknown)``: cosines over a topic's term pairs.

    ``norm='reference'`` divides by n times the fixed ``pairs`` (those of ten terms); ``'mean_pair'`` by
    the pairs that have a value. ``unknown`` counts terms without a vector; their pairs add nothing.
    """
    terms = topics.select("topic", "rank", "term")
    # Word vectors are the large side: one pass, only the topic terms' vectors are kept.
    vectors = word_vectors.join(small(terms), word_vectors["word"] == terms["term"]).select("topic", "rank", "vec")
    later = vectors.select("topic", F.col("rank").alias("i"), F.col("vec").alias("vi"))
    earlier = vectors.select("topic", F.col("rank").alias("j"), F.col("vec").alias("vj"))
    value = cosine(F.col("vi"), F.col("vj"))
    sums = (
        later.join(earlier, "topic")
        .where("j < i")
        .select("topic", value.alias("value"))
        .groupBy("topic")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n_pairs"))
    )
    known = vectors.groupBy("topic").agg(F.count("*").alias("n_known"))
    size = topics.groupBy("topic").agg(F.count("*").alias("n"))
    divisor = F.col("n") * pairs if norm == "reference" else F.nullif(F.col("n_pairs"), F.lit(0))
    return (
        size.join(known, "topic", "left")
        .join(sums, "topic", "left")
        .select(
            "topic",
            (F.coalesce("total", F.lit(0.0)) / divisor).alias("coherence"),
            (F.col("n") - F.coalesce("n_known", F.lit(0))).alias("unknown"),
        )
    )


def mean_over_topics(per_topic: DataFrame, value: str, k: int) -> DataFrame:
    """Sum over topics divided by k."""
    return per_topic.agg((F.sum(value) / k).alias(value))
