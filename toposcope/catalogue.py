"""Named queries over the test tables, one per operator, for the result check and the benchmark.

Each takes ``(spark, folder)`` and runs over whole tables. ``toposcope.oracle`` has the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.functions.text import term_counts
from toposcope.functions.vectors import symmetric_divergence
from toposcope.operators import audit, coherence, embeddings, heldout, lemma, nearest, paragraphs, randomised, report, split, terms, tfidf
from toposcope.plans import workflows
from toposcope.settings import checkpointed, discard_stored, row_count, spread, stored
from toposcope.sources.text import document_lines
from toposcope.sources.words import parse_word_vectors

Query = Callable[[SparkSession, str], DataFrame]

# A stop list for the four languages of the test texts.
STOP_WORDS = [
    "the", "and", "for", "that", "with", "are", "les", "des", "est", "que", "une", "pour", "dans", "der",
    "die", "das", "und", "den", "von", "los", "las", "del", "por", "con", "para",
]
MIN_DF = 2
MAX_CENTRES = 10_000
KEY = terms.KEY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def r6(value: Column) -> Column:
    """Six digits, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def text_rows(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Every paragraph of every document, the unclosed last ones included."""
    return paragraphs.segment_documents(documents(spark, folder), keep_trailing=True, **options)


def word_rows(spark: SparkSession, folder: str, **options) -> DataFrame:
    return paragraphs.remove_stop_words(text_rows(spark, folder, **options), STOP_WORDS)


def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_frequency(word_rows(spark, folder))


def doc_freqs(spark: SparkSession, folder: str) -> DataFrame:
    return terms.document_frequency(doc_terms(spark, folder), MIN_DF)


def counted_rows(spark: SparkSession, folder: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counted terms of every paragraph with a ``row_id``, stored: for queries that need them more than once."""
    counted = terms.count_terms(word_rows(spark, folder, carry=carry))
    return stored(counted.withColumn("row_id", F.monotonically_increasing_id()))


def joined_words(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.size("words").alias("n_words"), F.concat_ws(" ", "words").alias("content"))


# --- segmentation -------------------------------------------------------------------------------


def line_tokens(spark: SparkSession, folder: str) -> DataFrame:
    lines = paragraphs.tagged_lines(documents(spark, folder))
    return lines.select("doc_id", "line_no", F.posexplode("tokens").alias("token_no", "token"))


def separator_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = paragraphs.tagged_lines(documents(spark, folder))
    return lines.where("is_separator").select("doc_id", "line_no", F.size("tokens").alias("n_tokens"))


def paragraphs_closed(spark: SparkSession, folder: str) -> DataFrame:
    return joined_words(paragraphs.segment_documents(documents(spark, folder)))


def paragraphs_all(spark: SparkSession, folder: str) -> DataFrame:
    return joined_words(text_rows(spark, folder))


def paragraphs_next_line(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return joined_words(
        paragraphs.segment_documents(docs, emit="next_line", drop_words=STOP_WORDS, strip=True)
    )


def paragraph_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Segmentation of a table of lines (no document has to fit one row)."""
    lines = document_lines(documents(spark, folder))
    found = paragraphs.segment_lines(lines)
    return found.select(*KEY, "line_no", F.concat_ws(" ", "words").alias("content"))


def conversation_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    found = paragraphs.segment_lines(
        table(spark, folder, "conversations"), doc="conv_id", order="turn", line="text", keep_trailing=True
    )
    return found.select("conv_id", "para_no", "turn", F.concat_ws(" ", "words").alias("content"))


def stopword_filter_ci(spark: SparkSession, folder: str) -> DataFrame:
    return joined_words(word_rows(spark, folder))


def stopword_filter_cs(spark: SparkSession, folder: str) -> DataFrame:
    return joined_words(paragraphs.remove_stop_words(text_rows(spark, folder), STOP_WORDS, case_sensitive=True))


def stopword_filter_join(spark: SparkSession, folder: str) -> DataFrame:
    """The long-table form, for stop lists of any size."""
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    counts = terms.term_frequency(text_rows(spark, folder))
    return paragraphs.remove_stop_words_by_join(counts, stop).select(*KEY, "term", "tf")


def nonempty_docs(spark: SparkSession, folder: str) -> DataFrame:
    kept = paragraphs.remove_stop_words(text_rows(spark, folder), STOP_WORDS, drop_empty=False)
    return kept.agg(F.count("*").alias("n_docs"), F.count_if(F.size("words") > 0).alias("n_nonempty"))


# --- terms --------------------------------------------------------------------------------------


def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    return doc_terms(spark, folder)


def term_freq_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per group of many rows."""
    rows = word_rows(spark, folder, carry=("source",)).select("source", F.explode("words").alias("term"))
    return terms.group_term_frequency(rows, ("source",))


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return doc_freqs(spark, folder)


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return terms.vocabulary(doc_freqs(spark, folder))


def vocabulary_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    return terms.vocabulary(doc_freqs(spark, folder), max_terms=None)


def trim_vocab_most(spark: SparkSession, folder: str) -> DataFrame:
    return terms.trim_vocabulary(doc_freqs(spark, folder), 1000, "most")


def hashed_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Collisions of signed feature hashing of the whole vocabulary into 2^12 slots."""
    return terms.collision_ledger(terms.hashed_terms(doc_freqs(spark, folder), 12))


def trim_vocab_least(spark: SparkSession, folder: str) -> DataFrame:
    return terms.trim_vocabulary(doc_freqs(spark, folder), 1000, "least")


def min_nonzeros(spark: SparkSession, folder: str) -> DataFrame:
    counts = terms.listed_terms(counted_rows(spark, folder))
    return terms.min_nonzeros(counts, terms.document_frequency(counts, MIN_DF), 20)


def dict_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = terms.normalise_words(documents(spark, folder), ("doc_id",))
    counts = terms.document_frequency(terms.term_frequency(docs, ("doc_id",)), 1)
    return terms.filter_extremes(counts, row_count(docs)).select("term", "df")


def corpus_sizes(spark: SparkSession, folder: str) -> DataFrame:
    counted = counted_rows(spark, folder)
    frequencies = terms.document_frequency(terms.listed_terms(counted), MIN_DF)
    return frequencies.agg(
        F.count("*").alias("n_terms"), F.sum("df").alias("n_pairs"), F.sum("cf").alias("n_words")
    ).withColumn("n_docs", row_count(counted))


def idf(spark: SparkSession, folder: str) -> DataFrame:
    counted = counted_rows(spark, folder)
    frequencies = terms.document_frequency(terms.listed_terms(counted), MIN_DF)
    found = tfidf.inverse_document_frequency(frequencies, row_count(counted))
    return found.select("term", "df", r6(F.col("idf")).alias("idf"))


def weighted(weighting: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        counted = counted_rows(spark, folder)
        counts = terms.listed_terms(counted)
        out = tfidf.weigh_terms(counts, terms.document_frequency(counts, MIN_DF), row_count(counted), weighting)
        return out.select(*KEY, "term", r6(F.col("weight")).alias("weight"))

    return run


def term_vectors(counted: DataFrame) -> tuple[DataFrame, tfidf.TermVectors]:
    """Bounded vocabulary of counted rows, as a table and as vector maker."""
    vocab = checkpointed(terms.vocabulary(terms.document_frequency(terms.listed_terms(counted), MIN_DF)))
    return vocab, tfidf.TermVectors.of(vocab, counted.count())


def weighted_vectors(weighting: str) -> Query:
    """The same weights from vectors over the bounded vocabulary, without a shuffle of terms."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        counted = counted_rows(spark, folder)
        vectors = term_vectors(counted)[1]
        rows = vectors.weights(vectors.rows(counted), weighting)
        return vectors.long(rows).select(*KEY, "term_id", r6(F.col("weight")).alias("weight"))

    return run


def tf_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Counted terms against the words of the same row; expects no bad one."""
    rows = word_rows(spark, folder).select("words", term_counts(F.col("words")).alias("counted"))
    bad = terms.inconsistent_counts(F.col("words"), F.col("counted"))
    n_words = F.aggregate("counted", F.lit(0).cast("long"), lambda s, t: s + t["tf"])
    return rows.agg(
        F.sum(F.size("counted")).alias("n_checked"), F.sum(n_words).alias("n_words"), F.sum(F.size(bad)).alias("n_bad")
    )


# --- topics and coherence -----------------------------------------------------------------------


def topics_of(counted: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` terms with the greatest summed weight (idf times the term's share of its document) per language.

    The idf comes out of the sum, so shares are summed per (language, term) in each task and only those sums meet
    the vocabulary. A document's total leaves out the terms below ``MIN_DF`` = 2; each is in one row, whose id comes
    with the term's counts. Rows of equal keys share their total.
    """
    pairs = counted.select("row_id", F.inline("terms"))
    frequencies = stored(
        pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("row_id").alias("row_id"))
    )
    rare = frequencies.where(F.col("df") < MIN_DF).groupBy("row_id").agg(F.sum("cf").alias("rare"))
    size = F.aggregate("terms.tf", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = counted.select("row_id", *KEY, "lang", size.alias("size")).join(rare, "row_id", "left")
    known = F.col("size") - F.coalesce("rare", F.lit(0))
    totals = sizes.select("row_id", F.sum(known).over(Window.partitionBy(*KEY, "lang")).alias("total")).where("total > 0")
    shares = counted.select("row_id", "lang", "terms").join(totals, "row_id").select("lang", "total", F.inline("terms"))
    sums = shares.groupBy("lang", "term").agg(F.sum(F.col("tf") / F.col("total")).alias("share"))
    vocab = tfidf.inverse_document_frequency(frequencies.where(F.col("df") >= MIN_DF), row_count(counted))
    weights = sums.join(vocab.select("term", "idf"), "term").select(
        F.col("lang").alias("topic"), "term", r6(F.col("share") * F.col("idf")).alias("weight")
    )
    return nearest.top_rows(weights, "topic", [F.desc("weight"), F.asc("term")], n).select(
        "topic", "rank", "term", "weight"
    )


def language_topics(spark: SparkSession, folder: str) -> DataFrame:
    """``(topic, rank, term, weight)`` with a language as topic."""
    return topics_of(counted_rows(spark, folder, carry=("lang",)))


def topics_and_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Language topics and the documents' terms, from one pass over the texts."""
    counted = counted_rows(spark, folder, carry=("lang",))
    return checkpointed(topics_of(counted)), counted.select(*KEY, F.col("terms.term").alias("term"))


def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    found = coherence.cooccurrence(*topics_and_terms(spark, folder))
    return found.select("topic", "wi", "wj", "n_both", "n_wj")


def umass_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    found = coherence.umass(*topics_and_terms(spark, folder))
    return found.select("topic", r6(F.col("umass")).alias("umass"), "null_pairs")


def umass_mean(spark: SparkSession, folder: str) -> DataFrame:
    found = coherence.umass(*topics_and_terms(spark, folder))
    return found.agg(r6(F.sum("umass") / F.count("*")).alias("umass"))


def umass_long_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Coherence of topics of 12 and of 70 terms per language."""
    counted = counted_rows(spark, folder, carry=("lang",))
    sets = counted.select(*KEY, F.col("terms.term").alias("term"))
    longest = checkpointed(topics_of(counted, 70))
    sized = [(n, coherence.umass(longest.where(F.col("rank") <= n), sets)) for n in (12, 70)]
    return workflows.union_all([
        found.select(F.lit(n).alias("size"), "topic", r6(F.col("umass")).alias("umass"), "null_pairs") for n, found in sized
    ])


# --- word vectors -------------------------------------------------------------------------------


def numbered_vectors(vocab: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The term with id i has the i-th vector of the table: ``(word, vec)``."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("term_id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    names = vocab.select("term_id", F.col("term").alias("word"))
    return stored(vectors.join(names, "term_id").select("word", "vec"))


def word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return numbered_vectors(vocabulary(spark, folder), spark, folder)


def label_centres(spark: SparkSession, folder: str) -> np.ndarray:
    """Mean vector of each label; the number of labels is checked before they are fetched."""
    rows = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("dim", "value"))
    means = rows.groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean")))["mean"].alias("vec"))
    found = centres.limit(MAX_CENTRES + 1).collect()
    if len(found) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} labels")
    found.sort(key=lambda r: r["label"])
    return np.array([r["vec"] for r in found])


def doc_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the documents' word vectors, weighted by tf times tf idf."""
    counted = counted_rows(spark, folder)
    vocab, vectors = term_vectors(counted)
    rows = vectors.weights(vectors.rows(counted), "product")
    known = checkpointed(embeddings.vocabulary_vectors(vocab, numbered_vectors(vocab, spark, folder)))
    found = embeddings.document_vectors(rows, known, len(vectors.terms))
    return found.select(*KEY, F.posexplode("vec").alias("dim", "value")).withColumn("value", r6(F.col("value")))


def embed_coherence(spark: SparkSession, folder: str) -> DataFrame:
    counted = counted_rows(spark, folder, carry=("lang",))
    frequencies = terms.document_frequency(terms.listed_terms(counted), MIN_DF)
    vectors = numbered_vectors(terms.vocabulary(frequencies), spark, folder)
    found = coherence.embedding_coherence(checkpointed(topics_of(counted)), vectors)
    return found.select("topic", r6(F.col("coherence")).alias("coherence"), "unknown")


def oov_words(spark: SparkSession, folder: str) -> DataFrame:
    words = text_rows(spark, folder).select(F.explode("words").alias("word"))
    return embeddings.unknown_words(words, word_vectors(spark, folder))


def oov_count(spark: SparkSession, folder: str) -> DataFrame:
    words = text_rows(spark, folder).select(F.explode("words").alias("word"))
    return workflows.oov_report(words, word_vectors(spark, folder))[1]


def embeddings_text(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as text lines and read back."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vec")
    )
    back = parse_word_vectors(embeddings.embedding_lines(vectors))
    return back.select("word", F.posexplode("vec").alias("dim", "value")).withColumn("value", r6(F.col("value")))


def label_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec")
    )


def raw_nearest_clusters(spark: SparkSession, folder: str, metric: str, n: int) -> DataFrame:
    centres = label_centres(spark, folder)
    return nearest.nearest_centres(label_vectors(spark, folder), ("doc_id",), "vec", centres, n, metric)


def nearest_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = raw_nearest_clusters(spark, folder, "cosine", 5)
    return found.withColumn("weight", r6(F.col("weight")))


def nearest_clusters_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    found = raw_nearest_clusters(spark, folder, "sqeuclidean", 5)
    return found.withColumn("weight", r6(F.col("weight")))


def raw_nearest_words(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    found = nearest.nearest_rows(
        word_vectors(spark, folder), ("word",), "vec", label_centres(spark, folder), 10, metric
    )
    return found.select("topic", "rank", F.col("word").alias("term"), "weight")


def nearest_words(spark: SparkSession, folder: str) -> DataFrame:
    return raw_nearest_words(spark, folder, "cosine").withColumn("weight", r6(F.col("weight")))


def nearest_words_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    return raw_nearest_words(spark, folder, "sqeuclidean").withColumn("weight", r6(F.col("weight")))


def sizes(counted: DataFrame) -> list[Row]:
    """``(lang, total)``: each language's words."""
    size = F.aggregate("terms.tf", F.lit(0).cast("long"), lambda s, x: s + x)
    return counted.where("lang IS NOT NULL AND size(terms) > 0").groupBy("lang").agg(F.sum(size).alias("total")).orderBy("lang").collect()


def language_profiles(counted: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(term, w)`` of the vocabulary and the languages: a term's share of each language's words, null for none.

    One row per term from one count, so that no (language, term) rows are joined.
    """
    totals = sizes(counted)
    pairs = terms.listed_terms(counted, ("lang",))
    counts = pairs.groupBy("term").agg(
        F.count("*").alias("df"), *[F.sum(F.when(F.col("lang") == r["lang"], F.col("tf"))).alias(f"n{i}") for i, r in enumerate(totals)]
    )
    shares = [F.col(f"n{i}") / F.lit(r["total"]) for i, r in enumerate(totals)]
    vocab = counts.where((F.col("df") >= MIN_DF) & F.col("term").isNotNull())
    return vocab.select("term", F.array(*shares).cast("array<double>").alias("w")), [r["lang"] for r in totals]


def divergence_words(spark: SparkSession, folder: str) -> DataFrame:
    """Ten terms with the least divergence from the mean profile of each source's language mix.

    Features are the languages; a centre is a source's share of paragraphs per language.
    """
    mix = text_rows(spark, folder, carry=("lang", "source")).groupBy("source", "lang").agg(F.count("*").alias("n"))
    totals = mix.groupBy("source").agg(F.sum("n").alias("total"))
    centres = mix.join(totals, "source").select(
        F.col("source").alias("topic"), F.col("lang").alias("feature"), (F.col("n") / F.col("total")).alias("c")
    )
    return divergence_from(*language_profiles(counted_rows(spark, folder, carry=("lang",))), checkpointed(centres))


def divergence_from(profiles: DataFrame, features: list[str], centres: DataFrame, n: int = 10) -> DataFrame:
    """Terms ``(term, w)``, one weight per name in ``features``, against centres ``(topic, feature, c)``.

    A feature that a term lacks still counts with the centre's part, c ln 2, so each centre's whole is
    taken first and corrected by the features the term has. A term meets every centre in its own row;
    only each task's best ``n`` terms per topic are shuffled.
    """
    alone = symmetric_divergence(F.lit(0.0), F.col("c"))
    parts = [F.max(F.when(F.col("feature") == f, F.col("c"))) for f in features]
    topics = centres.where("topic IS NOT NULL").groupBy("topic").agg(
        F.sum(alone).alias("whole"), F.array(*parts).cast("array<double>").alias("c")
    )
    met = topics.agg(F.collect_list(F.struct("topic", "whole", "c"))).scalar()
    found = profiles.select("term", "w", F.inline(met))
    changes = []
    for i in range(len(features)):
        w, c = F.get("w", F.lit(i)), F.get("c", F.lit(i))
        change = symmetric_divergence(w, c) - symmetric_divergence(F.lit(0.0), c)
        changes.append(F.when(w.isNotNull() & c.isNotNull(), change))
    scored = found.where(F.exists(F.arrays_zip("w", "c"), lambda x: x["w"].isNotNull() & x["c"].isNotNull())).select(
        "topic", "term", r6(sum((F.coalesce(x, F.lit(0.0)) for x in changes), F.lit(0.0)) + F.col("whole")).alias("weight")
    )
    return nearest.top_rows(scored, "topic", [F.asc("weight"), F.asc("term")], n).select(
        "topic", "rank", "term", "weight"
    )


# --- lemmas -------------------------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}-]+|[.,!?;:]"


def tagged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, line_no, tokens)``: the (tok_no, token, tag) of every line, with a tag made by rule from the token's form."""

    def tagged(token: Column, number: Column) -> Column:
        size = F.length(token)
        tag = (
            F.when(token.rlike("^[.,!?;:]$"), "PUNC")
            .when(size <= 3, "DET")
            .when(size % 5 == 0, "NC")
            .when(size % 5 == 1, "V")
            .when(size % 5 == 2, "ADV")
            .when(size % 5 == 3, "ADJ")
            .otherwise("XX")
        )
        return F.struct(number.alias("tok_no"), token.alias("token"), tag.alias("tag"))

    lines = document_lines(documents(spark, folder))
    return lines.select("doc_id", "line_no", F.transform(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)), tagged).alias("tokens"))


def tagged_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The same, one token a row."""
    return tagged_lines(spark, folder).select("doc_id", "line_no", F.inline("tokens"))


def word_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon made by rule from the corpus vocabulary: up to three rows per form, one pair twice."""
    words = text_rows(spark, folder).select(F.explode("words").alias("word"))
    forms = words.select(F.lower("word").alias("form")).distinct()
    size = F.length("form")
    entries = F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit("nc").alias("pos"), F.expr("left(form, length(form) - 1)").alias("lemma"), (size % 3 != 0).alias("used")),
        F.struct(F.lit(2).alias("line_no"), F.lit("v").alias("pos"), F.concat("form", F.lit("r")).alias("lemma"), (size % 2 == 0).alias("used")),
        F.struct(F.lit(3).alias("line_no"), F.lit("v").alias("pos"), F.concat("form", F.lit("er")).alias("lemma"), (size % 4 == 0).alias("used")),
    )
    return forms.select("form", F.inline(entries)).where("used").select("form", "pos", "lemma", "line_no")


def looked_up(spark: SparkSession, folder: str) -> DataFrame:
    return lemma.look_up(tagged_tokens(spark, folder), word_lexicon(spark, folder))


def lemmatise(spark: SparkSession, folder: str) -> DataFrame:
    return lemma.lemma_lines(tagged_lines(spark, folder), word_lexicon(spark, folder))


def lemma_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lemma.lemma_statistics(looked_up(spark, folder))


def removed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the removed tokens, so that each (tag, text) is one row."""
    found = lemma.removed_tokens(lemma.with_fate(tagged_tokens(spark, folder)))
    return found.groupBy("Pos", "Text").agg(F.count("*").alias("n"))


def unknown_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lemma.unknown_forms(looked_up(spark, folder))


# --- split --------------------------------------------------------------------------------------


def train_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.train_held_out(text_rows(spark, folder))[0].select(*KEY)


def heldout_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.train_held_out(text_rows(spark, folder))[1].select(*KEY)


def heldout_by_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The held-out part as a set difference over whole rows."""
    rows = text_rows(spark, folder).select(*KEY)
    return split.rows_not_in(rows, split.train_held_out(rows)[0])


# --- report -------------------------------------------------------------------------------------


def topic_map(spark: SparkSession, folder: str) -> DataFrame:
    """All clusters of every vector by falling cosine: the topic map the reports start from."""
    return raw_nearest_clusters(spark, folder, "cosine", MAX_CENTRES)


def topic_map_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = report.wide_topic_map(raw_nearest_clusters(spark, folder, "cosine", 5), 5)
    return wide.select(
        "id", *[c for i in range(1, 6) for c in (F.col(f"topic_index_{i}"), r6(F.col(f"topic_weight_{i}")).alias(f"topic_weight_{i}"))]
    )


def topic_map_long(spark: SparkSession, folder: str) -> DataFrame:
    wide = report.wide_topic_map(raw_nearest_clusters(spark, folder, "cosine", 5), 5)
    return report.long_topic_map(wide, 5).withColumn("weight", r6(F.col("weight")))


def topic_words_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = report.wide_topic_words(raw_nearest_words(spark, folder, "cosine"), 10)
    return wide.select(
        "topic_id", *[c for i in range(1, 11) for c in (F.col(f"term_name_{i}"), r6(F.col(f"term_weight_{i}")).alias(f"term_weight_{i}"))]
    )


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return report.merge_topics(topic_map(spark, folder), report.topic_labels(spark))


def topic_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark, folder).select(
        "doc_id", "topic", "label", "rank", r6(F.col("weight")).alias("weight"), r6(F.col("top_weight")).alias("top_weight")
    )


def topic_merge_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Merged topics where most of the raw topics have no label."""
    shifted = topic_map(spark, folder).withColumn("topic", F.col("topic") + 12)
    return report.merge_topics(shifted, report.topic_labels(spark)).select(
        "doc_id", "topic", "label", "rank", r6(F.col("weight")).alias("weight"), r6(F.col("top_weight")).alias("top_weight")
    )


def topic_share(spark: SparkSession, folder: str) -> DataFrame:
    return report.topic_shares(merged(spark, folder)).select("doc_id", "topic", "share")


def topic_positions(spark: SparkSession, folder: str) -> DataFrame:
    return report.topic_positions(report.topic_shares(merged(spark, folder)))


def topic_counts(spark: SparkSession, folder: str) -> DataFrame:
    return report.topic_counts(topic_map(spark, folder))


def docfreq_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return report.frequency_histogram(doc_freqs(spark, folder))


def topic_captions(spark: SparkSession, folder: str) -> DataFrame:
    return report.topic_captions(raw_nearest_words(spark, folder, "cosine"), report.topic_labels(spark))


def rank_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measures by k made from the topic map: mean cosine and summed distance down to rank k."""
    ranks = topic_map(spark, folder)
    by_rank = ranks.groupBy(F.col("rank").alias("k")).agg(
        F.avg("weight").alias("word2vec"), F.sum(1 - F.col("weight")).alias("wsse")
    )
    return by_rank.unpivot("k", ["word2vec", "wsse"], "metric", "value").select(
        F.lit("embedding").alias("model"), "k", "metric", "value"
    )


def best_k(spark: SparkSession, folder: str) -> DataFrame:
    return report.best_k(rank_measures(spark, folder)).withColumn("value", r6(F.col("value")))


def measures_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = report.wide_measures(rank_measures(spark, folder), ["wsse", "word2vec"])
    return wide.select("topic", r6(F.col("wsse")).alias("wsse"), r6(F.col("word2vec")).alias("word2vec"))


# --- models -------------------------------------------------------------------------------------

FEW = {"max_iter": 10, "subsamplingRate": 1.0}  # every step sees every text


def corpus(spark: SparkSession, folder: str) -> workflows.Corpus:
    return workflows.prepare(documents(spark, folder), STOP_WORDS, keep_trailing=True, min_df=MIN_DF)


def corpus_and_vectors(spark: SparkSession, folder: str) -> tuple[workflows.Corpus, DataFrame]:
    """The corpus, and word vectors for its vocabulary, from one pass over the texts."""
    texts = corpus(spark, folder)
    return texts, numbered_vectors(texts.vocab, spark, folder)


def lda_topics(spark: SparkSession, folder: str) -> DataFrame:
    return workflows.analyse("lda", corpus(spark, folder), 5, **FEW)["topics"]


def lda_doc_topics(spark: SparkSession, folder: str) -> DataFrame:
    return workflows.analyse("lda", corpus(spark, folder), 5, **FEW)["doc_topics"]


def lda_sweep(spark: SparkSession, folder: str) -> DataFrame:
    texts, vectors = corpus_and_vectors(spark, folder)
    return workflows.sweep("lda", texts, [2, 4], word_vectors=vectors, kmeans={"max_iter": 20}, **FEW)


def lda_sweep_asymmetric(spark: SparkSession, folder: str) -> DataFrame:
    return workflows.sweep("lda", corpus(spark, folder), [5], prior="asymmetric", kmeans={"max_iter": 20}, **FEW)


def lda_cluster_words(spark: SparkSession, folder: str) -> DataFrame:
    found = workflows.analyse("lda_clusters", corpus(spark, folder), 4, lda_k=10, kmeans={"max_iter": 20}, **FEW)
    return found["topics"]


def svd_values(spark: SparkSession, folder: str) -> DataFrame:
    svd = workflows.decompose(corpus(spark, folder), 10)
    return report.singular_value_curve(svd.values(spark))


def lsa(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return workflows.analyse("lsa", corpus(spark, folder), 5, rank=10, max_iter=20, tables=(name,))[name]

    return run


def lsa_sweep(spark: SparkSession, folder: str) -> DataFrame:
    texts, vectors = corpus_and_vectors(spark, folder)
    return workflows.sweep("lsa", texts, [2, 4, 6], word_vectors=vectors, rank=10)


def embed_topics(spark: SparkSession, folder: str) -> DataFrame:
    texts, vectors = corpus_and_vectors(spark, folder)
    return workflows.analyse("embedding", texts, 5, word_vectors=vectors, max_iter=20)["topics"]


def embed_doc_topics(spark: SparkSession, folder: str) -> DataFrame:
    texts, vectors = corpus_and_vectors(spark, folder)
    return workflows.analyse("embedding", texts, 5, word_vectors=vectors, scaling=True, max_iter=20)["doc_topics"]


def embed_sweep(spark: SparkSession, folder: str) -> DataFrame:
    texts, vectors = corpus_and_vectors(spark, folder)
    return workflows.sweep("embedding", texts, [3, 5], word_vectors=vectors, max_iter=20)


def tfidf_cluster_words(spark: SparkSession, folder: str) -> DataFrame:
    return workflows.analyse("tfidf_clusters", corpus(spark, folder), 5, max_iter=20)["topics"]


# --- what every fit must hold, whatever it found ---------------------------------------------------


def in_falling_order(weight: str = "weight") -> Column:
    """Whether a group's weights fall with ``rank``."""
    weights = F.sort_array(F.collect_list(F.struct("rank", weight)))[weight]
    return weights == F.sort_array(weights, asc=False)


def lda_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph's topic shares: their number, sum and order."""
    shares = workflows.analyse("lda", corpus(spark, folder), 5, top=5, **FEW)["doc_topics"]
    return shares.groupBy(*KEY).agg(
        F.count_distinct("topic").alias("n_topics"), r6(F.sum("weight")).alias("total"), in_falling_order().alias("falling")
    )


def word_ranks(topics: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per topic: its words, ranks, words under their own id, and whether the weights fall."""
    own = vocab.select("term_id", F.col("term").alias("own"))
    return topics.join(own, "term_id", "left").groupBy("topic").agg(
        F.count_distinct("term").alias("n_words"), F.count_distinct("rank").alias("n_ranks"), F.max("rank").alias("last"),
        F.count_if(F.col("term") == F.col("own")).alias("n_known"), in_falling_order().alias("falling"),
    )


def lda_word_ranks(spark: SparkSession, folder: str) -> DataFrame:
    texts = corpus(spark, folder)
    return word_ranks(workflows.analyse("lda", texts, 5, **FEW)["topics"], texts.vocab)


def tfidf_cluster_ranks(spark: SparkSession, folder: str) -> DataFrame:
    texts = corpus(spark, folder)
    return word_ranks(workflows.analyse("tfidf_clusters", texts, 5)["topics"], texts.vocab)


def lsa_word_ranks(spark: SparkSession, folder: str) -> DataFrame:
    texts = corpus(spark, folder)
    return word_ranks(workflows.analyse("lsa", texts, 5, rank=10, tables=("topics",))["topics"], texts.vocab)


def lda_heldout_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the held-out paragraphs, as likelihood over perplexity."""
    measures = workflows.sweep("lda", corpus(spark, folder), [2, 4], **FEW)
    by_name = measures.groupBy("k").agg(*[
        F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in ("logLikelihood", "logPerplexity")
    ])
    return by_name.select("k", F.round(-F.col("logLikelihood") / F.col("logPerplexity")).cast("long").alias("tokens"))


def uncut_decomposition(spark: SparkSession, folder: str, audited: bool = False) -> tuple[float, randomised.RandomisedDecomposition]:
    """Rank 200 of the paragraphs' idf-weighted term shares over every term (no vocabulary cut), randomised; and the
    matrix's energy where it is asked for. The counted rows go once the fit has its own pieces of them."""
    texts = workflows.prepare(documents(spark, folder), STOP_WORDS, keep_trailing=True, min_df=MIN_DF, max_terms=None)
    rows = texts.weighted("relative")
    energy = randomised.energy(rows) if audited else float("nan")
    matrix = randomised.Matrix.of(rows, len(texts.terms))
    discard_stored(texts.rows)
    return energy, randomised.RandomisedDecomposition.of_matrix(matrix, texts.vocab.select("term_id", "term"), rank=200)


def lda_heldout_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Per held-out paragraph: words and the LDA bound under fixed topics (the training paragraphs of each language,
    λ = 0.1 + counts) and the fixed uniform mixture (α = 0.5)."""
    counted = counted_rows(spark, folder, carry=("lang",))
    pairs = counted.select(*KEY, F.coalesce("lang", F.lit("")).alias("topic"), F.inline("terms"))
    vocab = stored(terms.document_frequency(pairs, MIN_DF).select("term"))
    bucket = split.split_bucket(KEY)
    train = stored(pairs.where(bucket < 800).groupBy("term", "topic").agg(F.sum("tf").alias("tf")).join(vocab, "term"))
    topics = sorted(r[0] for r in train.select("topic").distinct().collect())
    expectations = heldout.topic_expectations(train, vocab, topics, 0.1)
    found = heldout.fixed_mixture_bounds(pairs.where(bucket >= 800), expectations, KEY, len(topics), 0.5)
    return found.select(*KEY, "tokens", (F.round("bound", 3) + 0.0).alias("bound"))


def kmeans_stationary(spark: SparkSession, folder: str) -> DataFrame:
    """k-means (k = 10) of the embedding vectors fitted to a fixed point, audited by sufficient sums: per cluster
    whether its centre is its members' mean, and the rows counted in all."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").where(F.col("embedding").isNotNull())
    vectors = vectors.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    fit = KMeans(k=10, maxIter=1000, tol=0.0, seed=7, featuresCol="features").fit(vectors.select(array_to_vector("embedding").alias("features")))
    found = audit.centre_audit(vectors, "embedding", np.array(fit.clusterCenters()))
    return found.select("cluster", (F.col("defect") <= 1e-9).alias("stationary"), F.sum("size").over(Window.partitionBy()).alias("n_rows"))


def lsa_uncut_values(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 largest singular values of the uncut matrix."""
    _, fit = uncut_decomposition(spark, folder)
    return fit.values(spark).select("concept", r6(F.col("sigma")).alias("sigma"))


def lsa_uncut_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The ten terms of largest absolute weight in each of the first five concepts of the uncut rank-200 fit."""
    _, fit = uncut_decomposition(spark, folder)
    return fit.topics(5, 10).select("topic", "rank", "term", r6(F.col("weight")).alias("weight"))


def lsa_uncut_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per concept of the uncut rank-200 fit: V'V against the identity, u = A v / sigma of length 1 (within 5 %),
    sigma falling, and the squared singular values within the matrix's energy."""
    energy, fit = uncut_decomposition(spark, folder, audited=True)
    defect = fit.gram_defect()
    per_concept = spark.createDataFrame(
        [(i, float(d), bool(i + 1 == fit.rank or fit.sigma[i] >= fit.sigma[i + 1])) for i, d in enumerate(defect)], "concept int, defect double, falling boolean"
    )
    return fit.left_sizes().join(F.broadcast(per_concept), "concept").select(
        "concept", r6(F.col("defect")).alias("v_defect"), (F.abs(F.col("u_size") - 1) <= 0.05).alias("u_near"), "falling",
        r6(F.lit(energy)).alias("energy"), F.lit(bool((fit.sigma**2).sum() <= energy * (1 + 1e-9))).alias("within"),
    )


def svd_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per concept: length of u (1 if the document side agrees with sigma), V'V against the identity, and energy."""
    texts = corpus(spark, folder)
    svd = workflows.decompose(texts, 10)
    rows = texts.weighted("relative")
    energy = rows.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x))).scalar()
    defect = np.abs(svd.v.T @ svd.v - np.eye(svd.rank)).max(axis=1)
    per_concept = spark.createDataFrame([(i, float(d)) for i, d in enumerate(defect)], "concept int, defect double")
    sizes = svd.left_vectors(svd.project(rows, texts.key), texts.key).groupBy("concept").agg(F.sum(F.col("u") ** 2).alias("u_size"))
    return sizes.join(F.broadcast(per_concept), "concept").select(
        "concept", r6(F.col("u_size")).alias("u_size"), r6(F.col("defect")).alias("v_defect"), r6(energy).alias("energy"),
        (F.lit(float((svd.sigma**2).sum())) <= energy * (1 + 1e-9)).alias("within"),
    )


def lsa_document_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph's concept weights: their number, order, and a squared sum of at most 1."""
    shares = workflows.analyse("lsa", corpus(spark, folder), 5, rank=10, tables=("doc_topics",))["doc_topics"]
    return shares.groupBy(*KEY).agg(
        F.count_distinct("topic").alias("n_topics"), in_falling_order().alias("falling"),
        (F.coalesce(F.sum(F.col("weight") ** 2), F.lit(0.0)) <= 1 + 1e-9).alias("within"),
    )


def embed_cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs in k-means clusters, and those whose cluster isn't the nearest centre's."""
    texts, vectors = corpus_and_vectors(spark, folder)
    fit = workflows.cluster_embeddings(workflows.embed_documents(texts, vectors)[0], 5)
    placed = fit.model.transform(fit.documents)
    found = nearest.nearest_centres(placed, (*KEY, "cluster"), "vec", fit.centres, 1, "sqeuclidean")
    return found.agg(
        F.count("*").alias("n_docs"), F.count_distinct("cluster").alias("n_clusters"),
        F.count_if(F.col("cluster") != F.col("topic")).alias("n_elsewhere"),
    )


SQL_CHECKED: dict[str, Query] = {
    f.__name__: f
    for f in (
        line_tokens, separator_lines, paragraphs_closed, paragraphs_all, paragraphs_next_line, paragraph_lines,
        conversation_paragraphs, stopword_filter_ci, stopword_filter_cs, stopword_filter_join, nonempty_docs,
        term_freq, term_freq_by_source, doc_freq, vocabulary, vocabulary_unbounded, trim_vocab_most,
        trim_vocab_least, hashed_ledger, min_nonzeros, dict_filter, corpus_sizes, idf, tf_consistency, language_topics,
        cooccurrence, umass_by_topic, umass_mean, doc_vectors, embed_coherence, oov_words, oov_count,
        embeddings_text, nearest_clusters, nearest_clusters_euclidean, nearest_words, nearest_words_euclidean,
        divergence_words, lemmatise, lemma_stats, removed_tokens, unknown_forms, train_split, heldout_split,
        heldout_by_difference, topic_map_wide, topic_map_long, topic_words_wide, topic_merge, topic_share,
        topic_positions, topic_counts, docfreq_histogram, topic_captions, best_k, measures_wide,
        umass_long_topics, topic_merge_unlabelled, lda_mixtures, lda_word_ranks, tfidf_cluster_ranks, lsa_word_ranks,
        lda_heldout_tokens, svd_invariants, lsa_document_shares, embed_cluster_members, lsa_uncut_invariants, kmeans_stationary, lda_heldout_bound,
    )
}
SQL_CHECKED |= {
    "tfidf_lsa": weighted("relative"),
    "tfidf_ml": weighted("tfidf"),
    "tf2idf_norm": weighted("tf2idf"),
    "tfidf_ntc": weighted("ntc"),
    "tfidf_lsa_vectors": weighted_vectors("relative"),
    "tf2idf_norm_vectors": weighted_vectors("tf2idf"),
    "tfidf_ntc_vectors": weighted_vectors("ntc"),
}

ROWS_ONLY: dict[str, Query] = {
    f.__name__: f
    for f in (
        lda_topics, lda_doc_topics, lda_sweep, lda_sweep_asymmetric, lda_cluster_words, svd_values, lsa_sweep,
        embed_topics, embed_doc_topics, embed_sweep, tfidf_cluster_words, lsa_uncut_values, lsa_uncut_topics,
    )
}
ROWS_ONLY |= {
    "lsa_topic_words": lsa("topics"),
    "lsa_raw_topic_words": lsa("raw_topics"),
    "lsa_svd_topic_words": lsa("svd_topics"),
    "lsa_doc_topics": lsa("doc_topics"),
    "lsa_concept_documents": lsa("concept_documents"),
}
