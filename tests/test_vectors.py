import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from toposcope.functions.vectors import centre_scores, symmetric_divergence
from toposcope.operators import nearest
from toposcope.operators.embeddings import document_vectors, embedding_lines, unknown_words
from toposcope.sources.words import parse_word_vectors

KEY = ("doc_id",)


@pytest.fixture(scope="module")
def weighted(spark):
    rows = [(1, [0, 1], [1.0, 3.0]), (2, [2], [5.0]), (3, [0, 2], [2.0, 9.0])]
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, weights array<double>")


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "term_id long, term string, vec array<double>")


@pytest.mark.parametrize("max_bytes", [1 << 30, 0])
def test_document_vectors_both_ways(weighted, known, max_bytes):
    found = {r["doc_id"]: r["vec"] for r in document_vectors(weighted, known, 3, KEY, max_bytes).collect()}
    assert found == {1: [0.25, 0.75], 2: [0.0, 0.0], 3: [1.0, 0.0]}


def test_document_vectors_without_a_known_term(weighted, known):
    found = document_vectors(weighted, known.where("term_id < 0"), 3, KEY, width=2).collect()
    assert [r["vec"] for r in found] == [[0.0, 0.0]] * 3


def test_zero_vector_has_no_cosine(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "doc_id long, vec array<double>")
    centres = np.array([[1.0, 0.0], [0.0, 1.0]])
    found = nearest.nearest_centres(rows, KEY, "vec", centres, 2).collect()
    assert {(r["doc_id"], r["rank"], r["topic"]): r["weight"] for r in found} == {
        (1, 1, 0): None, (1, 2, 1): None, (2, 1, 0): 1.0, (2, 2, 1): 0.0,
    }
    best = nearest.nearest_rows(rows, KEY, "vec", centres, 1).collect()
    assert [(r["topic"], r["doc_id"]) for r in sorted(best, key=lambda r: r["topic"])] == [(0, 2), (1, 2)]


def test_euclidean_ranks_ascending(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "doc_id long, vec array<double>")
    found = nearest.nearest_centres(rows, KEY, "vec", np.array([[5.0, 0.0], [1.0, 0.0]]), 1, "sqeuclidean").collect()
    assert {(r["doc_id"], r["topic"], r["weight"]) for r in found} == {(1, 1, 1.0), (2, 1, 1.0)}


def test_divergence(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "doc_id long, vec array<double>")
    scores = rows.select("doc_id", centre_scores(spark, F.col("vec"), np.array([[0.5, 0.5]]), "divergence").alias("s"))
    found = {r["doc_id"]: r["s"][0] for r in scores.collect()}
    want = math.log(2) - math.log(1.5) + 0.5 * math.log(1 / 1.5) + 0.5 * math.log(1 / 0.5)
    assert found[1] == pytest.approx(0.0) and found[2] == pytest.approx(want)
    parts = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "w double, c double")
    assert parts.agg(F.sum(symmetric_divergence(F.col("w"), F.col("c")))).first()[0] == pytest.approx(want)


def test_unknown_words(spark):
    words = spark.createDataFrame([("Mot",), ("mot",), ("12",), ("Connu",)], "word string")
    known = spark.createDataFrame([("connu",)], "word string")
    assert [r["word"] for r in unknown_words(words, known).collect()] == ["mot"]


def test_vector_text_round_trip(spark):
    vectors = spark.createDataFrame([("mot", [0.1, -2e-7]), ("autre", [1.0, 0.0])], "word string, vec array<double>")
    lines = embedding_lines(vectors)
    assert "autre\t1.0,0.0" in [r["value"] for r in lines.collect()]
    assert parse_word_vectors(lines).exceptAll(vectors).count() == 0
    twice = lines.union(spark.createDataFrame([("autre\t0.5,9",)], "value string"))
    assert parse_word_vectors(twice).where("word = 'autre'").first()["vec"] == [1.0, 0.0]


def test_joined_means_sort_no_pairs(spark, weighted, known):
    """Before: a vector aggregate, which sorts every (document, term) pair with its vector from 128 documents on."""
    found = document_vectors(weighted, known, 3, KEY, 0)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    many = spark.range(400).selectExpr("id as doc_id", "array(0, 1, 2) as ids", "array(1.0D, cast(id as double), 5.0D) as weights")
    one, other = ({r["doc_id"]: r["vec"] for r in document_vectors(many, known, 3, KEY, size).collect()} for size in (0, 1 << 30))
    assert len(one) == 400 and all(np.allclose(one[k], other[k], rtol=1e-12) for k in other)


def test_stored_vectors_need_no_python(spark):
    """Before: sparse vectors were made by a pandas function, in a second Python worker per task, and kept in memory."""
    from toposcope.operators import terms, tfidf

    words = spark.createDataFrame([(1, 0, ["b", "x", "a", "b"]), (2, 0, ["x"]), (3, 0, ["a"])], "doc_id long, para_no int, words array<string>")
    vectors = tfidf.TermVectors(["b", "a", "c"], np.array([1.0, 2.0, 3.0]), 3)
    rows = vectors.rows(terms.count_terms(words))
    assert [tuple(r) for r in rows.orderBy("doc_id").collect()] == [(1, 0, [0, 1], [2.0, 1.0], [1.0, 2.0]), (3, 0, [1], [1.0], [2.0])]
    found = vectors.vectors(rows, "tf", "tf")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["tf"] for r in found.collect()} == {1: Vectors.sparse(3, {0: 2.0, 1: 1.0}), 3: Vectors.sparse(3, {1: 1.0})}


def test_known_entries_in_pieces(spark, monkeypatch):
    from toposcope.functions import vectors

    monkeypatch.setattr(vectors, "PIECE_WORDS", 3)
    rows = [(i, ["t%d" % j for j in range(i, -1, -1)], [j + 1 for j in range(i, -1, -1)]) for i in range(6)] + [(6, None, None), (7, [], [])]
    df = spark.createDataFrame(rows, "i int, w array<string>, n array<long>").coalesce(1)
    found = df.select("i", vectors.known_entries(spark, F.col("w"), F.col("n"), ["t0", "t2", "t4"], np.array([0.5, 1.5, 2.5])).alias("e"))
    for r in found.collect():
        want = [j for j in (0, 2, 4) if r["i"] < 6 and j <= r["i"]]
        assert (r["e"]["ids"], r["e"]["counts"], r["e"]["idfs"]) == ([j // 2 for j in want], [j + 1.0 for j in want], [j / 2 + 0.5 for j in want])
