import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from toposcope import catalogue
from toposcope.operators import models, split
from toposcope.plans import workflows

FOLDER = "/root/testdata/sf0.001"
KEY = ("doc_id", "para_no")


@pytest.fixture(scope="module")
def corpus(spark):
    prepared = workflows.prepare(
        catalogue.table(spark, FOLDER, "documents"), catalogue.STOP_WORDS, keep_trailing=True, min_df=6
    )
    yield prepared
    prepared.close()


@pytest.fixture(scope="module")
def word_vectors(spark):
    return catalogue.word_vectors(spark, FOLDER)


def matrix_of(corpus, weighting):
    rows = corpus.weighted(weighting).orderBy(*corpus.key).collect()
    a = np.zeros((len(rows), len(corpus.terms)))
    for i, r in enumerate(rows):
        a[i, r["ids"]] = r["weights"]
    return a


def test_corpus_sizes(corpus):
    sizes = corpus.sizes()
    assert sizes["terms"] == corpus.vocab.count() and 0 < sizes["documents"] <= sizes["documents_read"]


def test_svd_equals_dense_svd(spark, corpus):
    svd = workflows.decompose(corpus, 6)
    a = matrix_of(corpus, "relative")
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(svd.sigma, s[:6], rtol=1e-6) and np.all(np.diff(svd.sigma) <= 0)
    assert np.sum(svd.sigma**2) <= np.sum(a**2) + 1e-9
    assert np.allclose(svd.v.T @ svd.v, np.eye(6), atol=1e-8)
    assert np.allclose(np.abs(svd.v), np.abs(vt[:6].T), atol=1e-4)
    projected = svd.project(corpus.weighted("relative"), corpus.key)
    vec = np.array([r["vec"] for r in projected.orderBy(*corpus.key).collect()])
    assert np.allclose(vec, a @ svd.v)
    joined = svd.project(corpus.weighted("relative"), corpus.key, max_bytes=0).orderBy(*corpus.key).collect()
    assert np.allclose(np.array([r["vec"] for r in joined]), vec) and np.all([r["size"] > 0 for r in joined])
    left = svd.left_vectors(projected, corpus.key).where("concept = 2").orderBy(*corpus.key).collect()
    assert np.allclose(np.abs([r["u"] for r in left]), np.abs(u[:, 2]), atol=1e-4)

    top = svd.topics(spark, 3, 4).where("topic = 1").orderBy("rank").collect()
    want = np.argsort(-np.abs(svd.v[:, 1]), kind="stable")[:4]
    assert [r["term"] for r in top] == [corpus.terms[i] for i in want]
    docs = svd.documents(projected, corpus.key, 2).where("rank = 1").orderBy(*corpus.key).collect()
    shares = (a @ svd.v) / np.linalg.norm(a, axis=1)[:, None]
    assert [r["topic"] for r in docs] == list(shares.argmax(axis=1))
    best = svd.concept_documents(projected, corpus.key, 1).where("concept = 0").first()
    assert best["u"] == pytest.approx((a @ svd.v[:, 0] / svd.sigma[0]).max())


def test_the_solver_keeps_no_rows_in_memory(corpus, monkeypatch):
    """Before: the rows were kept in memory and on disk; what had gone to disk was read whole into buffers each time."""
    from toposcope.operators import svd

    levels, matrix = [], svd.RowMatrix
    monkeypatch.setattr(svd, "RowMatrix", lambda rows: levels.append(rows.storageLevel) or matrix(rows))
    workflows.decompose(corpus, 3)
    assert [(level.useMemory, level.useDisk) for level in levels] == [(False, True)]


def test_lda_invariants_and_repeatability(corpus):
    rows = corpus.vector("tf", "tf")
    first, again = (models.fit_lda(rows, 3, max_iter=3) for _ in range(2))
    assert np.allclose(first.topicsMatrix().toArray(), again.topicsMatrix().toArray())
    shares = models.lda_documents(first, rows, corpus.key, 3).groupBy(*corpus.key).agg(F.sum("weight").alias("s"))
    assert shares.where("abs(s - 1) > 1e-9").count() == 0
    topics = models.lda_topics(first, corpus.terms, 5)
    assert topics.count() == 15 and topics.where("weight <= 0").count() == 0
    profiles = models.lda_term_profiles(first, corpus.terms)
    total = profiles.select(F.posexplode("profile").alias("t", "p")).groupBy("t").agg(F.sum("p").alias("s"))
    assert total.where("abs(s - 1) > 1e-9").count() == 0


def test_lda_options(corpus):
    rows = corpus.vector("tf", "tf")
    em = models.fit_lda(rows, 2, max_iter=2, optimizer="em", doc_concentration=5.0, topic_concentration=2.0)
    assert em.isDistributed()
    prior = models.asymmetric_prior(4)
    assert sum(prior) == pytest.approx(1.0) and prior == sorted(prior, reverse=True)
    assert models.fit_lda(rows, 4, max_iter=1, doc_concentration=prior).getDocConcentration() == pytest.approx(prior)


def test_scaled_centres_come_back_unscaled(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal((0, 0), 0.1, (30, 2)), rng.normal((10, 100), 0.1, (30, 2))])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "doc_id long, vec array<double>")
    rows = rows.withColumn("vector", array_to_vector("vec"))
    centres = workflows.cluster_embeddings(rows, 2, scaling=True, seed=1).centres
    assert np.allclose(sorted(centres.tolist()), [points[:30].mean(axis=0), points[30:].mean(axis=0)])


def test_cost_does_not_rise_with_iterations(corpus):
    rows = corpus.vector("ntc", "unit")
    costs = [models.fit_kmeans(rows, 4, "unit", max_iter=i, seed=7).summary.trainingCost for i in (1, 5, 20)]
    assert costs[0] >= costs[1] >= costs[2]


def test_centre_terms(spark):
    found = models.centre_terms(spark, np.array([[0.1, 0.9, 0.5], [1.0, 0.0, 0.0]]), ["a", "b", "c"], 2)
    rows = sorted((r["topic"], r["rank"], r["term"], r["weight"]) for r in found.collect())
    assert rows == [(0, 1, "b", 0.9), (0, 2, "c", 0.5), (1, 1, "a", 1.0), (1, 2, "b", 0.0)]


def test_split_is_whole_disjoint_and_stable(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("para_no"))
    train, held_out = split.train_held_out(rows)
    assert train.count() + held_out.count() == 2000 and train.intersect(held_out).count() == 0
    assert 0.75 < train.count() / 2000 < 0.85
    again = split.train_held_out(rows.repartition(7))[0]
    assert again.exceptAll(train).count() == 0
    assert split.rows_not_in(rows, train).exceptAll(held_out).count() == 0
    assert split.sample_rows(rows, 0.5, 1).count() == split.sample_rows(rows, 0.5, 1).count()


def test_sweeps(corpus, word_vectors):
    lda = workflows.sweep("lda", corpus, [2], word_vectors=word_vectors, max_iter=2, kmeans={"max_iter": 5})
    assert {r["metric"] for r in lda.collect()} == {"logLikelihood", "logPerplexity", "wsse", "umass", "word2vec"}
    every = workflows.sweep("lda", corpus, [2], fit_on="all", prior="asymmetric", max_iter=2, kmeans={"max_iter": 5})
    assert every.where("metric = 'umass'").first()["value"] < 0
    lsa = workflows.sweep("lsa", corpus, [2, 3], word_vectors=word_vectors, rank=4)
    assert {(r["k"], r["metric"]) for r in lsa.collect()} == {(k, m) for k in (2, 3) for m in ("umass", "word2vec")}
    emb = workflows.sweep("embedding", corpus, [2], word_vectors=word_vectors, max_iter=5, distance="euclidean", weighting="tfidf")
    assert emb.count() == 3 and emb.where("value IS NULL").count() == 0


def test_analyses(corpus, word_vectors):
    lda = workflows.analyse("lda", corpus, 3, max_iter=2)
    assert lda["topics"].count() == 30 and lda["doc_topics"].where("rank = 1").count() == corpus.rows.count()
    clusters = workflows.analyse("lda_clusters", corpus, 2, lda_k=4, max_iter=2, kmeans={"max_iter": 5})
    assert clusters["topics"].count() == 20 and clusters["documents"].count() == corpus.rows.count()
    assert clusters["topics"].where("weight < 0").count() == 0
    lsa = workflows.analyse("lsa", corpus, 3, rank=4, max_iter=5)
    assert lsa["raw_topics"].count() == lsa["topics"].count() == lsa["svd_topics"].count() == 30
    assert lsa["doc_topics"].count() == 4 * corpus.rows.count() and lsa["singular_values"].count() == 4
    emb = workflows.analyse("embedding", corpus, 3, word_vectors=word_vectors, max_iter=5, scaling=True)
    assert emb["topics"].count() == 30 and emb["doc_topics"].count() == 3 * corpus.rows.count()
    assert emb["unknown"].count() == len(corpus.terms) - word_vectors.join(corpus.vocab, F.col("word") == F.col("term")).count()
    raw = workflows.analyse("tfidf_clusters", corpus, 3, max_iter=5)
    assert raw["topics"].count() == 30 and raw["documents"].select("topic").distinct().count() <= 3


def test_lemmatise_workflow(spark):
    tagged = spark.createDataFrame([(1, 0, 0, "portes", "V")], "doc_id long, line_no int, tok_no int, token string, tag string")
    lexicon = spark.createDataFrame([("portes", "v", "porter", 0)], "form string, pos string, lemma string, line_no long")
    found = workflows.lemmatise(tagged, lexicon)
    assert found["text"].first()["text"] == "porter" and found["unknown"].count() == 0
