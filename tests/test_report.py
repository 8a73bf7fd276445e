import pytest
from pyspark.sql import functions as F

from toposcope.operators import report


@pytest.fixture(scope="module")
def labels(spark):
    return report.topic_labels(spark)


def topic_map(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, rank int, topic int, weight double")


def test_labels(labels):
    assert labels.count() == 17
    assert labels.where("topic = 5").count() == 2 and labels.where("topic = -1").count() == 7


def test_merge_keeps_first_two_topics(spark, labels):
    # Raw topics 8 and 11 are both topic 5; 1 is unknown; 3 is topic 2.
    doc = topic_map(spark, [(1, 1, 8, 0.6), (1, 2, 11, 0.5), (1, 3, 1, 0.3), (1, 4, 3, 0.1), (2, 1, 8, 0.9)])
    merged = report.merge_topics(doc, labels)
    rows = sorted((r["doc_id"], r["rank"], r["topic"], r["weight"], r["top_weight"]) for r in merged.collect())
    assert rows == [(1, 1, 5, 0.6, 0.6), (1, 3, -1, 0.3, 0.6), (2, 1, 5, 0.9, 0.9)]
    shares = report.topic_shares(merged)
    assert {(r["doc_id"], r["topic"]): r["share"] for r in shares.collect()} == {(1, 5): 16, (1, -1): 8, (2, 5): 36}
    places = report.topic_positions(shares)
    assert {(r["doc_id"], r["topic"]): (r["start"], r["stop"]) for r in places.collect()} == {
        (1, 10): (0, 8), (1, 5): (8, 24), (2, 5): (0, 36),
    }


def test_share_is_cut_toward_zero_and_zero_sum_skipped(spark, labels):
    doc = topic_map(spark, [(1, 1, 0, 0.5), (1, 2, 2, -0.1), (2, 1, 0, 0.0)])
    shares = report.topic_shares(report.merge_topics(doc, labels))
    assert {(r["doc_id"], r["topic"]): r["share"] for r in shares.collect()} == {(1, 0): 25, (1, 1): -5}


def test_counts_use_the_leading_run(spark):
    doc = topic_map(
        spark, [(1, 1, 0, 1.0), (1, 2, 1, 0.05), (1, 3, 2, 0.5), (2, 1, 0, 1.0), (2, 2, 1, 0.4), (2, 3, 2, 0.3), (2, 4, 3, 0.2), (2, 5, 4, 0.2)]
    )
    assert {r["topic"]: r["n_docs"] for r in report.topic_counts(doc).collect()} == {0: 2, 1: 1, 2: 1, 3: 1}


def test_histogram_edges(spark):
    freq = spark.createDataFrame([(d,) for d in [0, 1, 2, 24, 25, 26]], "df long")
    found = {r["bin"]: (r["n_terms"], r["low"]) for r in report.frequency_histogram(freq).collect()}
    assert found == {1: (2, 0.0), 2: (1, 1.25), 20: (2, 23.75)}


def test_captions(spark, labels):
    topics = spark.createDataFrame([(t, r, f"t{t}w{r}", 0.5) for t in (8, 11) for r in range(1, 8)], "topic int, rank int, term string, weight double")
    assert [tuple(r) for r in report.topic_captions(topics, labels).collect()] == [(5, "[Malheur] t8w1 t8w2 t8w3 t8w4 t8w5")]


def test_best_k_and_wide(spark):
    rows = [("lda", k, m, v) for k, m, v in [(2, "umass", -1.0), (3, "umass", -0.5), (4, "umass", -0.5), (2, "wsse", 9.0), (3, "wsse", 4.0)]]
    measures = spark.createDataFrame(rows, "model string, k int, metric string, value double")
    assert {r["metric"]: (r["k"], r["value"]) for r in report.best_k(measures).collect()} == {"umass": (3, -0.5), "wsse": (3, 4.0)}
    wide = report.wide_measures(measures, ["wsse", "umass"]).orderBy("topic").collect()
    assert [tuple(r) for r in wide] == [(2, 9.0, -1.0), (3, 4.0, -0.5), (4, None, -0.5)]


def test_wide_and_back(spark):
    doc = topic_map(spark, [(1, 1, 4, 0.6), (1, 2, 0, 0.5), (2, 1, 3, 0.9)])
    back = report.long_topic_map(report.wide_topic_map(doc, 2), 2).withColumnRenamed("id", "doc_id")
    assert back.exceptAll(doc).count() == 0 and back.count() == 3


def test_curve(spark):
    values = spark.createDataFrame([(0, 2.0), (1, 1.0)], "concept int, sigma double")
    assert [r["cumulative"] for r in report.singular_value_curve(values).orderBy(F.col("concept")).collect()] == [0.8, 1.0]


def test_topics_without_a_label_count_as_unknown(spark):
    labels = report.topic_labels(spark)
    rows = [(1, 1, 18, 0.9), (1, 2, 19, 0.05), (1, 3, 0, 0.1), (2, 1, 20, 1.0)]
    doc = spark.createDataFrame(rows, "doc_id long, rank int, topic int, weight double")
    got = {(r["doc_id"], r["rank"]): (r["topic"], r["top_weight"]) for r in report.merge_topics(doc, labels).collect()}
    known = labels.where("raw_topic = 0").first()["topic"]
    want = {(1, 1): (report.UNKNOWN, 0.9), (2, 1): (report.UNKNOWN, 1.0)}
    assert got == want | ({} if known == report.UNKNOWN else {(1, 3): (known, 0.9)})
