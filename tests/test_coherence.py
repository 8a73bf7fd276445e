import math

import pytest

from toposcope.operators.coherence import cooccurrence, embedding_coherence, mean_over_topics, umass

KEY = ("doc_id",)


@pytest.fixture(scope="module")
def topic(spark):
    return spark.createDataFrame([(0, 1, "w1"), (0, 2, "w2"), (0, 3, "w3")], "topic int, rank int, term string")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [["w1", "w2"], ["w1", "w2"], ["w1"], ["w1"], ["w2", "w3"]]
    return spark.createDataFrame([(i, w) for i, t in enumerate(texts) for w in t], "doc_id long, term string")


WANT = (math.log(3 / 4) + math.log(1 / 4) + math.log(2 / 3)) / 6


def test_umass_by_hand(topic, docs):
    row = umass(topic, docs, KEY).first()
    assert row["umass"] == pytest.approx(WANT) and row["umass"] == pytest.approx(math.log(1 / 8) / 6)
    assert row["null_pairs"] == 0


def test_umass_with_more_ranks_than_bits(topic, docs):
    assert umass(topic, docs, KEY).first()["umass"] == pytest.approx(WANT)


def test_absent_words_are_counted_not_infinite(topic, docs):
    row = umass(topic, docs.where("term <> 'w1'"), KEY).first()
    assert row["null_pairs"] == 2 and math.isfinite(row["umass"])


def test_cooccurrence_counts(topic, docs):
    found = {(r["wi"], r["wj"]): (r["n_both"], r["n_wj"]) for r in cooccurrence(topic, docs, KEY).collect()}
    assert found == {("w2", "w1"): (2, 4), ("w3", "w1"): (0, 4), ("w3", "w2"): (1, 3)}


def test_embedding_coherence(spark, topic):
    vectors = spark.createDataFrame([("w1", [1.0, 2.0]), ("w2", [1.0, 2.0])], "word string, vec array<double>")
    row = embedding_coherence(topic, vectors).first()
    assert row["coherence"] == pytest.approx(1 / (3 * 45)) and row["unknown"] == 1
    assert embedding_coherence(topic, vectors, norm="mean_pair").first()["coherence"] == pytest.approx(1.0)


def test_mean_over_topics(topic, docs):
    assert mean_over_topics(umass(topic, docs, KEY), "umass", 2).first()["umass"] == pytest.approx(WANT / 2)


@pytest.mark.parametrize("size", [12, 62, 70, 130])
def test_topics_of_any_length(spark, size):
    """Pair counts and the measure against plain counting; ranks run over one and several masks."""
    import math
    import random

    draw = random.Random(size)
    words = [f"t{r}" for r in range(1, size + 1)]
    held = [set(draw.sample(words, size // 2)) for _ in range(9)]
    topics = spark.createDataFrame([(0, r + 1, w) for r, w in enumerate(words)], "topic int, rank int, term string")
    rows = [(d, 0, w, 1) for d, own in enumerate(held) for w in own]
    docs = spark.createDataFrame(rows, "doc_id long, para_no long, term string, tf long").select(*KEY, "term", "tf")
    both = lambda *w: sum(all(x in own for x in w) for own in held)
    got = {(r["wi"], r["wj"]): (r["n_both"], r["n_wj"]) for r in cooccurrence(topics, docs, KEY).collect()}
    want = {(a, b): (both(a, b), both(b)) for i, a in enumerate(words) for b in words[:i]}
    assert got == want
    total = sum(math.log(n + 1) - math.log(m) for n, m in want.values() if m)
    assert umass(topics, docs, KEY).first()["umass"] == pytest.approx(total / (size * (size - 1)))


def test_hits_folded_in_rows_need_one_exchange(spark):
    """The in-row bitmap path agrees with the joined one and shuffles once, for the (topic, masks) count."""
    from pyspark.sql import functions as F

    from toposcope.operators.coherence import topic_hits

    topics = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 70, "z"), ("c", 0, "w")], "topic string, rank int, term string")
    sets = spark.createDataFrame([(1, ["x", "y", "y"]), (2, ["y"]), (3, ["z", "x", "q"]), (4, None), (5, []), (6, ["x", "y"])], "doc_id long, term array<string>")
    folded = topic_hits(topics, sets, ("doc_id",))
    joined = topic_hits(topics, sets.select("doc_id", F.explode("term").alias("term")), ("doc_id",))
    as_rows = lambda df: sorted((r.topic, tuple(r.ranks), r.n_docs) for r in df.collect())
    assert as_rows(folded) == as_rows(joined) == [("a", (0,), 1), ("a", (0, 1), 2), ("a", (1,), 1), ("b", (0,), 3), ("b", (70,), 1)]
    plan = topic_hits(topics, sets, ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
