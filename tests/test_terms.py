import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcope.operators import terms, tfidf
from toposcope.settings import row_count

KEY = ("doc_id",)


@pytest.fixture(scope="module")
def words(spark):
    rows = [(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["b", "c", "c", "c"])]
    return spark.createDataFrame(rows, "doc_id long, words array<string>").cache()


@pytest.fixture(scope="module")
def counts(words):
    return terms.term_frequency(words, KEY)


def test_vocabulary_order_and_idf(counts):
    freq = terms.document_frequency(counts, 2)
    vocab = terms.vocabulary(freq)
    assert [(r["term"], r["cf"], r["df"]) for r in vocab.orderBy("term_id").collect()] == [("c", 4, 2), ("a", 3, 2), ("b", 2, 2)]
    assert {round(r["idf"], 12) for r in tfidf.inverse_document_frequency(freq, 3).collect()} == {round(math.log(4 / 3), 12)}
    assert terms.vocabulary(freq, 2).count() == 2


def test_unbounded_ids_equal_window_ids(spark):
    freq = spark.range(5000).select(
        F.concat(F.lit("t"), (F.col("id") * 7919 % 5000).cast("string")).alias("term"),
        F.lit(2).cast("long").alias("df"),
        (F.col("id") % 13).alias("cf"),
    )
    bounded, whole = terms.vocabulary(freq), terms.vocabulary(freq.repartition(5), None)
    assert bounded.select("term_id", "term").exceptAll(whole.select("term_id", "term")).count() == 0
    assert whole.count() == 5000


def test_counts_are_consistent(words, counts):
    assert terms.inconsistent_terms(counts, words, KEY).count() == 0
    wrong = counts.where("doc_id = 1").withColumn("term", F.concat("term", F.lit("x")))
    assert terms.inconsistent_terms(wrong, words, KEY).count() == 2


def test_trim_and_extremes(spark):
    freq = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 9)], "term string, df long")
    assert [r["term"] for r in terms.trim_vocabulary(freq, 2, "most").collect()] == ["d", "b"]
    assert [r["term"] for r in terms.trim_vocabulary(freq, 2, "least").collect()] == ["a", "b"]
    assert {r["term"] for r in terms.filter_extremes(freq, 10, 2, 0.5, None).collect()} == {"b", "c"}
    assert [r["term"] for r in terms.filter_extremes(freq, 10, 1, 1.0, 1).collect()] == ["d"]


def test_min_nonzeros(counts):
    freq = terms.document_frequency(counts, 2)
    assert terms.min_nonzeros(counts, freq, 1, KEY).count() == 3
    assert terms.min_nonzeros(counts, freq, 2, KEY).count() == 0


@pytest.mark.parametrize("weighting", ["relative", "tfidf", "tf2idf", "ntc"])
def test_long_weights_equal_vectors(words, counts, weighting):
    freq = terms.document_frequency(counts, 2)
    vocab = terms.vocabulary(freq)
    long = tfidf.weigh_terms(counts, freq, row_count(words), weighting, KEY).join(vocab, "term")
    vectors = tfidf.TermVectors.of(vocab, 3)
    narrow = vectors.long(vectors.weights(vectors.rows(terms.count_terms(words), KEY), weighting), KEY)
    a = {(r["doc_id"], r["term_id"]): r["weight"] for r in long.collect()}
    b = {(r["doc_id"], r["term_id"]): r["weight"] for r in narrow.collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_vectors_and_minimum(words, counts):
    vocab = terms.vocabulary(terms.document_frequency(counts, 2))
    vectors = tfidf.TermVectors.of(vocab, 3)
    assert vectors.rows(terms.count_terms(words), KEY, 2).count() == 0
    dense = {r["doc_id"]: r["tf"].toArray() for r in vectors.vectors(vectors.rows(terms.count_terms(words), KEY), "tf", "tf", KEY).collect()}
    assert np.array_equal(dense[3], [3, 0, 1]) and np.array_equal(dense[1], [0, 2, 1])
    with pytest.raises(ValueError):
        tfidf.TermVectors.of(vocab, 3, max_terms=2)


def test_inconsistent_counts_in_a_row(spark):
    rows = spark.createDataFrame(
        [(["a", "b"], [("a", 1), ("c", 2), ("b", 0)]), ([], []), (["a"], [("a", 1)])],
        "words array<string>, counted array<struct<term:string,tf:int>>",
    )
    bad = rows.select(terms.inconsistent_counts(F.col("words"), F.col("counted")).alias("bad")).collect()
    assert [[t.term for t in r.bad] for r in bad] == [["c", "b"], [], []]


def test_least_frequent_equals_a_sort_and_sends_little(spark):
    """Exact against a sort with a limit, through ties on the frequency and on long term prefixes."""
    import random

    from toposcope.operators.terms import least_frequent

    rng = random.Random(7)
    rows = [(f"{rng.choice(['ab', 'abc', 'b', 'zz'])}{rng.randint(0, 999):03d}{i}", rng.choice([1, 2, 2, 2, 3, 5, 40, 41]), 1) for i in range(3000)]
    rows += [("same" + "x" * 30 + str(i), 2, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "term string, df long, cf long").repartition(7)
    for n in (0, 1, 10, 333, 1000, 3399, 5000):
        want = sorted(rows, key=lambda r: (r[1], r[0]))[:n]
        assert sorted(tuple(r) for r in least_frequent(df, "df", n).collect()) == sorted(want)


def test_signed_hashing_and_its_ledger(spark):
    import hashlib

    from toposcope.operators.terms import collision_ledger, hashed_terms

    rows = [(f"t{i}é", 1, i + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "term string, df long, cf long")
    got = {r.term: (r.slot, r.sign) for r in hashed_terms(df, 5).collect()}
    for term, _, _ in rows:
        h = hashlib.md5(term.encode()).hexdigest()
        assert got[term] == (int(h[:8], 16) % 32, 1 if int(h[8], 16) % 2 == 0 else -1)
    ledger = {r.slot: r for r in collision_ledger(hashed_terms(df, 5)).collect()}
    by_slot = {}
    for term, _, cf in rows:
        by_slot.setdefault(got[term][0], []).append((cf, got[term][1]))
    assert set(ledger) == {s for s, v in by_slot.items() if len(v) > 1}
    for s, r in ledger.items():
        cfs = [c for c, _ in by_slot[s]]
        assert (r.n_terms, r.cf, r.lost_cf, r.signed_cf) == (len(cfs), sum(cfs), sum(cfs) - max(cfs), sum(c * g for c, g in by_slot[s]))


def test_missing_terms_are_sought_once_a_row(spark):
    """Before: sought again for every term of the row, so the time grew with the square of its terms."""
    rows = spark.range(1).selectExpr("transform(sequence(1, 30000), x -> cast(x as string)) as words")
    counted = F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(1).alias("tf")))
    began = time.monotonic()
    assert rows.select(F.size(terms.inconsistent_counts(F.col("words"), counted)).alias("n")).first()["n"] == 0
    assert time.monotonic() - began < 20
