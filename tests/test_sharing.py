"""Steps that were repeated or shuffled for every term: topic weights, profiles, held-out bounds. Own rows."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pytest

from toposcope import catalogue
from toposcope.operators import tfidf

TEXTS = [
    (1, "alpha beta beta gamma", "en", "web"), (2, "alpha gamma rare delta", "en", "book"), (3, "delta alpha alpha", "fr", "web"),
    (3, "delta alpha alpha", "fr", "web"), (None, "beta gamma lonely", None, "web"), (4, "single", "fr", "book"), (1005, "gamma delta", "en", "web"),
]


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_topic_weights_without_term_joins(spark, folder, monkeypatch):
    """Before: every (document, term) row was joined with the vocabulary and shuffled again by document."""
    monkeypatch.setattr(tfidf, "weigh_terms", None)
    found = {(r["topic"], r["term"]): r["weight"] for r in catalogue.language_topics(spark, folder).collect()}
    docs = [((d, lang), text.split()) for d, text, lang, _ in TEXTS]
    df = defaultdict(int)
    for _, words in docs:
        for w in set(words):
            df[w] += 1
    total, want = defaultdict(int), defaultdict(float)
    for key, words in docs:  # rows of equal keys share their total
        total[key] += sum(df[w] > 1 for w in words)
    for key, words in docs:
        for w in words:
            if df[w] > 1:
                want[key[1], w] += math.log((len(docs) + 1) / (df[w] + 1)) / total[key]
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)


def test_long_topics_weigh_once(spark, folder, monkeypatch):
    """Before: the terms were weighed again for every topic length."""
    calls, plain = [], catalogue.topics_of
    monkeypatch.setattr(catalogue, "topics_of", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert catalogue.umass_long_topics(spark, folder).count() > 0 and len(calls) == 1


def test_divergence_without_topic_term_shuffle(spark, folder):
    """Before: one row per (topic, term, language) was shuffled by topic and term."""
    found = catalogue.divergence_words(spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(topic#\d+, term#", plan) and "hashpartitioning(lang" not in plan
    assert {(r["topic"], r["term"]) for r in found.collect()} == {(s, w) for s in ("web", "book") for w in ("alpha", "beta", "gamma", "delta")}


def test_heldout_bound_reads_the_texts_once(spark, folder, monkeypatch):
    """Before: the vocabulary came from a second pass over the texts, repeated at each of its uses."""
    calls, plain = [], catalogue.word_rows
    monkeypatch.setattr(catalogue, "word_rows", lambda *a, **k: calls.append(1) or plain(*a, **k))
    catalogue.lda_heldout_bound(spark, folder).collect()
    assert len(calls) == 1
