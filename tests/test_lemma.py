import pytest

from pyspark.sql import functions as F

from toposcope.operators import lemma
from toposcope.operators.lemma import (
    lemma_lines,
    lemma_statistics,
    lemma_text,
    lexicon_by_form,
    look_up,
    removed_tokens,
    unknown_forms,
)

LEXICON = [
    ("portes", "nc", "porte", 1),
    ("portes", "v", "porter", 2),
    ("marche", "v", "vieux", 3),
    ("marche", "v", "marcher", 4),
    ("rare", "adj", "premier", 5),
    ("rare", "nc", "second", 6),
]


@pytest.fixture(scope="module")
def found(spark):
    tokens = [
        ("Portes", "V"), ("portes", "ADV"), ("marche", "V"), ("rare", "V"), (".", "PUNC"), ("inconnu", "NC"),
        ("peut-être", "V"), ("ACTE", "NC"), ("12", "NC"), ("ab", "NC"), ("1234", "NC"), ("Autre", "??"), ("!", "PUNC"),
    ]
    rows = [(1, 0, i, t, tag) for i, (t, tag) in enumerate(tokens)] + [(1, 1, 0, "le", "DET")]
    tagged = spark.createDataFrame(rows, "doc_id long, line_no int, tok_no int, token string, tag string")
    lexicon = spark.createDataFrame(LEXICON, "form string, pos string, lemma string, line_no long")
    return look_up(tagged, lexicon).cache()


def test_precedence(spark):
    lexicon = spark.createDataFrame(LEXICON, "form string, pos string, lemma string, line_no long")
    rows = {r["form"]: (r["default_lemma"], r["pos_lemmas"]) for r in lexicon_by_form(lexicon).collect()}
    assert rows["portes"] == ("porte", {"nc": "porte", "v": "porter"})
    assert rows["marche"] == ("vieux", {"v": "marcher"})


def test_text(found):
    lines = [(r["line_no"], r["sentence_no"], r["text"]) for r in lemma_text(found).orderBy("line_no", "sentence_no").collect()]
    assert lines == [
        (0, 0, "porter marcher premier"),
        (0, 1, "inconnu peut ACTE Autre"),
        (0, 2, ""),
        (1, 0, ""),
    ]


def test_removed_and_statistics(found):
    assert sorted(map(tuple, removed_tokens(found).collect())) == [
        ("adv", "portes"), ("det", "le"), ("puncts", "!"), ("puncts", "."),
    ]
    assert lemma_statistics(found).first().asDict() == {
        "scanned": 14, "pair_misses": 4, "form_misses": 3, "unknown_forms": 3,
    }
    assert {r["form"] for r in unknown_forms(found).collect()} == {"inconnu", "peut", "autre"}


def test_removed_tokens_need_no_lexicon(spark):
    """Before: every token was joined with the lexicon, which was made from all words, to list the removed ones."""
    from toposcope import catalogue

    plan = catalogue.removed_tokens(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("common", [0, 2, 100])
def test_lines_of_tokens_give_the_same_text(spark, common):
    """Forms shared with the tasks and forms joined; lines that come in parts, without a key, or with no token."""
    tokens = [("Portes", "V"), ("portes", "ADV"), ("marche", "V"), ("rare", "V"), (".", "PUNC"), ("Leer", "V"), ("inconnu", None), ("peut-être", "V"), ("ACTE", "NC")]
    rows = [(k, 0, i + j, t, tag) for k in (1, 1, None) for j in (0, 5) for i, (t, tag) in enumerate(tokens)] + [(1, 1, 0, "le", "DET"), (2, 0, 0, "rare", "XX")]
    tagged = spark.createDataFrame(rows, "doc_id long, line_no int, tok_no int, token string, tag string")
    lexicon = spark.createDataFrame([*LEXICON, ("leer", "v", None, 7)], "form string, pos string, lemma string, line_no long")
    part = F.when(F.col("tok_no") > 5, 1).otherwise(0)
    lines = tagged.groupBy("doc_id", "line_no", part.alias("part")).agg(F.collect_list(F.struct("tok_no", "token", "tag")).alias("tokens")).drop("part")
    lines = lines.union(spark.createDataFrame([(9, 0, [])], lines.schema))
    want = sorted(map(str, lemma_text(look_up(tagged, lexicon)).collect()))
    assert sorted(map(str, lemma_lines(lines, lexicon, common=common).collect())) == want


def test_lemmatise_sends_no_common_token_through_a_join(spark, monkeypatch):
    """Before: every token met the lexicon in a join and was then sent on to its line."""
    from toposcope import catalogue

    monkeypatch.setattr(lemma, "look_up", None)
    plan = catalogue.lemmatise(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list(struct" not in plan and "ArrowEvalPython" in plan
