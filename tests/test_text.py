from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toposcope.functions.text import alphabetic_words, line_tokens, lines_of, term_counts
from toposcope.operators.paragraphs import (
    assemble_paragraphs,
    remove_stop_words,
    remove_stop_words_by_join,
    segment_documents,
    segment_lines,
    stop_list,
)
from toposcope.sources.text import document_lines

PLAY = ["PHEDRE", "mon coeur brule", "toujours encore", "", "HIPPOLYTE", "votre silence parle"]


def paragraphs(spark, lines, **options):
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    return [r["words"] for r in segment_documents(docs, **options).orderBy("para_no").collect()]


def by_hand(lines, keep_trailing=False, emit="separator"):
    """Procedural statement of the rule."""
    found, open_words = [], []
    for i, line in enumerate(lines):
        tokens = [t for t in line.split(" ") if len(t) > 2]
        if not tokens or any(t.upper() == t for t in tokens):
            if open_words and (emit == "separator" or i + 1 < len(lines) or keep_trailing):
                found.append(open_words)
            open_words = []
        else:
            open_words = open_words + tokens
    if open_words and keep_trailing:
        found.append(open_words)
    return found


def test_closed_paragraph_only(spark):
    assert paragraphs(spark, PLAY) == [["mon", "coeur", "brule", "toujours", "encore"]]


def test_trailing_paragraph_on_request(spark):
    assert paragraphs(spark, PLAY, keep_trailing=True)[1] == ["votre", "silence", "parle"]


def test_separators(spark):
    assert paragraphs(spark, ["", "", "mon coeur", "ab cd", "...", "1234", "deux mots", "1234"]) == [
        ["mon", "coeur"],
        ["deux", "mots"],
    ]
    assert paragraphs(spark, ["mon coeur", "sans fin"]) == []


def test_next_line_needs_a_line_after_the_separator(spark):
    assert paragraphs(spark, ["mon coeur", "ACTE"], emit="next_line") == []
    assert paragraphs(spark, ["mon coeur", "ACTE", "suite"], emit="next_line") == [["mon", "coeur"]]
    assert paragraphs(spark, ["mon coeur", "ACTE", "suite"], emit="next_line", drop_words=["mon", "coeur"]) == []
    assert paragraphs(spark, ["  mon coeur  ", "ACTE", "suite"], emit="next_line", strip=True) == [["mon", "coeur"]]


LINE = st.sampled_from(["", "ab", "ACTE", "mon coeur", "une ligne longue", "12 34", "1234", "voix BASSE", "été noir"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINE, min_size=1, max_size=14), min_size=1, max_size=5), st.integers(1, 5))
def test_both_segmentations_follow_the_rule(spark, plays, bucket):
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(plays)], "doc_id long, lines array<string>")
    lines = docs.select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    texts = docs.select("doc_id", F.array_join("lines", "\n").alias("text"))
    for keep, emit in ((False, "separator"), (True, "separator"), (False, "next_line")):
        want = sorted((i, n, w) for i, p in enumerate(plays) for n, w in enumerate(by_hand(p, keep, emit)))
        from_lines = assemble_paragraphs(segment_lines(lines, keep_trailing=keep, emit=emit, bucket_lines=bucket))
        assert sorted(map(tuple, from_lines.collect())) == want
        if all(p[-1] != "" for p in plays):  # a final line break opens no line in a text
            found = segment_documents(texts, keep_trailing=keep, emit=emit)
            assert sorted(map(tuple, found.collect())) == want


def test_case_rules_of_rare_letters(spark):
    words = ["straße", "ıııı", "ﬁnal", "ÉTÉS", "été"]
    docs = spark.createDataFrame([(i, f"{w}\nmot") for i, w in enumerate(words)], "doc_id long, text string")
    found = {r[0]: r[1] for r in segment_documents(docs, keep_trailing=True).select("doc_id", "words").collect()}
    assert found == {0: ["straße", "mot"], 1: ["ıııı", "mot"], 2: ["ﬁnal", "mot"], 3: ["mot"], 4: ["été", "mot"]}


def test_stop_words_keep_repeats_and_case_option(spark):
    rows = spark.createDataFrame([(1, 0, ["Le", "le", "zz", "zz"]), (2, 0, ["le"])], "doc_id long, para_no int, words array<string>")
    assert [r["words"] for r in remove_stop_words(rows, ["le"]).collect()] == [["zz", "zz"]]
    assert [r["words"] for r in remove_stop_words(rows, ["le"], case_sensitive=True).collect()] == [["Le", "zz", "zz"]]
    assert remove_stop_words(rows, ["le"], drop_empty=False).count() == 2


def test_stop_words_by_join_agree(spark):
    counts = spark.createDataFrame([(1, "Le", 1), (1, "zz", 2)], "doc_id long, term string, tf long")
    stop = spark.createDataFrame([("le",)], "word string")
    assert [r["term"] for r in remove_stop_words_by_join(counts, stop).collect()] == ["zz"]
    assert remove_stop_words_by_join(counts, stop, case_sensitive=True).count() == 2
    assert stop_list(stop) == ["le"]


def test_line_expressions(spark):
    row = spark.createDataFrame([("un  deux trois\r\nfin\n",)], "t string").select(
        lines_of(F.col("t")).alias("lines"),
        line_tokens(F.lit("un  deux trois")).alias("tokens"),
        term_counts(F.split(F.lit("b a b c b"), " ")).alias("counts"),
        alphabetic_words(F.lit("L'Été 2020 a_b _c x anticonstitutionnellement")).alias("words"),
    ).first()
    assert row["lines"] == ["un  deux trois", "fin"]
    assert row["tokens"] == ["deux", "trois"]
    assert [tuple(c) for c in row["counts"]] == [("a", 1), ("b", 3), ("c", 1)]
    assert row["words"] == ["été", "a_b"]


def test_document_lines(spark):
    docs = spark.createDataFrame([(7, "a\nb")], "doc_id long, text string")
    assert [tuple(r) for r in document_lines(docs).collect()] == [(7, 0, "a"), (7, 1, "b")]
