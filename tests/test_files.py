import pytest

from toposcope import sinks, sources
from toposcope.operators.lemma import look_up


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    lines = [f"ligne {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("seule")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        found = sources.read_lines(spark, str(tmp_path))
        rows = sorted((r["doc_id"][-5:], r["line_no"], r["line"]) for r in found.collect())
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [("a.txt", i, line) for i, line in enumerate(lines)] + [("b.txt", 0, "seule")]
    assert {r["text"][:7] for r in sources.read_documents(spark, str(tmp_path)).collect()} == {"ligne 0", "seule"}


def test_stop_words(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("les\nrome\n\nle\n")
    french = {r[0] for r in sources.default_stop_words(spark).collect()}
    both = [r[0] for r in sources.stop_words(spark, "french", str(path)).collect()]
    assert set(both) == french | {"les", "rome"} and len(both) == len(set(both))
    assert {r[0] for r in sources.read_word_list(spark, str(path)).collect()} == {"les", "rome", "le"}
    with pytest.raises(ValueError):
        sources.stop_words(spark, None)


def test_word_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([("mot", [0.5, 1.0]), ("roi", [1.5, 2.0])], "word string, vec array<double>")
    path = str(tmp_path / "vectors")
    sinks.save_word_vectors(vectors, path)
    assert sources.read_word_vectors(spark, path).exceptAll(vectors).count() == 0
    assert {r[0] for r in sources.read_known_words(spark, path).collect()} == {"mot", "roi"}


def test_lexicon_and_lemma_files(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("portes\tnc\tporte\nportes\tv\tporter\n")
    lexicon = sources.read_lexicon(spark, str(tmp_path / "lex.tsv"))
    tokens = [(1, 0, 0, "portes", "V"), (1, 0, 1, ".", "PUNC"), (1, 1, 0, "portes", "NC")]
    tagged = spark.createDataFrame(tokens, "doc_id long, line_no int, tok_no int, token string, tag string")
    found = look_up(tagged, lexicon)
    sinks.save_lemma_text(found, str(tmp_path / "text"))
    sinks.save_removed_tokens(found, str(tmp_path / "removed"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["porter", "", "porte"]
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "removed"), header=True).collect()] == [("puncts", ".")]
    (tmp_path / "tags.tsv").write_text("NC\tnc\n")
    assert sources.read_tag_map(spark, str(tmp_path / "tags.tsv")).collect() == [("NC", "nc")]


def test_result_tables(spark, tmp_path):
    doc_topics = spark.createDataFrame([(1, 0, 1, 4, 0.5), (1, 0, 2, 3, 0.25)], "doc_id long, para_no int, rank int, topic int, weight double")
    sinks.save_topic_map(sinks.single_key(doc_topics, ("doc_id", "para_no")), str(tmp_path / "map"), 2)
    assert sorted(map(tuple, sources.read_topic_map(spark, str(tmp_path / "map"), 2).collect())) == [("1:0", 1, 4, 0.5), ("1:0", 2, 3, 0.25)]

    topics = spark.createDataFrame([(0, 1, "l'or", 0.5), (0, 2, 'a"b', 0.25)], "topic int, rank int, term string, weight double")
    sinks.save_topic_words(topics, str(tmp_path / "words"), 2)
    assert sources.read_topic_words(spark, str(tmp_path / "words"), 2).select(topics.columns).exceptAll(topics).count() == 0

    measures = spark.createDataFrame([("lsa", 2, "word2vec", 0.5), ("lsa", 2, "umass", -1.5)], "model string, k int, metric string, value double")
    sinks.save_measures(measures, str(tmp_path / "measures"), "lsa")
    assert sources.read_measures(spark, str(tmp_path / "measures"), "lsa").exceptAll(measures).count() == 0

    freq = spark.createDataFrame([("mot", 3)], "term string, df long")
    sinks.save_document_frequencies(freq, str(tmp_path / "freq"))
    assert [tuple(r) for r in sources.read_document_frequencies(spark, str(tmp_path / "freq")).collect()] == [("mot", 3)]

    values = spark.createDataFrame([(1, 1.0), (0, 2.5)], "concept int, sigma double")
    sinks.save_singular_values(values, str(tmp_path / "sigma"))
    assert [tuple(r) for r in sources.read_singular_values(spark, str(tmp_path / "sigma")).collect()] == [(0, 2.5), (1, 1.0)]
