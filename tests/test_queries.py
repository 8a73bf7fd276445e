"""Registered queries against their SQL, and rules on plans and code."""

import ast
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.helpers import normalised_rows
from toposcope import catalogue, settings

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parent.parent / "toposcope"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def own(names) -> set[str]:
    """Without the training-data queries, which may be absent; ``tests/llm`` has theirs."""
    return {n for n in names if not re.fullmatch(r"op\d+_\w+|pipeline", n)}


def test_registry():
    assert own(entry.oracle_sql()) == set(catalogue.SQL_CHECKED)
    assert own(entry.queries()) == set(catalogue.SQL_CHECKED) | set(catalogue.ROWS_ONLY)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalogue.SQL_CHECKED))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = normalised_rows(df.columns, df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    want = normalised_rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).columns == ["topic", "umass", "null_pairs"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)[^\n]*", plan(df))


def test_text_is_not_shuffled(spark, monkeypatch, tmp_path):
    """On a table with many splits, as a large one has."""
    cores = spark.sparkContext.defaultParallelism
    catalogue.table(spark, FOLDER, "documents").repartition(4 * cores).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(catalogue, "table", lambda s, f, n: spark.read.parquet(str(tmp_path / "docs")))
    spark.conf.set("spark.sql.files.minPartitionNum", str(4 * cores))
    try:
        for query in (catalogue.paragraphs_all, catalogue.term_freq, catalogue.line_tokens, catalogue.tagged_tokens):
            assert exchanges(query(spark, FOLDER)) == []
        found = exchanges(catalogue.doc_freq(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    # Document frequency shuffles terms once, after counting per task.
    assert len(found) == 1 and "term" in found[0]


def test_large_tables_are_not_spread(spark, monkeypatch):
    """The table as it is, taken for a large one."""
    assert len(exchanges(catalogue.paragraphs_all(spark, FOLDER))) <= 1
    monkeypatch.setattr(settings, "SPREAD_BYTES", 0)
    for query in (catalogue.paragraphs_all, catalogue.term_freq, catalogue.line_tokens, catalogue.tagged_tokens):
        assert exchanges(query(spark, FOLDER)) == []


def test_consistency_needs_no_exchange_of_terms(spark, monkeypatch):
    monkeypatch.setattr(settings, "SPREAD_BYTES", 0)
    found = exchanges(catalogue.tf_consistency(spark, FOLDER))
    assert len(found) == 1 and "SinglePartition" in found[0]


def test_scan_reads_needed_columns(spark):
    text = plan(catalogue.term_freq(spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_ranking_is_limited_before_the_shuffle(spark):
    assert plan(catalogue.language_topics(spark, FOLDER)).count("WindowGroupLimit") == 2


def test_python_functions_run_once_per_row(spark):
    assert plan(catalogue.nearest_words(spark, FOLDER)).count("EvalPython") == 1
    assert plan(catalogue.nearest_clusters(spark, FOLDER)).count("EvalPython") == 1
    # Term look-up and weighted sum.
    assert plan(catalogue.doc_vectors(spark, FOLDER)).count("EvalPython") == 2


def test_hits_are_read_once(spark):
    text = plan(catalogue.umass_by_topic(spark, FOLDER))
    assert text.count("FileScan parquet") == 1


def test_no_cartesian_product(spark):
    for name in ("cooccurrence", "umass_by_topic", "divergence_words", "embed_coherence", "topic_merge", "nearest_words"):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


# Functions that may bring rows to the driver, each after a check of their number or for one row.
FETCHES = {
    "stop_list", "of", "word_matrix", "joined_means", "coherence_measures", "label_centres", "sizes", "topic_hits",
    "lda_topics", "vector_width", "held_out_tokens",
    # histograms of levels, values in a level or characters after a prefix; one width x width R; k x k Gram; sums
    "least_frequent", "tsqr", "gram_defect", "energy", "lda_heldout_bound",
}


def test_rows_reach_the_driver_only_where_bounded():
    for path in (p for p in PACKAGE.rglob("*.py") if "llm" not in p.parts):
        for fn in ast.walk(ast.parse(path.read_text())):
            if not isinstance(fn, ast.FunctionDef):
                continue
            for call in ast.walk(fn):
                if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute):
                    if call.func.attr in {"collect", "toPandas", "toArrow", "first", "toLocalIterator"}:
                        is_column_function = isinstance(call.func.value, ast.Name) and call.func.value.id == "F"
                        assert is_column_function or fn.name in FETCHES, f"{path.name}:{fn.name}"
                    assert call.func.attr not in {"localCheckpoint", "crossJoin"}, f"{path.name}:{fn.name}"
