"""Randomised SVD: tree QR, hashed test matrix, and agreement with a dense decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from toposcope import catalogue
from toposcope.operators import randomised


def test_tree_qr_matches_a_dense_one(spark, monkeypatch):
    monkeypatch.setattr(randomised, "FAN_IN", 2)
    y = np.random.default_rng(1).standard_normal((3000, 7))
    df = spark.createDataFrame([(row.tolist(),) for row in y], "y array<double>").repartition(9)
    r = randomised.tsqr(df, "y", 7)
    assert np.allclose(r.T @ r, y.T @ y)
    assert np.allclose(np.tril(r, -1), 0)


def test_test_matrix_is_fixed_and_gaussian():
    ids = np.arange(20_000)
    a, b = randomised.test_rows(ids, 8), randomised.test_rows(ids[::-1].copy(), 8)[::-1]
    assert np.array_equal(a, b)
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02


def test_exact_for_a_matrix_of_low_rank(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((300, 4)) @ np.diag([9.0, 5.0, 2.0, 1.0]) @ rng.standard_normal((4, 500))
    rows = [(list(range(500)), row.tolist()) for row in m]
    df = spark.createDataFrame(rows, "ids array<int>, weights array<double>")
    vocab = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "term_id int, term string")
    fit = randomised.RandomisedDecomposition.of(df, vocab, rank=6, power_steps=1)
    s = np.linalg.svd(m, compute_uv=False)
    assert fit.rank == 4 and np.allclose(fit.sigma, s[:4], rtol=1e-9)
    v = np.array([r["vec"] for r in fit.v.orderBy("term_id").collect()])
    dense = np.linalg.svd(m)[2][:4].T
    assert np.allclose(np.abs(v.T @ dense), np.eye(4), atol=1e-8)


@pytest.mark.parametrize("rank", [50])
def test_agrees_with_a_dense_svd_of_the_corpus(spark, rank):
    texts = catalogue.corpus(spark, "/root/testdata/sf0.001")
    rows = texts.weighted("relative")
    fit = randomised.RandomisedDecomposition.of(rows, texts.vocab.select("term_id", "term"), rank=rank)
    got = rows.select("ids", "weights").collect()
    a = np.zeros((len(got), len(texts.terms)))
    for i, r in enumerate(got):
        a[i, r["ids"]] = r["weights"]
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(fit.sigma[:10], s[:10], rtol=1e-8)
    assert np.abs(fit.sigma - s[:rank]).max() <= 1e-2 * s[0]
    assert fit.gram_defect().max() < 1e-9
    sizes = [r["u_size"] for r in fit.left_sizes().collect()]
    assert len(sizes) == rank and max(abs(x - 1) for x in sizes) < 0.05
    assert (fit.sigma**2).sum() <= randomised.energy(rows) * (1 + 1e-9)


def test_topics_read_off_the_distributed_vectors(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((200, 3)) @ np.diag([8.0, 4.0, 2.0]) @ rng.standard_normal((3, 120))
    df = spark.createDataFrame([(list(range(120)), row.tolist()) for row in m], "ids array<int>, weights array<double>")
    vocab = spark.createDataFrame([(i, f"t{i:03d}") for i in range(120)], "term_id int, term string")
    fit = randomised.RandomisedDecomposition.of(df, vocab, rank=3, power_steps=1)
    dense = np.abs(np.linalg.svd(m)[2][:3])
    got = {}
    for r in fit.topics(3, 5).collect():
        got.setdefault(r["topic"], []).append((r["rank"], r["term"]))
    for k in range(3):
        assert [t for _, t in sorted(got[k])] == [f"t{i:03d}" for i in np.argsort(-dense[k], kind="stable")[:5]]


def test_entries_are_multiplied_a_piece_at_a_time(monkeypatch):
    """Before: a batch of 10,000 rows was multiplied at once, entries × width numbers several times over."""
    import tracemalloc

    rng = np.random.default_rng(5)
    begin = np.r_[0, np.cumsum(rng.integers(0, 400, 1000))]
    at, weight, table = rng.integers(0, 50, begin[-1]), rng.standard_normal(begin[-1]), rng.standard_normal((50, 64))
    tracemalloc.start()
    got = randomised._sums(begin, at, weight, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * randomised.PIECE * 64 * 8 < begin[-1] * 64 * 8
    for r in (0, 17, 999):
        assert np.allclose(got[r], weight[begin[r] : begin[r + 1]] @ table[at[begin[r] : begin[r + 1]]])


def test_blocks_of_terms_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(sorted(rng.choice(80, 12, replace=False).tolist()), rng.random(12).tolist()) for _ in range(60)] + [([], [])]
    df = spark.createDataFrame(rows, "ids array<int>, weights array<double>").coalesce(1)
    vocab = spark.createDataFrame([(i, f"t{i}") for i in range(80)], "term_id int, term string")
    fits = []
    for entries in (1 << 30, 100):
        monkeypatch.setattr(randomised, "BLOCK_ENTRIES", entries)
        fits.append(randomised.RandomisedDecomposition.of(df, vocab, rank=5, power_steps=6, oversample=30))
    assert (fits[0].matrix.blocks, fits[1].matrix.blocks) == (1, 8)
    assert np.allclose(fits[0].sigma, fits[1].sigma, rtol=1e-6)


def test_panels_give_the_same_and_only_the_last_tables_stay(spark, monkeypatch):
    """Before: every step's rows stayed on disk, and all columns of all blocks crossed one shuffle."""
    from pathlib import Path

    from toposcope.settings import ensure_checkpoint_dir

    rng = np.random.default_rng(7)
    rows = [(sorted(rng.choice(40, 9, replace=False).tolist()), rng.random(9).tolist()) for _ in range(50)] + [([], []), (None, None)]
    df = spark.createDataFrame(rows, "ids array<int>, weights array<double>").coalesce(2)
    vocab = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "term_id int, term string")
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "tables"
    laid = lambda: {name: {p.parent for p in folder.glob(f"*/{name}=*")} for name in ("panel", "block")}
    before = laid()
    monkeypatch.setattr(randomised, "PANEL", 20)
    monkeypatch.setattr(randomised, "GROUP_BYTES", 4000)
    fit = randomised.RandomisedDecomposition.of(df, vocab, rank=24, power_steps=1, oversample=16)
    assert {name: len(found - before[name]) for name, found in laid().items()} == {"panel": 1, "block": 1}
    assert fit.source.groups > 1 and len(fit.source.slices) == 2
    dense = np.zeros((50, 40))
    for i, (ids, weights) in enumerate(rows[:50]):
        dense[i, ids] = weights
    s = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(fit.sigma, s[:24], rtol=1e-9)
    assert fit.gram_defect().max() < 1e-9 and all(abs(r["u_size"] - 1) < 1e-9 for r in fit.left_sizes().collect())
    v = np.array([r["vec"] for r in fit.v.orderBy("term_id").collect()])
    assert v.shape == (40, 24) and np.allclose(v.T @ v, np.eye(24), atol=1e-9) and (v.sum(axis=0) > 0).all()


def test_parts_that_come_early_wait():
    import pyarrow as pa

    batches = [pa.record_batch({"kind": pa.array(k, pa.int32()), "x": pa.array(x)}) for k, x in (([1, 0], [1, 2]), ([2, 2], [3, 4]), ([0, 1], [5, 6]))]
    assert [(k, rows["x"].to_pylist()) for k, rows in randomised._in_turn(iter(batches), [2, 2, 2])] == [(0, [2]), (0, [5]), (1, [1]), (1, [6]), (2, [3, 4])]
