"""Awkward rows, brute force and round trips for the training-data operators."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from toposcope.llm import archives, chat, decontaminate, graph, jaccard, pieces, quality, queries, secrets, sharding, substring, toxicity, words
from toposcope.settings import stored

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(80))
NEAR = BASE.replace("word40", "other")
ROWS = [
    (5, BASE), (3, BASE), (3, BASE), (7, NEAR), (8, None), (9, ""), (10, " \n\t "), (None, BASE), (11, LONG), (12, LONG), (13, "one two"), (14, "One  TWO"),
    (15, "sp ▁ é 💡\nline"), (16, " ".join(["same"] * 200)), (17, "\n".join([BASE] * 3)),
]


@pytest.fixture(scope="module")
def messy(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = ["node", "n_words", "fail_bits", "text_crc32", "size", "shard", "n_shingles", "label", "item_id", "own", "measured_text", "secret_spans", "score"]
    for c in clash:
        docs = docs.withColumn(c, F.lit("x"))
    return stored(docs.repartition(3))


@pytest.fixture(scope="module")
def none(messy):
    return messy.where("doc_id = -1")


def bag(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_substring_against_brute_force(messy, none):
    got = bag(substring.remove_repeats(messy, buckets=3), "doc_id", "n_words", "n_removed", "kept_sha256")
    order = lambda i: float("inf") if i is None else i
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in ROWS]
    for i, w in split:
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            least[s] = min(least.get(s, order(i)), order(i))
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < order(i):
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert substring.remove_repeats(none).collect() == []


def shingles(text, width=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_jaccard_awkward_rows(messy, none):
    got = bag(jaccard.similar_groups(messy), "doc_id", "n_shingles", "component_id")
    assert [g for g in got if g[0] is None] == [(None, 77, None)]
    assert sorted(g for g in got if g[0] is not None) == brute_components([r for r in ROWS if r[0] is not None], 4, 85)
    assert jaccard.similar_groups(none).collect() == []


def test_jaccard_against_brute_force_with_long_lists(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(260):
        n = int(draw.choice([5, 9, 12, 16, 24, 60]))
        w = [f"b{n}_{k}" for k in range(n)]
        for k in draw.choice(n, int(draw.integers(0, 3)), replace=False):
            w[k] = f"z{int(draw.integers(5))}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((1, 85), (4, 80)):
        got = bag(jaccard.similar_groups(docs, width=width, percent=percent, least_frequent=4, most_keys=16), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute_components(rows, width, percent), key=str)


def test_boundary_follows_the_cost():
    assert jaccard.subset_sizes(5, 85) == [] and jaccard.subset_sizes(7, 85) == [6, 7]
    assert jaccard.boundary({n: 10 for n in range(1, 60)}, 85) == 13


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def test_ledger_policies_and_ablation(messy, none):
    rows = stored(quality.ledger(messy))
    by = {r.doc_id: r for r in rows.collect()}
    assert (by[8].n_words, by[9].n_words, by[10].n_words, by[11].n_words) == (0, 0, 0, 30_000)
    assert by[16].n_repeat_words == 200 and by[16].n_stutter == 199 and by[17].n_dup_lines == 2 and by[17].n_repeat_words == 240
    assert by[15].word_chars == len("sp▁é💡line")
    table = {(r.policy, r.rule): r for r in quality.ablation(rows).collect()}
    kept = rows.where(quality.passes(quality.CURRENT)).count()
    one = table["v1", "few_words"]
    assert one.n_kept == kept and one.n_kept_without == rows.where(quality.passes(quality.CURRENT, without=1)).count() > kept
    assert quality.ledger(none).collect() == []
    assert quality.keep(messy, quality.CURRENT).columns == messy.columns


def test_reparameterised_questions(spark):
    item = "A train from Paris travels 120 km in 3 hours while another train from Paris goes 80 km in 3 hours"
    other = item.replace("Paris", "Berlin").replace("120", "150").replace("80", "95").replace("3 hours", "5 hours")
    odd = item.replace("from Paris goes", "from Madrid goes").replace("120", "150")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Well then. " + item + " and more"), (2, other), (3, odd), (4, item.upper()), (5, "nothing of that kind is in here at all"), (6, None), (7, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert {i: r.kind for i, r in got.items()} == {1: "verbatim", 2: "reparameterised", 3: "inconsistent", 4: "verbatim"}
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, bench).orderBy("doc_id").collect()] == [3, 5, 6, 7]
    small = bag(decontaminate.leaks(docs, bench, block_windows=30), "doc_id", "item_id", "kind")
    assert small == bag(decontaminate.leaks(docs, bench), "doc_id", "item_id", "kind")
    assert decontaminate.leaks(docs, bench.where("item_id = 99")).count() == 0


def test_cut_quotes_and_values_that_fall_together(spark):
    """Before: both inconsistent, so the pipeline kept them."""
    item = "A train from Paris travels 120 km in 3 hours while another slow train that left the same old station goes back 80 km in 3 hours"
    cut = item.replace("goes back 80 km in 3 hours", "met with 7 cows near Rome in 9 fields")
    sums = "please add the apples 3 and 5 which the farmer sold to all of the neighbours"
    bench = spark.createDataFrame([(1, item), (2, sums)], "item_id long, text string")
    docs = spark.createDataFrame([(1, cut), (2, sums.replace("3 and 5", "4 and 4"))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert {i: (r.item_id, r.kind, r.contaminated) for i, r in got.items()} == {1: (1, "verbatim", True), 2: (2, "reparameterised", True)}
    assert cut[got[1].byte_start : got[1].byte_end] == item[: item.index(" goes back")]
    assert decontaminate.remove_contaminated(docs, bench).count() == 0


def test_items_poor_in_literals_broken_up_or_in_other_words(spark):
    """Before: none of these was found."""
    words = [f"{a}{b}" for a in ("ral", "tis", "mon", "ked", "pul") for b in ("a", "o", "en", "is", "ur", "ai", "el", "um")]
    items = {
        1: "Compute 12 + 7 - 3 x 4 + 5", 2: "What is 12 + 7 - 3 x 4 + 5 + 18 - 6 x 2 + 44 - 9 x 21", 3: " ".join(words), 4: "they met Rome " + " ".join(words[::-1]),
        5: "the farmer has twelve sheep in the old barn behind his house", 6: "Tom buys 5 red pens. Ann buys 3 blue pens. Bob buys 4 green pens.", 7: "1 2 3",
    }
    half = " ".join(words[::-1])
    texts = {
        1: "Please Compute 12 + 7 - 3 x 4 + 5 now", 2: "So: what is 12 + 7 - 3 x 4 + 5 + 18 - 6 x 2 + 44 - 9 x 21?", 3: " ".join([*words[:20], "indeed", *words[20:]]), 4: "they met Rome " + half.replace(words[20], words[20] + " so to speak"),
        5: items[5].replace("twelve", "twenty"), 6: "Eve buys 8 red pens. Zoe buys 6 blue pens. Max buys 2 green pens.", 7: "1 2 3", 8: "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", 9: "Compute 11 + 7 - 3 x 4 + 5",
    }
    bench, docs = (spark.createDataFrame(list(x.items()), f"{i} long, text string") for x, i in ((items, "item_id"), (texts, "doc_id")))
    got = bag(decontaminate.leaks(docs, bench).where("contaminated"), "doc_id", "item_id", "kind")
    assert got == [(i, i, "reparameterised" if i > 4 else "verbatim") for i in range(1, 7)]
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, bench).orderBy("doc_id").collect()] == [7, 8, 9]


def test_secrets(spark, messy, none):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'use token = "{key}" here'), (2, f"see commit {key} for it"), (3, "docs/manual/2021/chapter-index.html page"), (4, None), (None, f'api_key = "{key}"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    made = secrets.labelled_findings(spark.read.parquet(f"{SF}/documents.parquet"))
    model = secrets.train(made)
    found = stored(secrets.find_secrets(docs, model))
    assert {r.doc_id: r.is_secret for r in found.collect()} == {1: True, 2: False, 3: False, None: True}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert clean == {1: 'use token = "[SECRET]" here', 2: rows[1][1], 3: rows[2][1], 4: None, None: 'api_key = "[SECRET]"'}
    test = secrets.labelled_findings(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 100)
    scored = secrets.score(test.withColumn("doc_id", F.lit(1)), model).selectExpr("avg(cast((label = 1) = is_secret as double))").first()[0]
    assert scored > 0.95
    assert secrets.find_secrets(none, model).collect() == [] and secrets.find_secrets(messy, model).count() >= 0


def test_secrets_of_any_length_alphabet_and_form(spark):
    """Before: only the plain runs of 16 signs or more were rows, and key=value was one of them."""
    model = secrets.train(secrets.labelled_findings(spark.read.parquet(f"{SF}/documents.parquet")))
    values = ["hunter2secret", "correcthorsebatterystaple", "P@ss!w0rd#2024$x", "48210957", "AbC123dEf456GhI789jKl012", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"]
    forms = ['password = "{}"', "api_key={} then", "curl host?token={}&page=2", '{{"db_password": "{}", "n": 1}}']
    true = [(k, f.format(v), f.format("[SECRET]")) for k, (v, f) in enumerate((v, f) for v in values for f in forms)]
    false = [(100 + k, t, t) for k, t in enumerate(["Note: the shop opens at 12:30", "title = \"three plain words\"", "see https://example.com/index", "the secret of the house", "a password is required here", "count=17"])]
    docs = spark.createDataFrame([r[:2] for r in true + false], "doc_id long, text string")
    found = stored(secrets.find_secrets(docs, model))
    rows = {(r.doc_id, docs_text.encode()[r.byte_start : r.byte_end].decode()) for docs_text, r in ((dict(r[:2] for r in true + false)[r.doc_id], r) for r in found.collect())}
    assert {(k, values[k // len(forms)]) for k, _, _ in true} <= rows
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    wrong = {k: clean[k] for k, _, want in true + false if clean[k] != want}
    assert not wrong, wrong


def test_preferences(spark, none):
    turns = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no <|im_end|>"),
             (2, "chosen", None, None, None), (3, "other", 0, "user", "x"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a")]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumn("c", F.lit(1))).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert (one.n_common, one.prompt) == (1, "<|im_start|>user\nhi<|im_end|>\n") and one.rejected == "<|im_start|>assistant\nno < |im_end|><|im_end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["yes<|im_end|>"]
    assert (got[2].n_common, got[2].rejected, got[2].chosen) == (0, "", "<|im_start|>\n<|im_end|>\n")
    assert (got[4].n_common, got[4].chosen, got[4].rejected) == (1, "", "")


def test_paired_conversations_use_every_turn(spark):
    """Before: turns of an odd conversation below half of the even one's, or without a number, were on no side."""
    sizes = {0: 8, 1: 2, 2: 3, 3: 6, 4: 2, 7: 2}
    turns = [(c, t, "user", f"<{c}.{t}>") for c, n in sizes.items() for t in range(n)]
    turns += [(1, None, "user", "<1.null>"), (0, None, "user", "<0.null>"), (None, 0, "user", "<null.0>"), (None, None, "user", "<null.null>")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.paired_conversations(table)).collect()}
    said = lambda text: re.findall(r"<[\w]+\.\w+>", text)
    whole = lambda c: [f"<{c}.{t}>" for t in range(sizes.get(c, 0))]
    assert {x for r in got.values() for x in said(r.prompt + r.chosen + r.rejected)} == {t[3] for t in turns}
    assert said(got[0].prompt) == ["<0.null>", *whole(0)[:4]] and said(got[0].chosen) == whole(0)[4:] and said(got[0].rejected) == ["<1.null>", *whole(1)]
    assert said(got[1].prompt + got[1].rejected) == whole(2)[:1] + whole(3) and said(got[2].rejected) == []
    assert (said(got[3].chosen), said(got[3].rejected)) == ([], whole(7))
    assert said(got[None].chosen) == ["<null.null>", "<null.0>"] and got[None].rejected == ""
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert chat.paired_conversations(table).select("text").distinct().count() == table.select("text").distinct().count()


def test_best_fit_decreasing_against_a_plain_scan():
    draw = np.random.default_rng(0)
    for _ in range(30):
        sizes = draw.integers(1, 60, 80).tolist()
        left, shard = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = min(((c, k) for k, c in enumerate(left) if c >= sizes[i]), default=None)
            if fit is None:
                left.append(100)
                fit = (100, len(left) - 1)
            left[fit[1]] -= sizes[i]
            shard[i] = fit[1]
        got = sharding.best_fit_decreasing(sizes, 100)
        assert (got.shard, got.shards) == (shard, len(left))
    assert sharding.best_fit_decreasing([500, 1], 100).shards == 2


def test_shards(spark, messy, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table, shards in ((docs, 16), (messy, 4)):
        rows = sharding.pack(table, shards=shards).toPandas()
        assert len(rows) == table.count() and rows["shard"].between(0, shards - 1).all()
        for _, own in rows.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))
        assert (rows.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    sums = sharding.pack(docs, shards=16).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert sums.max() < 1.3 * sums.mean()
    assert sharding.pack(none, shards=4).count() == 0


def test_shards_of_a_capacity_hold_it(spark, monkeypatch):
    """Before: each of the 4,096 crates was above this capacity, though all groups fit."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat(id % 20000, repeat('x', cast(id % 37 as int))) as text")
    sizes = {}
    for bound in (100, 100_000):
        monkeypatch.setattr(sharding, "DRIVER_GROUPS", bound)
        got = sharding.pack(docs, capacity=400).toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert sums.max() <= 400 and len(got) == 40_000 and (got.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
        sizes[bound] = got["size"].sum() / 400 / len(sums)
    assert sizes[100] > 0.9 and sizes[100_000] > 0.9
    plain = spark.createDataFrame([(k, "y" * (s - 1) + str(k)) for k, s in enumerate([60, 50, 40, 30, 20, 500])], "doc_id long, text string")
    got = sharding.pack(plain, capacity=101).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sorted(sums)[-1] == 501 and sorted(sums)[-2] <= 101


def test_toxicity(spark, messy, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = stored(toxicity.score(docs, labels))
    assert got.count() == docs.count()
    assert got.where("held_out != (crc32(cast(doc_id as string)) % 4 = 2) or predicted != cast(score >= 0.3 as int) or score not between 0 and 1").count() == 0
    wrong = got.join(labels, "doc_id").where("held_out").selectExpr("avg(cast(predicted != toxic as double))").first()[0]
    assert wrong < 0.1
    model = toxicity.fit(docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 != 2"))
    import pyarrow as pa

    score = lambda *t: model.scores(pa.array([x.encode() for x in t], pa.large_binary())).tolist()
    plain, gapped, inserted, digit, clean = score("you are an idiot and pathetic", "you are an i.d.i.o.t and pa-the-tic", "you are an idiqot and patheztic", "you are an 1d10t and path3t1c", "the ation of ander thing")
    assert min(plain, gapped, inserted, digit) > clean
    odd = toxicity.score(messy, labels.limit(0))
    assert odd.select("score").distinct().count() == 1 and odd.count() == len(ROWS)
    assert toxicity.score(none, labels).count() == 0


def test_kernel_against_its_definition():
    marks = toxicity.Landmarks.of(["^idiot", "^scumbag"])

    def value(x, y):
        def triples(w):
            out = {}
            for i in range(len(w)):
                for a, b in toxicity.STEPS:
                    if i + b < len(w):
                        t = w[i] + w[i + a] + w[i + b]
                        out[t] = out.get(t, 0) + toxicity.DECAY ** (b - 2)
            return out

        one, two = triples(x), triples(y)
        norm = toxicity._NORM[min(len(x), toxicity.LONG)] * toxicity._NORM[min(len(y), toxicity.LONG)]
        return min(1, max(0, sum(v * two.get(t, 0) for t, v in one.items()) / norm - toxicity.FLOOR) / (1 - toxicity.FLOOR))

    names = ["^idiot", "^idiiot", "^scum", "^scumbags", "^tree"]
    letters = [toxicity._numbers(w) for w in names]
    near, rows = marks.kernel(np.concatenate(letters), np.r_[0, np.cumsum([len(x) for x in letters])])
    got = np.zeros((len(names), 2))
    got[near] = rows
    assert np.allclose(got, [[value(w, m) for m in marks.words] for w in names], atol=1e-6)


@pytest.mark.skipif(not os.path.exists(queries.PIECE_MODEL), reason="no piece model")
def test_pieces_round_trip_and_repeatable(spark, messy, none):
    got = stored(pieces.encode(messy, queries.PIECE_MODEL))
    assert got.where("not lossless").count() == 0
    again = pieces.encode(messy.repartition(1), queries.PIECE_MODEL)
    assert bag(got, "doc_id", "piece_ids") == bag(again, "doc_id", "piece_ids")
    back = bag(pieces.decode(got, queries.PIECE_MODEL), "doc_id", "text")
    assert back == sorted(((i, t or "") for i, t in ROWS), key=str)
    assert bag(pieces.encode(messy, queries.PIECE_MODEL, seed=1), "piece_ids") != bag(got, "piece_ids")
    assert pieces.encode(none, queries.PIECE_MODEL).count() == 0


@pytest.mark.skipif(not os.path.exists(queries.PIECE_MODEL), reason="no piece model")
def test_sampled_segmentations_follow_the_lattice():
    model = pieces.load_model(queries.PIECE_MODEL)
    text = " then"
    points = pieces._code_points(text.encode())
    points = np.where(points == 32, np.uint32(pieces.SPACE), points)
    spell = {"".join(s.decode()): i for i, s in enumerate(model.surface) if s and i > 258}

    def paths(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in spell:
                for tail in paths(rest[n:]):
                    yield (spell[rest[:n]], *tail)

    weight = {p: float(np.exp(sum(model.weight[i] for i in p))) for p in paths(text)}
    n = 20_000
    ids, counts = pieces._sample(np.tile(points, n), np.zeros(n * len(points), bool), np.arange(n + 1) * len(points), np.arange(n).astype(np.uint64), model, 0)
    ends = np.r_[0, np.cumsum(counts)]
    seen = {}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        p = tuple(ids[a:b].tolist())
        seen[p] = seen.get(p, 0) + 1
    assert set(seen) <= set(weight)
    total = sum(weight.values())
    for p, w in weight.items():
        assert abs(seen.get(p, 0) / n - w / total) < 0.015


@pytest.mark.skipif(not os.path.exists(queries.PIECE_MODEL), reason="no piece model")
def test_pieces_are_sought_only_where_one_can_begin(monkeypatch):
    """Before: every run of up to 16 characters of a word was looked up, nearly nine a character here."""
    model, sought, find = pieces.load_model(queries.PIECE_MODEL), [], pieces.PieceModel.find
    monkeypatch.setattr(pieces.PieceModel, "find", lambda self, h: sought.append(len(h)) or find(self, h))
    points = pieces._code_points(" ".join(f"w{i * 7919 % 10007}ords{i}ing" for i in range(2000)).encode())
    points = np.where(points == 32, np.uint32(pieces.SPACE), points)
    pieces._sample(points, np.zeros(len(points), bool), np.array([0, len(points)]), np.zeros(1, np.uint64), model, 0)
    assert sum(sought) < 2 * len(points)


@pytest.mark.skipif(not os.path.exists(queries.PIECE_MODEL), reason="no piece model")
def test_a_random_number_that_rounds_to_one_loses_no_text(spark):
    """Before: the number of these keys passed every real piece, and a stretch without a piece kept one character."""
    text = " internationalisation"
    docs = spark.createDataFrame([(95445179, text), (98360967, text), (246132375, text)], "doc_id long, text string")
    got = stored(pieces.encode(docs, queries.PIECE_MODEL))
    assert got.where("not lossless").count() == 0
    assert {r["text"] for r in pieces.decode(got, queries.PIECE_MODEL).collect()} == {text}


def test_warc_round_trip(spark, tmp_path):
    rows = [(4, "http://a/x y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (9, None, None), (7, "u\nv", ""), (5, "http://c", "z\r\n\r\nWARC/1.0"), (None, "http://d", "<p>é</p>"), (5, "http://c", "z\r\n\r\nWARC/1.0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(0))
    got = bag(archives.convert_pages(pages, f"{tmp_path}/warc"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(least.get(h or "", archives.LAST), archives.LAST if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least[h or ""]
        again = first != (archives.LAST if i is None else i)
        want.append((i, len(data), archives.digest32(data), "revisit" if again else "response", first if again else None, True))
    assert got == sorted(want, key=str)
    assert archives.convert_pages(pages.where("page_id = 99"), f"{tmp_path}/empty").count() == 0
    every = bag(archives.convert_pages(pages, f"{tmp_path}/least", least_bytes=1), "page_id", "record_type")
    assert (7, "response") in every and (9, "response") in every


def test_arc_versions():
    for version in (1, 2):
        data = b"".join(archives.arc_bytes(version, "f.arc", "20200102030405", iter([("http://a b/c", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody"), ("dns:x", "text/dns", b"")])))
        info, page, dns = archives.parse_arc(data)
        assert page.fields["URL"] == "http://a b/c" and page.block.endswith(b"body") and dns.block == b""
        assert b"WARC-Type: warcinfo" in archives.warc_record(info) and b"WARC-Type: resource" in archives.warc_record(dns)
        assert b"WARC-Date: 2020-01-02T03:04:05Z" in archives.warc_record(page)
    with pytest.raises(ValueError, match="cut off"):
        list(archives.parse_arc(data[: data.index(b"body") + 2]))
    assert [b for _, b in archives.parse_warc(archives._unzipped(zlib.compress(b"", wbits=31) + zlib.compress(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n", wbits=31)))] == [b"hi"]


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    found = words.find_words(pa.array([b"aa ab", b"", b"ab\x0baa  aa"], pa.large_binary()))
    assert found.counts.tolist() == [2, 0, 3]
    h = words.word_hashes(found).tolist()
    assert h[0] == h[3] == h[4] and h[1] == h[2] != h[0]


def test_pipeline_stages_one_by_one(spark):
    """Each stage against plain code on its own input; the columns of documents stay to the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            groups = brute_components(sorted(before.items()), 5, 80)
            assert set(after) == {i for i, _, c in groups if i == c}
        elif name == "benchmark_leaks":
            assert set(before) - set(after) == {i for i, t in before.items() if any(b in t for b in bench)}
        elif name == "secret_scan":
            hit = {i for i, t in before.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
            assert {i for i in before if before[i] != after[i].text} == hit
        elif name == "sentencepiece":
            assert set(after) == set(before) and all(r.lossless for r in after.values())
        if name != "sentencepiece":
            assert docs.columns == columns


def test_pipeline_stages_on_awkward_rows(spark):
    docs = stored(spark.createDataFrame([(i, t, None, "s", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long"))
    for table in (docs, docs.where("doc_id = -1")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() <= table.count()


def test_near_duplicates_of_repeated_ids(spark):
    """Before: one of the two unlike texts of id 5 was lost, and a copy of id 3's text could stay in its place."""
    far = " ".join(f"far{i}" for i in range(60))
    rows = [(5, BASE), (5, NEAR), (5, far), (7, far), (3, "x y z " + far[:80]), (8, "x y z " + far[:80]), (8, "quite another text of id eight"), (9, ""), (9, None), (None, BASE)]
    docs = spark.createDataFrame([(i, t, None, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    left = sorted((r.n_chars for r in got.collect()))
    assert left in [[a, 2, 4, 6, b, 9] for a in (0, 1) for b in (7, 8)]
    again = sorted((r.n_chars for r in jaccard.first_of_groups(docs).collect()))
    assert again == left  # the same rows every time


def test_first_of_groups_with_clashing_columns_and_no_rows(spark):
    rows = [(5, BASE), (3, BASE), (3, BASE), (7, NEAR), (8, None), (None, BASE)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    for c in ("_near_key", "near_id", "near_label", "node", "label", "component_id", "first", "copies"):
        docs = docs.withColumn(c, F.lit(c))
    got = jaccard.first_of_groups(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r._near_key) for r in got.collect()) == [(-1, "_near_key"), (3, "_near_key"), (8, "_near_key")]
    assert jaccard.first_of_groups(docs.where("doc_id = -1")).count() == 0


def test_secret_values_never_nest_in_texts_without_spaces():
    """Before: every sign of minified JSON or ``a=a=a=…`` started a value to the end of the text (hours a MB)."""
    import time

    import pyarrow as pa

    def scan(text):
        batch = pa.record_batch({"doc_id": pa.array([1]), "text_crc32": pa.array([1]), "text": pa.array([text])})
        return [r for b in secrets._scan(iter([batch]), False) for r in b.to_pylist()]

    start = time.time()
    for text in ("a=" * 300_000, ":".join(f"{i % 256:02x}" for i in range(200_000))):
        found = scan(text)
        assert len(found) == 1 and found[0]["byte_end"] - found[0]["byte_start"] > len(text) - 4
    assert time.time() - start < 30
    found = scan('{"user":"ann","token":"' + "ab12" * 10 + '","n":12345678901234567,"ok":true}')
    assert [r["preview"] for r in found] == ["ann", "ab12" * 10, "12345678901234567", "true"]


def test_warc_record_ids_are_unique(spark, tmp_path):
    """Before: two rows of page 5 with other urls, and a repeated row, had one and the same record id."""
    rows = [(5, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (5, "http://a/", "<p>same</p>"), (7, "http://c/", "<p>same</p>"), (8, None, None), (9, "http://d/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archives.convert_pages(pages, f"{tmp_path}/warc").collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (5, 7)) == [(5, "response", None)] * 3 + [(7, "revisit", 5)]


def test_every_verbatim_benchmark_item_is_found(spark):
    """Brute force: every item of 8 words or more that a document holds as a substring is a verbatim leak of it."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect() if r.text and len(r.text.split()) >= 8]
    want = {(r.doc_id, i) for r in docs.collect() if r.text for i, t in items if t in r.text}
    assert want  # the tables plant such passages
    got = {(r.doc_id, r.item_id): (r.kind, r.contaminated) for r in decontaminate.leaks(docs, bench).collect()}
    assert all(got.get(pair) == ("verbatim", True) for pair in want), sorted(p for p in want if got.get(p) != ("verbatim", True))[:5]


def test_shards_follow_one_rule_for_any_number_of_groups(spark, monkeypatch):
    """Before: up to DRIVER_GROUPS groups were packed one by one, more of them in crates, with other shards."""
    docs = spark.range(5000).selectExpr("id as doc_id", "concat(id, repeat('x', cast(id % 37 as int))) as text")
    got = []
    for bound in (100, 100_000):
        monkeypatch.setattr(sharding, "DRIVER_GROUPS", bound)
        got.append({r.doc_id: (r.shard, r.slot) for r in sharding.pack(docs, shards=16).collect()})
    assert got[0] == got[1]


def test_shard_columns_against_plain_code(spark):
    """size, text_crc32, gapless slots per shard and equal texts together, by plain code over the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op7_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)  # null text: no bytes
        assert 0 <= r.shard < 16
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    home = {}
    for r in got:
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
