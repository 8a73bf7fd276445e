"""Brute force, awkward rows and empty tables for nearest neighbours, conversation repair and vector codes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcope.llm import codes, neighbours, queries, repair

SF = "/root/testdata/sf0.01"
CLASH = ["code", "error", "label_error", "q", "v", "r", "query_id", "rank", "score", "codes", "alive", "audit", "cost", "mb", "qb", "list_id"]


def with_clashes(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def vectors(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


# ---------------------------------------------------------------- op13


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Loops over parts, entries and components; no dictionaries."""
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return {}, hashlib.sha256(b"").hexdigest()
    first = min(ok, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, [math.floor(256 * x) for x in r[1]]))
    width = len(first[1]) if len(first[1]) % parts == 0 else 0
    ok = [(i, [math.floor(256 * np.float32(x)) for x in v], lab) for i, v, lab in ok if len(v) == width]
    step = width // parts
    start = sorted(ok, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))[:entries]
    books = [[r[1][p * step : (p + 1) * step] for r in start] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        j = min(range(len(d)), key=lambda j: (d[j], j))
        return j, d[j]

    for _ in range(rounds):
        sums = {}
        for _, q, _ in ok:
            for p in range(parts):
                j, _ = near(p, q[p * step : (p + 1) * step])
                s = sums.setdefault((p, j), [0] * (step + 1))
                s[0] += 1
                for t in range(step):
                    s[t + 1] += q[p * step + t]
        for (p, j), s in sums.items():
            books[p][j] = [x // s[0] for x in s[1:]]
    out = {}
    for n, (i, q, lab) in enumerate(ok):
        got = [near(p, q[p * step : (p + 1) * step]) for p in range(parts)]
        out[n] = (i, lab, "".join(f"{j:02x}" for j, _ in got), sum(d for _, d in got))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return out, digest


def awkward_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], i % 3 if i % 5 else None) for i in range(90)]
    rows += [(7, rows[7][1], 1), (200, None, 1), (201, [1.0] * 31 + [None], 1), (202, [float("nan")] * 32, 2), (203, [float("inf")] + [0.0] * 31, 2)]
    rows += [(204, [0.5] * 16, 1), (None, [0.25] * 32, None), (205, [0.0] * 32, 0), (206, [0.0] * 32, 0)]
    return rows


def test_codes_against_plain_loops(spark):
    rows = awkward_vectors()
    got = codes.encode(vectors(spark, rows)).collect()
    want, digest = plain_codes(rows)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"]) for r in got) == sorted((i if i is not None else -1, c, e) for i, _, c, e in want.values())
    assert {r["codebooks_sha256"] for r in got} == {digest}
    by_label = {}
    for i, lab, c, e in want.values():
        by_label[lab] = by_label.get(lab, 0) + e
    assert all(r["label_error"] == by_label[r["label"]] for r in got)


def test_codes_of_few_rows_and_none(spark):
    few = [(i, [float(i) / 7] * 16, None) for i in range(5)]
    got = codes.encode(vectors(spark, few)).collect()
    want, digest = plain_codes(few)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, e) for i, _, c, e in want.values())
    assert all(r["error"] == 0 and r["codebooks_sha256"] == digest for r in got)
    assert codes.encode(vectors(spark, few).where("vec_id < 0")).count() == 0
    assert codes.encode(vectors(spark, [(1, None, 1), (2, [float("nan")] * 16, 1)])).count() == 0


def test_dictionary_distances_equal_direct_ones():
    rng = np.random.default_rng(5)
    q = rng.integers(-300, 300, (500, 64))
    books = rng.integers(-300, 300, (16, 64, 4))
    c, e = codes.nearest(q, books)
    direct = ((q.reshape(500, 16, 1, 4) - books[None]) ** 2).sum(-1)
    assert (c == direct.argmin(-1)).all() and (e == direct.min(-1)).all()


# ---------------------------------------------------------------- op11


def brute_neighbours(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    width = len(min(ok, key=lambda r: (r[0], list(r[1])))[1]) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == width]
    out = {}
    for qi, qv in {i: v for i, v in sorted(ok, key=lambda r: (r[0], list(r[1])), reverse=True) if i % 100 == 0}.items():
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(qv, v))), i) for i, v in ok if i != qi)
        out[qi] = [i for _, i in d[:k]]
    return out


def test_neighbours_of_awkward_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], None) for i in range(0, 1200, 3)]
    rows += [(100, [rng.gauss(0, 1) for _ in range(16)], None), (100, rows[5][1], None), (3100, None, None), (3200, [0.0] * 16, None), (3400, [float("nan")] * 16, None)]
    rows += [(1000 + j, rows[0][1], None) for j in range(12)] + [(None, rows[0][1], None), (3500, [1.0] * 8, None)]
    got = neighbours.nearest(vectors(spark, rows)).collect()
    want = brute_neighbours(rows)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == set(want) and not {3100, 3200, 3400, 3500} & set(found)
    hit = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hit >= 0.9 * sum(len(w) for w in want.values())
    assert found[0] == want[0] == [1000 + j for j in range(10)]  # twelve exact copies: ties by id
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert all(scores[(0, 1000 + j)] == 0.0 for j in range(10))


def test_neighbours_few_and_none(spark):
    rows = [(0, [1.0, 0.0], None), (5, [0.0, 1.0], None), (7, [1.0, 1.0], None)]
    got = sorted((r["rank"], r["vec_id"]) for r in neighbours.nearest(vectors(spark, rows)).collect())
    assert got == [(1, 7), (2, 5)]
    assert neighbours.nearest(vectors(spark, rows).where("vec_id < 0")).count() == 0


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    ids = np.arange(3000)
    got = neighbours.scan(q, np.full(20, -1), x, ids)
    for i in range(20):
        want = np.argsort(((x - q[i]) ** 2).sum(1), kind="stable")[:10]
        assert sorted(j for qi, j in got if qi == i) == sorted(want)


def test_neighbours_recall_on_the_test_table(spark):
    df = queries.table(spark, SF, "embeddings")
    got = queries.op11_nearest_neighbours(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"], None) for r in df.collect()]
    want = brute_neighbours(rows)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(found.get(q, set()) & set(w)) for q, w in want.items()) >= 0.9 * 10 * len(want)


# ---------------------------------------------------------------- op12


def plain_repair(rows):
    kinds = repair.faults(rows)
    best = {repair.START: (0, "", ())}

    def offer(t, s, c, a, out):
        if s is not None and (s not in t or (c, a) < t[s][:2]):
            t[s] = (c, a, out)

    def inserts(t):
        for _ in range(3):
            for s, (c, a, out) in list(t.items()):
                role = "assistant" if s == repair.USER else "user"
                offer(t, repair._emit(s, role[0]), c + 3, a + "I", out + ((role, ""),))

    inserts(best)
    for (role, text), k in zip(rows, kinds):
        now = {}
        for s, (c, a, out) in best.items():
            offer(now, s, c + 4, a + "D", out)
            if k in ("blank", "duplicate"):
                continue
            x = 3 if k == "truncated" else 0
            offer(now, repair._emit(s, role[:1]), c + x, a + "K", out + ((role, text),))
            target = "assistant" if s == repair.USER else "user"
            offer(now, repair._emit(s, target[0]), c + 3 + x, a + "R", out + ((target, text),))
        inserts(now)
        best = now
    return min((best[s] for s in repair.ACCEPT if s in best), key=lambda v: v[:2])


def exhaustive_repair(rows):
    kinds, limit, found = repair.faults(rows), 4 * len(rows), []

    def go(i, s, c, a):
        if c > limit:
            return
        if i == len(rows) and s in repair.ACCEPT:
            found.append((c, a))
        add = "assistant" if s == repair.USER else "user"
        go(i, repair._emit(s, add[0]), c + 3, a + "I")
        if i == len(rows):
            return
        role, k = rows[i][0], kinds[i]
        x = 3 if k == "truncated" else 0
        go(i + 1, s, c + 4, a + "D")
        if k not in ("blank", "duplicate"):
            if repair._emit(s, role[:1]) is not None:
                go(i + 1, repair._emit(s, role[:1]), c + x, a + "K")
            go(i + 1, repair._emit(s, add[0]), c + 3 + x, a + "R")

    go(0, repair.START, 0, "")
    return min(found)


def test_repair_against_plain_strings_and_every_script():
    rng = random.Random(1)
    roles, texts = ["system", "user", "assistant", " ", "tool", ""], ["Hi.", "hi", " ", "", "Ok!", "x?", "a\n"]
    for n in range(7):
        for _ in range(150):
            rows = [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]
            cost, audit, fixed = repair.repair(rows)
            assert (cost, audit, tuple(fixed)) == plain_repair(rows)
            if n <= 5:
                assert (cost, audit) == exhaustive_repair(rows)
    long = [(rng.choice(roles), rng.choice(texts) + str(i % 50)) for i in range(4000)]
    assert repair.repair(long)[:2] == plain_repair(long)[:2]


def test_prefix_tree_compares_by_longest_common_prefix():
    tree = repair.Scripts(64)
    a = b = 0
    for ch in "KKDKIKRK":
        a = tree.child(a, ch, ch)
    for ch in "KKDKIKRD":
        b = tree.child(b, ch, ch)
    c = tree.ancestor(a, 5)
    assert tree.less(b, a) and not tree.less(a, b) and tree.less(c, a) and tree.text(c) == "KKDKI"
    assert tree.child(tree.ancestor(a, 7), "K", "K") == a  # interned


def plain_audit(rows):
    """Damage, order and summary by plain Python over ``(conv_id, turn, role, text)``."""
    s = lambda x: " " if x is None else str(x)
    out, convs = [], {}
    for c, t, role, text in rows:
        convs.setdefault(c, [])
        kind = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text.replace(".", "").replace("!", "").replace("?", "") if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    for c, items in convs.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out.append((c, repair.summary(c, [t for t, _, _ in items], [(r, x) for _, r, x in items])))
    return out


def test_audit_of_awkward_conversations(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), rng.choice(["Hi.", "no end", None, "", "Why?"])) for c in range(40) for t in range(rng.randint(0, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ok."), (50, None, None, None), (50, 3, "user", "x" * 200_000 + ".")]
    rows += [(60, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(3000)]
    gone = next(c for c in range(1000, 100_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Hi.")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r.asDict() for r in repair.audit(df).collect()}
    want = dict(plain_audit(rows))
    assert set(got) == set(want)
    for c, w in want.items():
        assert {k: got[c][k] for k in w} == w
    assert got[gone]["n_rows"] == 0 and got[gone]["audit"] == "" and got[gone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert repair.audit(df.where("turn < -5")).count() == 0
