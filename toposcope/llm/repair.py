"""Conversation structure repair: the cheapest edit script that makes a conversation's roles legal.

A repaired conversation has role initials ``(s?(ua)+)?``: an optional system turn, then user and assistant
turns in pairs. Edits, with their initials: ``K`` keep a row (cost 0), ``R`` give it the role user or assistant
(3), ``D`` delete it (4; the only choice for a blank or repeated row), ``I`` insert an empty user or assistant
turn anywhere (3); a truncated row that is not deleted costs 3 more. Of all scripts of least cost, the audit is
the ASCII-least string of initials.

The search is a dynamic programme over (row, grammar state). Equal-cost scripts are compared as whole strings,
which would copy them at every step; instead every script is a node of a persistent tree of shared prefixes
(parent, edit, depth), with binary-lifting ancestors and a rolling hash of the prefix it spells. Two scripts
compare by their longest common prefix, found by climbing both nodes from equal depth while the hashes of the
ancestors differ; nodes are interned by (parent, edit, row and role given), so equal prefixes are one node and a hash that agrees
between different nodes is a collision, found and treated as a difference. A comparison costs O(log length).

Spark damages the rows (built-in functions only), groups the rows of each conversation into one call of the
search, and returns one row per conversation: rows are dealt by conversation, sorted within each task, and cut
into conversations as they stream through one Arrow pass. A conversation's rows are held by one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edit costs of the contract: fixed values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_MOD = (1 << 61) - 1
_BASE = 0x5BD1E995
_INK = re.compile(r"[^\x20\x09-\x0D]")
_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
START, SYSTEM, USER, DONE = range(4)
ACCEPT = (START, DONE)

_LONGS = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _LONGS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
SCHEMA = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with ``alive`` false for a dropped row (kept so that its conversation still answers).

    Nulls in ``conv_id``, ``turn``, ``role`` and ``text`` read as one space in strings (the key ``conv_id:turn``,
    the role and the text). ``crc32(key) % 20``: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3
    repeats it (same turn), 4 makes it a user turn. Other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias("alive"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


class Scripts:
    """Persistent edit scripts: interned nodes with rolling prefix hashes and binary-lifting ancestors."""

    def __init__(self, longest: int):
        self.levels = max(1, longest.bit_length())
        self.parent, self.edit, self.depth, self.hash, self.payload = [0], [""], [0], [0], [None]
        self.up = [[0] * self.levels]
        self.interned: dict[tuple[int, str], int] = {}

    def child(self, node: int, edit: str, payload=None) -> int:
        key = (node, edit, payload)
        found = self.interned.get(key)
        if found is not None:
            return found
        new = len(self.parent)
        self.parent.append(node)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _MOD)
        self.payload.append(payload)
        up = [node]
        for k in range(1, self.levels):
            up.append(self.up[up[k - 1]][k - 1])
        self.up.append(up)
        self.interned[key] = new
        return new

    def ancestor(self, node: int, depth: int) -> int:
        climb, k = self.depth[node] - depth, 0
        while climb:
            if climb & 1:
                node = self.up[node][k]
            climb >>= 1
            k += 1
        return node

    def _same(self, a: int, b: int) -> bool:
        """Equal prefixes: equal hashes, verified by identity. Equal scripts are one interned node (an edit script
        fixes the rows it uses and the roles it gives), so equal hashes of two nodes are a collision."""
        return self.hash[a] == self.hash[b] and a == b

    def less(self, a: int, b: int) -> bool:
        """Whether the script of ``a`` is ASCII-less than that of ``b``."""
        if a == b:
            return False
        m = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, m), self.ancestor(b, m)
        if self._same(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(self.levels)):
            ux, uy = self.up[x][k], self.up[y][k]
            if self.depth[x] >= (1 << k) and not self._same(ux, uy):
                x, y = ux, uy
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        return "".join(reversed(self._walk(node, self.edit)))

    def rows(self, node: int) -> list:
        """Payloads of the kept, rerolled and inserted rows, in order."""
        return [p for p in reversed(self._walk(node, self.payload)) if p is not None]

    def _walk(self, node: int, values: list) -> list:
        out = []
        while node:
            out.append(values[node])
            node = self.parent[node]
        return out


def _emit(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state in (START, SYSTEM, DONE) else None
    if initial == "a":
        return DONE if state == USER else None
    return None


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each ``(role, text)`` row in order: ``blank``, ``duplicate``, ``truncated`` or ``""``."""
    seen, out = set(), []
    for role, text in rows:
        if not _INK.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif _END.search(text).group() not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def repair(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """``(cost, audit, repaired rows)`` of the cheapest script over ``(role, text)`` rows in order; ties ASCII-least."""
    kinds = faults(rows)
    tree = Scripts(2 * len(rows) + 4)
    best: list[tuple[int, int] | None] = [None] * 4
    best[START] = (0, 0)

    def offer(table, state, cost, node):
        old = table[state]
        if old is None or cost < old[0] or (cost == old[0] and tree.less(node, old[1])):
            table[state] = (cost, node)

    def inserts(table):
        for _ in range(3):  # user then assistant at most, from any state
            for state in range(4):
                if table[state] is None:
                    continue
                cost, node = table[state]
                role = "assistant" if state == USER else "user"
                offer(table, _emit(state, role[0]), cost + INSERT, tree.child(node, "I", (-1, role)))

    inserts(best)
    for i, ((role, text), kind) in enumerate(zip(rows, kinds)):
        now: list[tuple[int, int] | None] = [None] * 4
        extra = TRUNCATED if kind == "truncated" else 0
        for state in range(4):
            if best[state] is None:
                continue
            cost, node = best[state]
            offer(now, state, cost + DELETE, tree.child(node, "D"))
            if kind in ("blank", "duplicate"):
                continue
            kept = _emit(state, role[:1])
            if kept is not None:
                offer(now, kept, cost + KEEP + extra, tree.child(node, "K", (i, role)))
            target = "assistant" if state == USER else "user"
            offer(now, _emit(state, target[0]), cost + REROLE + extra, tree.child(node, "R", (i, target)))
        inserts(now)
        best = now
    cost, node = min((best[s] for s in ACCEPT if best[s] is not None), key=lambda cn: cn[0])
    for s in ACCEPT:  # the ASCII-least of the cheapest
        if best[s] is not None and best[s][0] == cost and tree.less(best[s][1], node):
            node = best[s][1]
    return cost, tree.text(node), [(r, rows[i][1] if i >= 0 else "") for i, r in tree.rows(node)]


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def summary(conv_id, turns: list, rows: list[tuple[str, str]]) -> dict:
    """One result row of a conversation whose rows after damage are ``rows`` with ``turns`` (in order)."""
    known = [t for t in turns if t is not None]
    kinds = faults(rows)
    cost, audit, fixed = repair(rows)
    text = "\n".join(f"{r}:{t}" for r, t in fixed)
    return {
        "conv_id": conv_id,
        "n_rows": len(rows),
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": kinds.count("blank"),
        "duplicate": kinds.count("duplicate"),
        "truncated": kinds.count("truncated"),
        "illegal": _illegal([r for r, _ in rows]),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def _conversations(batches):
    """Rows sorted by conversation and order, cut into conversations as they stream by; one result per conversation."""
    out, current, turns, rows = [], None, [], []
    started = False

    def flush():
        if started:
            out.append(summary(current, turns, rows))

    for batch in batches:
        ids, turn, role, text, alive = (batch.column(i).to_pylist() for i in range(5))
        for c, t, r, x, a in zip(ids, turn, role, text, alive):
            if not started or c != current:
                flush()
                current, turns, rows, started = c, [], [], True
            if a:
                turns.append(t)
                rows.append((r, x))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    flush()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def audit(conversations: DataFrame) -> DataFrame:
    """One row per original ``conv_id`` (null ids together): fault counts, cost, audit and repaired hash.

    Rows after damage are ordered by turn (nulls first), then role and text; a repeated row follows its copy.
    ``gaps`` counts missing turn numbers between the least and greatest (nulls ignored; none: 0); ``blank``,
    ``duplicate`` and ``truncated`` count each row's first fault; ``illegal`` counts adjacent role initials other
    than ``su``, ``ua`` and ``au``. ``repaired_sha256`` hashes the repaired ``role:text`` lines joined by newlines.
    A conversation without rows after damage has zeros, an empty audit and the hash of the empty string.
    """
    rows = damaged(conversations).repartition("conv_id")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "alive").mapInArrow(_conversations, SCHEMA)
