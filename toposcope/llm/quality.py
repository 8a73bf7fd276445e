"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; its failure is one bit of ``fail_bits`` and what it measured is
kept beside it. Policies are versioned masks over those bits, so another policy or an ablation (what would
a policy keep without one of its rules?) needs no second look at the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposcope.llm import words as W

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_upper", "n_lower"]
_DDL = ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """Fails if ``100 * measure`` is more than ``percent`` of ``per`` (both Spark SQL over the measures)."""

    name: str
    measure: str
    percent: int
    per: str

    @property
    def fails(self) -> Column:
        return F.expr(f"100 * ({self.measure}) > {self.percent} * ({self.per})")


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any rule of ``hard``, or more than ``allowed`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


# The order is the bit number and never changes; new rules go to the end.
RULES = (
    Rule("few_words", "20 - n_words", 0, "1"),
    Rule("repeated_windows", "n_repeat_words", 30, "n_words"),
    Rule("symbols", "n_symbols", 20, "n_words"),
    Rule("stutter", "n_stutter", 30, "n_words"),
    Rule("shouting", "n_upper", 60, "n_upper + n_lower"),
    Rule("duplicate_lines", "n_dup_lines", 60, "n_lines"),
    Rule("long_words", "word_chars", 1500, "n_words"),
    Rule("short_words", "2 * n_words", 100, "word_chars"),
)
POLICIES = (
    Policy("base", ("few_words", "repeated_windows")),
    Policy("v1", ("few_words", "repeated_windows", "symbols", "stutter", "shouting")),
    Policy("v2", ("few_words", "repeated_windows", "symbols", "stutter", "shouting"), ("duplicate_lines", "long_words", "short_words"), 1),
)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def _measure(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches, "measured_text"):
        found = W.find_words(chunk.column("measured_text"))
        data, offsets, n = found.data, found.offsets, chunk.num_rows
        rows = np.arange(n, dtype=np.uint64)
        row_of_word = np.repeat(rows, found.counts)
        inside = ~W.BREAK[data]
        hashes = W.word_hashes(found)

        at = W.window_starts(found, WINDOW)
        windows = W.mix(W.window_hashes(hashes, WINDOW)[at] ^ W.mix(row_of_word[at]))
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        repeated = W.covered(len(hashes), at[times[back] > 1], WINDOW)

        same = np.r_[False, hashes[1:] == hashes[:-1]]
        same[found.first[:-1][found.counts > 0]] = False

        # A line ends before a \n or at the end of its text; only lines with a word count.
        breaks = np.flatnonzero(data == 10)
        begin = np.unique(np.r_[offsets[:-1], breaks + 1])
        begin = begin[begin < len(data)]
        end = np.r_[begin[1:], len(data)].astype(np.int64)
        end = end - (data[end - 1] == 10)
        worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, begin)
        begin, end = begin[worded], end[worded]
        line_row = np.searchsorted(offsets, begin, side="right") - 1
        lines = W.mix(W.span_hashes(data, begin, end) ^ W.mix(line_row.astype(np.uint64)))
        _, first = np.unique(lines, return_index=True)
        n_lines = np.bincount(line_row, minlength=n)

        symbols = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
        columns = [
            found.counts, W.row_sums(inside & ((data & 0xC0) != 0x80), offsets), W.row_sums(symbols, offsets), n_lines - np.bincount(line_row[first], minlength=n),
            W.row_sums(repeated, found.first), n_lines, W.row_sums(same, found.first), W.row_sums((data >= 65) & (data <= 90), offsets), W.row_sums((data >= 97) & (data <= 122), offsets),
        ]
        yield pa.RecordBatch.from_arrays([*(chunk.column(k) for k in keep), *(pa.array(c.astype(np.int64)) for c in columns)], names=[*keep, *MEASURES])


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, the measures, and ``fail_bits`` with bit i set where rule i fails; one row per input row.

    Null and empty texts have no words: all measures are 0 and ``few_words`` fails. Repeated rows and null
    ids stay as they are; columns other than ``doc_id`` and ``text`` are not read.
    """
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("measured_text"))
    return _with_bits(measured.mapInArrow(partial(_measure, keep=["doc_id"]), "doc_id long, " + _DDL), rules)


def _with_bits(measured: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    bits = [F.when(r.fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def keep(docs: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows of ``docs``, all columns, that the policy accepts; ledger and verdict are made beside each row, without a join."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # the measures' names may be taken
    renamed = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()], F.col("text").cast("string").alias("measured_text"))
    fields = ", ".join(f"{own[f.name]} {f.dataType.simpleString()}" for f in docs.schema)
    rows = _with_bits(renamed.mapInArrow(partial(_measure, keep=list(own.values())), f"{fields}, {_DDL}"), rules)
    return rows.where(passes(policy, rules)).select(*[F.col(a).alias(c) for c, a in own.items()])


def passes(policy: Policy, rules: Sequence[Rule] = RULES, bits: Column | None = None, without: int = 0) -> Column:
    """Whether ``bits`` (default: column ``fail_bits``) satisfy the policy, ignoring the bits in ``without``."""
    bits = F.col("fail_bits") if bits is None else bits
    hard, soft = mask(policy.hard, rules) & ~without, mask(policy.soft, rules) & ~without
    return (bits.bitwiseAND(F.lit(hard)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(soft))) <= policy.allowed)


def apply_policy(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``policy`` and ``kept`` to ledger rows."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", passes(policy, rules))


def ablation(rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(policy, rule, n_kept, n_kept_without, n_failed)`` from ledger rows, without looking at them twice.

    The ledger is counted by ``fail_bits`` first, so that at most 2^rules rows remain for all policies.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(
            F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), passes(p, rules).alias("kept"),
            passes(p, rules, without=1 << i).alias("kept_without"), (F.col("fail_bits").bitwiseAND(F.lit(1 << i)) != 0).alias("failed"),
        )
        for p in policies for i, r in enumerate(rules) if r.name in p.hard + p.soft
    ]
    one = lambda c: F.sum(F.when(F.col(f"c.{c}"), F.col("n")).otherwise(0))
    return patterns.select("n", F.explode(F.array(*cases)).alias("c")).groupBy("c.policy", "c.rule").agg(
        one("kept").alias("n_kept"), one("kept_without").alias("n_kept_without"), one("failed").alias("n_failed")
    )


BASE = POLICIES[0]
CURRENT = POLICIES[1]
