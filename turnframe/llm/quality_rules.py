"""Quality rules with host-level verdicts.

Every document gets word, symbol, line and repetition counts and a verdict on
each rule.  Rule failures are then aggregated by host (``host`` column),
each host's failure rate is shrunk towards the corpus by a beta prior fitted
to all hosts by its moments, and the host's verdict is joined back:

* ``blocked``: the shrunk rate of documents that fail a base rule is at least
  ``block_rate``; none of the host's documents is kept;
* ``strict``: the shrunk rate of soft failures is over ``strict_factor``
  times the corpus rate; the strict soft limits hold;
* ``fair``: the lenient soft limits hold.

Null text counts as empty (no words, so base_failed); null hosts form one
group; repeated rows each count and are each returned; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import Words, cover, mix, per_doc, pieces, window_starts, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
BROADCAST_HOSTS = 100_000
SALTS = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SCHEMA = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)


def _line_counts(text: str | None) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _counts(batches):
    for b in pieces(batches, 2):
        w = Words(b.column(2))
        n = len(w)
        codepoint = (w.buf & 0xC0) != 0x80
        in_word = np.zeros(len(w.buf) + 1, np.int8)
        in_word[w.starts] += 1
        in_word[w.ends] -= 1
        # a word may begin where the one before ends (next text), so add up
        codepoint &= np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        grams = windows(w.hashes(), 3)
        ok = window_starts(w.first, 3, n)[:len(grams)]
        at = np.flatnonzero(ok)
        key = grams[at] ^ mix(w.doc_of()[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        repeats = cover(at[order[twice]], 3, n)
        lines = [_line_counts(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(w.counts, pa.int64()), pa.array(per_doc(codepoint, w.offsets)),
             pa.array(per_doc(SYMBOLS[w.buf], w.offsets)), pa.array([x[1] for x in lines], pa.int64()),
             pa.array(per_doc(repeats, w.first)), pa.array([x[0] for x in lines], pa.int64())],
            names=["doc_id", "host", *COUNTS])


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: doc_id, host and the counts that the rules use."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"),
                    F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_counts, SCHEMA)


def with_rules(counts: DataFrame) -> DataFrame:
    """Adds the verdict of each document rule."""
    c = F.col
    return counts.withColumns({
        "base_failed": (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")),
        # lenient and strict limits of the soft rules
        "soft_failed": (10 * c("n_symbols") > 3 * c("n_words")) | (100 * c("n_dup_lines") > 50 * c("n_lines")),
        "soft_strict": (10 * c("n_symbols") > c("n_words")) | (100 * c("n_dup_lines") > 30 * c("n_lines")),
    })


def beta_prior(rates: DataFrame, failed: str, total: str) -> tuple[float, float]:
    """Beta(a, b) whose mean and variance are those of the hosts' failure
    rates, each host weighted by its documents and the binomial noise taken
    off.  One row of sums reaches the driver."""
    r = rates.agg(F.sum(failed), F.sum(total), F.count("*"), F.sum(F.col(total) * F.col(total)),
                  F.sum(F.col(failed) * F.col(failed) / F.col(total))).first()
    k, n, hosts, n2, sq = (float(x or 0) for x in r)
    m = min(max(k / n if n else 0.0, 1e-6), 1 - 1e-6)
    if hosts < 2:
        return m * 2, (1 - m) * 2
    between = (sq - n * m * m - (hosts - 1) * m * (1 - m)) / (n - n2 / n)
    s = m * (1 - m) / max(between, 1e-9) - 1
    s = min(max(s, 2.0), 1e6)
    return m * s, (1 - m) * s


def host_verdicts(rules: DataFrame, block_rate: float = 0.5, strict_factor: float = 2.0) -> DataFrame:
    """Per host: documents, shrunk failure rates and the verdict."""
    hosts = materialize(rules.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("k_base"),
        F.sum(F.col("soft_strict").cast("long")).alias("k_soft")), "hosts")
    (ab, bb), (a, b) = beta_prior(hosts, "k_base", "n_docs"), beta_prior(hosts, "k_soft", "n_docs")
    base = (F.col("k_base") + F.lit(ab)) / (F.col("n_docs") + F.lit(ab + bb))
    soft = (F.col("k_soft") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.select("host", "n_docs", base.alias("base_rate"), soft.alias("soft_rate"),
                        F.when(base >= block_rate, "blocked")
                        .when(soft > F.lit(strict_factor * a / (a + b)), "strict").otherwise("fair").alias("verdict"))


def apply_rules(docs: DataFrame, host: str = "source", block_rate: float = 0.5,
                strict_factor: float = 2.0) -> DataFrame:
    """doc_id, host, the counts, base_failed, verdict and kept.

    The texts are read once; the counts (a few integers a document) are
    written to the shared folder and used for both the host totals and the
    result.  Verdicts are broadcast up to ``BROADCAST_HOSTS`` hosts; beyond
    that they are joined with hosts dealt over ``SALTS`` copies, so that a
    host with a third of all rows is no single task.
    """
    rules = with_rules(materialize(rule_counts(docs, host), "rule-counts"))
    verdicts = materialize(host_verdicts(rules, block_rate, strict_factor).select(
        F.col("host").alias("v_host"), F.col("verdict")), "verdicts")
    on = F.col("host").eqNullSafe(F.col("v_host"))
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = rules.join(F.broadcast(verdicts), on)
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        dealt = verdicts.withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rules.withColumn("salt", salt).join(dealt, on & (F.col("salt") == F.col("v_salt")))
    soft = F.when(F.col("verdict") == "strict", F.col("soft_strict")).otherwise(F.col("soft_failed"))
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & ~soft
    return joined.select("doc_id", "host", *COUNTS, "base_failed", "verdict", kept.alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")
