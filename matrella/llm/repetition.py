"""Repetition inside a single document, and what it says about the host the document comes from.

For each document the share of its words that lie in a run of n words occurring at least twice in it is measured, and the shares of repeated
lines and of repeated blocks (paragraphs, cues).  Rules turn shares into failures; failures are counted per host; a host's rate is shrunk towards
that of all hosts by an empirical beta prior (method of moments), so a host of three documents is not judged by these three alone; and the host's
verdict is joined back to its documents: a document of a bad host is suspect at a lower share than others (`STRICT` times the rule's share).

Null and empty texts have no words and shares of 0; a text of fewer than n words cannot repeat a run.  A null host is a host of its own.
Repeated documents count as often as they occur.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrella.llm.words import _WORD, kept_lines, plain, slabs
from matrella.session import cut

RUN = 6
SHARES = "doc_id bigint, host string, n_words int, run_share double, line_share double, block_share double"
#: share, of a rule's, from which on a document of a bad host is suspect
STRICT = 2 / 3
#: rule -> (column, share from which on a document fails)
RULES = {"runs": ("run_share", 0.3), "lines": ("line_share", 0.3), "blocks": ("block_share", 0.2)}

_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_runs(codes: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """For each word whether it lies in a run of `run` words that occurs at least twice in its document.

    codes: one 64-bit code a word; doc: the document of each word, ascending.  Runs are compared by 64-bit hashes.
    """
    covered = np.zeros(len(codes), bool)
    starts = len(codes) - run + 1
    if starts < 1:
        return covered
    h = np.zeros(starts, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = (h ^ (h >> np.uint64(29))) * _MIX + codes[k : k + starts]
        h ^= h >> np.uint64(32)
        h = h * _MIX + doc[:starts].astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _MIX
    inside = np.flatnonzero(doc[:starts] == doc[run - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(starts, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _repeated_share(units: list[str]) -> float:
    """Share of characters in units that occurred before in the list."""
    total = sum(map(len, units))
    return 1 - sum(map(len, set(units))) / total if total else 0.0


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slabs(batch, "text"):
            words: list[str] = []
            counts, line_share, block_share = [], [], []
            for text in b.column("text").to_pylist():
                lines = kept_lines(text) if text else []
                before = len(words)
                words += _WORD.findall(plain(lines))
                counts.append(len(words) - before)
                spoken = [s for x in lines if (s := x.strip(" \t"))]  # lines and blocks without the blanks around them
                line_share.append(_repeated_share(spoken))
                block_share.append(_repeated_share([s for x in "\n".join(lines).split("\n\n") if (s := x.strip(" \t\n"))]))
            counts = np.array(counts, np.int64)
            codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
            doc = np.repeat(np.arange(len(counts)), counts)
            covered = np.bincount(doc, repeated_runs(codes, doc, RUN), len(counts))
            share = covered / np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), pa.array(counts.astype(np.int32)), pa.array(share), pa.array(line_share, pa.float64()), pa.array(block_share, pa.float64())],
                ["doc_id", "host", "n_words", "run_share", "line_share", "block_share"],
            )


def shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, run_share, line_share, block_share) of each document."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).mapInArrow(_measure, SHARES)


def _prior(n: Column, fails: Column) -> tuple[Column, Column]:
    """Method of moments over hosts: mean rate and strength (pseudo-documents) of the beta prior."""
    rate = fails / n
    mean = F.sum(fails) / F.sum(n)
    # variance of the rates, less what chance alone would give hosts of these sizes
    spread = F.var_samp(rate) - F.avg(F.lit(1.0) / n) * mean * (1 - mean)
    strength = F.when(spread > 1e-9, mean * (1 - mean) / spread - 1)
    return mean, F.greatest(F.lit(1.0), F.least(F.coalesce(strength, F.lit(1e4)), F.lit(1e4)))


def host_verdicts(measured: DataFrame, limit: float = 0.2) -> DataFrame:
    """(host, n_docs, and per rule failures, shrunk rate and verdict): bad if any shrunk rate exceeds `limit`."""
    fails = [F.sum((F.col(c) >= least).cast("bigint")).alias(f"{rule}_failed") for rule, (c, least) in RULES.items()]
    hosts = cut(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails))
    moments = []
    for rule in RULES:
        mean, strength = _prior(F.col("n_docs"), F.col(f"{rule}_failed"))
        moments += [mean.alias(f"{rule}_mean"), strength.alias(f"{rule}_strength")]
    prior = hosts.agg(*moments).first()  # one row
    rates = {}
    for rule in RULES:
        m, s = prior[f"{rule}_mean"], prior[f"{rule}_strength"]
        rates[f"{rule}_rate"] = (F.col(f"{rule}_failed") + F.lit((m or 0.0) * s)) / (F.col("n_docs") + F.lit(s))
    hosts = hosts.withColumns(rates)
    worst = F.greatest(*[F.col(f"{rule}_rate") for rule in RULES])
    return hosts.withColumn("host_bad", worst > limit)


def judged(docs: DataFrame, limit: float = 0.2) -> DataFrame:
    """Each document with its shares, which rules it fails, its host's shrunk rates and verdict, and per rule whether it is suspect.

    Suspect is a document whose share reaches the rule's, or STRICT times that if its host is bad: so failing documents are suspect in any case.
    """
    measured = cut(shares(docs))
    hosts = host_verdicts(measured, limit)
    # one row a host joins back; a null host meets itself
    h = hosts.withColumnRenamed("host", "host_key")
    out = measured.join(h, F.col("host").eqNullSafe(F.col("host_key"))).drop("host_key")
    strict = F.when(F.col("host_bad"), F.lit(STRICT)).otherwise(F.lit(1.0))
    flags = {f"{rule}_fails": F.col(c) >= least for rule, (c, least) in RULES.items()}
    return out.withColumns(flags | {f"{rule}_suspect": F.col(c) >= least * strict for rule, (c, least) in RULES.items()})
