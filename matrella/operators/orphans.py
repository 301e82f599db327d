"""References to records that do not exist.

Method: a Bloom filter of the parent keys is broadcast and proves most orphans at once (a key that the filter
does not know is certainly absent); only references that pass the filter are verified by an exact join.  All
references are first pre-aggregated per (table, key, period), so a key that holds a third of all rows is one
row per period before anything is shuffled.

Nulls: a reference with a null key or a null time is no reference; parent rows with a null key and delete rows
with a null key or time are ignored; a parent row without a time proves that the key exists, but at no time.  Repeated rows change nothing but the counts.  Empty tables on either side are allowed: without
parents every reference is `missing`.  Other columns of the inputs are never read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrella.session import cut

#: Proven size bound of a broadcast filter: 2**19 words of 64 bits are 2**19 rows of two longs (8 MB of data), enough for about 3 million keys.  A filter of
#: more keys grows on and is joined by word instead, after the references were reduced to one row a key and month.
BROADCAST_WORDS = 1 << 19
#: Bound of any filter (1.4 thousand million keys); beyond it the share of false positives rises.  Results stay exact in any case, as positives are verified.
MAX_WORDS = 1 << 28
BITS_PER_KEY = 12


@dataclass(frozen=True)
class KeyFilter:
    """A blocked Bloom filter as a frame (bloom_word, bloom_bits) of at most MAX_WORDS rows."""

    words: int
    frame: DataFrame

    def split(self, df: DataFrame, key: str) -> DataFrame:
        """df with a column `maybe_known`: false proves that no parent has the key."""
        probe = df.withColumn("bloom_word", _word(F.col(key), self.words))
        mask = _mask(F.col(key))
        frame = F.broadcast(self.frame) if self.words <= BROADCAST_WORDS else self.frame
        return (
            probe.join(frame, "bloom_word", "left")
            .withColumn("maybe_known", F.coalesce(F.col("bloom_bits").bitwiseAND(mask) == mask, F.lit(False)))
            .drop("bloom_word", "bloom_bits")
        )


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit word, from a second hash."""
    h = F.xxhash64(key, F.lit(17))
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def key_filter(keys: DataFrame, key: str, most: int | None = None) -> KeyFilter:
    """The filter of all non-null values of `key`, of at most `most` words; building it combines on the map side, copies cost nothing."""
    most = MAX_WORDS if most is None else min(most, MAX_WORDS)
    present = keys.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    n = present.agg(F.approx_count_distinct("k")).first()[0]
    words = 1 << 6
    while words * 64 < BITS_PER_KEY * n and words < most:
        words *= 2
    frame = present.groupBy(_word(F.col("k"), words).alias("bloom_word")).agg(F.bit_or(_mask(F.col("k"))).alias("bloom_bits"))
    return KeyFilter(words, frame)


def references(sources: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One frame (table_name, soma_joinid, at) of all references; sources: name -> (frame, key column, time column)."""
    out = None
    for name, (df, key, at) in sources.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("soma_joinid"), F.col(at).alias("at"))
        part = part.where(F.col("soma_joinid").isNotNull() & F.col("at").isNotNull())
        out = part if out is None else out.unionAll(part)
    return out


def dead_spans(loads: DataFrame, deletes: DataFrame) -> DataFrame:
    """(soma_joinid, dead_from, dead_to): disjoint spans in which the last event of a key is a delete; dead_to is null while it lasts.

    loads and deletes: (soma_joinid, at).  Of a load and a delete in the same instant the load counts.
    """
    d = deletes.distinct().withColumnRenamed("at", "dead_from")
    only = loads.join(d.select("soma_joinid").distinct(), "soma_joinid", "left_semi").distinct()
    after = d.join(only, "soma_joinid").where(F.col("at") >= F.col("dead_from")).groupBy("soma_joinid", "dead_from").agg(F.min("at").alias("dead_to"))
    ends = d.join(after, ["soma_joinid", "dead_from"], "left")
    return ends.groupBy("soma_joinid", "dead_to").agg(F.min("dead_from").alias("dead_from")).where(F.col("dead_to").isNull() | (F.col("dead_to") > F.col("dead_from")))


def orphans(refs: DataFrame, parents: DataFrame, deletes: DataFrame, always: DataFrame) -> DataFrame:
    """Every orphan reference as distinct (table_name, period, soma_joinid, reason, n_refs).

    refs: as of `references`; parents, deletes: (soma_joinid, at); always: (soma_joinid) keys that exist at all times.
    reason: `missing` (no parent row at all), `late` (first seen after the reference), `deleted` (last event before it is a delete).
    n_refs counts the references of the key in that table and period (for `deleted` the distinct instants concerned).
    """
    parents = parents.where(F.col("soma_joinid").isNotNull())
    timed = parents.where(F.col("at").isNotNull())
    deletes = deletes.where(F.col("soma_joinid").isNotNull() & F.col("at").isNotNull())
    always = always.select("soma_joinid").where(F.col("soma_joinid").isNotNull()).distinct()

    known = key_filter(parents.select("soma_joinid"), "soma_joinid")
    # the only pass over the references: one row a table, key and month, and of keys that may ever have been deleted one row an instant
    ever_deleted = key_filter(deletes, "soma_joinid", BROADCAST_WORDS).split(refs, "soma_joinid")
    instant = F.when(F.col("maybe_known"), F.col("at")).alias("instant")
    seen = ever_deleted.groupBy("table_name", "soma_joinid", F.date_format("at", "yyyy-MM").alias("period"), instant).agg(F.min("at").alias("first_ref"), F.count(F.lit(1)).alias("n_refs"))
    seen = cut(seen.join(always, "soma_joinid", "left_anti"))
    per_key = seen.groupBy("table_name", "soma_joinid", "period").agg(F.min("first_ref").alias("first_ref"), F.sum("n_refs").alias("n_refs"))
    per_key = cut(known.split(per_key, "soma_joinid"))

    out = ["table_name", "period", "soma_joinid", "reason", "n_refs"]
    proven = per_key.where(~F.col("maybe_known")).withColumn("reason", F.lit("missing")).select(*out)

    # exact check of the filter's positives: one row per key on the parents' side
    first_load = parents.groupBy("soma_joinid").agg(F.min("at").alias("first_load"))
    first_delete = deletes.groupBy("soma_joinid").agg(F.min("at").alias("first_delete"))
    first = first_load.join(first_delete, "soma_joinid", "left").select("soma_joinid", F.least("first_load", "first_delete").alias("first_event"), F.lit(True).alias("has_parent"))
    checked = per_key.where("maybe_known").join(first, "soma_joinid", "left")
    reason = F.when(F.col("has_parent").isNull(), "missing").when(F.col("first_event").isNull() | (F.col("first_ref") < F.col("first_event")), "late")
    verified = checked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*out)

    # only keys that were ever deleted need every instant of their references
    spans = dead_spans(timed.select("soma_joinid", "at"), deletes.select("soma_joinid", "at"))
    spans = spans.join(parents.select("soma_joinid").distinct(), "soma_joinid", "left_semi")
    dead = seen.where("instant is not null").join(spans, "soma_joinid").where((F.col("instant") >= F.col("dead_from")) & (F.col("dead_to").isNull() | (F.col("instant") < F.col("dead_to"))))
    deleted = dead.groupBy("table_name", "period", "soma_joinid").agg(F.count(F.lit(1)).alias("n_refs")).withColumn("reason", F.lit("deleted")).select(*out)
    return proven.unionAll(verified).unionAll(deleted)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason: keys and references."""
    return found.groupBy("table_name", "period", "reason").agg(F.countDistinct("soma_joinid").alias("n_keys"), F.sum("n_refs").alias("n_refs"))
