"""A few keys holding most records: eager aggregation through joins.

Both inputs of a join are first reduced to one compact state per join key (counts, sums); the reduction combines
on the map side, so a key that holds a third of all rows leaves each task as one row.  The states are joined,
counts are multiplied and sums scaled by the other side's count, and the result is rolled up to the wanted group.
That equals joining first and aggregating afterwards, without any task that sees all rows of a hot key.

Nulls: a null key joins nothing (its rows count only in totals); a null or NaN value counts as a row but not as
a value.  Repeated rows count as often as they occur, as in the plain join.  Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrella.session import cut


def clean_value(col: Column) -> Column:
    """The value as double, null where it is null or NaN."""
    v = col.cast("double")
    return F.when(~F.isnan(v), v)


def fact_states(df: DataFrame, key: Column, value: Column, name: str = "key") -> DataFrame:
    """(key, n_rows, n_values, sum_values): one compact state per key, the null key included."""
    v = clean_value(value)
    return df.select(key.alias(name), v.alias("__v")).groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"), F.count("__v").alias("n_values"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("sum_values"))


def join_states(facts: DataFrame, groups: DataFrame, key: str = "key", group: str = "group_key") -> DataFrame:
    """Facts joined to groups and aggregated per group, from states only.

    facts: as of `fact_states`; groups: (key, group, n_dim) with the number of dimension rows of each key and group.
    Gives (group, n_rows, n_values, sum_values) as `facts JOIN groups ... GROUP BY group` over the raw rows would.
    """
    return per_joined_group(join_inputs(facts, groups, key, group), group)


def with_mean(states: DataFrame) -> DataFrame:
    """States with mean_value, null where a key has no value."""
    return states.withColumn("mean_value", F.when(F.col("n_values") > 0, F.col("sum_values") / F.col("n_values")))


def join_inputs(facts: DataFrame, groups: DataFrame, key: str = "key", group: str = "group_key") -> DataFrame:
    """The compact states of both inputs joined by key, keys of either side kept: (key, n_rows, n_values, sum_values, group, n_dim), one row a key and group.

    A null key joins nothing and stands for itself.  `per_key`, `per_group` and `per_joined_group` roll the result up.  It is written to the shared checkpoint
    folder, one row a key and group, so that roll-ups and totals don't read the inputs again.
    """
    g = groups.select(F.col(key).alias("__key"), group, "n_dim")
    both = facts.join(g, F.col(key) == F.col("__key"), "full")
    return cut(both.withColumn(key, F.coalesce(key, "__key")).drop("__key"))


def per_key(joined: DataFrame, key: str = "key") -> DataFrame:
    """The facts of each key again: its state stands on each of its rows, so the largest is the state."""
    return joined.where(F.col("n_rows").isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in ("n_rows", "n_values", "sum_values")])


def per_group(joined: DataFrame, group: str = "group_key") -> DataFrame:
    """(group, n_rows): dimension rows of each group, the null group included."""
    return joined.where(F.col("n_dim").isNotNull()).groupBy(group).agg(F.sum("n_dim").alias("n_rows"))


def per_joined_group(joined: DataFrame, group: str = "group_key") -> DataFrame:
    """Facts per group as the plain join would count them: each key's state times its dimension rows."""
    both = joined.where(F.col("n_rows").isNotNull() & F.col("n_dim").isNotNull() & F.col(group).isNotNull())
    return both.groupBy(group).agg(*[F.sum(F.col(c) * F.col("n_dim")).alias(c) for c in ("n_rows", "n_values", "sum_values")])


def heavy_keys(states: DataFrame, share: float, key: str = "key") -> DataFrame:
    """The non-null keys that hold at least `share` of all rows; the total includes the null key."""
    total = states.agg(F.sum("n_rows")).scalar()
    return states.where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * total))
