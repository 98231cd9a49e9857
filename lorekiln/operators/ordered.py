"""Ordered state within groups of any size: a hot group is cut into ranges of its order, which are linked by a small table.

Ranges come from PARTS quantiles of the order column over all rows, so there
are at most PARTS of them in a group, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def ranged(df: DataFrame, order: str) -> DataFrame:
    """Adds ``range__``, the number of the quantile range of ``order``; nulls come first."""
    edges = df.agg(F.percentile_approx(F.col(order).cast("double"), [k / PARTS for k in range(1, PARTS)], 1000)).first()[0] or []
    edges = sorted(set(edges))
    number = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order).cast("double"))) if edges else F.lit(0)
    return df.withColumn("range__", F.coalesce(number, F.lit(-1)))


def _carry(parts: DataFrame, by: list[str], value: str, back: bool = False) -> DataFrame:
    """The last (or next) value that isn't null from the ranges before (behind) each range."""
    w = Window.partitionBy(*by).orderBy(F.col("range__").desc() if back else F.col("range__").asc()).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(value, F.last(value, ignorenulls=True).over(w))


def _joined(df: DataFrame, parts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``parts`` for its group and range; null groups meet too."""
    keys = [*by, "range__"]
    other = parts.select(*[F.col(c).alias(f"{c}__k") for c in keys], *[c for c in parts.columns if c not in keys])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__k"))
    return df.join(other, on, how).drop(*[f"{c}__k" for c in keys])


def neighbours_in_order(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``previous`` and ``next``: the order values next to each row within its group."""
    rows = ranged(df, order)
    w = Window.partitionBy(*by, "range__").orderBy(order)
    inner = rows.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))
    ends = rows.groupBy(*by, "range__").agg(F.min(order).alias("first__"), F.max(order).alias("last__"))
    parts = _carry(_carry(ends, by, "last__"), by, "first__", back=True)
    return _joined(inner, parts, by).withColumn("previous", F.coalesce("previous", "last__")).withColumn("next", F.coalesce("next", "first__")).drop("first__", "last__", "range__")


def carried(df: DataFrame, by: list[str], order: str, value: str, to: str) -> DataFrame:
    """Adds ``to``: the last value before each row within its group, nulls passed over."""
    rows = ranged(df, order)
    w = Window.partitionBy(*by, "range__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn(to, F.last(value, ignorenulls=True).over(w))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*by, "range__").agg(F.max_by(value, order).alias("last__"))
    every = rows.select(*by, "range__").distinct()
    parts = _carry(_joined(every, ends, by, "left"), by, "last__")
    return _joined(inner, parts, by).withColumn(to, F.coalesce(to, "last__")).drop("last__", "range__")


def numbered(df: DataFrame, by: list[str], order: str, tie: str, to: str) -> DataFrame:
    """Adds ``to``: the number of each row within its group by ``order``, then ``tie``, from 1."""
    rows = ranged(df, order)
    inner = rows.withColumn(to, F.row_number().over(Window.partitionBy(*by, "range__").orderBy(F.col(order).asc_nulls_first(), tie)))
    sizes = rows.groupBy(*by, "range__").agg(F.count("*").alias("size__"))
    w = Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.withColumn("skip__", F.coalesce(F.sum("size__").over(w), F.lit(0))).drop("size__")
    return _joined(inner, parts, by).withColumn(to, (F.col(to) + F.col("skip__")).cast("int")).drop("skip__", "range__")


def newest(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group with ``recency`` from 1; cut in each range first."""
    rows = ranged(df, order)
    recency = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    few = rows.withColumn("recency", recency(*by, "range__")).where(F.col("recency") <= n)
    return few.withColumn("recency", recency(*by)).where(F.col("recency") <= n).drop("range__")
