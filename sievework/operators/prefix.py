"""Running sums and ranks over groups of any size without one task per group.

``W.partitionBy(group).orderBy(...)`` puts a whole group into one task; with a
third of all rows in one group that task never ends. Here each group is cut
into buckets by a hash of its ordering key. Bucket totals (at most ``buckets``
rows a group) are summed first, then each bucket is ranked on its own and
shifted by the total of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_bucket(key: list[str], buckets: int, salt: int = 7) -> Column:
    """Bucket 0..buckets-1 by the high bits of a 64-bit hash, so bucket order is hash order."""
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *key), 33)
    return F.floor(spread * F.lit(buckets) / F.lit(1 << 31)).cast("int")


def running_sum(df: DataFrame, group: list[str], key: list[str], value: str | None, out: str, buckets: int = 256, salt: int = 7) -> DataFrame:
    """Add ``out``: the sum of ``value`` (or the count) over the rows of the group before this one, in hash order of ``key``.

    ``key`` must be unique within a group for a stable result; null groups form a group of their own.
    """
    bucketed = df.withColumn("_b", hash_bucket(key, buckets, salt))
    amount = F.col(value) if value else F.lit(1)
    totals = bucketed.groupBy(*group, "_b").agg(F.sum(amount).cast("double" if value and dict(df.dtypes)[value] == "double" else "long").alias("_t"))
    before = totals.withColumn(
        "_base", F.coalesce(F.sum("_t").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_t")
    renamed = before.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), "_base")
    match = F.col("_b") == F.col("_gb")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = W.partitionBy(*group, "_b").orderBy(F.xxhash64(F.lit(salt), *key), *key).rowsBetween(W.unboundedPreceding, -1)
    return (
        bucketed.join(renamed, match, "left")
        .withColumn(out, F.coalesce(F.sum(amount).over(within), F.lit(0)) + F.col("_base"))
        .drop("_b", "_gb", "_base", *[f"_g{i}" for i in range(len(group))])
    )
