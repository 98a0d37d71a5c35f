"""Pairs of rows that share a bucket, for buckets of any size.

A bucket of n rows is cut into m = ceil(n / crowd) parts. On the left a row stands in its own part and is repeated for each
part it has to meet, on the right the other way round, so a join key (bucket, part, part) holds at most about ``crowd`` rows
a side and every pair of the bucket meets exactly once. Buckets of one row are dropped before the join.

Joins are merge joins by hint: behind an explode or a Python function the optimizer's size is too low by orders of magnitude,
and it would broadcast what no executor or driver can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CROWD = 400


def counted(keys: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``keys`` (k, ...) without buckets of one row, with ``m``, the parts of its bucket. Counts are combined before they shuffle."""
    sizes = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / crowd).cast("int").alias("m"))
    return keys.join(sizes.hint("merge"), "k")


def meeting(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """left (k, m, l...) and right (k, m, r...) joined on the bucket; ``by`` is the row key that both name, cut into parts by its hash."""
    parts = lambda: F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    own = F.pmod(F.xxhash64(by), F.col("m")).cast("int")
    rest = lambda df: [c for c in df.columns if c not in ("k", "m", by)]
    x = left.select("k", own.alias("_x"), parts().alias("_y"), F.col(by).alias("a"), *[F.col(c).alias(f"{c}_a") for c in rest(left)])
    y = right.select("k", parts().alias("_x"), own.alias("_y"), F.col(by).alias("b"), *[F.col(c).alias(f"{c}_b") for c in rest(right)])
    return x.join(y.hint("merge"), ["k", "_x", "_y"]).drop("_x", "_y")
