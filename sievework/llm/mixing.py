"""Mixing sources to target weights (problem 8): a time-varying curriculum.

For each mix the weight of source i at time t (0 to 1) is
w_i(t) = w_i + (t - 1/2) d_i. The d_i add up to zero and lean the mix from
more even at the start to more uneven at the end, so at every time the weights
add up to one and over all time each source gets its target w_i. The total B is
the largest at which no source needs more than ``max_repeats`` passes. The
cumulative demand B * integral(w_i) is inverted in closed form: the token at
which a copy of a document lies within its source gives the time at which it is
due. Copies are then range-sorted by that time.

Within a source documents are taken in hash order, in whole passes and one part
pass; the running token count comes from a two-level prefix sum, so a source
that holds a third of all rows is no single task.

Cases. Sources are compared in one spelling. A targeted source without tokens
gets share 0 and does not hold back the others. Documents without a source,
without tokens or of untargeted sources are used 0 times and not listed.
Targets that repeat in a mix add up; max_repeats below 1 or a share not above 0
means the source is not drawn. Repeated rows of one id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.tokens import source_key
from sievework.operators.prefix import running_sum
from sievework.session import small

LEAN = 0.5


def plans(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, weight, slope, have, demand, total): what each mix takes of each source. One row a target."""
    have = docs.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("have"))
    wanted = targets.withColumn("s", source_key(F.col("source"))).groupBy("mix_id", "s").agg(F.sum("target_share").alias("weight"), F.max("max_repeats").alias("repeats"))
    joined = wanted.join(have, F.col("s") == F.col("source"), "left").select("mix_id", F.col("s").alias("source"), "weight", "repeats", F.coalesce("have", F.lit(0)).alias("have"))
    mix = W.partitionBy("mix_id")
    drawn = (F.col("have") > 0) & (F.col("weight") > 0) & (F.col("repeats") >= 1)
    limit = F.min(F.when(drawn, F.col("have") * F.col("repeats") / F.col("weight"))).over(mix)
    rows = joined.withColumn("total", F.coalesce(limit, F.lit(0.0))).withColumn("demand", F.when(drawn, F.col("total") * F.col("weight")).otherwise(0.0))
    even = F.sum(F.when(drawn, F.col("weight")).otherwise(0.0)).over(mix) / F.sum(F.when(drawn, 1).otherwise(0)).over(mix)
    lean = F.col("weight") - even
    # No weight may fall below zero at the end: w + d/2 >= 0 for the smallest.
    room = F.min(F.when(drawn & (lean < 0), -2 * F.col("weight") / lean)).over(mix)
    slope = lean * F.least(F.lit(LEAN), F.coalesce(room, F.lit(LEAN)))
    return rows.select("mix_id", "source", "weight", F.when(drawn, slope).otherwise(0.0).alias("slope"), "have", "demand", "total")


def draws(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, tokens, uses, before, ...): documents that a mix uses at least once, and where each lies in its source."""
    one = docs.filter("doc_id IS NOT NULL AND tokens > 0 AND source IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.source", "r.tokens")
    placed = running_sum(one, ["source"], ["doc_id"], "tokens", "before")
    # One row a target: the table of mixes is fixed and small.
    rows = placed.join(small(plans(one, targets).filter("demand > 0")), "source")
    passes = F.floor(F.col("demand") / F.col("have") + 1e-9)
    rest = F.col("demand") - passes * F.col("have")
    extra = (F.col("before") + F.col("tokens") / 2 <= rest).cast("long")
    return rows.withColumn("uses", (passes + extra).cast("int")).filter("uses > 0")


def uses(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, uses)."""
    return draws(docs, targets).select("mix_id", "doc_id", "source", "uses")


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, documents, tokens, share): what each source really gets."""
    got = draws(docs, targets).groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    wanted = targets.groupBy("mix_id", source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    rows = wanted.join(got, ["mix_id", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    share = tokens / F.nullif(F.sum(tokens).over(W.partitionBy("mix_id")), F.lit(0))
    return rows.select("mix_id", "source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("share"))


def training_order(docs: DataFrame, targets: DataFrame, parts: int | None = None) -> DataFrame:
    """(mix_id, doc_id, source, copy_no, position): every copy with the time (0 to 1) at which it is due, range-sorted."""
    copies = draws(docs, targets).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    at = (F.col("copy_no") * F.col("have") + F.col("before") + F.col("tokens") / 2) / F.col("total")
    start = F.col("weight") - F.col("slope") / 2
    root = F.sqrt(F.greatest(start * start + 2 * F.col("slope") * at, F.lit(0.0)))
    due = F.when(F.abs("slope") < 1e-9, at / F.col("weight")).otherwise(2 * at / (start + root))
    rows = copies.select("mix_id", "doc_id", "source", "copy_no", F.round(F.least(due, F.lit(1.0)), 9).alias("position"))
    order = ["mix_id", "position", "doc_id", "copy_no"]
    return (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
