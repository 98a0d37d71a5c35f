"""Filling fixed-capacity containers with items (problem 7): bulk-synchronous best fit.

Documents are ordered by size and ranked within it. As sizes are whole numbers
of at most the capacity, documents of one size and containers of one gap are
interchangeable, and a round works on classes (size, count) and (gap, count):
the classes of sizes are swept from the largest down; the documents of a class
all at once take the successor gap (the smallest that holds them), as many to a
container as it holds; where more documents than places want a gap, the lower
ranks get it and the others go on to the next gap, and where none is left new
containers are opened; then gaps are updated and the next round begins. The
state is bounded by the capacity and not by the documents, so the rounds run in
one task for each capacity; ranking, lookup and totals are distributed.

Cases. A document of more tokens than the capacity is cut into full containers
of its own and a remainder that is packed like any document. Documents without
tokens (null or empty text) take no space and go to container 0. Null ids are
left out. Repeated rows of one id are one document. Ties are broken by a hash
of the id. Capacities below 1 give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.prefix import running_sum
from sievework.session import small


def best_fit(classes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Moves (size, first rank, rank after the last, first container, documents a container) and the number of containers.

    A document of the size with rank r in the range goes to container first + (r - first rank) // documents a container.
    """
    moves: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # gaps in use, ascending
    held: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, count)
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in held:
                insort(gaps, gap)
                held[gap] = []
            held[gap].append((first, count))

    for size, n in sorted(classes, reverse=True):
        rank = 0
        while rank < n:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, count = held[gap].pop()
                if not held[gap]:
                    del held[gap]
                    gaps.pop(at)
            else:
                gap, first, count = capacity, opened, -(-(n - rank) // (capacity // size))
                opened += count
            per = gap // size
            full = min(count, (n - rank) // per)
            if full:
                moves.append((size, rank, rank + full * per, first, per))
                rank += full * per
                put(gap - per * size, first, full)
            if full < count:
                rest = min(n - rank, per - 1) if full < count else 0
                if rest:
                    moves.append((size, rank, rank + rest, first + full, per))
                    rank += rest
                    put(gap - rest * size, first + full, 1)
                    full += 1
                put(gap, first + full, count - full)
    return moves, opened


def fixed_capacities(capacities: DataFrame, most: int = 1000) -> list[tuple[int, int]]:
    """The capacities as literals. The table is fixed; one of more than ``most`` rows is refused, not cut."""
    rows = capacities.filter("capacity_id IS NOT NULL AND max_tokens >= 1").groupBy("capacity_id").agg(F.max("max_tokens").alias("m")).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities")
    return sorted((r["capacity_id"], r["m"]) for r in rows)


def pieces(docs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, max_tokens, doc_id, tokens, full, size): full containers that a document fills alone, and the size left to pack."""
    sizes = fixed_capacities(capacities)
    caps = F.array(*[F.struct(F.lit(c).cast("int").alias("capacity_id"), F.lit(m).cast("int").alias("max_tokens")) for c, m in sizes]) if sizes else F.array().cast("array<struct<capacity_id:int,max_tokens:int>>")
    one = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    full = F.when(F.col("tokens") > F.col("max_tokens"), F.floor(F.col("tokens") / F.col("max_tokens"))).otherwise(0)
    each = one.select("doc_id", "tokens", F.explode(caps).alias("c")).select("doc_id", "tokens", "c.capacity_id", "c.max_tokens")
    return each.select("capacity_id", "max_tokens", "doc_id", "tokens", full.alias("full"), (F.col("tokens") - full * F.col("max_tokens")).cast("long").alias("size"))


def pack(docs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, doc_id, part_no, container_id, tokens) for documents (doc_id, tokens).

    The table of capacities is fixed and small; containers are numbered from 0 within a capacity.
    """
    items = pieces(docs, capacities)
    classes = items.filter("size > 0").groupBy("capacity_id", "max_tokens", "size").agg(F.count("*").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        moves, opened = best_fit(list(zip(pdf["size"].tolist(), pdf["n"].tolist())), int(pdf["max_tokens"].iloc[0]))
        out = pd.DataFrame(moves, columns=["size", "lo", "hi", "first", "per"])
        out.insert(0, "capacity_id", pdf["capacity_id"].iloc[0])
        out["opened"] = opened
        return out

    moves = classes.groupBy("capacity_id").applyInPandas(plan, "capacity_id int, size bigint, lo bigint, hi bigint, first bigint, per bigint, opened bigint")
    by_size = moves.groupBy(F.col("capacity_id").alias("_c"), F.col("size").alias("_s")).agg(F.collect_list(F.struct("lo", "hi", "first", "per")).alias("moves"))
    ranked = running_sum(items.filter("size > 0"), ["capacity_id", "size"], ["doc_id"], None, "rank")
    placed = ranked.join(by_size, (F.col("capacity_id") == F.col("_c")) & (F.col("size") == F.col("_s")))
    move = F.get(F.filter("moves", lambda m: (m["lo"] <= F.col("rank")) & (F.col("rank") < m["hi"])), 0)
    spot = move["first"] + F.floor((F.col("rank") - move["lo"]) / move["per"])
    packed = placed.select("capacity_id", "doc_id", F.col("full").cast("int").alias("part_no"), spot.cast("long").alias("container_id"), F.col("size").alias("tokens"))
    empty = items.filter("tokens = 0").select("capacity_id", "doc_id", F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("container_id"), F.lit(0).cast("long").alias("tokens"))
    opened = moves.groupBy(F.col("capacity_id").alias("_c")).agg(F.max("opened").alias("opened"))
    large = running_sum(items.filter("full > 0"), ["capacity_id"], ["doc_id"], "full", "before").join(opened, F.col("capacity_id") == F.col("_c"), "left")
    parts = large.select("capacity_id", "doc_id", "max_tokens", "before", F.coalesce("opened", F.lit(0)).alias("opened"), F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("part_no"))
    alone = parts.select("capacity_id", "doc_id", "part_no", (F.col("opened") + F.col("before") + F.col("part_no")).cast("long").alias("container_id"), F.col("max_tokens").cast("long").alias("tokens"))
    return packed.unionByName(alone).unionByName(empty)


def fills(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container_id, documents, used_tokens, fill): what each container holds."""
    caps = small(capacities.groupBy(F.col("capacity_id").alias("_c")).agg(F.max("max_tokens").alias("max_tokens")))
    used = packed.groupBy("capacity_id", "container_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("used_tokens"))
    return used.join(caps, F.col("capacity_id") == F.col("_c")).select("capacity_id", "container_id", "documents", "used_tokens", F.round(F.col("used_tokens") / F.col("max_tokens"), 6).alias("fill"))
