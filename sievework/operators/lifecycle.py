"""Life of sources and stored tables: states, last good copies, upserts, inserts of what is absent, review and history.

Every operator is a plain transform of tables to the table that is to be written, so it can run in a batch job or in
``foreachBatch``; repeated with the same input it gives the same table.

Cases. Null keys are no rows. Of rows with equal order the one with the greater remaining values is kept, so ties are
defined. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order``, then by the other columns. One aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*key, *order)]
    keyed = rows.dropna(subset=key)
    best = keyed.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The stored table after the changes: of each key the latest row of either."""
    return latest(stored.unionByName(changes), key, order)


def insert_absent(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The stored table and, of each key it does not hold, the first of the new rows by ``order``."""
    rest = [c for c in new.columns if c not in (*key, *order)]
    first = new.dropna(subset=key).groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    rows = first.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in stored.columns])
    return stored.unionByName(rows.join(stored.select(*key).distinct(), key, "left_anti"))


def snapshots(files: DataFrame) -> DataFrame:
    """(source_key, snapshot_no, good, loaded_at) of files (source_key, snapshot_no, error, loaded_at): one failed file fails its snapshot."""
    return files.groupBy("source_key", "snapshot_no").agg(
        (F.max((F.coalesce("error", F.lit("")) != "").cast("int")) == 0).alias("good"), F.max("loaded_at").alias("loaded_at")
    )


def source_states(files: DataFrame, days: int = 30) -> DataFrame:
    """(source_key, last_no, good_no, age_days, state): LIVE, LAST_GOOD (a copy of at most ``days``), STALE or UNAVAILABLE, at the last load of any source."""
    s = snapshots(files)
    each = s.groupBy("source_key").agg(
        F.max("snapshot_no").alias("last_no"), F.max(F.when(F.col("good"), F.col("snapshot_no"))).alias("good_no"), F.max_by(F.when(F.col("good"), F.col("loaded_at")), F.when(F.col("good"), F.col("snapshot_no"))).alias("good_at")
    )
    now = s.agg(F.max("loaded_at").alias("now"))
    aged = each.join(F.broadcast(now)).withColumn("age_days", F.floor((F.unix_micros("now") - F.unix_micros("good_at")) / 86_400_000_000).cast("int"))  # one row
    state = F.when(F.col("good_no").isNull(), "UNAVAILABLE").when(F.col("good_no") == F.col("last_no"), "LIVE").when(F.col("age_days") <= days, "LAST_GOOD").otherwise("STALE")
    return aged.select("source_key", "last_no", "good_no", "age_days", state.alias("state"))


def files_in_use(files: DataFrame) -> DataFrame:
    """(source_key, file_no, snapshot_no): for each part of a source the copy to read, the newest that did not fail."""
    good = files.filter("coalesce(error, '') = ''")
    return good.groupBy("source_key", "file_no").agg(F.max("snapshot_no").alias("snapshot_no"))


def changed_sources(files: DataFrame) -> DataFrame:
    """(source_key) of sources whose last good snapshot differs from the good one before in any file."""
    from pyspark.sql import Window as W

    good = files.join(snapshots(files).filter("good").select("source_key", "snapshot_no"), ["source_key", "snapshot_no"])
    marks = good.groupBy("source_key", "snapshot_no").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", F.col("file_no").cast("string"), "fingerprint"))), "|").alias("mark"))
    before = marks.withColumn("old", F.lag("mark").over(W.partitionBy("source_key").orderBy("snapshot_no")))
    last = before.groupBy("source_key").agg(F.max_by(F.struct("mark", "old"), "snapshot_no").alias("l"))
    return last.filter(~F.col("l.mark").eqNullSafe(F.col("l.old"))).select("source_key")


def plain_reason(error: Column, most: int = 120) -> Column:
    """An error as people read it: addresses out, blanks single, at most ``most`` characters."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(error, F.lit("")), r"https?://[^ ]+", ""), r" +", " "))
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def counted(n: Column, one: str, many: str) -> Column:
    """'1 match', '3 matches'."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def listing(values: Column, by: str = "; ") -> Column:
    """Distinct stated values of a group in order, joined: an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(values) != "", values))), by)
