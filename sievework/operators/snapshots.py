"""Changes between full snapshots (problem 2) as signed cells.

Every valid row is unpivoted into key-field-value cells and one key-presence
marker. A snapshot counts its cells with +1 in the comparison in which it is
the newer side and with -1 in the one in which it is the older side. Equal
cells cancel in the grouped sum, so what is left over classifies the row:
a presence of +1 is an addition, of -1 a removal, and a presence of 0 with a
cell left over is a change, of exactly the fields whose cells are left.

Cases. Null and '' (and, for arrays, null, [] and null elements as '') are one
value. Blanks of any kind around ids are removed; rows without an id are not
valid and are left out. Of several rows for one id in one snapshot the one
with the latest ``delivered_at`` holds; on a tie the greatest row in column
order, so the result does not depend on file order. A snapshot with an error
in any of its files is void as a whole. The first valid snapshot of a source
yields nothing. An empty but valid snapshot removes everything. Other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.session import small

FIELDS = ("list", "primary_name", "names", "dob", "cnic")
BLANKS = r"^[\s\h\u200B\uFEFF]+|[\s\h\u200B\uFEFF]+$"


def clean_id(col: Column) -> Column:
    return F.regexp_replace(col, BLANKS, "")


def _as_text(df: DataFrame, field: str) -> Column:
    """One text per value, null as ''; arrays keep their order."""
    if dict(df.dtypes)[field].startswith("array"):
        parts = F.transform(F.coalesce(F.col(field), F.array().cast(dict(df.dtypes)[field])), lambda x: F.coalesce(x.cast("string"), F.lit("")))
        return F.array_join(parts, "\u001f")
    return F.coalesce(F.col(field).cast("string"), F.lit(""))


def comparisons(files: DataFrame) -> DataFrame:
    """(source_key, snapshot_no, next_no, has_prev): valid snapshots, each with the next valid one that is compared with it."""
    valid = (
        files.groupBy("source_key", "snapshot_no")
        .agg(F.max(F.when(F.coalesce(F.trim("error"), F.lit("")) != "", 1).otherwise(0)).alias("bad"))
        .filter("bad = 0")
    )
    order = W.partitionBy("source_key").orderBy("snapshot_no")
    return valid.select(
        "source_key", "snapshot_no", F.lead("snapshot_no").over(order).alias("next_no"), F.lag("snapshot_no").over(order).isNotNull().alias("has_prev")
    )


def latest_rows(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row an id and snapshot: the latest delivered. Partially aggregated before the shuffle, so a hot id is no hot task."""
    picked = rows.select(
        "source_key", "snapshot_no", clean_id(F.col("id")).alias("id"), F.struct(F.col("delivered_at"), *[_as_text(rows, f).alias(f) for f in fields]).alias("r")
    ).filter("id <> ''")
    return picked.groupBy("source_key", "snapshot_no", "id").agg(F.max("r").alias("r"))


def signed_cells(rows: DataFrame, files: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source_key, snapshot_no, id, field, value, sign); ``snapshot_no`` is the newer side, field '' is the presence marker."""
    pairs = small(comparisons(files))
    kept = latest_rows(rows.join(pairs.select("source_key", "snapshot_no"), ["source_key", "snapshot_no"], "left_semi"), fields)
    roles = kept.join(pairs, ["source_key", "snapshot_no"]).select(
        "source_key",
        "id",
        "r",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(F.col("has_prev"), F.col("snapshot_no")).alias("at"), F.lit(1).cast("long").alias("sign")),
                    F.struct(F.col("next_no").alias("at"), F.lit(-1).cast("long").alias("sign")),
                ),
                lambda x: x["at"].isNotNull(),
            )
        ).alias("role"),
    )
    cells = [F.struct(F.lit("").alias("field"), F.lit(0).cast("long").alias("value"))]
    cells += [F.struct(F.lit(f).alias("field"), F.xxhash64(F.lit(f), F.col(f"r.{f}")).alias("value")) for f in fields]
    return roles.select("source_key", F.col("role.at").alias("snapshot_no"), "id", F.explode(F.array(*cells)).alias("c"), F.col("role.sign").alias("sign")).select(
        "source_key", "snapshot_no", "id", "c.field", "c.value", "sign"
    )


def snapshot_changes(rows: DataFrame, files: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source_key, snapshot_no, id, change_type, changed_fields) against the last earlier valid snapshot.

    ``files`` has a row for each file of a snapshot; it is broadcast only while its
    estimated size is small, else the planner shuffles it too.
    """
    left = signed_cells(rows, files, fields).groupBy("source_key", "snapshot_no", "id", "field", "value").agg(F.sum("sign").alias("n")).filter("n <> 0")
    verdict = left.groupBy("source_key", "snapshot_no", "id").agg(
        F.sum(F.when(F.col("field") == "", F.col("n")).otherwise(0)).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("touched"),
    )
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return verdict.select(
        "source_key", "snapshot_no", "id", kind.alias("change_type"), F.when(F.col("presence") == 0, F.col("touched")).otherwise(F.array().cast("array<string>")).alias("changed_fields")
    )


def field_change_counts(changes: DataFrame) -> DataFrame:
    """(source_key, snapshot_no, field, n_ids): how many ids changed in each field."""
    return (
        changes.filter("change_type = 'changed'")
        .select("source_key", "snapshot_no", F.explode("changed_fields").alias("field"))
        .groupBy("source_key", "snapshot_no", "field")
        .agg(F.count("*").alias("n_ids"))
    )
