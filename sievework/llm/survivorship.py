"""Best representative of each duplicate group (problem 5).

Field-by-field survivorship in one aggregation: for every attribute the maximum
of the struct (usable, source priority, timestamp, member id, value) over the
group. The maximum is partially aggregated before the shuffle, so a group that
holds a third of all rows moves one row a partition.

Cases. A value is usable if it states something and is not cut off; null,
blank and placeholder cells are not. A group without a usable value for an
attribute yields no row for it. Ties of priority and time go to the greater
member id; repeated rows change nothing. Null times lose to any time. Rows with
a null group are left out. Columns other than those named are not read, so
extra columns with clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import clean_cell, known_level, known_province

ELLIPSIS = r"(?:\.\.+|…|\[\s*(?:cut|truncated)\s*\])\s*$"


@dataclass(frozen=True)
class Attribute:
    """An attribute to fill: the column's text and the test that it can be used."""

    name: str
    value: Column
    usable: Column


def stated_text(col: Column) -> Column:
    """Usable free text: it states something, has a letter and is not cut off."""
    s = clean_cell(col)
    return (s != "") & s.rlike(r"\p{L}") & ~s.rlike(ELLIPSIS)


def survivors(rows: DataFrame, group: str, member: str, priority: Column, at: str, attributes: list[Attribute]) -> DataFrame:
    """(group, field_name, member, value): for each group and attribute the member whose value survives."""
    picked = rows.select(
        F.col(group).alias("_group"),
        *[
            F.when(a.usable & F.col(group).isNotNull(), F.struct(priority.cast("int").alias("p"), F.col(at).alias("t"), F.col(member).alias("m"), a.value.cast("string").alias("v"))).alias(f"_a{i}")
            for i, a in enumerate(attributes)
        ],
    )
    best = picked.groupBy("_group").agg(*[F.max(f"_a{i}").alias(f"_a{i}") for i in range(len(attributes))])
    fields = F.array(*[F.struct(F.lit(a.name).alias("field_name"), F.col(f"_a{i}").alias("best")) for i, a in enumerate(attributes)])
    return (
        best.select("_group", F.explode(fields).alias("f"))
        .filter("f.best IS NOT NULL")
        .select(F.col("_group").alias(group), "f.field_name", F.col("f.best.m").alias(member), F.col("f.best.v").alias("value"))
    )


def office_attributes() -> list[Attribute]:
    """The attributes of an office holder: level, position and province."""
    return [
        Attribute("pep_level", F.col("pep_level"), known_level(F.col("pep_level")).isNotNull()),
        Attribute("position", F.col("position"), stated_text(F.col("position"))),
        Attribute("province", F.col("province"), known_province(F.col("province")).isNotNull()),
    ]


def office_survivors(matches: DataFrame, groups: DataFrame, lists: DataFrame) -> DataFrame:
    """(group_id, field_name, match_id, value) for matches grouped by office holder; lists with status OK go first."""
    trusted = lists.groupBy(F.col("list").alias("_list")).agg(F.max((F.upper(F.trim(F.coalesce("status", F.lit("OK")))) == "OK").cast("int")).alias("_ok"))
    narrow = matches.select("match_id", F.col("list").alias("_of"), "checked_at", "pep_level", "position", "province")
    members = groups.select("group_id", F.col("match_id").alias("_m")).join(narrow, F.col("_m") == F.col("match_id"))
    return survivors(members.join(trusted, F.col("_of") == F.col("_list"), "left"), "group_id", "match_id", F.coalesce("_ok", F.lit(1)), "checked_at", office_attributes())


def surviving_records(found: DataFrame) -> DataFrame:
    """One row a group: the surviving value of each attribute."""
    return found.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in ("pep_level", "position", "province")])
