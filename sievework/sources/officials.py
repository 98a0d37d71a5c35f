"""Office holders from a snapshot of people, politicians and assembly members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.scalars import first_year
from sievework.operators.offices import classify_position
from sievework.sources.lists import _record

PEOPLE = "id string, name string, aliases array<string>, dob string, dod string, positions array<struct<label:string,start:string,end:string>>"
POLITICIANS = "id string, name string, dob string, party string"
MEMBERS = "assembly string, label string, level string, province string, source string, name string, names array<string>, constituency string, party string"


def in_lookback(end: Column, today: Column, years: float) -> Column:
    """In office, or left no longer ago than ``years``; 0 keeps only current offices, below 0 keeps all; a date that cannot be read counts to its year's end."""
    y = F.regexp_extract(F.coalesce(end, F.lit("")), r"^\s*(\d{4})", 1)
    if years < 0:
        return F.lit(True)
    left = F.coalesce(F.try_to_date(F.substring(F.trim(end), 1, 10), "yyyy-MM-dd"), F.make_date(F.when(y != "", y).cast("int"), F.lit(12), F.lit(31)))
    return (y == "") | (F.lit(years > 0) & (F.datediff(today, left) <= years * 365.25))


def span(start: Column, end: Column) -> Column:
    a, b = first_year(start), first_year(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(" ("), a, F.lit(" to "), b, F.lit(")"))).when(a.isNotNull(), F.concat(F.lit(" (from "), a, F.lit(")"))).when(b.isNotNull(), F.concat(F.lit(" (until "), b, F.lit(")"))).otherwise("")


def tenure_is_recent(cell: Column, this_year: int, years: int) -> Column:
    """The latest year in a cell is within the look-back; without a year it is kept."""
    latest = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda x: x.cast("int")))
    return F.coalesce(latest >= this_year - years, F.lit(True))


def _name_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")), " ")


def _finish(rows: DataFrame, ident: Column, names: Column, offices: Column, dob: Column, source: Column) -> DataFrame:
    """Records from (label, level, province, span) offices: the highest level wins, four offices are shown."""
    rows = rows.select(ident.alias("ident"), F.array_distinct(F.filter(F.transform(names, F.trim), lambda n: n != "")).alias("names"), offices.alias("o"), dob.alias("birth"), source.alias("src")).filter("size(names) > 0 AND size(o) > 0")
    has = lambda level: F.exists("o", lambda p: p["level"] == level)
    level = F.when(has("National"), "National").when(has("Provincial"), "Provincial").when(has("Local"), "Local").otherwise(F.get(F.col("o"), 0)["level"])
    rows = rows.withColumn("lvl", level)
    there = F.array_distinct(F.transform(F.filter("o", lambda p: (p["province"] != "") & (p["level"] == F.when(F.col("lvl") == "Provincial", "Provincial").otherwise("Local"))), lambda p: p["province"]))
    rows = rows.withColumn("there", F.when(F.col("lvl").isin("Provincial", "Local"), there).otherwise(F.array().cast("array<string>")))
    shown = F.transform(F.slice("o", 1, 4), lambda p: F.concat(p["label"], p["span"]))
    more = F.when(F.size("o") > 4, F.array(F.concat(F.lit("and "), (F.size("o") - 4).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    position = F.array_join(F.concat(shown, more), "; ")
    programs = F.concat(F.lit("PEP, "), F.col("lvl"), F.when(F.size("there") > 0, F.concat(F.lit(", "), F.array_join("there", ", "))).otherwise(""))
    return _record(
        rows, list=F.lit("PEP knowledge base"), id=F.col("ident"), primary_name=F.get(F.col("names"), 0), type=F.lit("Individual"), programs=programs, dob=F.col("birth"), nationality=F.lit("Pakistan"),
        remarks=F.concat(position, F.lit("; Source: "), F.col("src")), names=F.col("names"), source_key=F.lit("pep"), province=F.coalesce(F.get(F.col("there"), 0), F.lit("")), pep_level=F.col("lvl"), position=position,
    )


def snapshot_records(people: DataFrame, politicians: DataFrame, members: DataFrame, today: str, years: float = 5) -> DataFrame:
    """People with a qualifying office, then politicians and members whose name is not among those before."""
    day = F.lit(today).cast("date")
    alive = people.filter("coalesce(dod, '') = ''")
    offices = F.filter(
        F.transform("positions", lambda p: F.struct(p["label"].alias("label"), classify_position(p["label"], F.lit(True)).alias("c"), span(p["start"], p["end"]).alias("span"), in_lookback(p["end"], day, years).alias("ok"))),
        lambda p: p["c"].isNotNull() & p["ok"],
    )
    ordered = F.transform(
        F.array_sort(F.transform(offices, lambda p: F.struct(p["span"].contains("to").alias("past"), p["span"].alias("span"), p["label"].alias("label"), p["c"]["level"].alias("level"), p["c"]["province"].alias("province")))),
        lambda p: F.struct(p["label"].alias("label"), p["level"].alias("level"), p["province"].alias("province"), p["span"].alias("span")),
    )
    ident = F.concat(F.lit("PEP-WD-"), F.coalesce("id", F.lit("")))
    first = _finish(alive, ident, F.concat(F.array(F.coalesce("name", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>"))), ordered, F.substring(F.coalesce("dob", F.lit("")), 1, 10), F.concat(F.lit("Wikidata "), F.col("id")))
    one = lambda label, level, province: F.array(F.struct(label.alias("label"), level.alias("level"), province.alias("province"), F.lit("").alias("span")))
    party = F.when(F.coalesce("party", F.lit("")) != "", F.concat(F.lit(" ("), F.col("party"), F.lit(")"))).otherwise("")
    second = _finish(politicians, ident, F.array(F.coalesce("name", F.lit(""))), one(F.concat(F.lit("Politician"), party), F.lit("Political"), F.lit("")), F.substring(F.coalesce("dob", F.lit("")), 1, 10), F.concat(F.lit("Wikidata "), F.col("id")))
    names = F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.col("names")).otherwise(F.array(F.coalesce("name", F.lit(""))))
    detail = F.array_join(F.filter(F.array(F.coalesce("constituency", F.lit("")), F.coalesce("party", F.lit(""))), lambda x: x != ""), ", ")
    label = F.concat(F.lit("Member, "), F.coalesce("label", F.lit("assembly")), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))
    third = _finish(members, F.concat(F.lit("PEP-ASM-"), F.coalesce("assembly", F.lit("")), F.lit("-"), F.substring(F.regexp_replace(F.get(names, 0), r"\W+", ""), 1, 30)), names, one(label, F.coalesce("level", F.lit("")), F.coalesce("province", F.lit(""))), F.lit(""), F.coalesce("source", F.lit("")))
    keyed = [d.withColumn("_k", _name_key(F.col("primary_name"))).withColumn("_step", F.lit(i)) for i, d in enumerate((first, second, third))]
    every = keyed[0].unionByName(keyed[1]).unionByName(keyed[2])
    # People never drop each other; a later step drops names of earlier ones and repeats of its own.
    w = W.partitionBy("_k").orderBy("_step", "id")
    return every.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.min("_step").over(W.partitionBy("_k"))).filter("_step = 0 OR (_first = _step AND _n = 1)").drop("_k", "_step", "_n", "_first")
