"""Sanctions and office-holder lists: consolidated XML, designation XML, two-part CSV, uploads of any header, red-book text.

Each reader takes a DataFrame of whole texts (column ``text``) or parsed rows and returns
``RECORD`` columns. An empty or null text gives no records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import clean_cell, normalize_cnic, normalize_province
from sievework.operators.verdict import level_from_text
from sievework.sources.markup import RECORD, blocks, decode, first_tag, joined, tags

# Header keys (lower case, letters and digits only) that stand for each field of an upload.
HEADERS = {
    "name": ("name", "fullname", "personname", "nameofperson", "nameofaccused", "proscribedperson"),
    "father": ("father", "fathername", "fathersname", "fatherhusbandname", "parentage"),
    "cnic": ("cnic", "cnicno", "cnicnumber", "nic", "nationalid", "idcardno"),
    "province": ("province", "region", "state"),
    "district": ("district", "city", "domicile"),
    "serial": ("sr", "srno", "sno", "serial", "serialno", "id", "no"),
    "position": ("position", "designation", "office", "post", "title"),
    "level": ("level", "peplevel", "category"),
    "dob": ("dob", "dateofbirth", "birthdate"),
    "notes": ("notes", "remarks", "comments"),
}


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {c: F.lit("") for c in RECORD} | {"names": F.array().cast("array<string>")}
    return df.select(*[(columns.get(c, empty[c])).alias(c) for c in RECORD])


def read_whole(spark, path: str) -> DataFrame:
    """Files as whole texts, one row each."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def consolidated_xml(files: DataFrame, label: str = "UN consolidated list") -> DataFrame:
    """Individuals and entities; name parts joined, birth as date, else year, else a span of years."""
    out = []
    for kind in ("INDIVIDUAL", "ENTITY"):
        b = F.col("b")
        one = files.select(F.explode(blocks(F.col("text"), kind)).alias("b"))
        primary = decode(joined([first_tag(b, t) for t in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")]))
        births = F.transform(
            blocks(b, "INDIVIDUAL_DATE_OF_BIRTH"),
            lambda d: F.coalesce(F.nullif(first_tag(d, "DATE"), F.lit("")), F.nullif(first_tag(d, "YEAR"), F.lit("")), joined([first_tag(d, "FROM_YEAR"), first_tag(d, "TO_YEAR")], "-")),
        )
        nations = F.flatten(F.transform(blocks(b, "NATIONALITY"), lambda n: F.transform(tags(n, "VALUE"), decode)))
        ident = F.coalesce(F.nullif(first_tag(b, "REFERENCE_NUMBER"), F.lit("")), first_tag(b, "DATAID"))
        names = F.filter(F.concat(F.array(primary), F.transform(tags(b, "ALIAS_NAME"), decode)), lambda x: x != "")
        out.append(
            _record(
                one, list=F.lit(label), id=ident, primary_name=primary, type=F.lit(kind.capitalize()), programs=F.array_join(tags(b, "UN_LIST_TYPE"), ", "),
                dob=F.array_join(F.filter(births, lambda x: x != ""), "; "), nationality=F.array_join(nations, "; "), listed_on=first_tag(b, "LISTED_ON"),
                remarks=decode(first_tag(b, "COMMENTS1")), names=names, source_key=F.lit("unsc"),
            )
        )
    return out[0].unionByName(out[1])


def designation_xml(files: DataFrame, label: str = "UK consolidated list") -> DataFrame:
    """Designations; the primary name is the first marked so, else the first."""
    b = F.col("b")
    one = files.select(F.explode(blocks(F.col("text"), "Designation")).alias("b"))
    forms = F.filter(
        F.transform(
            blocks(b, "Name"),
            lambda n: F.struct(decode(joined([first_tag(n, f"Name{i}") for i in range(1, 7)])).alias("n"), first_tag(n, "NameType").rlike("(?i)primary name$").alias("p")),
        ),
        lambda x: x["n"] != "",
    )
    one = one.withColumn("forms", forms).filter("size(forms) > 0")
    primary = F.coalesce(F.get(F.filter("forms", lambda x: x["p"]), 0)["n"], F.get(F.col("forms"), 0)["n"])
    remarks = F.coalesce(F.nullif(first_tag(b, "UKStatementofReasons"), F.lit("")), first_tag(b, "OtherInformation"))
    return _record(
        one, list=F.lit(label), id=first_tag(b, "UniqueID"), primary_name=primary, type=first_tag(b, "IndividualEntityShip"), programs=decode(first_tag(b, "RegimeName")),
        dob=F.array_join(tags(b, "DOB"), "; "), nationality=F.array_join(F.transform(tags(b, "Nationality"), decode), "; "), listed_on=first_tag(b, "DateDesignated"),
        remarks=decode(remarks), names=F.transform("forms", lambda x: x["n"]), source_key=F.lit("uksl"),
    )


def _nul(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(s == "-0-", "").otherwise(s)


def _cut(text: Column, mark: str) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"{mark} [^;]+"), F.lit(0)), lambda x: F.replace(x, F.lit(f"{mark} "), F.lit(""))), "; ")


def two_part_csv(primary: DataFrame, aliases: DataFrame, label: str = "OFAC primary list") -> DataFrame:
    """Headerless rows (_c0 ..) and their aliases; birth dates and nationalities are read from the remarks."""
    also = (
        aliases.filter(_nul(F.col("_c3")) != "")
        .groupBy(F.col("_c0").alias("_k"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_c1").cast("long").alias("o"), _nul(F.col("_c3")).alias("n")))), lambda x: x["n"]).alias("also"))
    )
    rows = primary.filter(_nul(F.col("_c1")) != "").join(also, F.col("_c0") == F.col("_k"), "left")
    name, kind, remarks = _nul(F.col("_c1")), _nul(F.col("_c2")), _nul(F.col("_c11"))
    return _record(
        rows, list=F.lit(label), id=F.concat(F.lit("OFAC-"), F.col("_c0")), primary_name=name, type=F.when(kind == "", "Entity").otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.expr("substring(regexp_replace(trim(_c2), '^-0-$', ''), 2)"))),
        programs=_nul(F.col("_c3")), dob=_cut(remarks, "DOB"), nationality=_cut(remarks, "nationality"), remarks=remarks,
        names=F.concat(F.array(name), F.coalesce("also", F.array().cast("array<string>"))), source_key=F.lit("ofac"),
    )


def read_two_part_csv(spark, primary: str, aliases: str, label: str = "OFAC primary list") -> DataFrame:
    """The two headerless files; quotes are doubled inside quotes."""
    read = lambda path, n: spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', schema=", ".join(f"_c{i} string" for i in range(n)))
    return two_part_csv(read(primary, 12), read(aliases, 5), label)


def header_fields(row: Column, field: str) -> Column:
    """First non-empty value of a map row (header -> cell) under any key that stands for the field, in the order of the header."""
    keyed = F.filter(F.map_entries(row), lambda e: F.regexp_replace(F.lower(e["key"]), r"[^a-z0-9]", "").isin(*HEADERS[field]) & (clean_cell(e["value"]) != ""))
    found = clean_cell(F.get(keyed, 0)["value"])
    if field != "name":
        return F.coalesce(found, F.lit(""))
    loose = F.filter(F.map_entries(row), lambda e: F.lower(e["key"]).contains("name") & ~F.lower(e["key"]).rlike("father|husband|mother|guardian|wife") & (clean_cell(e["value"]) != ""))
    return F.coalesce(found, clean_cell(F.get(loose, 0)["value"]), F.lit(""))


def upload_rows(rows: DataFrame, label: str, source_key: str, pep: bool = False) -> DataFrame:
    """Records of an upload with any header: rows (row_no, cells map<string,string>). Rows without a name are left out."""
    get = {f: header_fields(F.col("cells"), f) for f in HEADERS}
    named = rows.withColumn("_name", get["name"]).filter("_name <> ''")
    parts = F.filter(F.transform(F.split("_name", r"(?i)\s*(?:\balias\b|\baka\b|\ba\.k\.a\.?|@" + (r"|\|" if pep else "") + r")\s*"), F.trim), lambda x: x != "")
    cnic = normalize_cnic(get["cnic"])
    ident = F.concat(F.lit("PEP-" if pep else "NACTA-"), F.coalesce(F.nullif(get["serial"], F.lit("")), F.col("row_no").cast("string")))
    notes = joined([F.when(v != "", F.concat(F.lit(f"{n}: "), v)).otherwise("") for n, v in (("Father/Husband", get["father"]), ("District", get["district"]), ("Notes", get["notes"]))], "; ")
    level = F.coalesce(F.nullif(level_from_text(get["level"]), F.lit("")), level_from_text(get["position"]))
    return _record(
        named, list=F.lit(label), id=ident, primary_name=F.get(parts, 0), type=F.lit("Individual"), dob=get["dob"], remarks=notes, names=F.array_distinct(parts), source_key=F.lit(source_key),
        cnic=cnic, father=get["father"], province=normalize_province(get["province"]), pep_level=level if pep else F.lit(""), position=get["position"] if pep else F.lit(""),
    )


def read_upload(spark, path: str, sample: str | None = None) -> DataFrame:
    """(row_no, cells) of a CSV, JSON or XML upload; the form is read off its first characters."""
    head = sample if sample is not None else (spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4096)).first() or [""])[0]
    start = head.lstrip("﻿ \r\n\t")[:1]
    if start in ("[", "{"):
        frame = spark.read.json(path, multiLine=True)
        nested = [f.name for f in frame.schema if f.dataType.simpleString().startswith("array<struct")]
        frame = frame.select(F.inline(nested[0])) if nested else frame
    elif start == "<":
        if "<!ENTITY" in head or "<!DOCTYPE" in head:
            raise ValueError("entity declarations are refused")
        import re

        names = re.findall(r"<([A-Za-z_][\w.-]*)[\s>]", head)
        tag = next((n for n in names if names.count(n) > 1), names[-1])
        frame = spark.read.format("xml").option("rowTag", tag).load(path)
    else:
        first = head.splitlines()[0] if head else ""
        frame = spark.read.csv(path, header=True, sep=max(",;\t|", key=first.count), multiLine=True, escape='"')
    cells = [x for c in frame.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return frame.select((F.monotonically_increasing_id() + 1).alias("row_no"), F.create_map(*cells).alias("cells"))


def red_book(texts: DataFrame, label: str = "FIA Red Book") -> DataFrame:
    """Accused persons in the text of a book (title, text): blocks that begin with the marker, with the last zone and FIR before each."""
    mark = "Name of Accused"
    pieces = texts.select("title", F.posexplode(F.split("text", mark)).alias("n", "piece"), F.split("text", mark).alias("all"))
    rows = pieces.filter("n > 0").withColumn("block", F.substring("piece", 1, 1500)).withColumn("ahead", F.substring(F.element_at("all", F.col("n")), -700, 700))
    take = lambda pattern, c="block": F.trim(F.regexp_extract(F.col(c), pattern, 1))
    raw = F.trim(F.regexp_replace(take(r"^\s*:?\s*([^\n]+)"), r"\s+", " "))
    names = F.filter(F.transform(F.split(raw, r"(?i)\s*(?:\balias\b|\baka\b|@)\s*"), F.trim), lambda x: x != "")
    last = lambda pattern: F.coalesce(F.element_at(F.nullif(F.regexp_extract_all("ahead", F.lit(pattern), F.lit(1)), F.array().cast("array<string>")), -1), F.lit(""))
    rows = rows.withColumn("names", names).filter((F.size("names") > 0) & (F.length(raw) <= 120))
    printed = take(r"(?i)CNIC[^0-9]{0,20}([0-9]{5}-?[0-9]{7}-?[0-9])")
    ident = F.concat(F.lit("FIA-RB-"), F.coalesce(F.nullif(printed, F.lit("")), F.col("n").cast("string")))
    remarks = joined([F.when(z != "", F.concat(F.lit(f"{n}: "), z)).otherwise("") for n, z in (("Zone", last(r"(?i)ZONE\s*:?\s*([^\n]+?)\s*(?:\bFIR\b|\n|$)")), ("FIR", last(r"(?i)FIR[^0-9\n]{0,12}([0-9]+/[0-9]{2,4})")))], "; ")
    return _record(
        rows, list=F.lit(label), id=ident, primary_name=F.get(F.col("names"), 0), type=F.lit("Individual"), programs=F.col("title"), dob=take(r"(?i)(?:DOB|Date of Birth)\s*:?\s*([^\n]+)"),
        remarks=remarks, names=F.col("names"), source_key=F.lit("fia"), cnic=normalize_cnic(printed), father=take(r"(?i)(?:S/O|Father'?s? Name)\s*:?\s*([^\n]+)"),
    )


def news_items(feeds: DataFrame) -> DataFrame:
    """(applicant_id, title, description, link, published, source) of feeds (applicant_id, text)."""
    b = F.col("b")
    rows = feeds.select("applicant_id", F.explode(blocks(F.col("text"), "item")).alias("b"))
    description = F.trim(F.regexp_replace(F.regexp_replace(decode(decode(first_tag(b, "description"))), r"<[^>]+>", " "), r"\s+", " "))
    source = decode(F.regexp_extract(b, r"<source[^>]*>([\s\S]*?)</source>", 1))
    return rows.select("applicant_id", decode(first_tag(b, "title")).alias("title"), description.alias("description"), decode(first_tag(b, "link")).alias("link"), first_tag(b, "pubDate").alias("published"), source.alias("source"))


def merge_first(parts: list[DataFrame], key: Column) -> DataFrame:
    """Records of several sources, the earlier source first: of records with one key the first source's is kept."""
    from pyspark.sql import Window as W

    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]).withColumn("_key", key)
    order = W.partitionBy("_key").orderBy("_source", "id")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_source", "_key")
