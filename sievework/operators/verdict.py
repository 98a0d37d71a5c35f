"""Evidence beside a match, status of a source, and the verdict of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import known_province, normalize_cnic

# Sources in report order, and those that may be absent.
SOURCE_ORDER = ("UNSC", "OFAC", "UKSL", "FIA_REDBOOK", "NACTA", "PEP", "ADVERSE_MEDIA")
OPTIONAL_SOURCES = ("FIA_REDBOOK", "NACTA", "PEP")


def _given(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def dob_year_match(applicant_dob: Column, listed_dob: Column) -> Column:
    """Yes or No by the applicant's first four-digit year in the listed text; n/a where either is missing."""
    year = F.regexp_extract(F.coalesce(applicant_dob, F.lit("")), r"([0-9]{4})", 1)
    return F.when((year == "") | ~_given(listed_dob), "n/a").when(F.contains(listed_dob, year), "Yes").otherwise("No")


def cnic_match(a: Column, b: Column) -> Column:
    """Equality of normalised numbers; null where either is missing."""
    x, y = normalize_cnic(a), normalize_cnic(b)
    return F.when((x != "") & (y != ""), x == y)


def province_match(a: Column, b: Column) -> Column:
    x, y = known_province(a), known_province(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y)


def source_status(source: Column, skipped: Column, available: Column, matches: Column, partial: Column, articles: Column) -> Column:
    """SKIPPED, NOT_CONFIGURED, ERROR, REVIEW, HIT, PARTIAL or CLEAR, in this order of tests."""
    return (
        F.when(skipped, "SKIPPED")
        .when(~available, F.when(source.isin(*OPTIONAL_SOURCES), "NOT_CONFIGURED").otherwise("ERROR"))
        .when(matches > 0, F.when(source == "PEP", "REVIEW").otherwise("HIT"))
        .when(partial, "PARTIAL")
        .when(articles > 0, "REVIEW")
        .otherwise("CLEAR")
    )


def overall_verdict(statuses: DataFrame, case: list[str], fia_required: bool = True, nacta_required: bool = True, pep_required: bool = False) -> DataFrame:
    """One verdict a case from rows (case, source, status): one conditional aggregation, no ordering needed."""
    excused = F.lit(False)
    for name, needed in (("FIA_REDBOOK", fia_required), ("NACTA", nacta_required), ("PEP", pep_required)):
        if not needed:
            excused = excused | (F.col("source") == name)
    status = F.col("status")
    has = lambda cond: F.max(F.when(cond, 1).otherwise(0))
    flags = statuses.groupBy(*case).agg(
        has(status == "HIT").alias("_hit"), has(status == "REVIEW").alias("_review"), has(status != "SKIPPED").alias("_any"),
        has(status.isin("ERROR", "NOT_CONFIGURED", "PARTIAL") & ~excused).alias("_open"),
    )
    verdict = (
        F.when(F.col("_any") == 0, "MANUAL_REVIEW").when(F.col("_hit") == 1, "ESCALATE_TO_COMPLIANCE").when((F.col("_review") == 1) | (F.col("_open") == 1), "MANUAL_REVIEW").otherwise("AUTO_CLEAR")
    )
    return flags.select(*case, verdict.alias("verdict"))


def level_from_text(col: Column) -> Column:
    """Level named in free text: provincial is tested first, then national, then local."""
    t = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return (
        F.when(t.rlike(r"prov|state|region|assembly of (sindh|punjab|balochistan|khyber)"), "Provincial")
        .when(t.rlike(r"nat|fed|central|senate"), "National")
        .when(t.rlike(r"\blocal\b|municipal|metropolitan|\bdistrict\b|\bcity\b|\btown\b|union council"), "Local")
        .otherwise("")
    )


def adverse_word(text: Column) -> Column:
    """The first adverse word of a text, or null."""
    from sievework.lexicon import ADVERSE

    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(" + "|".join(ADVERSE) + r")\b", 1)
    return F.when(found != "", found)


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over the sorted rows of each group: fields joined by 0x1F, each row closed by 0x1E.

    The rows of one group are one text by definition; ``content_marks`` is the form for groups of any size.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("list", "id", "primary_name")]
    names = F.array_join(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))), "|")
    row = F.struct(*[f.alias(f"f{i}") for i, f in enumerate([*fields, names, F.coalesce("dob", F.lit("")), F.coalesce("cnic", F.lit(""))])])
    text = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: F.concat(F.concat_ws("\u001f", *[r[f"f{i}"] for i in range(6)]), F.lit("\u001e"))), "")
    return rows.withColumn("row", row).groupBy(*by).agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("records"))


def content_marks(rows: DataFrame, by: list[str]) -> DataFrame:
    """An order-free mark of the content of each group: count and two sums of row hashes, partially aggregated."""
    names = F.array_join("names", "|", "")
    cells = [F.coalesce(c, F.lit("")) for c in (F.col("list"), F.col("id"), F.col("primary_name"), names, F.col("dob"), F.col("cnic"))]
    h = F.xxhash64(*cells)
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("mark_a"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("mark_b"))


def chain_links(rows: DataFrame, key: str, payload: Column, slices: int = 64) -> DataFrame:
    """Each row's payload hash with that of the row before, in key order over the whole table, without one global sort task.

    Rows are range-cut by key; the first row of a slice takes the last hash of the slice before it.
    """
    from pyspark.sql import Window as W

    cut = rows.select(F.col(key).alias("k"), F.sha2(payload, 256).alias("row_hash"))
    width = cut.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    if width is None or width["lo"] is None:
        return cut.select(F.col("k").alias(key), F.lit("0" * 64).alias("prev_hash"), "row_hash")
    step = max(1, -(-(width["hi"] - width["lo"] + 1) // slices))
    sliced = cut.withColumn("s", F.floor((F.col("k") - width["lo"]) / step))
    last = sliced.groupBy("s").agg(F.max_by("row_hash", "k").alias("h"))
    before = last.select((F.col("s")).alias("s"), F.lag("h").over(W.orderBy("s")).alias("carried"))  # one row a slice
    prev = F.coalesce(F.lag("row_hash").over(W.partitionBy("s").orderBy("k")), F.col("carried"), F.lit("0" * 64))
    return sliced.join(before, "s").select(F.col("k").alias(key), prev.alias("prev_hash"), "row_hash")
