"""Scalar functions on identifiers, provinces, levels and cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical provinces and the spellings that stand for each.
PROVINCES = {
    "Punjab": ("punjab", "panjab", "pb"),
    "Sindh": ("sindh", "sind"),
    "Khyber Pakhtunkhwa": ("khyber pakhtunkhwa", "khyber pakhtoonkhwa", "kpk", "kp", "nwfp", "n w f p", "north west frontier province"),
    "Balochistan": ("balochistan", "baluchistan"),
    "Islamabad Capital Territory": ("islamabad capital territory", "islamabad", "ict", "federal capital", "capital territory"),
    "Gilgit-Baltistan": ("gilgit baltistan", "gb", "gilgit", "northern areas"),
    "Azad Jammu and Kashmir": ("azad jammu and kashmir", "azad jammu kashmir", "azad kashmir", "ajk", "aj k", "a j k"),
}
# Cells that state nothing.
PLACEHOLDERS = ("", "-", "--", "?", "??", "n/a", "na", "nil", "none", "null", "unknown", "not known", "not recorded", "none stated", "not stated", "not available", "tbc", "tba", "see remarks", "(vacant)", "vacant")


def clean_cell(col: Column) -> Column:
    """White space collapsed; null and cells that state nothing become ''."""
    s = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s\h]+", " "))
    return F.when(F.lower(s).isin(*PLACEHOLDERS), "").otherwise(s)


def known_province(col: Column) -> Column:
    """The canonical province that a cell states in whatever spelling, else null."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z]+", " "))
    pairs = [F.lit(x) for name, forms in PROVINCES.items() for form in forms for x in (form, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_province(col: Column) -> Column:
    """Canonical province; '' for placeholders; other values tidied, each word (letters after a non-letter) capitalised."""
    s = clean_cell(col)
    titled = F.aggregate(
        F.split(F.lower(s), ""),
        F.lit(""),
        lambda acc, c: F.concat(acc, F.when(acc.rlike(r"\p{L}$"), c).otherwise(F.upper(c))),
    )
    return F.when(s == "", "").otherwise(F.coalesce(known_province(s), titled))


def normalize_cnic(col: Column) -> Column:
    """The 13 digits of a national identity number; '' unless there are 13 with more than two different ones."""
    digits = F.regexp_replace(F.coalesce(col, F.lit("")), r"[^0-9]", "")
    return F.when((F.length(digits) == 13) & (F.size(F.array_distinct(F.split(digits, ""))) > 2), digits).otherwise("")


def known_level(col: Column) -> Column:
    """National, Provincial or Local where a cell states a level in whatever spelling, else null."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z]+", " "))
    key = F.regexp_replace(key, r" level$", "")
    return F.when(key.isin("national", "federal"), "National").when(key.isin("provincial", "province"), "Provincial").when(key.isin("local", "municipal", "district"), "Local")


def header_key(col: Column) -> Column:
    """Header text to its lookup key: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]", "")


def first_year(col: Column) -> Column:
    """First run of four digits, or null."""
    y = F.regexp_extract(F.coalesce(col, F.lit("")), r"([0-9]{4})", 1)
    return F.when(y != "", y)


def resolve_threshold(col: Column, default: float = 85.0, low: float = 50.0, high: float = 100.0) -> Column:
    """Digits and dots of a typed threshold; blank, unreadable, zero or out of range gives the default."""
    value = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[^0-9.]", "").try_cast("double")
    return F.when((value >= low) & (value <= high), value).otherwise(F.lit(default))


def case_ref(created: Column, ident: Column) -> Column:
    """CS-YYYYMMDD- and the id in at least five digits."""
    return F.concat(F.lit("CS-"), F.date_format(created, "yyyyMMdd"), F.lit("-"), F.format_string("%05d", ident))


def csv_guard(col: Column) -> Column:
    """A leading quote before text that a spreadsheet would run as a formula."""
    return F.when(F.substring(col, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), col)).otherwise(col)


def control_free(col: Column) -> Column:
    """Control characters removed, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
