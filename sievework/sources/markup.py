"""Elements, tags and entities of feed text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = ("list", "id", "primary_name", "type", "programs", "dob", "nationality", "listed_on", "remarks", "names", "source_key", "cnic", "father", "province", "pep_level", "position")


def blocks(text: Column, name: str) -> Column:
    """Inner content of every <name>...</name>."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"<{name}>([\\s\\S]*?)</{name}>"), F.lit(1))


def plain(text: Column) -> Column:
    """Tags taken out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def tags(text: Column, name: str) -> Column:
    """Texts of every <name>...</name>, blank ones left out."""
    return F.filter(F.transform(blocks(text, name), plain), lambda t: t != "")


def first_tag(text: Column, name: str) -> Column:
    return F.coalesce(F.get(tags(text, name), 0), F.lit(""))


def decode(text: Column) -> Column:
    """Five entities, the ampersand first."""
    out = text
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined(parts: list[Column], sep: str = " ") -> Column:
    """Non-empty texts joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)
