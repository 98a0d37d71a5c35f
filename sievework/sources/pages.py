"""Member rosters on web pages: tables with spans, cards, name-and-seat pairs, profiles, and links to editions."""

from html.parser import HTMLParser
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.sources.markup import decode, plain

SEAT = r"(?:NA|PP|PK|PB|PS|PF|LA|GBA|W|NM)-?\s?[0-9]{1,3}"
VACANT = r"(?i)\b(vacant|vacancy|seat is empty)\b"


class _Marks(HTMLParser):
    """The marks and visible texts of a page in order: (tag, True or False for its end, attributes) and (None, text, None)."""

    SILENT = ("script", "style", "sup")

    def __init__(self) -> None:
        super().__init__()
        self.seen: list[tuple] = []
        self._silent = 0

    def handle_starttag(self, tag, attrs):
        self._silent += tag in self.SILENT
        self.seen.append((None, " ", None) if tag == "br" else (tag, True, dict(attrs)))

    def handle_endtag(self, tag):
        self._silent = max(0, self._silent - (tag in self.SILENT))
        self.seen.append((tag, False, None))

    def handle_data(self, data):
        if not self._silent:
            self.seen.append((None, data, None))


def _span(attrs: dict, name: str) -> int:
    said = attrs.get(name) or ""
    return min(60, int(said)) if said.isdigit() and int(said) else 1


def _grid(cells: list[tuple[int, int, int, str]]) -> list[list[str]]:
    """Rows of text of cells (row, width, height, text) in order: each takes the first free place of its row and all that it spans."""
    taken: dict[tuple[int, int], str] = {}
    rows = 1 + max((r for r, *_ in cells), default=-1)
    for row, wide, high, text in cells:
        at = next(c for c in count() if (row, c) not in taken)
        taken.update({(r, c): text for r in range(row, min(row + high, rows)) for c in range(at, at + wide)})
    width = [max((c for r, c in taken if r == row), default=-1) + 1 for row in range(rows)]
    return [[taken.get((row, c), "") for c in range(width[row])] for row in range(rows)]


def table_rows(html: str) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page, spans expanded; a table inside a cell is a table of its own. Breaks part words; raised notes and scripts are no text."""
    marks = _Marks()
    marks.feed(html or "")
    done, inside = [], []  # a table in work: its cells, its row number, and the open cell as [width, height, texts]
    for tag, what, attrs in [*marks.seen, *[("table", False, None)] * len(marks.seen)]:
        if tag == "table" and what:
            inside.append({"cells": [], "row": -1, "open": None})
        if not inside:
            continue
        table = inside[-1]
        if tag is None:
            if table["open"]:
                table["open"][2].append(what)
            continue
        if tag in ("td", "th", "tr", "table") and table["open"] and not (tag == "table" and what):
            wide, high, texts = table["open"]
            table["cells"].append((table["row"], wide, high, " ".join("".join(texts).split())))
            table["open"] = None
        if tag == "tr" and what:
            table["row"] += 1
        elif tag in ("td", "th") and what and table["row"] >= 0:
            table["open"] = [_span(attrs, "colspan"), _span(attrs, "rowspan"), []]
        elif tag == "table" and not what:
            done.append(_grid(inside.pop()["cells"]))
    return [(i, j, row) for i, table in enumerate(done) for j, row in enumerate(table) if row]


def html_tables(pages: DataFrame) -> DataFrame:
    """(url, table_no, row_no, cells) of pages (url, text), one Arrow batch of pages at a time."""

    def run(batches):
        for pdf in batches:
            out = [(u, i, j, cells) for u, t in zip(pdf["url"], pdf["text"]) for i, j, cells in table_rows(t)]
            yield pd.DataFrame(out, columns=["url", "table_no", "row_no", "cells"])

    return pages.select("url", "text").mapInPandas(run, "url string, table_no int, row_no int, cells array<string>")


def table_members(pages: DataFrame) -> DataFrame:
    """(url, name, seat, party) of tables whose first rows have a name heading; vacancies out, one row a name."""
    rows = html_tables(pages)
    heads = rows.filter("row_no < 4").withColumn("name_at", F.array_position(F.transform("cells", lambda c: c.rlike(r"(?i)^(name|name of member|member)s?$")), True))
    head = heads.filter("name_at > 0").groupBy("url", "table_no").agg(F.min(F.struct("row_no", "name_at", "cells")).alias("h"))
    find = lambda pattern: F.array_position(F.transform("h.cells", lambda c: c.rlike(pattern)), True)
    cells = rows.join(head, ["url", "table_no"]).filter(F.col("row_no") > F.col("h.row_no"))
    pick = lambda at: F.coalesce(F.get(F.col("cells"), at.cast("int") - 1), F.lit(""))
    found = cells.select("url", "table_no", "row_no", member_name(pick(F.col("h.name_at"))).alias("name"), pick(find(r"(?i)constituency|seat|halqa")).alias("seat"), pick(find(r"(?i)party")).alias("party"))
    order = W.partitionBy("url", F.lower("name")).orderBy("table_no", "row_no")
    return found.filter("name IS NOT NULL").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "table_no", "row_no")


def member_name(cell: Column) -> Column:
    """A member's name without reference marks and brackets; null for vacancies and texts that are no name."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"\[[^\]]*\]", " "), r"\([^)]*\)", " "), r"[*†‡\s]+", " "))
    digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
    return F.when(~s.rlike(VACANT) & F.length(s).between(4, 80) & (digits <= 2), s)


def text_nodes(pages: DataFrame) -> DataFrame:
    """(url, pos, node): the visible texts of pages in order."""
    nodes = F.filter(F.transform(F.split(F.regexp_replace("text", r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"<[^>]*>"), lambda t: F.trim(F.regexp_replace(decode(t), r"[\s\h]+", " "))), lambda t: t != "")
    return pages.select("url", F.posexplode(nodes).alias("pos", "node"))


def seat_pairs(pages: DataFrame) -> DataFrame:
    """(url, name, seat): a text node followed by a seat; the name ends at a bar."""
    w = W.partitionBy("url").orderBy("pos")
    rows = text_nodes(pages).withColumn("before", F.lag("node").over(w)).filter(F.col("node").rlike("^" + SEAT))
    name = member_name(F.trim(F.get(F.split("before", r" \| "), 0)))
    return rows.select("url", name.alias("name"), F.regexp_extract("node", "^" + SEAT, 0).alias("seat")).filter("name IS NOT NULL").dropDuplicates(["url", "name", "seat"])


def links(pages: DataFrame) -> DataFrame:
    """(url, pos, href, label) of anchors."""
    anchors = F.regexp_extract_all("text", F.lit(r"(?is)<a\s[^>]*href=\"[^\"]+\"[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("url", F.posexplode(anchors).alias("pos", "a"))
    return rows.select("url", "pos", decode(F.regexp_extract("a", r"(?i)href=\"([^\"]+)\"", 1)).alias("href"), decode(plain(F.col("a"))).alias("label"))


def card_members(pages: DataFrame) -> DataFrame:
    """(url, name, seat) of member links that read name, seat, place."""
    rows = links(pages).filter(F.col("href").contains("/members/") & F.col("label").rlike(SEAT))
    return rows.select("url", member_name(F.trim(F.regexp_extract("label", r"^(.*?)\s+" + SEAT, 1))).alias("name"), F.regexp_extract("label", SEAT, 0).alias("seat")).filter("name IS NOT NULL").distinct()


def editions(pages: DataFrame, host: str) -> DataFrame:
    """(url, title) of linked PDF editions, made absolute on one https host; foreign hosts are dropped, the first of a URL is kept."""
    rows = links(pages).filter(F.lower("label").contains("red book") & F.col("href").rlike(r"(?i)\.pdf$"))
    path = F.regexp_replace("href", r"(?i)^https?://(?:[^/@]*@)?[^/]+", "")
    own = ~F.col("href").rlike(r"(?i)^https?://") | F.col("href").rlike(rf"(?i)^https?://(?:www\.)?{host}/")
    full = rows.filter(own).select("pos", F.concat(F.lit(f"https://{host}/"), F.regexp_replace(path, r"^/+", "")).alias("url"), F.col("label").alias("title"))
    return full.groupBy("url").agg(F.min_by("title", "pos").alias("title"))


def complete(counts: DataFrame, least: float = 0.98) -> DataFrame:
    """(key, read, announced, ok) for rows (key, read, text): whether enough of the announced total was read."""
    total = F.regexp_extract("text", r"(?i)Showing\s+[0-9]+\s*(?:-|to)\s*[0-9]+\s+of\s+([0-9]+)", 1)
    n = F.when(total != "", total.cast("int"))
    return counts.select("key", "read", n.alias("announced"), (n.isNull() | (F.col("read") >= least * n)).alias("ok"))
