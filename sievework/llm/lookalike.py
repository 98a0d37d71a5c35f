"""Visually identical text with different characters (problem 6).

1. Compatibility normalization (NFKC) turns full-width, mathematical and
   ligature forms into ordinary letters and composes accents; ignorable
   characters are deleted, all blanks become a space.
2. Every token is a lattice: each character with its look-alikes in other
   scripts. Viterbi finds the best path under character bigram scores of one
   script at a time, a cost for each replaced character and a high cost for
   changing script inside a token, or from the script of the whole text.
   The bigram counts come from all tokens of the texts that are wholly in one
   script; their number is bounded by the alphabets.

Cases. Null stays null, '' stays ''. Plain ASCII never leaves the JVM. Single
accented letters, words wholly in another script and ordinary blanks are left
alone and not reported. Null elements of arrays are kept. Texts are processed
whole, whatever their length; a token longer than any word is a longer lattice.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sets of letters that look alike (Latin first, then Cyrillic, Greek and others).
LOOKALIKES = (
    "aаα", "bЬ", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iіι", "jјϳ", "kкκ", "lӏ", "mм", "nո", "oоοօ", "pрρ", "qԛ", "rг", "sѕ", "tтτ", "uυս", "vѵν", "wԝ", "xхχ", "yуγ",
    "AАΑ", "BВΒ", "CСϹ", "DԀ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "VѴ", "WԜ", "XХΧ", "YУΥҮ", "ZΖ",
    "éё", "ïї", "ıі",
)
# Hyphens that are not the ordinary one.
HYPHENS = "‐‑‒﹣－⁃"
PLAIN = r"^[\x20-\x7E\t\r\n]*$"
EDIT_COST, SWITCH_COST, CONTEXT_COST, SMOOTH = 1.0, 8.0, 16.0, 0.5
_SCRIPTS = ("Latin", "Cyrillic", "Greek")


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """Latin, Cyrillic, Greek, another script's first name word, or '' for what is no letter."""
    if unicodedata.category(ch)[0] != "L":
        return ""
    word = unicodedata.name(ch, "?").split(" ")[0]
    return {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek"}.get(word, word)


@lru_cache(maxsize=65536)
def ignorable(ch: str) -> bool:
    """Characters that show nothing: format and control characters, joiners, fillers, variation selectors."""
    code = ord(ch)
    if unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\r\n":
        return True
    return code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= code <= 0x180F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF


ALIKE: dict[str, tuple[str, ...]] = {}
for _set in LOOKALIKES:
    for _c in _set:
        ALIKE[_c] = tuple(dict.fromkeys((*ALIKE.get(_c, ()), *(x for x in _set if x != _c))))


def strip_forms(text: str) -> str:
    """Compatibility normalization, ignorable characters deleted, blanks and hyphens made ordinary."""
    kept = "".join(c for c in text if not ignorable(c))
    kept = unicodedata.normalize("NFKC", kept)
    kept = "".join(c for c in kept if not ignorable(c))
    return "".join(" " if unicodedata.category(c) == "Zs" else "-" if c in HYPHENS else c for c in kept)


class Restorer:
    """Viterbi search over look-alike lattices with bigram counts {(script, a, b): n}."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        totals: dict[tuple[str, str], float] = {}
        size: dict[str, set[str]] = {}
        for (script, a, b), n in counts.items():
            totals[script, a] = totals.get((script, a), 0.0) + n
            size.setdefault(script, set()).add(b)
        self.counts, self.totals, self.size = counts, totals, {k: len(v) + 1 for k, v in size.items()}
        self.token = lru_cache(maxsize=200_000)(self._token)

    def score(self, script: str, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        return math.log((self.counts.get((script, a, b), 0) + SMOOTH) / (self.totals.get((script, a), 0.0) + SMOOTH * self.size.get(script, 30)))

    def _token(self, token: str, context: str) -> str:
        """The token spelled in the letters that it most likely means."""
        if not any(c in ALIKE for c in token) or all(ord(c) < 128 for c in token) and context in ("", "Latin"):
            return token
        scripts = {script_of(c) for c in token} - {""}
        if len(scripts) == 1 and (context in ("", *scripts) or any(c not in ALIKE for c in token if script_of(c))):
            return token
        paths: dict[tuple[str, str], tuple[float, str]] = {("", "^"): (0.0, "")}
        for ch in token:
            options = (ch, *ALIKE.get(ch, ()))
            new: dict[tuple[str, str], tuple[float, str]] = {}
            for c in options:
                s = script_of(c)
                cost = EDIT_COST if c != ch else 0.0
                for (before, last), (total, text) in paths.items():
                    if not s:
                        step, state = 0.0, (before, "^")
                    elif before and before != s:
                        step, state = -SWITCH_COST + self.score(s, "^", c), (s, c)
                    else:
                        step, state = self.score(s, last, c), (s, c)
                        if not before and context and s != context:
                            step -= CONTEXT_COST
                    value = total + step - cost
                    if state not in new or value > new[state][0]:
                        new[state] = (value, text + c)
            paths = new
        return max(paths.values())[1]

    def text(self, raw: str) -> str:
        """The whole text in its consistent form."""
        flat = strip_forms(raw)
        if all(ord(c) < 128 for c in flat):
            return flat
        words, word = [], ""
        for c in flat:
            if script_of(c) or unicodedata.category(c)[0] == "M":
                word += c
            else:
                words += [word, c] if word else [c]
                word = ""
        words += [word] if word else []
        weight: dict[str, int] = {}
        for w in words:
            for c in w:
                if s := script_of(c):
                    weight[s] = weight.get(s, 0) + (1 if c in ALIKE and s != "Latin" else 3)
        context = max(weight, key=lambda k: (weight[k], k), default="")
        return "".join(self.token(w, context) if len(w) > 1 or script_of(w) else w for w in words)


def bigram_counts(texts: DataFrame, text: str) -> dict[tuple[str, str, str], int]:
    """Bigrams of all tokens wholly in one of the three scripts, counted over all texts.

    Aggregated before anything reaches the driver; the result has at most one entry for a
    pair of letters of one alphabet (some tens of thousands), however many texts there are.
    """
    words = texts.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    script = F.lit(None).cast("string")
    for name, block in (("Latin", r"^[a-zß-ɏ]+$"), ("Greek", r"^[Ͱ-Ͽ]+$"), ("Cyrillic", r"^[Ѐ-ԯ]+$")):
        script = F.when(F.col("w").rlike(block), name).otherwise(script)
    words = words.groupBy("w").count().withColumn("script", script).filter("script IS NOT NULL")
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    pairs = words.select("script", "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: padded.substr(i, F.lit(2)))).alias("p"))
    rows = pairs.groupBy("script", "p").agg(F.sum("count").alias("n")).collect()
    return {(r["script"], r["p"][0], r["p"][1]): r["n"] for r in rows}


def long_texts(df: DataFrame, key: str, field: str, field_name: str) -> DataFrame:
    """(field_name, row_key, part, text): one row for each text of the field; arrays give one for each element."""
    if dict(df.dtypes)[field].startswith("array"):
        return df.select(F.lit(field_name).alias("field_name"), F.col(key).cast("string").alias("row_key"), F.posexplode(field).alias("part", "text"))
    return df.select(F.lit(field_name).alias("field_name"), F.col(key).cast("string").alias("row_key"), F.lit(0).alias("part"), F.col(field).cast("string").alias("text"))


def consistent(texts: DataFrame, counts: dict[tuple[str, str, str], int]) -> DataFrame:
    """Adds clean_text and changed to rows of (field_name, row_key, part, text)."""
    plain = texts.filter(F.col("text").isNull() | F.col("text").rlike(PLAIN)).select("*", F.col("text").alias("clean_text"), F.lit(False).alias("changed"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(counts)
        for pdf in batches:
            pdf["clean_text"] = [restorer.text(t) for t in pdf["text"]]
            pdf["changed"] = pdf["clean_text"] != pdf["text"]
            yield pdf

    other = texts.filter(F.col("text").isNotNull() & ~F.col("text").rlike(PLAIN))
    schema = "field_name string, row_key string, part int, text string, clean_text string, changed boolean"
    return plain.unionByName(other.mapInPandas(restore, schema))


