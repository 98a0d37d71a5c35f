"""Persons behind several matches of one applicant: greedy complete-link groups.

A match joins the first group of which it agrees with every member, taken by
falling score; this depends on the order, so each applicant's matches (at most
``most``, the report's own limit) are grouped in one Arrow batch.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.scalars import first_year, known_province
from sievework.operators.matching import score

NAME_AGREES = 90.0


def _names(m) -> list[str]:
    return [n for n in dict.fromkeys([m.primary_name, m.matched_name, *(m.aliases if m.aliases is not None else [])]) if n]


def _agree(a, b) -> bool:
    pairs = ((a.cnic or "", b.cnic or ""), (a.province or "", b.province or ""), (a.year or "", b.year or ""))
    if any(x and y and x != y for x, y in pairs) or not any(x and y for x, y in pairs):
        return False
    for x in _names(a):
        for y in _names(b):
            s, kind = score(text.tokens_text(x), text.tokens_text(y))
            if kind in ("exact", "close") and s >= NAME_AGREES:
                return True
    return False


def person_groups(matches: DataFrame, applicant: str = "applicant_id", most: int = 50) -> DataFrame:
    """(applicant, match_id, person_no, is_lead) of the best ``most`` office-holder matches of each applicant.

    ``matches``: applicant, match_id, score, primary_name, matched_name, aliases, cnic, province, dob.
    """
    from pyspark.sql import Window as W

    rank = W.partitionBy(applicant).orderBy(F.col("score").desc(), (F.coalesce("dob", F.lit("")) == "").cast("int"), "match_id")
    kept = matches.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        out = []
        for m in pdf.sort_values("place").itertuples(index=False):
            at = next((i for i, g in enumerate(groups) if all(_agree(m, x) for x in g)), len(groups))
            if at == len(groups):
                groups.append([])
            groups[at].append(m)
            out.append((m.applicant, m.match_id, at + 1, len(groups[at]) == 1))
        return pd.DataFrame(out, columns=["applicant", "match_id", "person_no", "is_lead"])

    narrow = kept.select(
        F.col(applicant).alias("applicant"), "match_id", "primary_name", "matched_name", "aliases", F.coalesce("cnic", F.lit("")).alias("cnic"),
        F.coalesce(known_province(F.col("province")), F.lit("")).alias("province"), F.coalesce(first_year(F.col("dob")), F.lit("")).alias("year"), F.col("_n").alias("place"),
    )
    grouped = narrow.groupBy("applicant").applyInPandas(lambda pdf: run(pdf), "applicant bigint, match_id bigint, person_no int, is_lead boolean")
    return grouped.withColumnRenamed("applicant", applicant)
