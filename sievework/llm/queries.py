"""Queries of the problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import linkage, lookalike, mixing, names, packing, parties, subjects, survivorship, tokens
from sievework.plans import problems
from sievework.session import reliable, table


def _births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth, in a checkpoint of their own: the plans that use them stay small."""
    return reliable(problems.birth_dates(spark, sf_dir))


def _identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = parties.nickname_pairs(table(spark, sf_dir, "name_forms"))
    return names.link_names(table(spark, sf_dir, "list_records"), table(spark, sf_dir, "applicants"), _births(spark, sf_dir), known)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions of one person or firm, at least one of them an applicant."""
    return names.cluster_pairs(*_identities(spark, sf_dir))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of every mention, with the number of its mentions."""
    from pyspark.sql import Window as W

    found, _ = _identities(spark, sf_dir)
    return found.select("key", "kind", "cluster", F.count("*").over(W.partitionBy("cluster")).alias("mentions"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of list records that are one party, each with its confidence and how it was found."""
    known = parties.nickname_pairs(table(spark, sf_dir, "name_forms"))
    return linkage.link_records(table(spark, sf_dir, "list_records"), _births(spark, sf_dir), known)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of list records of different lists that are one party."""
    return p3_links(spark, sf_dir).select("id_a", "id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match whose value survives, for each group and field."""
    found = survivorship.office_survivors(*(table(spark, sf_dir, t) for t in ("matches", "match_groups", "list_meta")))
    return found.select("group_id", "field_name", "match_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record for each group."""
    return survivorship.surviving_records(survivorship.office_survivors(*(table(spark, sf_dir, t) for t in ("matches", "match_groups", "list_meta"))))


def _name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, people = table(spark, sf_dir, "list_records"), table(spark, sf_dir, "applicants")
    return (
        lookalike.long_texts(records, "id", "names", "list_records.names")
        .unionByName(lookalike.long_texts(records, "id", "remarks", "list_records.remarks"))
        .unionByName(lookalike.long_texts(people, "id", "full_name", "applicants.full_name"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold imitating, invisible or uncommon forms of characters."""
    texts = _name_texts(spark, sf_dir)
    counts = lookalike.bigram_counts(texts, "text")
    return lookalike.consistent(texts, counts).filter("changed AND row_key IS NOT NULL").select("field_name", "row_key").distinct()


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    texts = _name_texts(spark, sf_dir)
    return lookalike.consistent(texts, lookalike.bigram_counts(texts, "text")).select("field_name", "row_key", "part", "clean_text", "changed").distinct()


def _sizes(spark: SparkSession, sf_dir: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of all documents, tokenized once into a checkpoint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.source_key(F.col("source")).alias("source"), "text")
    return reliable(tokens.token_counts(docs, vocabulary))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, and of every part of one that exceeds the capacity."""
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each container holds."""
    capacities = table(spark, sf_dir, "pack_capacities")
    return packing.fills(packing.pack(_sizes(spark, sf_dir), capacities), capacities)


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mix uses each document."""
    return mixing.uses(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source of a mix really gets."""
    return mixing.shares(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy in the order of training."""
    return mixing.training_order(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _subject_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each document really treats."""
    return _subject_areas(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and share of the corpus by subject."""
    return subjects.composition(_subject_areas(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found, "p3_links": p3_links, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_texts": p6_texts, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_uses": p8_uses, "p8_shares": p8_shares, "p8_order": p8_order, "p9_found": p9_found, "p9_composition": p9_composition}

_P5 = r"""
WITH m AS (
  SELECT g.group_id, m.match_id, m.checked_at, m.pep_level, m.position, m.province,
         CASE WHEN upper(trim(coalesce(l.status, 'OK'))) = 'OK' THEN 1 ELSE 0 END AS ok
  FROM match_groups g JOIN matches m USING (match_id) LEFT JOIN list_meta l ON l.list = m.list),
u AS (
  SELECT group_id, 'pep_level' AS field_name, match_id, checked_at, ok, pep_level AS v FROM m
  WHERE lower(trim(pep_level)) IN ('national', 'provincial', 'local')
  UNION ALL
  SELECT group_id, 'position', match_id, checked_at, ok, position FROM m
  WHERE lower(trim(position)) NOT IN ('', '-', '?', '??', 'n/a', 'unknown', 'tbc', 'see remarks', '(vacant)', 'not recorded', 'none stated')
    AND NOT regexp_matches(trim(position), '(\.\.|…)$')
  UNION ALL
  SELECT group_id, 'province', match_id, checked_at, ok, province FROM m
  WHERE trim(regexp_replace(lower(province), '[^a-z]+', ' ', 'g')) IN ('punjab', 'panjab', 'pb', 'sindh', 'sind', 'khyber pakhtunkhwa', 'kpk', 'kp', 'nwfp',
    'balochistan', 'baluchistan', 'islamabad capital territory', 'islamabad', 'ict', 'gilgit baltistan', 'gb', 'azad jammu and kashmir', 'azad kashmir', 'ajk')),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY ok DESC, checked_at DESC, match_id DESC) = 1)
"""
ORACLES = {
    "p5_found": _P5 + "SELECT group_id, field_name, match_id FROM best",
    "p5_records": _P5
    + """SELECT group_id, max(CASE WHEN field_name = 'pep_level' THEN v END) AS pep_level, max(CASE WHEN field_name = 'position' THEN v END) AS position,
  max(CASE WHEN field_name = 'province' THEN v END) AS province FROM best GROUP BY group_id""",
}
