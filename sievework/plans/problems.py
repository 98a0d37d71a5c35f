"""Queries of the general problems: snapshot changes and time normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import snapshots, timestamps
from sievework.session import small, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids added, removed or changed since the last snapshot that loaded."""
    changes = snapshots.snapshot_changes(table(spark, sf_dir, "list_snapshots"), table(spark, sf_dir, "group_snapshots"))
    return changes.select("source_key", "snapshot_no", "id", "change_type")


def p2_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ids by source, snapshot and field."""
    changes = snapshots.snapshot_changes(table(spark, sf_dir, "list_snapshots"), table(spark, sf_dir, "group_snapshots"))
    return snapshots.field_change_counts(changes)


def _list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list, order): how a list writes numeric dates, by its note."""
    note = F.lower(F.coalesce(F.col("note"), F.lit("")))
    order = F.when(note.contains("month first"), "month first").when(note.contains("day first"), "day first")
    return table(spark, sf_dir, "list_meta").groupBy(F.col("list").alias("_list")).agg(F.max(order).alias("date_order"))


def _user_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, date_order): how a user types numeric dates; the latest preferences hold."""
    prefs = table(spark, sf_dir, "user_preferences")
    return prefs.groupBy(F.col("user_id").alias("_user")).agg(F.max_by(F.get_json_object("prefs", "$.display.date_order"), "updated_at").alias("date_order"))


def standard_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of the four text fields of problem 4, with the basis of its zone."""
    lists = table(spark, sf_dir, "list_records").join(small(_list_order(spark, sf_dir)), F.col("list") == F.col("_list"), "left")
    people = table(spark, sf_dir, "applicants").join(small(_user_order(spark, sf_dir)), F.col("user_id") == F.col("_user"), "left")
    outlets = table(spark, sf_dir, "outlets").groupBy(F.col("source").alias("_source")).agg(F.max("home_zone").alias("home_zone"))
    news = table(spark, sf_dir, "articles").join(small(outlets), F.col("source") == F.col("_source"), "left")
    order = F.col("date_order")
    parts = [
        timestamps.field_texts(lists, "id", "dob", "list_records.dob", order, True),
        timestamps.field_texts(lists, "id", "listed_on", "list_records.listed_on", order, False),
        timestamps.field_texts(people, "id", "dob", "applicants.dob", order, True),
        timestamps.field_texts(news, "article_id", "published", "articles.published", F.lit(None), False, F.col("home_zone")),
    ]
    return timestamps.standardise(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of birth among the standard times: (field_name, row_key, std_value)."""
    lists = table(spark, sf_dir, "list_records").join(small(_list_order(spark, sf_dir)), F.col("list") == F.col("_list"), "left")
    people = table(spark, sf_dir, "applicants").join(small(_user_order(spark, sf_dir)), F.col("user_id") == F.col("_user"), "left")
    texts = timestamps.field_texts(lists, "id", "dob", "list_records.dob", F.col("date_order"), True).unionByName(
        timestamps.field_texts(people, "id", "dob", "applicants.dob", F.col("date_order"), True)
    )
    return timestamps.standardise(texts, clocks=False).select("field_name", "row_key", "std_value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unambiguous value for each date stated in the four fields."""
    return standard_times(spark, sf_dir).select("field_name", "row_key", "std_value").distinct()


def zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every outlet the zone that its zoneless times and their ingestion fit best."""
    news = table(spark, sf_dir, "articles").select("source", "published", F.unix_seconds("fetched_at").alias("ingested"))
    timed = timestamps.parse_dates(news, "published", F.lit(None).cast("string"), F.lit(False)).filter("_p.kind IN ('local', 'instant')")
    return timestamps.estimate_zones(timed.select("source", "_p.epoch", F.when(F.col("_p.kind") == "instant", F.coalesce("_p.offset", F.lit(0))).alias("offset"), "ingested"), "source")


def p4_zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated zone of each outlet beside the one it declares."""
    declared = table(spark, sf_dir, "outlets").select("source", "home_zone")
    found = zone_estimates(spark, sf_dir)
    return found.join(small(declared), "source", "left").select("source", "home_zone", F.col("zone").alias("estimated_zone"), "violations", "readings", "least_wait")


QUERIES = {"p2_found": p2_found, "p2_changed_fields": p2_changed_fields, "p4_found": p4_found, "p4_zone_estimates": p4_zone_estimates}

_P2_ROWS = r"""
WITH valid AS (
  SELECT source_key, snapshot_no, max(CASE WHEN trim(coalesce(error, '')) <> '' THEN 1 ELSE 0 END) AS bad
  FROM group_snapshots GROUP BY 1, 2 HAVING bad = 0),
pairs AS (
  SELECT source_key, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source_key ORDER BY snapshot_no) AS prev_no FROM valid),
cleaned AS (
  SELECT s.source_key, s.snapshot_no, regexp_replace(s.id, '^[\s\x{00A0}\x{3000}\x{200B}\x{FEFF}]+|[\s\x{00A0}\x{3000}\x{200B}\x{FEFF}]+$', '', 'g') AS id,
         coalesce(s.list, '') AS list, coalesce(s.primary_name, '') AS primary_name, array_to_string(coalesce(s.names, []), chr(31)) AS names,
         coalesce(s.dob, '') AS dob, coalesce(s.cnic, '') AS cnic, s.delivered_at
  FROM list_snapshots s JOIN valid USING (source_key, snapshot_no)),
kept AS (
  SELECT * FROM cleaned WHERE id <> ''
  QUALIFY row_number() OVER (PARTITION BY source_key, snapshot_no, id ORDER BY delivered_at DESC, list DESC, primary_name DESC, names DESC, dob DESC, cnic DESC) = 1),
sides AS (
  SELECT p.source_key, p.snapshot_no, k.id, k.list, k.primary_name, k.names, k.dob, k.cnic, TRUE AS is_new
  FROM pairs p JOIN kept k ON k.source_key = p.source_key AND k.snapshot_no = p.snapshot_no WHERE p.prev_no IS NOT NULL
  UNION ALL
  SELECT p.source_key, p.snapshot_no, k.id, k.list, k.primary_name, k.names, k.dob, k.cnic, FALSE
  FROM pairs p JOIN kept k ON k.source_key = p.source_key AND k.snapshot_no = p.prev_no WHERE p.prev_no IS NOT NULL),
compared AS (
  SELECT n.source_key AS ns, n.snapshot_no AS nn, n.id AS ni, o.source_key AS os, o.snapshot_no AS onn, o.id AS oi,
         n.list IS DISTINCT FROM o.list AS c_list, n.primary_name IS DISTINCT FROM o.primary_name AS c_primary, n.names IS DISTINCT FROM o.names AS c_names,
         n.dob IS DISTINCT FROM o.dob AS c_dob, n.cnic IS DISTINCT FROM o.cnic AS c_cnic
  FROM (SELECT * FROM sides WHERE is_new) n FULL JOIN (SELECT * FROM sides WHERE NOT is_new) o
    ON n.source_key = o.source_key AND n.snapshot_no = o.snapshot_no AND n.id = o.id)
"""
ORACLES = {
    "p2_found": _P2_ROWS
    + """
SELECT coalesce(ns, os) AS source_key, coalesce(nn, onn) AS snapshot_no, coalesce(ni, oi) AS id,
       CASE WHEN os IS NULL THEN 'added' WHEN ns IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM compared WHERE os IS NULL OR ns IS NULL OR c_list OR c_primary OR c_names OR c_dob OR c_cnic""",
    "p2_changed_fields": _P2_ROWS
    + """
SELECT ns AS source_key, nn AS snapshot_no, field, count(*) AS n_ids FROM (
  SELECT ns, nn, unnest(list_filter([CASE WHEN c_list THEN 'list' END, CASE WHEN c_primary THEN 'primary_name' END, CASE WHEN c_names THEN 'names' END,
    CASE WHEN c_dob THEN 'dob' END, CASE WHEN c_cnic THEN 'cnic' END], lambda x: x IS NOT NULL)) AS field
  FROM compared WHERE ns IS NOT NULL AND os IS NOT NULL) GROUP BY 1, 2, 3""",
}
