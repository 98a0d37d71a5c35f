"""Queries of sources, stored tables, history and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import scalars
from sievework.operators import lifecycle, verdict
from sievework.plans.reference_sql import province_sql
from sievework.session import table
from sievework.streaming.monitor import ALERT_KEY

_YEAR = "2022-01-01"


def _alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "matches").select("applicant_id", "source", "list", F.col("id").alias("ref"), F.unix_micros("checked_at").alias("seen"))
    late = F.col("seen") >= F.unix_micros(F.lit(_YEAR + " 00:00:00+00").cast("timestamp"))
    stored = m.filter(~late).dropna(subset=ALERT_KEY).groupBy(*ALERT_KEY).agg(F.min("seen").alias("seen"))
    return stored, m.filter(late)


def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each source: live, last good copy, stale or unavailable."""
    return lifecycle.source_states(table(spark, sf_dir, "group_snapshots"))


def last_good_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the last snapshot of each source that did not fail, by list."""
    good = lifecycle.source_states(table(spark, sf_dir, "group_snapshots")).select("source_key", F.col("good_no").alias("snapshot_no"))
    rows = table(spark, sf_dir, "list_snapshots").join(good, ["source_key", "snapshot_no"]).withColumn("id", F.trim("id")).filter("id <> ''")
    return rows.groupBy("source_key", "list").agg(F.count_distinct("id").alias("records"))


def files_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy of each file of a source that is read."""
    return lifecycle.files_in_use(table(spark, sf_dir, "group_snapshots"))


def rescreen_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of monitored applicants in sources that changed."""
    changed = lifecycle.changed_sources(table(spark, sf_dir, "group_snapshots"))
    watched = table(spark, sf_dir, "applicants").filter("monitored").select(F.col("id").alias("applicant_id")).distinct()
    records = table(spark, sf_dir, "list_records").select("id", "source_key").distinct().join(changed, "source_key")
    m = table(spark, sf_dir, "matches").select("applicant_id", "match_id", "id").distinct().join(watched, "applicant_id").join(records, "id")
    return m.groupBy("applicant_id", "source_key").agg(F.count_distinct("match_id").alias("matches"))


def alerts_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts stored before 2022 and those of later matches that were not there."""
    return lifecycle.insert_absent(*_alerts(spark, sf_dir), ALERT_KEY, ["seen"])


def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of 2023 and later that are neither in the baseline (before 2022) nor among the alerts of 2022."""
    from sievework.streaming import monitor

    stored, late = _alerts(spark, sf_dir)
    year = F.col("seen") < F.unix_micros(F.lit("2023-01-01 00:00:00+00").cast("timestamp"))
    return monitor.new_alerts(late.filter(~year).select(ALERT_KEY), stored.select(ALERT_KEY), late.filter(year).select(ALERT_KEY).distinct())


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest good fingerprint of each file, the snapshots merged into the stored state one after the other."""
    rows = table(spark, sf_dir, "group_snapshots").filter("coalesce(error, '') = ''").select("source_key", "file_no", "snapshot_no", "fingerprint")
    return lifecycle.upsert(rows.filter("snapshot_no <= 3"), rows.filter("snapshot_no > 3"), ["source_key", "file_no"], ["snapshot_no"])


def latest_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each applicant as last submitted."""
    rows = table(spark, sf_dir, "applicants").select("id", F.unix_micros("submitted_at").alias("at"), "full_name", "overall_status")
    return lifecycle.latest(rows, ["id"], ["at"])


def history_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screenings that hit or need a review, with the date order their user prefers."""
    prefs = lifecycle.latest(table(spark, sf_dir, "user_preferences").select("user_id", F.unix_micros("updated_at").alias("at"), "prefs"), ["user_id"], ["at"])
    order = prefs.select("user_id", F.get_json_object("prefs", "$.display.date_order").alias("date_order"))
    rows = table(spark, sf_dir, "applicants").filter(F.col("overall_status").isin("POTENTIAL MATCH", "REVIEW") & F.col("user_id").isNotNull())
    return rows.select("id", "user_id", "overall_status").distinct().join(order, "user_id", "left")


def results_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results each user may see: those of their own applicants. Counted for each applicant before the user is joined."""
    own = table(spark, sf_dir, "applicants").filter("user_id IS NOT NULL").select(F.col("id").alias("applicant_id"), "user_id").distinct()
    n = table(spark, sf_dir, "matches").select("applicant_id", "match_id").distinct().groupBy("applicant_id").agg(F.count("*").alias("n"))
    return own.join(n, "applicant_id").groupBy("user_id").agg(F.sum("n").alias("results"))


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screenings by status and the decision last taken."""
    rows = table(spark, sf_dir, "applicants").select("id", "overall_status", F.unix_micros("reviewed_at").alias("at"), "review_decision")
    last = rows.groupBy("id").agg(F.max("overall_status").alias("overall_status"), F.max(F.struct("at", "review_decision"))["review_decision"].alias("decision"))
    return last.groupBy("overall_status", F.coalesce("decision", F.lit("")).alias("decision")).agg(F.count("*").alias("n"))


def list_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published marks of the lists of each source."""
    return table(spark, sf_dir, "list_meta").groupBy("source_key").agg(lifecycle.listing(F.col("published")).alias("version"))


def result_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of each applicant and source."""
    m = table(spark, sf_dir, "matches").groupBy("applicant_id", "source").agg(F.count_distinct("match_id").alias("n"), F.max("score").alias("best"))
    text = F.concat("source", F.lit(": "), lifecycle.counted(F.col("n"), "possible match", "possible matches"), F.lit(", best score "), F.format_string("%.1f", "best"))
    return m.select("applicant_id", "source", text.alias("banner"))


def plain_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of files as people read them."""
    rows = table(spark, sf_dir, "group_snapshots").select("source_key", lifecycle.plain_reason(F.col("error")).alias("reason"))
    return rows.filter("reason <> ''").groupBy("source_key", "reason").agg(F.count("*").alias("files"))


def person_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under which an applicant's office holders are listed, and where."""
    m = table(spark, sf_dir, "matches").filter("source = 'PEP'")
    names = m.select("applicant_id", "list", F.explode(F.array_compact(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("primary_name")))).alias("name"))
    return names.groupBy("applicant_id").agg(lifecycle.listing(F.col("name")).alias("names"), lifecycle.listing(F.col("list")).alias("lists"))


def unclassified_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 offices without a level that stand most often."""
    rows = table(spark, sf_dir, "list_records").filter("trim(coalesce(position, '')) <> ''").select("id", "position").distinct()
    return rows.filter(verdict.level_from_text(F.col("position")) == "").groupBy("position").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "position").limit(15)


def members_by_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office holders by province and stated level."""
    rows = table(spark, sf_dir, "list_records").filter("source_key = 'pep'").select("id", "province", "pep_level").distinct()
    return rows.groupBy(F.coalesce(scalars.known_province(F.col("province")), F.lit("")).alias("province"), F.lower(F.trim(F.coalesce("pep_level", F.lit("")))).alias("level")).agg(F.count_distinct("id").alias("people"))


def list_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each list may replace the copy before: enough records, and within a tenth of the publisher's count."""
    n = table(spark, sf_dir, "list_records").groupBy("list").agg(F.count_distinct("id").alias("found"))
    rows = table(spark, sf_dir, "list_meta").select("list", "records").join(n, "list", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    ok = F.when(F.col("found") < 10, "too few").when(F.abs(F.col("found") - F.col("records")) * 10 > F.col("records"), "count differs").otherwise("ok")
    return rows.select("list", "found", ok.alias("gate"))


def overdue_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored applicants whose last check lies more than 30 days before the latest of all."""
    rows = table(spark, sf_dir, "applicants").filter("monitored").groupBy("id").agg(F.max("last_monitored_at").alias("last"))
    now = rows.agg(F.max("last").alias("now"))
    return rows.join(F.broadcast(now), (F.col("last") < F.col("now") - F.expr("INTERVAL 30 DAYS")) | F.col("last").isNull()).select("id")  # one row


QUERIES = {
    f.__name__: f
    for f in (
        source_state, last_good_records, files_in_use, rescreen_changed, alerts_append, new_alerts, state_upsert, latest_applicants, history_filtered, results_by_user, review_states, list_versions,
        result_banners, plain_errors, person_labels, unclassified_positions, members_by_province, list_gate, overdue_checks,
    )
}

_GOOD = "g AS (SELECT source_key, snapshot_no, max(loaded_at) AS loaded_at, bool_and(coalesce(error, '') = '') AS good FROM group_snapshots GROUP BY 1, 2)"
_KEY = "applicant_id, source, list, id AS ref"
_LEVEL = r"""(CASE WHEN regexp_matches(lower(trim(position)), 'prov|state|region|assembly of (sindh|punjab|balochistan|khyber)') THEN 'Provincial' WHEN regexp_matches(lower(trim(position)), 'nat|fed|central|senate') THEN 'National'
  WHEN regexp_matches(lower(trim(position)), '\blocal\b|municipal|metropolitan|\bdistrict\b|\bcity\b|\btown\b|union council') THEN 'Local' ELSE '' END)"""
ORACLES = {
    "source_state": f"""
      WITH {_GOOD}, e AS (SELECT source_key, max(snapshot_no) AS last_no, max(snapshot_no) FILTER (good) AS good_no, arg_max(loaded_at, snapshot_no) FILTER (good) AS good_at FROM g GROUP BY 1),
      a AS (SELECT *, CAST(floor((epoch_us((SELECT max(loaded_at) FROM g)) - epoch_us(good_at)) / 86400000000) AS INTEGER) AS age_days FROM e)
      SELECT source_key, last_no, good_no, age_days, CASE WHEN good_no IS NULL THEN 'UNAVAILABLE' WHEN good_no = last_no THEN 'LIVE' WHEN age_days <= 30 THEN 'LAST_GOOD' ELSE 'STALE' END AS state FROM a""",
    "last_good_records": f"""
      WITH {_GOOD}, k AS (SELECT source_key, max(snapshot_no) AS snapshot_no FROM g WHERE good GROUP BY 1)
      SELECT source_key, list, count(DISTINCT trim(id)) AS records FROM list_snapshots JOIN k USING (source_key, snapshot_no) WHERE trim(id) <> '' GROUP BY 1, 2""",
    "files_in_use": "SELECT source_key, file_no, max(snapshot_no) AS snapshot_no FROM group_snapshots WHERE coalesce(error, '') = '' GROUP BY 1, 2",
    "rescreen_changed": f"""
      WITH {_GOOD}, m AS (SELECT source_key, snapshot_no, string_agg(DISTINCT file_no || ':' || fingerprint, '|' ORDER BY file_no || ':' || fingerprint) AS mark FROM group_snapshots JOIN g USING (source_key, snapshot_no) WHERE good GROUP BY 1, 2),
      l AS (SELECT *, lag(mark) OVER (PARTITION BY source_key ORDER BY snapshot_no) AS old FROM m QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY snapshot_no DESC) = 1),
      r AS (SELECT DISTINCT id, source_key FROM list_records JOIN l USING (source_key) WHERE mark IS DISTINCT FROM old)
      SELECT applicant_id, source_key, count(DISTINCT match_id) AS matches FROM matches JOIN r USING (id) WHERE applicant_id IN (SELECT id FROM applicants WHERE monitored) GROUP BY 1, 2""",
    "alerts_append": f"""
      WITH m AS (SELECT {_KEY}, epoch_us(checked_at) AS seen, checked_at < TIMESTAMPTZ '{_YEAR} 00:00:00+00' AS early FROM matches),
      s AS (SELECT applicant_id, source, list, ref, min(seen) AS seen FROM m WHERE early GROUP BY ALL)
      SELECT * FROM s UNION ALL SELECT applicant_id, source, list, ref, min(seen) FROM m WHERE NOT early AND (applicant_id, source, list, ref) NOT IN (SELECT applicant_id, source, list, ref FROM s) GROUP BY ALL""",
    "new_alerts": f"""
      SELECT DISTINCT {_KEY} FROM matches m WHERE checked_at >= TIMESTAMPTZ '2023-01-01 00:00:00+00' AND NOT EXISTS
        (SELECT 1 FROM matches b WHERE b.checked_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' AND b.applicant_id = m.applicant_id AND b.source = m.source AND b.list = m.list AND b.id = m.id)""",
    "state_upsert": """
      SELECT source_key, file_no, snapshot_no, fingerprint FROM group_snapshots WHERE coalesce(error, '') = ''
      QUALIFY row_number() OVER (PARTITION BY source_key, file_no ORDER BY snapshot_no DESC, fingerprint DESC) = 1""",
    "latest_applicants": """
      SELECT id, epoch_us(submitted_at) AS at, full_name, overall_status FROM applicants
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY submitted_at DESC NULLS LAST, full_name DESC NULLS LAST, overall_status DESC NULLS LAST) = 1""",
    "history_filtered": """
      WITH p AS (SELECT user_id, json_extract_string(prefs, '$.display.date_order') AS date_order FROM user_preferences WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, prefs DESC) = 1)
      SELECT DISTINCT user_id, id, overall_status, date_order FROM applicants LEFT JOIN p USING (user_id) WHERE overall_status IN ('POTENTIAL MATCH', 'REVIEW') AND user_id IS NOT NULL""",
    "results_by_user": """
      SELECT user_id, count(*) AS results FROM (SELECT DISTINCT user_id, applicant_id, match_id FROM (SELECT DISTINCT id AS applicant_id, user_id FROM applicants WHERE user_id IS NOT NULL) JOIN matches USING (applicant_id)) GROUP BY 1""",
    "review_states": """
      WITH l AS (SELECT id, max(overall_status) AS overall_status, max({'at': coalesce(epoch_us(reviewed_at), -1), 'd': coalesce(review_decision, '')}).d AS decision FROM applicants GROUP BY 1)
      SELECT overall_status, decision, count(*) AS n FROM l GROUP BY 1, 2""",
    "list_versions": "SELECT source_key, coalesce(string_agg(DISTINCT published, '; ' ORDER BY published) FILTER (trim(published) <> ''), '') AS version FROM list_meta GROUP BY 1",
    "result_banners": """
      SELECT applicant_id, source, source || ': ' || n || CASE WHEN n = 1 THEN ' possible match' ELSE ' possible matches' END || ', best score ' || printf('%.1f', best) AS banner
      FROM (SELECT applicant_id, source, count(DISTINCT match_id) AS n, max(score) AS best FROM matches GROUP BY 1, 2)""",
    "plain_errors": """
      WITH r AS (SELECT source_key, trim(regexp_replace(regexp_replace(coalesce(error, ''), 'https?://[^ ]+', '', 'g'), ' +', ' ', 'g')) AS s FROM group_snapshots)
      SELECT source_key, CASE WHEN length(s) > 120 THEN rtrim(left(s, 119)) || '…' ELSE s END AS reason, count(*) AS files FROM r WHERE s <> '' GROUP BY 1, 2""",
    "person_labels": """
      WITH m AS (SELECT applicant_id, list, unnest(list_append(coalesce(aliases, []), primary_name)) AS name FROM matches WHERE source = 'PEP')
      SELECT applicant_id, coalesce(string_agg(DISTINCT name, '; ' ORDER BY name) FILTER (trim(name) <> ''), '') AS names, coalesce(string_agg(DISTINCT list, '; ' ORDER BY list) FILTER (trim(list) <> ''), '') AS lists FROM m WHERE name IS NOT NULL GROUP BY 1""",
    "unclassified_positions": f"""
      SELECT position, count(*) AS n FROM (SELECT DISTINCT id, position FROM list_records WHERE trim(coalesce(position, '')) <> '') WHERE {_LEVEL} = '' GROUP BY 1 ORDER BY n DESC, position LIMIT 15""",
    "members_by_province": f"""
      SELECT coalesce({province_sql('province')}, '') AS province, lower(trim(coalesce(pep_level, ''))) AS level, count(DISTINCT id) AS people FROM list_records WHERE source_key = 'pep' GROUP BY 1, 2""",
    "list_gate": """
      WITH n AS (SELECT list, count(DISTINCT id) AS found FROM list_records GROUP BY 1), r AS (SELECT list, records, coalesce(found, 0) AS found FROM list_meta LEFT JOIN n USING (list))
      SELECT list, found, CASE WHEN found < 10 THEN 'too few' WHEN abs(found - records) * 10 > records THEN 'count differs' ELSE 'ok' END AS gate FROM r""",
    "overdue_checks": """
      WITH r AS (SELECT id, max(last_monitored_at) AS last FROM applicants WHERE monitored GROUP BY 1)
      SELECT id FROM r WHERE last IS NULL OR last < (SELECT max(last) FROM r) - INTERVAL 30 DAY""",
}
