"""Queries of the screening operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import scalars, text
from sievework.operators import grouping, matching, offices, verdict
from sievework.session import small, table
from sievework.streaming import monitor

def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of applicants; rows may repeat."""
    return table(spark, sf_dir, "applicants")


def _screening(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People with their own threshold, list names, and the pairs of one CNIC."""
    one = F.max(F.struct("submitted_at", "full_name", scalars.resolve_threshold(F.col("threshold")).alias("least"), scalars.normalize_cnic(F.col("cnic")).alias("cnic"))).alias("p")
    people = _people(spark, sf_dir).filter("full_name IS NOT NULL").groupBy(F.col("id").alias("app")).agg(one).select("app", "p.full_name", "p.least", "p.cnic")
    records = table(spark, sf_dir, "list_records").groupBy("id").agg(F.max(F.struct("names", "type", scalars.normalize_cnic(F.col("cnic")).alias("cnic"))).alias("r"))
    names = records.select(F.col("id").alias("rec"), F.posexplode("r.names").alias("name_ord", "name"), (F.lower("r.type") == "entity").alias("is_entity")).filter("name IS NOT NULL")
    numbers = records.select(F.col("id").alias("rec"), "r.cnic")
    same = people.filter("cnic <> ''").select("app", "cnic").join(numbers.filter("cnic <> ''").hint("merge"), "cnic").select("app", "rec")
    return people.drop("cnic"), names, same


def screen_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every applicant against every list name at the applicant's own threshold, and every record of its CNIC: the whole matching core."""
    people, names, same = _screening(spark, sf_dir)
    return matching.screen(people, names, same=same)


def screen_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the screening reports: the best 50 records of each applicant and source, those of one CNIC first, and whether they are among its best 50 over all sources.

    ``total`` is the true number of the source. Sources follow the order of the report; ties go to the smaller record id.
    """
    people, names, same = _screening(spark, sf_dir)
    numbers = _people(spark, sf_dir).groupBy(F.col("id").alias("app")).agg(F.max(scalars.normalize_cnic(F.col("cnic"))).alias("cnic"))
    records = table(spark, sf_dir, "list_records").groupBy(F.col("id").alias("rec")).agg(F.min("source_key").alias("source_key"), F.max(scalars.normalize_cnic(F.col("cnic"))).alias("cnic"))
    source = F.element_at(F.create_map(*[F.lit(x) for p in _SOURCE_OF_KEY.items() for x in p]), F.col("source_key"))
    return matching.screen(people, names, same=same, report=(records.select("rec", source.alias("source"), "cnic"), numbers))


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded tokens of the names of persons: titles off, fused parts split, families of spellings and sounds united."""
    names = _people(spark, sf_dir).select(F.col("full_name").alias("name"))
    persons = table(spark, sf_dir, "list_records").filter("lower(type) <> 'entity'").select(F.explode("names").alias("name"))
    return names.unionByName(persons).filter("name IS NOT NULL").distinct().select("name", F.array_join(text.name_tokens(F.col("name")), " ").alias("folded"))


def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token postings of all names: in how many records each folded token stands; firms without their legal form."""
    rows = table(spark, sf_dir, "list_records").filter("id IS NOT NULL").select("id", F.explode("names").alias("name"), F.coalesce(F.lower(F.trim("type")) == "entity", F.lit(False)).alias("is_entity"))
    toks = matching.folded(rows.filter("name IS NOT NULL").distinct(), ["id", "name"], "name", "is_entity")
    return toks.select("id", F.explode("toks").alias("token")).groupBy("token").agg(F.count_distinct("id").alias("records"))


def norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised form and script check of applicants' names."""
    return _people(spark, sf_dir).select("id", text.norm(F.col("full_name")).alias("normed"), text.unsupported_script(F.col("full_name")).alias("refused")).distinct()


def norm_names_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised form of applicants' names."""
    return _people(spark, sf_dir).filter("full_name IS NOT NULL").select("id", text.norm(F.col("full_name")).alias("normed")).distinct()


def cnic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("id", scalars.normalize_cnic(F.col("cnic")).alias("cnic")).distinct()


def cnic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants and list records of one national number."""
    a = _people(spark, sf_dir).select("id", scalars.normalize_cnic(F.col("cnic")).alias("cnic")).filter("cnic <> ''").distinct()
    b = table(spark, sf_dir, "list_records").select(F.col("id").alias("rec"), scalars.normalize_cnic(F.col("cnic")).alias("cnic")).filter("cnic <> ''").distinct()
    return a.join(b, "cnic").select("id", "rec", "cnic")


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by canonical province."""
    return _matches(spark, sf_dir).groupBy(F.coalesce(scalars.known_province(F.col("province")), F.lit("")).alias("province")).agg(F.count("*").alias("n"))


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).groupBy(scalars.resolve_threshold(F.col("threshold")).alias("threshold")).agg(F.count_distinct("id").alias("n"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence columns of every match beside its applicant."""
    a = _people(spark, sf_dir).groupBy(F.col("id").alias("applicant_id")).agg(F.max(F.struct(F.coalesce("dob", F.lit("")).alias("dob"), F.coalesce("cnic", F.lit("")).alias("cnic"), F.coalesce("province", F.lit("")).alias("province"))).alias("a"))
    m = _matches(spark, sf_dir).select("match_id", "applicant_id", "dob", "cnic", "province").distinct()
    return m.join(a, "applicant_id").select(
        "match_id", verdict.dob_year_match(F.col("a.dob"), F.col("dob")).alias("dob_year"), verdict.cnic_match(F.col("a.cnic"), F.col("cnic")).alias("same_cnic"), verdict.province_match(F.col("a.province"), F.col("province")).alias("same_province")
    )


def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 50 matches of each applicant and source, with the true total."""
    m = _matches(spark, sf_dir).select("match_id", "applicant_id", "source", "score", F.coalesce("cnic_match", F.lit(False)).alias("by_cnic")).distinct()
    top = matching.top_matches(m, ["applicant_id", "source"], [F.desc("by_cnic"), F.desc("score"), F.asc("match_id")])
    return top.select("applicant_id", "source", "match_id", "place", "total")


def best_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest score of each applicant and record, and the name that reached it first."""
    best = _matches(spark, sf_dir).groupBy("applicant_id", "id").agg(F.max("score").alias("score"), F.max_by("matched_name", F.struct("score", (-F.col("match_id")).alias("o"))).alias("matched_name"))
    return best.select("applicant_id", "id", F.round("score", 1).alias("score"), "matched_name")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each applicant over all sources; the source named first wins ties."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in verdict.SOURCE_ORDER]), F.col("source")), F.lit(0))
    pick = F.struct("score", (-F.when(rank == 0, 99).otherwise(rank)).alias("s"), (-F.col("match_id")).alias("m"))
    return _matches(spark, sf_dir).groupBy("applicant_id").agg(F.max_by(F.struct("source", "match_id"), pick).alias("b"), F.max("score").alias("score")).select("applicant_id", "b.source", "b.match_id", "score")


def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and list."""
    m = _matches(spark, sf_dir).select("match_id", "source", "list", "cnic_match", "score").distinct()
    return m.groupBy("source", "list").agg(
        F.count("*").alias("matches"), F.count_if("cnic_match").alias("by_cnic"), F.count_if(F.col("score") >= 95).alias("strong"), F.round(F.avg("score"), 4).alias("mean_score")
    )


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every applicant from its matches and articles; lists that are not OK make a source partial."""
    people = _people(spark, sf_dir).select(F.col("id").alias("applicant_id")).distinct()
    hits = _matches(spark, sf_dir).groupBy("applicant_id", "source").agg(F.count_distinct("match_id").alias("n"))
    news = table(spark, sf_dir, "articles").groupBy("applicant_id").agg(F.count_distinct("article_id").alias("articles"))
    meta = table(spark, sf_dir, "list_meta").withColumn("source", F.element_at(F.create_map(*[F.lit(x) for p in _SOURCE_OF_KEY.items() for x in p]), F.col("source_key")))
    partial = meta.groupBy("source").agg(F.max((F.coalesce("status", F.lit("OK")) != "OK").cast("int")).alias("partial"))
    each = people.select("applicant_id", F.explode(F.array(*[F.lit(s) for s in verdict.SOURCE_ORDER])).alias("source"))
    rows = each.join(hits, ["applicant_id", "source"], "left").join(news, "applicant_id", "left").join(small(partial), "source", "left")
    articles = F.when(F.col("source") == "ADVERSE_MEDIA", F.coalesce("articles", F.lit(0))).otherwise(0)
    status = verdict.source_status(F.col("source"), F.lit(False), F.lit(True), F.coalesce("n", F.lit(0)), F.coalesce("partial", F.lit(0)) == 1, articles)
    return verdict.overall_verdict(rows.select("applicant_id", "source", status.alias("status")), ["applicant_id"])


_SOURCE_OF_KEY = {"unsc": "UNSC", "ofac": "OFAC", "uksl": "UKSL", "fia": "FIA_REDBOOK", "nacta": "NACTA", "pep": "PEP"}


def snapshot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each list of the records as they stand."""
    rows = table(spark, sf_dir, "list_records").select("list", "id", "primary_name", "names", "dob", "cnic").distinct()
    return verdict.fingerprints(rows.withColumn("of_list", F.col("list")), ["of_list"])


def content_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free content marks of every snapshot file."""
    return verdict.content_marks(table(spark, sf_dir, "list_snapshots"), ["source_key", "snapshot_no", "file_no"])


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every file against the same file of the snapshot before."""
    g = table(spark, sf_dir, "group_snapshots")
    now = g.select(F.concat_ws("/", "source_key", F.col("file_no").cast("string")).alias("source"), "snapshot_no", "fingerprint", (F.coalesce("error", F.lit("")) == "").alias("available"))
    old = F.last(F.when(F.col("available"), F.col("fingerprint")), True).over(W.partitionBy("source").orderBy("snapshot_no").rowsBetween(W.unboundedPreceding, -1))
    status = F.when(~F.col("available"), "unavailable").when(old.isNull(), "first_seen").when(F.col("fingerprint") == old, "unchanged").otherwise("changed")
    return now.select("source", "snapshot_no", status.alias("status"))


def baseline_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of matches exploded from their arrays, counted by applicant."""
    m = _matches(spark, sf_dir).select("applicant_id", "match_id", F.explode("aliases").alias("alias")).filter("alias IS NOT NULL").distinct()
    return m.groupBy("applicant_id").agg(F.count("*").alias("aliases"), F.count_distinct("alias").alias("different"))


def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants by overall status with their match counts of sanctions, office holders and news."""
    people = _people(spark, sf_dir).groupBy("id").agg(F.max("overall_status").alias("overall_status"))
    hits = _matches(spark, sf_dir).groupBy(F.col("applicant_id").alias("id")).agg(
        F.count_distinct(F.when(F.col("source") != "PEP", F.col("match_id"))).alias("sanctions"), F.count_distinct(F.when(F.col("source") == "PEP", F.col("match_id"))).alias("pep")
    )
    news = table(spark, sf_dir, "articles").groupBy(F.col("applicant_id").alias("id")).agg(F.count_distinct("article_id").alias("news"))
    rows = people.join(hits, "id", "left").join(news, "id", "left")
    return rows.groupBy("overall_status").agg(F.count("*").alias("applicants"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("sanctions", "pep", "news")])


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of 50 of the screenings, newest first."""
    rows = _people(spark, sf_dir).select("id", "full_name", "overall_status", "submitted_at").distinct()
    return rows.orderBy(F.desc_nulls_last("submitted_at"), F.desc("id"), "full_name").offset(100).limit(50).select("id", "overall_status")


def case_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("id", scalars.case_ref(F.col("submitted_at"), F.col("id")).alias("case_ref")).distinct()


def guarded_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review notes and names as they go to a spreadsheet."""
    return _people(spark, sf_dir).select("id", scalars.csv_guard(F.col("full_name")).alias("name"), scalars.csv_guard(F.col("cnic")).alias("cnic")).distinct()


def pep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office holders merged by name and birth year; the upload goes before the rosters and those before the knowledge base."""
    order = F.element_at(F.create_map(*[F.lit(x) for p in _PEP_ORDER.items() for x in p]), F.col("list"))
    rows = table(spark, sf_dir, "list_records").filter("source_key = 'pep'").select("id", "list", "primary_name", "dob").distinct()
    tokens = F.array_join(F.array_sort(F.split(F.lower(F.trim(F.regexp_replace("primary_name", r"\s+", " "))), " ")), " ")
    key = F.concat_ws("|", tokens, F.coalesce(scalars.first_year(F.col("dob")), F.lit("")))
    best = rows.groupBy(key.alias("person")).agg(F.min(F.struct(F.coalesce(order, F.lit(9)).alias("o"), "id")).alias("b"), F.count("*").alias("copies"))
    return best.select("person", F.col("b.id").alias("id"), "copies")


def pep_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office holders merged as in ``pep_merge``, but by the folded tokens of the name, so that spellings the folding unites are one person."""
    order = F.element_at(F.create_map(*[F.lit(x) for p in _PEP_ORDER.items() for x in p]), F.col("list"))
    rows = table(spark, sf_dir, "list_records").filter("source_key = 'pep'").select("id", "list", "primary_name", "dob").distinct()
    toks = matching.folded(rows.select("primary_name").filter("primary_name IS NOT NULL").distinct(), ["primary_name"], "primary_name")
    named = rows.join(toks, "primary_name", "left")
    tokens = F.coalesce(F.array_join(F.array_sort("toks"), " "), F.lit(""))
    key = F.concat_ws("|", tokens, F.coalesce(scalars.first_year(F.col("dob")), F.lit("")))
    best = named.groupBy(key.alias("person")).agg(F.min(F.struct(F.coalesce(order, F.lit(9)).alias("o"), "id")).alias("b"), F.count("*").alias("copies"))
    return best.select("person", F.col("b.id").alias("id"), "copies")


_PEP_ORDER = {"PEP admin upload": 1, "PEP assembly rosters": 2, "PEP knowledge base": 3, "PEP scratch import": 4}


def position_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level read from the text of every position, counted."""
    rows = table(spark, sf_dir, "list_records").select("id", "position").distinct()
    return rows.groupBy(verdict.level_from_text(F.col("position")).alias("level")).agg(F.count("*").alias("n"))


def classified_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offices by the level and province of their label."""
    got = offices.classify_position(F.col("position"))
    rows = _matches(spark, sf_dir).select("match_id", got.alias("g")).distinct()
    return rows.groupBy(F.col("g.level").alias("level"), F.col("g.province").alias("province")).agg(F.count("*").alias("n"))


def person_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons behind the office-holder matches of each applicant."""
    m = _matches(spark, sf_dir).filter("source = 'PEP'").dropDuplicates(["match_id"])
    return grouping.person_groups(m)


def adverse_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title has an adverse word, by word."""
    rows = table(spark, sf_dir, "articles").select("article_id", F.lower(verdict.adverse_word(F.col("title"))).alias("word")).distinct()
    return rows.filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("articles"))


def news_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with an adverse word and the applicant's surname plus one more name part, each in any spelling at Jaro-Winkler 0.92."""
    a = _people(spark, sf_dir).groupBy(F.col("id").alias("applicant_id")).agg(F.max("full_name").alias("full_name")).filter("full_name IS NOT NULL")
    n = table(spark, sf_dir, "articles").select("article_id", "applicant_id", "title").distinct().filter(verdict.adverse_word(F.col("title")).isNotNull())
    need = matching.folded(a, ["applicant_id"], "full_name").withColumnRenamed("toks", "need")
    have = matching.folded(n.select("title").distinct(), ["title"], "title").withColumnRenamed("toks", "have")
    rows = n.join(need, "applicant_id").join(have, "title")
    return rows.filter(matching.names_person(F.col("need"), F.col("have"))).select("article_id")


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every event with that of the event before."""
    e = table(spark, sf_dir, "events")
    return verdict.chain_links(e, "event_id", F.concat_ws("|", F.col("event_id").cast("string"), F.coalesce(F.col("event_type"), F.lit(""))))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(F.percentile("value", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max("value").alias("most"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


def list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest counters of each list and the warnings they give."""
    r = table(spark, sf_dir, "list_records")
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    c = r.groupBy("list").agg(
        F.count_distinct("id").alias("records"), F.count_if(scalars.normalize_cnic(F.col("cnic")) != "").alias("with_cnic"), F.count_if(given("father")).alias("with_father"), F.count_if(given("province")).alias("with_province"), F.count_if(given("pep_level")).alias("with_level")
    )
    warn = [F.when(F.col(f"with_{x}") == 0, f"no {x}") for x in ("cnic", "father", "province", "level")]
    return c.select("list", "records", "with_cnic", "with_father", "with_province", "with_level", F.array_join(F.array_compact(F.array(*warn)), ", ").alias("warnings"))


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy figures of stored scores against equality of CNICs, by source."""
    m = _matches(spark, sf_dir).select("match_id", "source", "score", "cnic_match").distinct().filter("cnic_match IS NOT NULL")
    said = F.col("score") >= 85
    ratio = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    true = F.col("cnic_match")
    return m.groupBy("source").agg(F.count("*").alias("n"), F.round(F.count_if(said == true) / F.count("*"), 6).alias("accuracy"), ratio(said & true, true).alias("recall"), ratio(said & ~true, ~true).alias("false_alarms"))


QUERIES = {
    f.__name__: f
    for f in (
        screen_applicants, screen_top, folded_names, token_postings, norm_names, norm_names_plain, cnic_numbers, cnic_matches, provinces, thresholds, evidence, top_matches, best_per_record, coverage, source_rollup, case_verdicts,
        snapshot_fingerprints, content_marks, change_detect, baseline_refs, batch_rollup, history_page, case_refs, guarded_export, pep_merge, pep_persons, position_levels, classified_positions,
        person_groups, adverse_articles, news_hits, audit_chain, latency_percentiles, windowed_events, list_quality, quality_metrics,
    )
}


def prepared_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants that can be screened and those that cannot, with the reason."""
    from sievework.sources import applicants

    rows = applicants.prepared(_people(spark, sf_dir).select("id", "full_name").distinct())
    return rows.groupBy("state", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of every document's text."""
    from sievework.sources import applicants

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return applicants.manifest(docs, "doc", F.col("text").cast("binary"))


def monitored_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored applicants with the matches found since they were last checked."""
    a = _people(spark, sf_dir).filter("monitored").groupBy("id").agg(F.max("last_monitored_at").alias("last"))
    m = _matches(spark, sf_dir).select("applicant_id", "match_id", "checked_at").distinct()
    late = m.join(a, F.col("id") == F.col("applicant_id")).filter(F.col("checked_at") > F.col("last")).groupBy("id").agg(F.count("*").alias("open_alerts"))
    return a.join(late, "id", "left").select("id", F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"))


QUERIES |= {f.__name__: f for f in (prepared_applicants, evidence_manifest, monitored_people)}
