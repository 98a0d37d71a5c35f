"""DuckDB SQL of the screening queries."""

from __future__ import annotations

from sievework import lexicon
from sievework.functions.scalars import PROVINCES
from sievework.functions import text
from sievework.lexicon import ADVERSE

_CASE = " ".join(f"WHEN '{form}' THEN '{name}'" for name, forms in PROVINCES.items() for form in forms)


def province_sql(col: str) -> str:
    return f"(CASE trim(regexp_replace(lower(coalesce({col}, '')), '[^a-z]+', ' ', 'g')) {_CASE} END)"


def _cnic(col: str) -> str:
    d = f"regexp_replace(coalesce({col}, ''), '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) = 13 AND len(list_distinct(string_split({d}, ''))) > 2 THEN {d} ELSE '' END)"


_ADVERSE = r"(?i)\b(" + "|".join(ADVERSE) + r")\b"

ORACLES = {
    "cnic_numbers": f"SELECT DISTINCT id, {_cnic('cnic')} AS cnic FROM applicants",
    "cnic_matches": f"""SELECT DISTINCT a.id, r.id AS rec, {_cnic('a.cnic')} AS cnic FROM applicants a JOIN list_records r
      ON {_cnic('a.cnic')} = {_cnic('r.cnic')} WHERE {_cnic('a.cnic')} <> ''""",
    "provinces": f"SELECT coalesce({province_sql('province')}, '') AS province, count(*) AS n FROM matches GROUP BY 1",
    "thresholds": """SELECT CASE WHEN threshold BETWEEN 50 AND 100 THEN threshold ELSE 85.0 END AS threshold, count(DISTINCT id) AS n FROM applicants GROUP BY 1""",
    "evidence": f"""
      WITH a AS (SELECT id AS applicant_id, max({{'dob': coalesce(dob, ''), 'cnic': coalesce(cnic, ''), 'province': coalesce(province, '')}}) AS a FROM applicants GROUP BY 1),
      m AS (SELECT DISTINCT match_id, applicant_id, dob, cnic, province FROM matches),
      j AS (SELECT match_id, regexp_extract(a.a.dob, '([0-9]{{4}})', 1) AS y, m.dob, {_cnic('a.a.cnic')} AS ca, {_cnic('m.cnic')} AS cm, {province_sql('a.a.province')} AS pa, {province_sql('m.province')} AS pm
            FROM m JOIN a USING (applicant_id))
      SELECT match_id, CASE WHEN y = '' OR coalesce(dob, '') = '' THEN 'n/a' WHEN contains(dob, y) THEN 'Yes' ELSE 'No' END AS dob_year,
        CASE WHEN ca <> '' AND cm <> '' THEN ca = cm END AS same_cnic, CASE WHEN pa IS NOT NULL AND pm IS NOT NULL THEN pa = pm END AS same_province FROM j""",
    "top_matches": """
      WITH m AS (SELECT DISTINCT match_id, applicant_id, source, score, coalesce(cnic_match, false) AS by_cnic FROM matches)
      SELECT applicant_id, source, match_id, CAST(row_number() OVER w AS INTEGER) AS place, count(*) OVER (PARTITION BY applicant_id, source) AS total FROM m
      WINDOW w AS (PARTITION BY applicant_id, source ORDER BY by_cnic DESC, score DESC, match_id) QUALIFY place <= 50""",
    "best_per_record": """
      SELECT applicant_id, id, round(score, 1) AS score, matched_name FROM (SELECT DISTINCT applicant_id, id, score, matched_name, match_id FROM matches)
      QUALIFY row_number() OVER (PARTITION BY applicant_id, id ORDER BY score DESC, match_id) = 1""",
    "coverage": """
      SELECT applicant_id, source, match_id, score FROM (SELECT DISTINCT applicant_id, source, match_id, score FROM matches)
      QUALIFY row_number() OVER (PARTITION BY applicant_id ORDER BY score DESC, coalesce(list_position(['UNSC', 'OFAC', 'UKSL', 'FIA_REDBOOK', 'NACTA', 'PEP', 'ADVERSE_MEDIA'], source), 99), match_id) = 1""",
    "source_rollup": """
      SELECT source, list, count(*) AS matches, count(*) FILTER (cnic_match) AS by_cnic, count(*) FILTER (score >= 95) AS strong, round(avg(score), 4) AS mean_score
      FROM (SELECT DISTINCT match_id, source, list, cnic_match, score FROM matches) GROUP BY 1, 2""",
    "case_verdicts": """
      WITH p AS (SELECT DISTINCT id AS applicant_id FROM applicants),
      h AS (SELECT applicant_id, max(CASE WHEN source <> 'PEP' THEN 1 ELSE 0 END) AS hit, max(CASE WHEN source = 'PEP' THEN 1 ELSE 0 END) AS pep FROM matches GROUP BY 1),
      t AS (SELECT applicant_id, source FROM matches GROUP BY 1, 2),
      n AS (SELECT DISTINCT applicant_id FROM articles),
      bad AS (SELECT DISTINCT CASE source_key WHEN 'unsc' THEN 'UNSC' WHEN 'ofac' THEN 'OFAC' WHEN 'uksl' THEN 'UKSL' WHEN 'fia' THEN 'FIA_REDBOOK' WHEN 'nacta' THEN 'NACTA' ELSE 'PEP' END AS source
              FROM list_meta WHERE coalesce(status, 'OK') <> 'OK'),
      open AS (SELECT p.applicant_id, count(*) AS k FROM p CROSS JOIN bad LEFT JOIN t ON t.applicant_id = p.applicant_id AND t.source = bad.source WHERE t.source IS NULL AND bad.source <> 'PEP' GROUP BY 1)
      SELECT p.applicant_id, CASE WHEN h.hit = 1 THEN 'ESCALATE_TO_COMPLIANCE' WHEN h.pep = 1 OR n.applicant_id IS NOT NULL OR open.k IS NOT NULL THEN 'MANUAL_REVIEW' ELSE 'AUTO_CLEAR' END AS verdict
      FROM p LEFT JOIN h USING (applicant_id) LEFT JOIN n USING (applicant_id) LEFT JOIN open USING (applicant_id)""",
    "snapshot_fingerprints": """
      WITH r AS (SELECT DISTINCT coalesce(list, '') AS list, coalesce(id, '') AS id, coalesce(primary_name, '') AS primary_name, array_to_string(list_transform(coalesce(names, []), lambda x: coalesce(x, '')), '|') AS names,
        coalesce(dob, '') AS dob, coalesce(cnic, '') AS cnic FROM list_records)
      SELECT list AS of_list, sha256(string_agg(list || chr(31) || id || chr(31) || primary_name || chr(31) || names || chr(31) || dob || chr(31) || cnic || chr(30), '' ORDER BY list, id, primary_name, names, dob, cnic)) AS fingerprint,
        count(*) AS records FROM r GROUP BY 1""",
    "change_detect": """
      WITH g AS (SELECT source_key || '/' || file_no AS source, snapshot_no, fingerprint, coalesce(error, '') = '' AS ok FROM group_snapshots)
      SELECT source, snapshot_no, CASE WHEN NOT ok THEN 'unavailable' WHEN old IS NULL THEN 'first_seen' WHEN fingerprint = old THEN 'unchanged' ELSE 'changed' END AS status
      FROM (SELECT *, last_value(CASE WHEN ok THEN fingerprint END IGNORE NULLS) OVER (PARTITION BY source ORDER BY snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM g)""",
    "baseline_refs": """
      SELECT applicant_id, count(*) AS aliases, count(DISTINCT alias) AS different FROM (SELECT DISTINCT applicant_id, match_id, unnest(aliases) AS alias FROM matches) WHERE alias IS NOT NULL GROUP BY 1""",
    "batch_rollup": """
      WITH p AS (SELECT id, max(overall_status) AS overall_status FROM applicants GROUP BY 1),
      h AS (SELECT applicant_id AS id, count(DISTINCT CASE WHEN source <> 'PEP' THEN match_id END) AS sanctions, count(DISTINCT CASE WHEN source = 'PEP' THEN match_id END) AS pep FROM matches GROUP BY 1),
      n AS (SELECT applicant_id AS id, count(DISTINCT article_id) AS news FROM articles GROUP BY 1)
      SELECT overall_status, count(*) AS applicants, CAST(sum(coalesce(sanctions, 0)) AS BIGINT) AS sanctions, CAST(sum(coalesce(pep, 0)) AS BIGINT) AS pep, CAST(sum(coalesce(news, 0)) AS BIGINT) AS news
      FROM p LEFT JOIN h USING (id) LEFT JOIN n USING (id) GROUP BY 1""",
    "history_page": """
      SELECT id, overall_status FROM (SELECT DISTINCT id, full_name, overall_status, submitted_at FROM applicants)
      ORDER BY submitted_at DESC NULLS LAST, id DESC, full_name LIMIT 50 OFFSET 100""",
    "case_refs": "SELECT DISTINCT id, 'CS-' || strftime(submitted_at AT TIME ZONE 'UTC', '%Y%m%d') || '-' || lpad(CAST(id AS VARCHAR), CAST(greatest(5, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS case_ref FROM applicants",
    "guarded_export": """
      SELECT DISTINCT id, CASE WHEN left(full_name, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || full_name ELSE full_name END AS name,
        CASE WHEN left(cnic, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || cnic ELSE cnic END AS cnic FROM applicants""",
    "position_levels": r"""
      SELECT CASE WHEN regexp_matches(t, 'prov|state|region|assembly of (sindh|punjab|balochistan|khyber)') THEN 'Provincial' WHEN regexp_matches(t, 'nat|fed|central|senate') THEN 'National'
        WHEN regexp_matches(t, '\blocal\b|municipal|metropolitan|\bdistrict\b|\bcity\b|\btown\b|union council') THEN 'Local' ELSE '' END AS level, count(*) AS n
      FROM (SELECT DISTINCT id, position, lower(trim(coalesce(position, ''))) AS t FROM list_records) GROUP BY 1""",
    "adverse_articles": f"""
      SELECT lower(regexp_extract(title, '{_ADVERSE}', 1)) AS word, count(DISTINCT article_id) AS articles FROM articles WHERE regexp_matches(title, '{_ADVERSE}') GROUP BY 1""",
    "audit_chain": """
      SELECT event_id, sha256(event_id || '|' || coalesce(event_type, '')) AS row_hash,
        coalesce(lag(sha256(event_id || '|' || coalesce(event_type, ''))) OVER (ORDER BY event_id), repeat('0', 64)) AS prev_hash FROM events""",
    "latency_percentiles": """
      SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY 1""",
    "windowed_events": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "list_quality": f"""
      SELECT *, array_to_string(list_filter([CASE WHEN with_cnic = 0 THEN 'no cnic' END, CASE WHEN with_father = 0 THEN 'no father' END, CASE WHEN with_province = 0 THEN 'no province' END,
        CASE WHEN with_level = 0 THEN 'no level' END], lambda x: x IS NOT NULL), ', ') AS warnings FROM (
      SELECT list, count(DISTINCT id) AS records, count(*) FILTER ({_cnic('cnic')} <> '') AS with_cnic, count(*) FILTER (trim(coalesce(father, '')) <> '') AS with_father,
        count(*) FILTER (trim(coalesce(province, '')) <> '') AS with_province, count(*) FILTER (trim(coalesce(pep_level, '')) <> '') AS with_level FROM list_records GROUP BY 1)""",
    "quality_metrics": """
      SELECT source, count(*) AS n, round(count(*) FILTER ((score >= 85) = cnic_match) / count(*), 6) AS accuracy, round(count(*) FILTER (score >= 85 AND cnic_match) / nullif(count(*) FILTER (cnic_match), 0), 6) AS recall,
        round(count(*) FILTER (score >= 85 AND NOT cnic_match) / nullif(count(*) FILTER (NOT cnic_match), 0), 6) AS false_alarms
      FROM (SELECT DISTINCT match_id, source, score, cnic_match FROM matches WHERE cnic_match IS NOT NULL) GROUP BY 1""",
    "pep_merge": r"""
      SELECT person, id, copies FROM (
        SELECT *, count(*) OVER (PARTITION BY person) AS copies, row_number() OVER (PARTITION BY person ORDER BY CASE list WHEN 'PEP admin upload' THEN 1 WHEN 'PEP assembly rosters' THEN 2 WHEN 'PEP knowledge base' THEN 3 WHEN 'PEP scratch import' THEN 4 ELSE 9 END, id) AS k
        FROM (SELECT id, list, array_to_string(list_sort(string_split(lower(trim(regexp_replace(primary_name, '\s+', ' ', 'g'))), ' ')), ' ') || '|' || coalesce(nullif(regexp_extract(coalesce(dob, ''), '([0-9]{4})', 1), ''), '') AS person
              FROM (SELECT DISTINCT id, list, primary_name, dob FROM list_records WHERE source_key = 'pep'))) WHERE k = 1""",
}

ORACLES |= {
    "evidence_manifest": "SELECT CAST(doc_id AS VARCHAR) AS name, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "monitored_people": """
      WITH a AS (SELECT id, max(last_monitored_at) AS last FROM applicants WHERE monitored GROUP BY 1),
      l AS (SELECT id, count(*) AS k FROM a JOIN (SELECT DISTINCT applicant_id, match_id, checked_at FROM matches) m ON m.applicant_id = a.id AND m.checked_at > a.last GROUP BY 1)
      SELECT a.id, coalesce(k, 0) AS open_alerts FROM a LEFT JOIN l USING (id)""",
}


def _norm_sql(col: str) -> str:
    """Upper-case letters, digits and single blanks: the character map as two ``translate`` tables and the few characters that become several letters."""
    one = {c: t for c, t in text.character_map().items() if len(t.strip()) == 1 and len(t) == 1}
    gone = [c for c, t in text.character_map().items() if t == ""]
    more = {c: t for c, t in text.character_map().items() if c not in one and t}
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"{quoted(c)}: {quoted(t)}" for c, t in more.items())
    kept = f"regexp_replace(translate({col}, {quoted(''.join([*one, *gone]))}, {quoted(''.join(one.values()))}), '[''`]', '', 'g')"
    spelled = f"array_to_string(list_transform(string_split({kept}, ''), lambda c: coalesce(map_extract_value(MAP {{{pairs}}}, c), c)), '')"
    return f"trim(regexp_replace(regexp_replace(upper({spelled}), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _values(rows, *columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") t({', '.join(columns)})"


_FUSABLE = sorted((s, c) for s in text.VARIANT.keys() | lexicon.FUSE_WORDS if (c := text.VARIANT.get(s, s)) in lexicon.FUSE_WORDS)
_ABDUL_NAMES = sorted({p + d + s: s for p in lexicon.ABDUL_PREFIXES for s in lexicon.ABDUL_SECOND for d in ("", s[0])}.items())
_SOUNDS = "w"
for _sound, _letter in lexicon.PHONETIC:
    _SOUNDS = f"replace({_SOUNDS}, '{_sound}', '{_letter}')"
# One letter of each run: the letters whose neighbour before differs.
_SINGLE = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: i = 1 OR string_split({0}, '')[i - 1] <> c), '')"
FOLD = f"""
  fuse AS (SELECT * FROM {_values(_FUSABLE, 's', 'c')}), abdul AS (SELECT * FROM {_values(_ABDUL_NAMES, 'fused', 'second')}), family AS (SELECT * FROM {_values(sorted(text.VARIANT.items()), 'spelling', 'canon')}),
  raw AS (SELECT DISTINCT unnest(toks) AS t FROM parts),
  u AS (SELECT t, unnest(CASE WHEN second IS NULL THEN [t] ELSE ['ABDUL', second] END) AS u, generate_subscripts(CASE WHEN second IS NULL THEN [t] ELSE ['ABDUL', second] END, 1) AS i FROM raw LEFT JOIN abdul ON fused = t),
  v AS (SELECT t, i, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM (SELECT *, CASE WHEN u LIKE '%ULLAH' AND length(u) >= 8 AND NOT ({' OR '.join(f"starts_with(u, '{p}')" for p in lexicon.ABDUL_PREFIXES)}) THEN [left(u, length(u) - 5), 'ULLAH'] ELSE [u] END AS x FROM u)),
  p AS (SELECT t, i, j, CASE WHEN length(v) >= 7 AND right(v, 2) IN ('UL', 'UR', 'US', 'UD') THEN left(v, length(v) - 2) ELSE v END AS v FROM v),
  cut AS (SELECT t, i, j, v, min(n) AS n FROM (SELECT *, unnest(range(3, length(v) - 2)) AS n FROM p WHERE length(v) >= 6 AND v NOT IN (SELECT s FROM fuse)) q
    JOIN fuse a ON a.s = left(v, n) JOIN fuse b ON b.s = substr(v, CAST(n AS INTEGER) + 1) WHERE NOT (a.c = 'ABDUL' AND b.c = 'ULLAH') GROUP BY 1, 2, 3, 4),
  w AS (SELECT t, i, j, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (SELECT p.*, CASE WHEN n IS NULL THEN [p.v] ELSE [left(p.v, n), substr(p.v, CAST(n AS INTEGER) + 1)] END AS x FROM p LEFT JOIN cut USING (t, i, j, v))),
  c AS (SELECT t, i, j, k, coalesce(canon, w) AS w FROM w LEFT JOIN family ON spelling = w),
  s AS (SELECT t, i, j, k, w, {_SOUNDS} AS h FROM c),
  fold AS (SELECT t, string_agg(CASE WHEN length(w) > 2 THEN {_SINGLE.format('h')} ELSE w END, ' ' ORDER BY i, j, k) AS f FROM s GROUP BY 1)"""
ORACLES |= {
    "norm_names_plain": f"SELECT DISTINCT id, {_norm_sql('full_name')} AS normed FROM applicants WHERE full_name IS NOT NULL",
    "folded_names": f"""
      WITH n AS (SELECT full_name AS name FROM applicants UNION SELECT unnest(names) FROM list_records WHERE lower(type) <> 'entity'),
      x AS (SELECT DISTINCT name, string_split({_norm_sql('name')}, ' ') AS all_toks FROM n WHERE name IS NOT NULL),
      parts AS (SELECT name, CASE WHEN len(k) > 0 THEN k ELSE list_filter(all_toks, lambda t: t <> '') END AS toks FROM (SELECT *, list_filter(all_toks, lambda t: t <> '' AND t NOT IN ({', '.join(f"'{h}'" for h in lexicon.HONORIFICS)})) AS k FROM x)),
      {FOLD},
      e AS (SELECT name, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM parts)
      SELECT parts.name, coalesce(string_agg(f, ' ' ORDER BY pos), '') AS folded FROM parts LEFT JOIN e ON e.name = parts.name LEFT JOIN fold USING (t) GROUP BY 1""",
}
