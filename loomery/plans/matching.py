"""Queries that read terms, places and résumé fields out of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.operators import place, resume, skills
from loomery.session import spread
from loomery.sources.tables import table

#: The résumé that every advertisement is matched with, and the places read from locations.
RESUME = "Python and Spark on Kubernetes; SQL, Kafka, Docker. Procurement and customer support."
COUNTRIES = {"de": ["germany", "deutschland"], "ca": ["canada"], "gb": ["united kingdom", "uk", "great britain"], "fr": ["france"], "jp": ["japan"], "us": ["usa", "united states", "us"]}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.explode(skills.terms_in(F.col("text"))).alias("term"))


def _fit(spark: SparkSession, d: str) -> DataFrame:
    return skills.fit(_documents(spark, d).withColumn("resume", F.lit(RESUME)), job="text")


def _market(spark: SparkSession, d: str) -> DataFrame:
    return skills.market(_fit(spark, d), 0.01)


def _competencies(spark: SparkSession, d: str) -> DataFrame:
    made = skills.competencies(_fit(spark, d), "doc_id", job="text")
    return made.select("doc_id", "grp", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), F.col("weight").cast("long").alias("weight"), "total", "percent", "ord")


def _structure(spark: SparkSession, d: str) -> DataFrame:
    made = resume.load(_documents(spark, d))
    groups = F.array_join(F.transform("competencies", lambda c: F.concat(c["grp"], F.lit(":"), F.array_join(c["terms"], ","))), ";")
    return made.select("doc_id", "usable", F.array_join("warnings", ",").alias("warnings"), F.array_join("skills", ",").alias("skills"), groups.alias("competencies"), F.array_join("titles", "|").alias("titles"), "years", "seniority", "summary")


def _locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_locations")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    kept = skills.signals(table(spark, d, "market_signals"))
    order = Window.partitionBy("report_id", "kind").orderBy(F.desc("postings"), F.desc_nulls_last("core_in"), F.asc_nulls_last("term"), "signal_id")
    return kept.withColumn("n", F.row_number().over(order)).where("n <= 8").select("report_id", "kind", "n", "term", "postings", "share")


def _seniority(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits")
    return hits.select("hit_id", resume.seniority(F.array(F.coalesce("title", F.lit(""))), F.lit(None).cast("double")).alias("level"))


def _resume(spark: SparkSession, d: str) -> DataFrame:
    held = resume.titles(F.col("text"))
    return _documents(spark, d).select("doc_id", F.array_join(held, " | ").alias("titles"), resume.query_of(F.lit(""), held, skills.terms_in(F.col("text"))).alias("query"))


_KNOWN = sorted({t.lower() for g in skills.TAXONOMY.values() for t in g})
_LAST = {t.lower(): g for g, ts in skills.TAXONOMY.items() for t in ts}
_LIST = lambda ts: "[" + ", ".join(f"'{t}'" for t in ts) + "]"
_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+#. ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


def _terms_sql(x: str, plain: str) -> str:
    words = f"list_transform(string_split({plain}, ' '), lambda w: regexp_replace(w, '\\.+$', ''))"
    single = f"list_filter({_LIST(t for t in _KNOWN if ' ' not in t)}, lambda t: list_contains({words}, t))"
    several = f"list_filter({_LIST(t for t in _KNOWN if ' ' in t)}, lambda t: contains({plain}, t))"
    shouted = f"list_transform(regexp_extract_all(coalesce({x}, ''), '\\b[A-Z]{{2,5}}\\b'), lambda t: lower(t))"
    return f"list_sort(list_distinct(list_concat({single}, {several}, {shouted})))"


_HELD = f"WITH plain AS (SELECT doc_id, text, {_NORM('text')} AS p FROM documents), held AS (SELECT doc_id, p, {_terms_sql('text', 'p')} AS terms FROM plain)"
_FIT = _HELD + f""", mine AS (SELECT {_terms_sql("'" + RESUME + "'", _NORM("'" + RESUME + "'"))} AS mine),
weighed AS (SELECT doc_id, t AS term, greatest(1, ((length(p) - length(replace(p, t, ''))) / length(t))::INTEGER) AS w, list_contains(mine, t) AS met
  FROM (SELECT doc_id, p, unnest(terms) AS t FROM held), mine),
fitted AS (SELECT doc_id, round_even(100 * sum(w) FILTER (met) / sum(w), 0)::INTEGER AS fit_percent, greatest(2, round_even(max(w) * 0.5::DOUBLE, 0))::INTEGER AS core_cut, count(*) AS n,
  string_agg(term, ',' ORDER BY w DESC, term) FILTER (met) AS matched, list(term ORDER BY w DESC, term) FILTER (NOT met) AS gaps FROM weighed GROUP BY doc_id)
"""
_WS = r"[\s\x0B\p{Z}]+"
_PLACE = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '{_WS}', ' ', 'g'), ' ')"
_MODE = (
    lambda x: f"CASE WHEN regexp_matches({x}, '{'|'.join(place.HYBRID)}') THEN 'hybrid' WHEN regexp_matches({x}, '{place.bounded(place.REMOTE)}') THEN 'remote' "  # noqa: E731
    f"WHEN regexp_matches({x}, '{place.bounded(place.GLOBAL)}') THEN 'remote' WHEN {x} <> '' THEN 'onsite' ELSE 'unknown' END"
)
_PIECES = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '[,/|;()\\[\\]–—-]| or | and '), lambda p: regexp_replace(p, '^[ .]+|[ .]+$', '', 'g')), lambda p: p <> '')"
_COUNTRY = lambda x: "CASE " + " ".join(f"WHEN list_has_any({x}, {_LIST(ns)}) THEN '{c}'" for c, ns in COUNTRIES.items()) + " END"


def _parse_sql() -> str:
    codes = {x: c for c, n in place.STATES.items() for x in (c, n)}
    abroad = {n: c for c, (names, cities) in place.COUNTRIES.items() for n in [*names, *cities]}
    bare = "p"
    for phrase in sorted([*place.HYBRID, *place.REMOTE], key=lambda p: (-len(p), p)):
        bare = f"regexp_replace({bare}, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])', '\\1 \\2', 'g')"
    bare = f"regexp_replace(regexp_replace({bare}, '^[ ,:()/|–—-]+|[ ,:()/|–—-]+$', '', 'g'), ' +', ' ', 'g')"
    of = lambda table, x: f"{_LIST(table.values())}[list_position({_LIST(table)}, {x})]"
    said = f"regexp_matches(p, '{place.bounded(place.US)}') OR list_contains({_LIST(place.US_ONLY)}, p) OR regexp_matches(regexp_replace(p, '(north|south|latin|central) america', ' ', 'g'), '{place.bounded(['america'])}')"
    mode = place.bounded([*place.HYBRID, *place.REMOTE])
    plain = f"x <> '' AND NOT list_contains({_LIST(codes)}, x) AND NOT list_contains({_LIST(place.US_ONLY)}, x) AND NOT regexp_matches(x, '{mode}')"
    usual = _LIST(names[0] for names, _ in place.COUNTRIES.values())
    cases = [
        ("p = ''", "NULL", "NULL", "NULL", "'UNKNOWN'", "'low'"), (f"list_contains({_LIST(place.US_ONLY)}, p) OR list_contains({_LIST(place.US_ONLY)}, bare)", "'us'", "NULL", "NULL", "'US'", "'high'"),
        (f"regexp_matches(p, '{place.bounded(place.GLOBAL)}')", "NULL", "NULL", "NULL", "'GLOBAL'", "'high'"), (f"regexp_extract(p, '{place.region_pattern(place.REGIONS)}', 1) <> ''", "NULL", "NULL", "NULL", "'REGION'", "'medium'"),
        ("named IS NOT NULL", of(abroad, "named"), "NULL", f"CASE WHEN length(named) > 2 AND NOT list_contains({usual}, named) THEN named END", "'COUNTRY'", "'high'"),
        ("anywhere <> ''", of(abroad, "anywhere"), "NULL", "NULL", "'COUNTRY'", "'medium'"),
        ("len(states) > 0", "'us'", "CASE WHEN len(states) = 1 THEN states[1] END", "city", "CASE WHEN len(states) = 1 AND said THEN 'US' ELSE 'US_STATES' END", "CASE WHEN sure THEN 'high' ELSE 'medium' END"),
        ("said", "'us'", "NULL", "NULL", "'US'", "'high'"),
    ]
    pick = lambda i, last: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {last} END"
    return f"""WITH a AS (SELECT location_id, {_PLACE('raw_location')} AS p FROM job_locations),
    b AS (SELECT *, {_PIECES('p')} AS held, {_MODE('p')} AS way, {said} AS said, {bare} AS bare, list_transform(string_split(p, ','), lambda x: trim(x)) AS commas, regexp_extract(p, '{place.anywhere_pattern(place.COUNTRIES)}', 1) AS anywhere FROM a),
    c AS (SELECT *, list_filter(held, lambda x: list_contains({_LIST(abroad)}, x)) AS foreigners, list_filter(held, lambda x: list_contains({_LIST(codes)}, x)) AS stated, list_filter(commas, lambda x: {plain})[1] AS city FROM b),
    d AS (SELECT *, list_filter(foreigners, lambda x: length(x) = list_max(list_transform(foreigners, lambda y: length(y))))[1] AS named, list_sort(list_distinct(list_transform(stated, lambda x: {of(codes, 'x')}))) AS states,
      said OR len(list_filter(stated, lambda x: length(x) > 2 OR NOT list_contains({_LIST(place.AMBIGUOUS)}, x))) > 0 AS sure FROM c)
    SELECT location_id, {pick(1, 'NULL')} AS country, {pick(2, 'NULL')} AS state, {pick(3, "CASE WHEN way <> 'remote' THEN nullif(commas[1], '') END")} AS city, way AS work_mode,
      CASE WHEN way = 'remote' THEN {pick(4, "'UNKNOWN'")} ELSE 'NOT_REMOTE' END AS remote_scope, {pick(5, "'low'")} AS confidence FROM d"""


def _scope_sql() -> str:
    cut = "p"
    for phrase in sorted([*place.HYBRID, *place.REMOTE], key=lambda p: (-len(p), p)):
        cut = f"regexp_replace({cut}, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])', '\\1\\2', 'g')"
    cut = f"regexp_replace(regexp_replace(regexp_replace({cut}, '\\( *\\)|\\[ *\\]', '', 'g'), ' +', ' ', 'g'), '^[ ,;:/|()\\[\\]–—-]+|[ ,;:/|(\\[–—-]+$', '', 'g')"
    return f"""SELECT location_id, {cut} AS place, CASE WHEN {_MODE('p')} <> 'remote' THEN 'NOT_REMOTE' WHEN regexp_matches(p, '{place.bounded(place.GLOBAL)}') THEN 'GLOBAL' WHEN country = 'us' AND len(remote_states) > 1 THEN 'US_STATES'
      WHEN country = 'us' THEN 'US' WHEN country IS NOT NULL THEN 'COUNTRY' ELSE 'UNKNOWN' END AS scope FROM (SELECT location_id, country, remote_states, {_PLACE('raw_location')} AS p FROM job_locations)"""


_CAPITALS = lambda x: f"array_to_string(list_transform(string_split(nullif({x}, ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_TITLES = f"""lines AS (SELECT doc_id, unnest(range(len(string_split_regex(coalesce(text, ''), '\\r?\\n')))) AS no, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line FROM documents),
heads AS (SELECT doc_id, no, trim(regexp_extract(line, '^\\s*([A-Z][A-Za-z0-9&/,.+ -]{{2,60}}?)\\s*([|@,–—-]|$)', 1), ' -|,') AS h FROM lines),
roles AS (SELECT * FROM heads WHERE length(h) BETWEEN 4 AND 60 AND len(list_filter({_LIST(resume.ROLES)}, lambda r: contains(lower(h), r))) > 0),
firsts AS (SELECT doc_id, arg_min(h, no) AS h, min(no) AS no FROM roles GROUP BY doc_id, lower(h)), titled AS (SELECT doc_id, list(h ORDER BY no)[1:6] AS titles FROM firsts GROUP BY doc_id)
"""
_YEARS = f"""tokens AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(\\d+(?:\\.\\d+)*|[a-z]+|[!-/:-`{{-\\x{{10ffff}}])', 1) AS t FROM documents),
spots AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i, t FROM tokens),
unit AS (SELECT *, i + 1 + CASE WHEN t[i + 1] = '+' THEN 1 + CASE WHEN t[i + 2] = '+' THEN 1 ELSE 0 END ELSE 0 END AS u FROM spots WHERE regexp_matches(w, '^\\d{{1,2}}(\\.\\d)?$')),
of_ AS (SELECT *, u + 1 + CASE WHEN t[u + 1] = 'of' THEN 1 ELSE 0 END AS o FROM unit WHERE t[u] IN ('year', 'years')), qualified AS (SELECT *, o + CASE WHEN list_contains({_LIST(resume.QUALIFIERS)}, t[o]) THEN 1 ELSE 0 END AS q FROM of_),
stated AS (SELECT doc_id, max(w::DOUBLE) AS years FROM qualified WHERE t[q] LIKE 'experience%' GROUP BY doc_id),
ends AS (SELECT *, i + 2 + CASE WHEN regexp_matches(coalesce(t[i + 2], ''), '^\\d{{1,2}}$') AND t[i + 3] IN ('/', '-') THEN 2 ELSE 0 END AS e FROM spots WHERE regexp_matches(w, '^\\d{{4}}$') AND list_contains({_LIST(resume.DASHES)}, t[i + 1])),
spans AS (SELECT doc_id, w::INTEGER AS a, CASE WHEN regexp_matches(t[e], '^({'|'.join(resume.NOWS)})') THEN {resume.NOW} WHEN regexp_matches(t[e], '^\\d{{4}}$') THEN t[e]::INTEGER END AS b FROM ends),
span AS (SELECT doc_id, (max(b) - min(a))::DOUBLE AS years FROM spans WHERE a >= 1980 AND a <= b AND b <= {resume.NOW} GROUP BY doc_id HAVING max(b) - min(a) BETWEEN 1 AND 50),
aged AS (SELECT doc_id, coalesce(stated.years, span.years) AS years FROM documents LEFT JOIN stated USING (doc_id) LEFT JOIN span USING (doc_id))
"""


def _seniority_sql() -> str:
    ladder = "CASE WHEN years IS NULL THEN '' WHEN years >= 12 THEN 'senior' WHEN years >= 5 THEN 'mid' ELSE 'entry' END"
    case = []
    for level, markers in resume.LEVELS.items():
        spelled = "|".join(m.replace(".", r"\.") + ("" if m.endswith(".") else r"($|[^a-z0-9])") for m in markers)
        value = f"coalesce(nullif({ladder}, ''), 'mid')" if level == "mid" else f"'{level}'"
        case.append(f"WHEN regexp_matches(lower(array_to_string(titles, ' | ')), '(^|[^a-z0-9])({spelled})') THEN {value}")
    return f"CASE {' '.join(case)} ELSE {ladder} END"


def _structure_sql() -> str:
    groups = ", ".join(
        f"CASE WHEN len(list_intersect({_LIST(sorted({t.lower() for t in ts}))}, skills)) > 0 THEN '{g}:' || array_to_string(list_sort(list_intersect({_LIST(sorted({t.lower() for t in ts}))}, skills)), ',') END" for g, ts in skills.TAXONOMY.items()
    )
    return f"""{_HELD}, {_TITLES}, {_YEARS}, cut AS (SELECT doc_id, list_filter(terms, lambda t: NOT list_contains({_LIST(resume.COLLISIONS)}, t)) AS skills FROM held),
    joined AS (SELECT doc_id, length(coalesce(text, '')) AS chars, skills, coalesce(titles, []) AS titles, years FROM documents JOIN cut USING (doc_id) LEFT JOIN titled USING (doc_id) LEFT JOIN aged USING (doc_id)),
    made AS (SELECT *, chars >= 400 AS usable, {_seniority_sql()} AS seniority FROM joined)
    SELECT doc_id, usable, CASE WHEN NOT usable THEN 'little text' WHEN len(skills) < 5 THEN 'few skills' ELSE '' END AS warnings, CASE WHEN usable THEN array_to_string(skills, ',') END AS skills,
      CASE WHEN usable THEN concat_ws(';', {groups}) END AS competencies, CASE WHEN usable THEN array_to_string(titles, '|') END AS titles, CASE WHEN usable THEN years END AS years, CASE WHEN usable THEN seniority END AS seniority,
      concat_ws(', ', format('{{:,}}', chars) || ' chars via text', CASE WHEN usable THEN len(skills) ELSE 0 END || ' skill term(s)', '~' || CASE WHEN usable THEN regexp_replace(years::VARCHAR, '\\.0$', '') END || ' yrs', CASE WHEN usable THEN nullif(seniority, '') END) AS summary FROM made"""


def _level_sql() -> str:
    case = []
    for level, markers in resume.LEVELS.items():
        spelled = "|".join(m.replace(".", r"\.") + ("" if m.endswith(".") else r"($|[^a-z0-9])") for m in markers)
        case.append(f"WHEN regexp_matches(t, '(^|[^a-z0-9])({spelled})') THEN '{level}'")
    return f"SELECT hit_id, CASE {' '.join(case)} ELSE '' END AS level FROM (SELECT hit_id, lower(coalesce(title, '')) AS t FROM hits)"


QUERIES = {
    "skills_extract": (_skills, _HELD + " SELECT doc_id, unnest(terms) AS term FROM held"),
    "fit_score": (
        lambda s, d: _fit(s, d).select("doc_id", "fit_percent", F.array_join("matched", ",").alias("matched"), F.array_join("gaps", ",").alias("gaps"), "core_cut", "confidence"),
        _FIT + """SELECT doc_id, coalesce(fit_percent, 0)::INTEGER AS fit_percent, coalesce(matched, '') AS matched, coalesce(array_to_string(gaps[1:8], ','), '') AS gaps, coalesce(core_cut, 2)::INTEGER AS core_cut,
        CASE WHEN n >= 12 THEN 'high' WHEN n >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM documents LEFT JOIN fitted USING (doc_id)""",
    ),
    "fit_core": (
        lambda s, d: _fit(s, d).select("doc_id", F.explode(F.concat("core_met", "core_missing")).alias("term"), "core_met").select("doc_id", "term", F.array_contains("core_met", F.col("term")).alias("met")),
        _FIT + "SELECT doc_id, term, met FROM weighed JOIN fitted USING (doc_id) WHERE w >= core_cut",
    ),
    "fit_competencies": (
        _competencies,
        _FIT + f""", groups AS (SELECT unnest({_LIST(_LAST)}) AS term, unnest({_LIST(_LAST.values())}) AS grp), places AS (SELECT unnest({_LIST(skills.TAXONOMY)}) AS grp, unnest(range({len(skills.TAXONOMY)})) AS place),
        made AS (SELECT doc_id, grp, coalesce(string_agg(term, ',' ORDER BY w DESC, term) FILTER (met), '') AS matched, coalesce(string_agg(term, ',' ORDER BY w DESC, term) FILTER (NOT met), '') AS missing, sum(w)::BIGINT AS weight,
          count(*) AS total, round_even(100 * count(*) FILTER (met) / count(*), 0)::INTEGER AS percent FROM weighed JOIN groups USING (term) GROUP BY doc_id, grp)
        SELECT doc_id, grp, matched, missing, weight, total::INTEGER AS total, percent, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, place)::INTEGER AS ord FROM made JOIN places USING (grp)""",
    ),
    "market_rollup": (
        _market,
        _FIT + """, each AS (SELECT f.doc_id, CASE WHEN w.met THEN 'strength' ELSE 'gap' END AS kind, w.term, w.w >= f.core_cut AS core FROM weighed w JOIN fitted f USING (doc_id) WHERE w.met OR list_contains(f.gaps[1:8], w.term)),
        totals AS (SELECT count(*) AS total, count(*) FILTER (n < 6) AS low FROM fitted), counted AS (SELECT kind, term, count(*) AS postings, count(*) FILTER (core) AS core_in FROM each GROUP BY ALL)
        SELECT kind, ord::INTEGER AS ord, term, postings::BIGINT AS postings, core_in::BIGINT AS core_in, total::BIGINT AS total, round(postings / total, 6) AS share, low::BIGINT AS low FROM (
          SELECT *, row_number() OVER (PARTITION BY kind ORDER BY postings DESC, core_in DESC, term) AS ord FROM counted, totals WHERE postings / total >= 0.01) WHERE ord <= 8""",
    ),
    "cover_opener": (
        lambda s, d: _fit(s, d).select("doc_id", skills.opener(F.col("matched")).alias("opener")),
        _FIT + """, four AS (SELECT doc_id, list(term ORDER BY w DESC, term)[1:4] AS m FROM weighed WHERE met GROUP BY doc_id)
        SELECT doc_id, CASE WHEN m IS NULL THEN '' WHEN len(m) = 1 THEN 'My experience covers ' || m[1] || '.' ELSE 'My experience covers ' || array_to_string(m[1:len(m) - 1], ', ') || ' and ' || m[len(m)] || '.' END AS opener
        FROM documents LEFT JOIN four USING (doc_id)""",
    ),
    "market_signals": (
        _signals,
        """SELECT report_id, kind, n::INTEGER AS n, term, postings, share FROM (SELECT report_id, kind, term, postings, round(postings / total, 6) AS share,
        row_number() OVER (PARTITION BY report_id, kind ORDER BY postings DESC, core_in DESC NULLS LAST, term NULLS LAST, signal_id) AS n FROM market_signals WHERE total > 0 AND postings / total >= 0.15) WHERE n <= 8""",
    ),
    "work_mode": (
        lambda s, d: _locations(s, d).select("location_id", place.work_mode(F.col("raw_location")).alias("mode")),
        f"SELECT location_id, {_MODE('p')} AS mode FROM (SELECT location_id, {_PLACE('raw_location')} AS p FROM job_locations)",
    ),
    "location_parts": (
        lambda s, d: _locations(s, d).select("location_id", F.array_join(place.parts(F.col("raw_location")), "|").alias("parts"), place.first_match(F.col("raw_location"), COUNTRIES).alias("country")),
        f"SELECT location_id, array_to_string(ps, '|') AS parts, {_COUNTRY('ps')} AS country FROM (SELECT location_id, {_PIECES(_PLACE('raw_location'))} AS ps FROM job_locations)",
    ),
    "location_parse": (
        lambda s, d: _locations(s, d).select("location_id", place.parse(F.col("raw_location")).alias("p")).select("location_id", "p.country", "p.state", "p.city", "p.work_mode", "p.remote_scope", "p.confidence"),
        _parse_sql(),
    ),
    "location_scope": (
        lambda s, d: _locations(s, d).select("location_id", place.without_mode(F.col("raw_location")).alias("place"), place.scope(F.col("raw_location"), F.col("country"), F.col("remote_states")).alias("scope")),
        _scope_sql(),
    ),
    "location_label": (
        lambda s, d: _locations(s, d).select("location_id", place.display(F.col("work_mode"), F.col("city"), F.col("state"), F.col("country")).alias("label")),
        f"""SELECT location_id, CASE WHEN named = '' THEN coalesce(lead, 'Unknown') ELSE concat_ws(' - ', lead, named) END AS label FROM (
        SELECT location_id, CASE WHEN work_mode IN ('remote', 'hybrid') THEN {_CAPITALS('work_mode')} END AS lead, concat_ws(', ', {_CAPITALS('city')}, upper(nullif(state, '')), upper(nullif(country, ''))) AS named FROM job_locations)""",
    ),
    "work_auth": (
        lambda s, d: _documents(s, d).select("doc_id", F.array_join(place.authorization(F.col("text")), ",").alias("signals")),
        "WITH p AS (SELECT doc_id, " + _PLACE("text") + " AS p FROM documents) SELECT doc_id, concat_ws(',', "
        + ", ".join(f"CASE WHEN regexp_matches(p, '{place.bounded([p for t in ts for p in place.expanded(t)])}') THEN '{c}' END" for c, ts in place.AUTHORIZATION.items()) + ") AS signals FROM p",
    ),
    "seniority": (_seniority, _level_sql()),
    "resume_years": (lambda s, d: _documents(s, d).select("doc_id", resume.years(F.col("text")).alias("years")), f"WITH {_YEARS} SELECT doc_id, years FROM aged"),
    "resume_structure": (_structure, _structure_sql()),
    "resume_query": (
        _resume,
        f"""{_HELD}, {_TITLES} SELECT doc_id, coalesce(array_to_string(titles, ' | '), '') AS titles, concat_ws(', ', titles[1], CASE WHEN len(terms) > 0 THEN array_to_string(list_transform(
          list_sort(list_transform(terms, lambda t: {{'w': -len(string_split(t, ' ')), 'n': -length(t), 's': t}}))[1:12], lambda x: x.s), ', ') END) AS query FROM held LEFT JOIN titled USING (doc_id)""",
    ),
}
