"""Queries that clean, cut and sample texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import clean_lines, fingerprint, html_to_text, paragraphs
from loomery.operators import chunk
from loomery.operators.boilerplate import Boilerplate
from loomery.operators.sample import first_of_each, round_robin, snapshot_delta, top_counts
from loomery.sources.tables import table

RULES = Boilerplate()


def _paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(paragraphs(F.col("text"), "\n")).alias("pos", "paragraph"))


def _paragraph_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _paragraph_split(spark, d).where(F.length("paragraph") >= 40).select("doc_id", "pos", fingerprint(F.col("paragraph")).alias("fp"))


def _min_body_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") >= 200).select("doc_id", F.length("text").cast("long").alias("chars"))


def _html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", html_to_text(F.col("text")).alias("plain"))


def _clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean_lines(F.col("text")).alias("clean"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits")


def _chunks(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return chunk.chunk(table(spark, d, "documents"), strategy, carry=("lang", "url"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "section").unionByName(_chunks(spark, d, "fixed"))


def _section_split(spark: SparkSession, d: str) -> DataFrame:
    return chunk.sections(table(spark, d, "documents"), "doc_id", "text").groupBy("key", "section").agg(F.count(F.lit(1)).alias("bodies"), F.sum(F.length("body")).alias("chars")).withColumnRenamed("key", "doc_id")


def _delta(spark: SparkSession, d: str) -> DataFrame:
    """Each advertisement as last crawled in the first half of the crawl's days, against the second half."""
    rows = table(spark, d, "documents").withColumn("day", F.to_date("crawled_at"))
    middle = rows.agg(F.date_add(F.min("day"), F.floor(F.datediff(F.max("day"), F.min("day")) / 2).cast("int"))).scalar()
    late = F.coalesce(F.col("day") >= middle, F.lit(False))
    last = lambda part: part.groupBy("ad_id").agg(F.max_by(F.struct("text", "source"), F.struct("crawled_at", "doc_id")).alias("s")).select("ad_id", "s.text", "s.source")
    return snapshot_delta(last(rows.where(~late)), last(rows.where(late)), "ad_id", ["text", "source"])


B = r"[\s\x0B\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"
_PARTS = lambda x: f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda p: {_STRIP('p')}), lambda p: p <> '')"
_FP = lambda x: f"sha1(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' '))"
_PARAGRAPHS = f"""
WITH parts AS (SELECT doc_id, {_PARTS('text')} AS ps FROM documents),
paragraphs AS (SELECT doc_id, unnest(range(len(ps)))::INTEGER AS pos, unnest(ps) AS paragraph FROM parts)
"""
_BOILER = f"""
WITH docs AS (SELECT hit_id, coalesce(nullif(company, ''), 'unknown') AS company, coalesce(text, '') AS text, {_PARTS('text')} AS ps FROM hits),
placed AS (SELECT hit_id, company, unnest(range(len(ps))) AS pos, unnest(ps) AS paragraph FROM docs),
printed AS (SELECT *, CASE WHEN length(paragraph) >= 40 THEN {_FP('paragraph')} END AS fp FROM placed),
sizes AS (SELECT company, count(*) AS n_docs FROM docs GROUP BY company),
counted AS (SELECT company, fp, count(DISTINCT hit_id) AS n FROM printed WHERE fp IS NOT NULL GROUP BY company, fp),
own AS (SELECT company, fp, n, n_docs FROM counted JOIN sizes USING (company) WHERE n_docs >= 3 AND n >= greatest(2, round_even(n_docs * 0.15::DOUBLE, 0))),
shared AS (SELECT fp, count(*) AS companies FROM counted GROUP BY fp HAVING count(*) >= greatest(3, round_even((SELECT count(*) FROM sizes) * 0.15::DOUBLE, 0))),
marked AS (SELECT p.*, o.fp IS NULL AND s.fp IS NULL AS keep FROM printed p LEFT JOIN own o ON p.company = o.company AND p.fp = o.fp LEFT JOIN shared s ON p.fp = s.fp),
texts AS (SELECT hit_id, coalesce(string_agg(paragraph, chr(10) ORDER BY pos) FILTER (keep), '') AS text, count(*) FILTER (NOT keep) AS dropped FROM marked GROUP BY hit_id),
stripped AS (SELECT d.hit_id, d.company, coalesce(t.text, '') AS text, coalesce(t.dropped, 0)::BIGINT AS dropped, length(d.text)::BIGINT AS chars_before, length(coalesce(t.text, ''))::BIGINT AS chars_after
  FROM docs d LEFT JOIN texts t USING (hit_id))
"""


def _heading_sql() -> str:
    pattern = chunk.HEADING.replace("'", "''")
    case = " ".join(f"WHEN regexp_matches(line, '(?i)({'|'.join(p)})') THEN '{name}'" for name, p in chunk.HEADINGS.items())
    return f"""
    WITH lines AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    marked AS (SELECT *, regexp_matches(line, '{pattern}') AS heading FROM lines),
    islands AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM marked),
    named AS (SELECT doc_id, island, coalesce(max(CASE WHEN heading THEN CASE {case} ELSE 'other' END END), 'other') AS section,
      coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT heading), '') AS body FROM islands GROUP BY doc_id, island),
    stripped AS (SELECT doc_id, island, section, {_STRIP('body')} AS body FROM named)"""


_SPLIT = " SELECT doc_id, section, count(*)::BIGINT AS bodies, sum(length(body))::BIGINT AS chars FROM stripped WHERE body <> '' GROUP BY doc_id, section"
_PLAIN = lambda x: f"replace(replace(replace({x}, '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')"


def chunk_sql(size: int = 1600, overlap: int = 200, least: int = 80) -> str:
    """Tables fixed_chunks, section_chunks and both_chunks: windows packed by recursion over each body's paragraphs."""
    step, parts = size - overlap, _PARTS("body").replace("chr(10))", "chr(10) || chr(10))")
    fits = f"(cur = '' OR length(cur) + length(p) + 2 <= {size})"
    head = "coalesce(nullif(source, ''), 'Unknown company') || ' - ' || coalesce(nullif(title, ''), 'Untitled role')"

    def made(name: str, origin: str) -> str:
        return f"""
    {name}_fold AS (
      SELECT doc_id, ord, section, body, {parts} AS ps, 0 AS i, []::VARCHAR[] AS out, '' AS cur FROM {origin}
      UNION ALL
      SELECT doc_id, ord, section, body, ps, i + 1, list_concat(kept, list_transform(range(cuts), lambda k: substr(grown, 1 + k * {step}, {size}))), substr(grown, 1 + cuts * {step}) FROM (
        SELECT *, greatest(ceil((length(grown) - {size}) / {step}), 0)::BIGINT AS cuts FROM (
          SELECT *, CASE WHEN {fits} THEN out ELSE list_append(out, cur) END AS kept, CASE WHEN cur = '' THEN p WHEN {fits} THEN cur || chr(10) || chr(10) || p ELSE right(cur, {overlap}) || chr(10) || chr(10) || p END AS grown
          FROM (SELECT *, ps[i + 1] AS p FROM {name}_fold WHERE i < len(ps))))),
    {name}_cut AS (SELECT doc_id, ord, section, list_filter(CASE WHEN length(body) <= {size} THEN [body] ELSE list_append(out, cur) END, lambda x: regexp_matches(x, '[^\\s\\x0B\\p{{Z}}]')) AS pieces FROM {name}_fold WHERE i = len(ps)),
    {name}_each AS (SELECT doc_id, ord, section, unnest(range(len(pieces))) AS j, unnest(pieces) AS raw FROM {name}_cut),
    {name}_placed AS (SELECT doc_id, section, raw, row_number() OVER (PARTITION BY doc_id ORDER BY ord, j) - 1 AS n FROM {name}_each)"""

    def told(name: str, origin: str) -> str:
        return f"""SELECT doc_id || '::{name}::' || n AS id, doc_id, '{name}' AS strategy, section, raw,
      {head} || CASE WHEN section IN ('other', 'unknown') THEN '' ELSE ' [' || replace(section, '_', ' ') || ']' END || chr(10) || chr(10) || raw AS text, lang, url FROM {origin} JOIN documents USING (doc_id) WHERE length(raw) >= {least}"""

    sections = _heading_sql().strip().removeprefix("WITH")
    return f"""WITH RECURSIVE {sections}, bodies AS (SELECT doc_id, island AS ord, section, body FROM stripped JOIN documents USING (doc_id) WHERE body <> '' AND text IS NOT NULL),
    wholes AS (SELECT doc_id, 0 AS ord, 'unknown' AS section, text AS body FROM documents WHERE text IS NOT NULL), {made("fixed", "wholes")}, {made("section", "bodies")},
    fixed_chunks AS ({told("fixed", "fixed_placed")}),
    section_chunks AS ({told("section", "section_placed")} UNION ALL {told("fixed", "(FROM fixed_placed WHERE doc_id NOT IN (SELECT doc_id FROM section_placed)) x")}),
    both_chunks AS (FROM fixed_chunks UNION ALL FROM section_chunks)"""


_STATS = ", stats AS (SELECT strategy, count(*) AS chunks, floor(sum(length(raw)) / count(*)) AS mean_chars, min(length(raw)) AS min_chars, max(length(raw)) AS max_chars FROM both_chunks GROUP BY strategy)"


QUERIES = {
    "paragraph_split": (_paragraph_split, _PARAGRAPHS + "SELECT * FROM paragraphs"),
    "paragraph_fingerprint": (_paragraph_fingerprint, _PARAGRAPHS + f"SELECT doc_id, pos, {_FP('paragraph')} AS fp FROM paragraphs WHERE length(paragraph) >= 40"),
    "min_body_filter": (_min_body_filter, "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE length(text) >= 200"),
    # the only entities of these tables are &amp;, &#39; and &nbsp;
    "html_to_text": (
        _html_to_text,
        f"""WITH a AS (SELECT doc_id, {_PLAIN("coalesce(text, '')")} AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)<\\s*(?:br|/(?:p|div|li|h[1-6]|tr))\\s*/?>', chr(10), 'g'), '(?i)<\\s*li[^>]*>', chr(10) || '- ', 'g') AS t FROM a),
        c AS (SELECT doc_id, regexp_replace({_PLAIN("regexp_replace(t, '<[^>]+>', ' ', 'g')")}, '[ \\t\\x{{a0}}]+', ' ', 'g') AS t FROM b),
        d AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_STRIP('x')}), chr(10)) AS t FROM c)
        SELECT doc_id, {_STRIP("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} AS plain FROM d""",
    ),
    "clean_lines": (
        _clean_lines,
        f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{a0}}]+', ' ', 'g') AS t FROM documents),
        b AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_STRIP('x')}), chr(10)) AS t FROM a)
        SELECT doc_id, {_STRIP("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM b""",
    ),
    "boilerplate_company": (lambda s, d: RULES.of_company(_hits(s, d)), _BOILER + "SELECT company, fp, n::BIGINT AS n, n_docs::BIGINT AS n_docs FROM own"),
    "boilerplate_global": (lambda s, d: RULES.of_all(_hits(s, d)), _BOILER + "SELECT fp, companies::BIGINT AS companies FROM shared"),
    "boilerplate_strip": (lambda s, d: RULES.stripped(_hits(s, d)), _BOILER + "SELECT * FROM stripped"),
    "boilerplate_summary": (
        lambda s, d: RULES.summary(_hits(s, d)),
        _BOILER + """SELECT count(*)::BIGINT AS docs, count(DISTINCT company)::BIGINT AS companies, sum(dropped)::BIGINT AS dropped, sum(chars_before)::BIGINT AS chars_before, sum(chars_after)::BIGINT AS chars_after,
        round(100 * (sum(chars_before) - sum(chars_after)) / greatest(sum(chars_before), 1), 4)::DOUBLE AS pct_removed, floor(sum(chars_after) / count(*))::BIGINT AS mean_chars FROM stripped""",
    ),
    "boilerplate_top_offenders": (
        lambda s, d: RULES.offenders(_hits(s, d)),
        _BOILER + """, top AS (SELECT *, round(n / n_docs, 6) AS share FROM own ORDER BY share DESC, n DESC, company, fp LIMIT 6)
        SELECT company, fp, n::BIGINT AS n, n_docs::BIGINT AS n_docs, share::DOUBLE AS share, (SELECT arg_min(paragraph, hit_id * 1000000 + pos) FROM printed p WHERE p.company = top.company AND p.fp = top.fp) AS sample FROM top""",
    ),
    "boilerplate_most_shared": (
        lambda s, d: RULES.most_shared(_hits(s, d)),
        _BOILER + """, top AS (SELECT fp, companies FROM shared ORDER BY companies DESC, fp LIMIT 3)
        SELECT fp, companies::BIGINT AS companies, (SELECT arg_min(paragraph, hit_id * 1000000 + pos) FROM printed p WHERE p.fp = top.fp) AS sample FROM top""",
    ),
    "boilerplate_most_repeated": (
        lambda s, d: RULES.most_repeated(_hits(s, d)),
        _BOILER + """, top AS (SELECT * FROM own ORDER BY n DESC, company, fp LIMIT 5)
        SELECT company, fp, n::BIGINT AS n, n_docs::BIGINT AS n_docs, (SELECT arg_min(paragraph, hit_id * 1000000 + pos) FROM printed p WHERE p.company = top.company AND p.fp = top.fp) AS sample FROM top""",
    ),
    "section_split": (_section_split, _heading_sql() + _SPLIT),
    "chunk_fixed": (lambda s, d: _chunks(s, d, "fixed"), chunk_sql() + " SELECT * FROM fixed_chunks"),
    "chunk_section": (lambda s, d: _chunks(s, d, "section"), chunk_sql() + " SELECT * FROM section_chunks"),
    "chunk_stats": (lambda s, d: chunk.stats(_both(s, d)), chunk_sql() + _STATS + " SELECT strategy, chunks::BIGINT AS chunks, mean_chars::BIGINT AS mean_chars, min_chars::INTEGER AS min_chars, max_chars::INTEGER AS max_chars FROM stats"),
    "chunk_sections_counted": (
        lambda s, d: chunk.section_stats(_both(s, d)),
        chunk_sql() + """, n AS (SELECT strategy, section, count(*) AS chunks FROM both_chunks GROUP BY ALL)
        SELECT strategy, section, chunks::BIGINT AS chunks, round(chunks / sum(chunks) OVER (PARTITION BY strategy), 4) AS share, row_number() OVER (PARTITION BY strategy ORDER BY chunks DESC, section)::INTEGER AS ord FROM n""",
    ),
    "strategy_compare": (
        lambda s, d: chunk.compare(_both(s, d)),
        chunk_sql() + _STATS + """, f AS (FROM stats WHERE strategy = 'fixed'), s AS (FROM stats WHERE strategy = 'section')
        SELECT s.chunks::BIGINT AS section_chunks, s.mean_chars::BIGINT AS section_mean, f.chunks::BIGINT AS fixed_chunks, f.mean_chars::BIGINT AS fixed_mean,
        round(s.chunks / greatest(f.chunks, 1), 4) AS count_ratio, round(s.mean_chars / greatest(f.mean_chars, 1), 4) AS size_ratio FROM f, s""",
    ),
    "per_source_cap": (
        lambda s, d: first_of_each(table(s, d, "documents").select("doc_id", "source"), 10, "source", "doc_id"),
        "SELECT doc_id, source, slot::INTEGER AS slot FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'unknown') ORDER BY doc_id) AS slot FROM documents) WHERE slot <= 10",
    ),
    "roundrobin_sample": (
        lambda s, d: round_robin(table(s, d, "documents").select("doc_id", "source"), 40, "source", "doc_id"),
        """WITH a AS (SELECT doc_id, source, coalesce(nullif(source, ''), 'unknown') AS name FROM documents),
        b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS slot, count(*) OVER (PARTITION BY name) AS width, min(doc_id) OVER (PARTITION BY name) AS first FROM a)
        SELECT doc_id, source, slot::INTEGER AS slot FROM b ORDER BY slot, width DESC, first LIMIT 40""",
    ),
    "count_by_category": (
        lambda s, d: _hits(s, d).groupBy(F.coalesce(F.nullif("section", F.lit("")), F.lit("unknown")).alias("section")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT coalesce(nullif(section, ''), 'unknown') AS section, count(*)::BIGINT AS n FROM hits GROUP BY 1",
    ),
    "top_categories": (
        lambda s, d: top_counts(table(s, d, "job_locations"), "work_mode"),
        "SELECT *, row_number() OVER (ORDER BY n DESC, work_mode)::INTEGER AS ord FROM (SELECT coalesce(nullif(work_mode, ''), 'unknown') AS work_mode, count(*)::BIGINT AS n FROM job_locations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)",
    ),
    "snapshot_delta": (
        _delta,
        """WITH rows AS (SELECT *, coalesce(crawled_at::DATE >= (SELECT min(crawled_at::DATE) + (max(crawled_at::DATE) - min(crawled_at::DATE))::INTEGER // 2 FROM documents), FALSE) AS late FROM documents),
        a AS (SELECT ad_id, text, source FROM rows WHERE NOT late QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY crawled_at DESC NULLS LAST, doc_id DESC) = 1),
        b AS (SELECT ad_id, text, source FROM rows WHERE late QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY crawled_at DESC NULLS LAST, doc_id DESC) = 1)
        SELECT ad_id, CASE WHEN a.ad_id IS NULL THEN 'new' WHEN b.ad_id IS NULL THEN 'closed' WHEN a.text IS DISTINCT FROM b.text OR a.source IS DISTINCT FROM b.source THEN 'changed' ELSE 'same' END AS state
        FROM a FULL JOIN b USING (ad_id)""",
    ),
}
