"""Queries that measure retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.operators import answer, evaluate
from loomery.operators.chunk import chunk
from loomery.operators.retrieve import Index
from loomery.plans import cleaning, search
from loomery.session import stash
from loomery.sources.tables import table

def _replies(spark: SparkSession, d: str) -> DataFrame:
    """A reply and a judge's words for each delivered hit, made from its own columns: id, top_sim, hits, reply, judged."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    reply = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" ["), told("dense_rank"), F.lit("] and ["), told("sparse_rank"), F.lit("], see ["), told("dense_rank"), F.lit("][1, 2]"),
        F.when(F.col("title").isNull(), f" {answer.REFUSAL}").otherwise(""),
    )
    judged = F.when(F.col("company").isNotNull(), F.concat(F.lit('Sure: {"total_claims": '), told("dense_rank"), F.lit(', "unsupported_claims": '), told("sparse_rank"), F.lit(', "worst": "x"} end'))).otherwise("no verdict")
    return table(spark, d, "hits").select(F.col("hit_id").alias("id"), F.col("sim").alias("top_sim"), F.lit(10).alias("hits"), F.when(F.col("section").isNotNull(), reply).alias("reply"), judged.alias("judged"))


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("id", F.array_join(answer.citations(F.col("reply"), F.col("hits")), ",").alias("cited"), answer.dangling(F.col("reply"), F.col("hits")).alias("dangling"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("id", answer.parse_verdict(F.col("judged")).alias("v")).select("id", "v.total", "v.unsupported", "v.worst", "v.ran")


def _guards(spark: SparkSession, d: str) -> DataFrame:
    asked = (F.col("top_sim"), F.col("reply"), answer.parse_verdict(F.col("judged")))
    return _replies(spark, d).select("id", answer.outcome(*asked).alias("outcome"), answer.reason(*asked).alias("reason"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered hit of a known question as an answer, with what was measured of it."""
    hits = table(spark, d, "hits").join(table(spark, d, "questions").select(F.col("id").alias("question_id"), "should_refuse"), "question_id")
    missing = F.col("sparse_rank").isNull()
    return hits.select(
        "should_refuse", (F.coalesce("sim", F.lit(0.0)) < 0.6).alias("refused"), F.col("dense_rank").alias("claims"), F.col("sparse_rank").alias("unsupported"), missing.alias("judge_failed"),
        F.size(answer.citation_numbers(F.col("text"))).alias("citations"), F.size(F.split(F.coalesce("title", F.lit("")), " ")).alias("bad_citations"), F.col("rerank_score").isNotNull().alias("widened"), (~missing).alias("verified"),
        (F.coalesce(F.col("sparse_rank") > F.col("dense_rank"), F.lit(False))).alias("overturned"), F.length(F.coalesce("text", F.lit(""))).alias("prompt_tokens"), F.col("score").alias("latency_s"),
    )


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Delivered hits as the ranking of each question."""
    hits = table(spark, d, "hits").where("question_id IS NOT NULL")
    return hits.withColumnRenamed("question_id", "qid").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "hit_id")))


def _context(spark: SparkSession, d: str) -> DataFrame:
    return answer.context(_ranked(spark, d).where("rank <= 5"))


def _per_question(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_hit(_ranked(spark, d).where("rank <= 5"), table(spark, d, "questions"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """Two ways of chunking, with and without BM25, with and without reranking (by length, standing in for a model)."""
    asked, rankings = table(spark, d, "questions").withColumn("qid", F.col("id")), {}
    for strategy in ("section", "fixed"):
        index = Index(stash(chunk(table(spark, d, "documents"), strategy)), key="id", dim=search.DIM, columns=("text",))
        ranked = index.rankings(asked, 40)
        for mode in ("hybrid", "dense"):
            for scorer in (None, search.longest):
                rankings[f"{strategy}/{mode}/{'rerank' if scorer else 'norerank'}"] = index.retrieve(asked, mode=mode, scorer=scorer, ranked=ranked)
    return evaluate.matrix(rankings, asked).drop("seconds")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sweep(_per_question(spark, d))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.coverage(table(spark, d, "questions"), table(spark, d, "documents"))


_TOLD = lambda c: f"coalesce({c}::VARCHAR, '0')"
_R = f"""WITH r AS (SELECT hit_id AS id, sim AS top_sim, 10 AS hits,
CASE WHEN section IS NOT NULL THEN coalesce(text, '') || ' [' || {_TOLD('dense_rank')} || '] and [' || {_TOLD('sparse_rank')} || '], see [' || {_TOLD('dense_rank')} || '][1, 2]' || CASE WHEN title IS NULL THEN ' {answer.REFUSAL}' ELSE '' END END AS reply,
CASE WHEN company IS NOT NULL THEN 'Sure: {{"total_claims": ' || {_TOLD('dense_rank')} || ', "unsupported_claims": ' || {_TOLD('sparse_rank')} || ', "worst": "x"}} end' ELSE 'no verdict' END AS judged FROM hits)"""
_V = _R + r""", b AS (SELECT *, regexp_extract(coalesce(judged, ''), '(?s)(\{.*\})', 1) AS body FROM r),
v AS (SELECT *, CASE WHEN body <> '' THEN (body->>'total_claims')::INTEGER END AS t, CASE WHEN body <> '' THEN (body->>'unsupported_claims')::INTEGER END AS u, CASE WHEN body <> '' THEN body->>'worst' END AS worst FROM b)"""
_OUTCOME = f"CASE WHEN coalesce(top_sim, 0) < 0.6 THEN 'refused: similarity' WHEN contains(coalesce(reply, ''), '{answer.REFUSAL}') THEN 'refused: model' WHEN t > 0 AND u / t > {answer.UNSUPPORTED} THEN 'refused: claims' ELSE 'answered' END"
_RANKED = """
WITH ranked AS (SELECT *, question_id AS qid, row_number() OVER (PARTITION BY question_id ORDER BY score DESC NULLS LAST, hit_id) AS rank FROM hits WHERE question_id IS NOT NULL)
"""
_HAS = lambda term, text: (
    f"CASE WHEN regexp_matches(lower({term}), '^[\\p{{L}}\\p{{N}}]+( [\\p{{L}}\\p{{N}}]+)*$') "
    f"THEN contains(' ' || regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ', ' ' || lower({term}) || ' ') ELSE contains(lower(coalesce({text}, '')), lower({term})) END"
)
_QUESTION = _RANKED + f""", terms AS (SELECT id, unnest(expect_terms) AS term FROM questions),
found AS (SELECT qid, min(rank) AS first_rank FROM ranked JOIN terms ON id = qid WHERE rank <= 5 AND {_HAS('term', 'text')} GROUP BY qid),
sims AS (SELECT qid, round(coalesce(max(sim), 0), 4) AS top_sim, count(*) AS n_hits FROM ranked WHERE rank <= 5 GROUP BY qid),
per AS (SELECT q.id AS qid, should_refuse, category, first_rank, coalesce(top_sim, 0) AS top_sim, n_hits FROM questions q LEFT JOIN sims ON sims.qid = q.id LEFT JOIN found ON found.qid = q.id)
"""
_METRICS = """count(*) FILTER (NOT should_refuse)::BIGINT AS answerable, round(count(first_rank) FILTER (NOT should_refuse) / greatest(count(*) FILTER (NOT should_refuse), 1), 4) AS hit_rate,
        round(coalesce(sum(1 / first_rank) FILTER (NOT should_refuse), 0) / greatest(count(*) FILTER (NOT should_refuse), 1), 4) AS mrr, round(avg(first_rank) FILTER (NOT should_refuse), 2) AS mean_first_hit,
        round(avg(top_sim) FILTER (NOT should_refuse), 4) AS sim_answerable, round(avg(top_sim) FILTER (should_refuse), 4) AS sim_refuse,
        round(avg(top_sim) FILTER (NOT should_refuse) - avg(top_sim) FILTER (should_refuse), 4) AS separation, round(avg(top_sim) FILTER (NOT should_refuse) - avg(top_sim) FILTER (category = 'off_domain'), 4) AS separation_off_domain"""


def _matrix_sql() -> str:
    parts, names = [], []
    for strategy in ("section", "fixed"):
        docs = f"(SELECT id AS doc_id, text FROM {strategy}_chunks)"
        for mode in ("hybrid", "dense"):
            for k, rank, name in ((20, "rank", "norerank"), (40, "row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, rank)", "rerank")):
                ranked = "FROM fused" if mode == "hybrid" else "FROM (SELECT qid, doc_id, rank FROM dense)"
                found = search.wide_sql(k).replace("FROM documents", f"FROM {docs}").strip()
                names.append(f"{strategy}_{mode}_{name}")
                parts.append(f"""{names[-1]} AS ({found} SELECT * FROM (SELECT '{strategy}/{mode}/{name}' AS config, qid, {rank} AS rank, round(sim, 6) AS sim, text
                {ranked} JOIN sims USING (qid, doc_id) JOIN {docs} USING (doc_id)) WHERE rank <= 5)""")
    return f"""{cleaning.chunk_sql()}, {", ".join(parts)}, ranked AS ({" UNION ALL ".join(f"FROM {n}" for n in names)}),
    terms AS (SELECT id, unnest(expect_terms) AS term FROM questions), found AS (SELECT config, qid, min(rank) AS first_rank FROM ranked JOIN terms ON id = qid WHERE {_HAS('term', 'text')} GROUP BY ALL),
    best AS (SELECT config, qid, round(coalesce(max(sim), 0), 4) AS top_sim FROM ranked GROUP BY ALL),
    per AS (SELECT c.config, q.id AS qid, should_refuse, category, first_rank, coalesce(top_sim, 0) AS top_sim FROM (SELECT DISTINCT config FROM ranked) c CROSS JOIN questions q
      LEFT JOIN best ON best.qid = q.id AND best.config = c.config LEFT JOIN found ON found.qid = q.id AND found.config = c.config),
    measured AS (SELECT config, {_METRICS} FROM per GROUP BY config)"""


_SWEEP = _QUESTION + """, swept AS (SELECT thr, count(*) FILTER (top_sim < thr AND should_refuse) AS tp, count(*) FILTER (top_sim >= thr AND should_refuse) AS fn,
count(*) FILTER (top_sim < thr AND NOT should_refuse) AS fp, count(*) FILTER (top_sim >= thr AND NOT should_refuse) AS tn, round((tp + tn) / greatest(tp + tn + fp + fn, 1), 3) AS accuracy
FROM per, (SELECT round(i / 20, 2) AS thr FROM range(21) t(i)) GROUP BY thr)
"""

QUERIES = {
    "citations_extract": (
        _citations,
        _R + r""", n AS (SELECT id, hits, list_transform(regexp_extract_all(coalesce(reply, ''), '\[(\d{1,9})\]', 1), lambda x: x::INTEGER) AS ns FROM r),
        g AS (SELECT id, hits, ns, list_filter(ns, lambda x: x >= 1 AND x <= hits) AS ok FROM n)
        SELECT id, array_to_string(list_filter(ok, lambda x, i: NOT list_contains(ok[1:i - 1], x)), ',') AS cited, (len(ns) - len(ok))::INTEGER AS dangling FROM g""",
    ),
    "verdict_parse": (_verdicts, _V + " SELECT id, coalesce(CASE WHEN u IS NOT NULL THEN t END, 0)::INTEGER AS total, coalesce(CASE WHEN t IS NOT NULL THEN u END, 0)::INTEGER AS unsupported, CASE WHEN t IS NOT NULL AND u IS NOT NULL THEN worst END AS worst, t IS NOT NULL AND u IS NOT NULL AS ran FROM v"),
    "guard_outcomes": (
        _guards,
        _V + f""" SELECT id, outcome, CASE outcome WHEN 'refused: similarity' THEN 'top similarity ' || round(coalesce(top_sim, 0), 4) || ' < 0.6' WHEN 'refused: model' THEN 'the model found the context insufficient'
        WHEN 'refused: claims' THEN u || '/' || t || ' claims unsupported' END AS reason FROM (SELECT *, {_OUTCOME} AS outcome FROM v)""",
    ),
    "context_block": (
        _context,
        _RANKED + """SELECT qid, string_agg('[' || rank || '] ' || coalesce(nullif(company, ''), 'Unknown company') || ' - ' || coalesce(nullif(title, ''), 'Untitled role')
          || CASE WHEN section IS NOT NULL AND section NOT IN ('', 'other', 'unknown') THEN ', ' || replace(section, '_', ' ') ELSE '' END || CASE WHEN location <> '' THEN ' | ' || location ELSE '' END
          || CASE WHEN compensation <> '' THEN ' | pay: ' || compensation ELSE '' END || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
        FROM ranked WHERE rank <= 5 GROUP BY qid""",
    ),
    "first_hit_rank": (
        lambda s, d: _per_question(s, d).select("qid", "first_rank", "top_sim", F.coalesce("n_hits", F.lit(0)).alias("n_hits")),
        _QUESTION + "SELECT qid, first_rank::INTEGER AS first_rank, top_sim, coalesce(n_hits, 0)::BIGINT AS n_hits FROM per",
    ),
    "retrieval_metrics": (
        lambda s, d: evaluate.retrieval_metrics(_per_question(s, d)),
        _QUESTION + f"SELECT {_METRICS} FROM per",
    ),
    "retrieval_matrix": (_matrix, _matrix_sql() + " SELECT * FROM measured"),
    "best_configuration": (
        lambda s, d: evaluate.best_configuration(_matrix(s, d)),
        _matrix_sql() + " SELECT (SELECT config FROM measured ORDER BY mrr DESC NULLS LAST, separation DESC NULLS LAST, config LIMIT 1) AS config, (SELECT config FROM measured ORDER BY separation DESC NULLS LAST, config LIMIT 1) AS cleanest",
    ),
    "threshold_sweep": (_sweep, _SWEEP + "SELECT thr, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, tn::BIGINT AS tn, accuracy FROM swept"),
    "best_threshold": (
        lambda s, d: evaluate.best_threshold(_sweep(s, d)),
        _SWEEP + "SELECT thr, accuracy, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, thr > 0 AND tp > 0 AS works FROM swept ORDER BY accuracy DESC, fn, thr LIMIT 1",
    ),
    "generation_metrics": (
        lambda s, d: evaluate.generation_metrics(_answers(s, d)),
        r"""WITH a AS (SELECT should_refuse, coalesce(sim, 0) < 0.6 AS refused, dense_rank AS claims, sparse_rank AS unsupported, sparse_rank IS NULL AS judge_failed, len(regexp_extract_all(coalesce(text, ''), '\[(\d{1,9})\]')) AS citations,
          len(string_split(coalesce(title, ''), ' ')) AS bad_citations, rerank_score IS NOT NULL AS widened, sparse_rank IS NOT NULL AS verified, coalesce(sparse_rank > dense_rank, FALSE) AS overturned, length(coalesce(text, '')) AS prompt_tokens, score AS latency_s
          FROM hits JOIN questions ON questions.id = hits.question_id),
        l AS (SELECT latency_s, row_number() OVER (ORDER BY latency_s) AS pos, count(*) OVER () AS n FROM a WHERE latency_s IS NOT NULL),
        p AS (SELECT round(quantile_cont(latency_s, 0.5), 6) AS p50_latency_s, round(max(CASE WHEN pos = CASE WHEN floor(n * 0.95) = 0 THEN n ELSE floor(n * 0.95) END THEN latency_s END), 6) AS p95_latency_s FROM l)
        SELECT count(*)::BIGINT AS answers, round(count(*) FILTER (refused = should_refuse) / count(*), 4) AS refusal_accuracy, count(*) FILTER (should_refuse AND NOT refused)::BIGINT AS missed,
        count(*) FILTER (refused AND NOT should_refuse)::BIGINT AS over_refusals, round(1 - sum(unsupported) FILTER (NOT refused AND NOT judge_failed) / sum(claims) FILTER (NOT refused AND NOT judge_failed), 4) AS faithfulness,
        count(*) FILTER (NOT refused AND judge_failed)::BIGINT AS judge_failures, count(*) FILTER (NOT refused AND citations > 0)::BIGINT AS cited, sum(bad_citations)::BIGINT AS dangling, count(*) FILTER (widened AND NOT refused)::BIGINT AS rescued,
        count(*) FILTER (verified)::BIGINT AS checked, count(*) FILTER (overturned)::BIGINT AS overturned, count(*) FILTER (overturned AND should_refuse)::BIGINT AS overturned_rightly, count(*) FILTER (overturned AND NOT should_refuse)::BIGINT AS overturned_wrongly,
        floor(avg(prompt_tokens) FILTER (NOT refused))::BIGINT AS mean_prompt_tokens, any_value(p50_latency_s) AS p50_latency_s, any_value(p95_latency_s) AS p95_latency_s FROM a, p""",
    ),
    "score_percentiles": (
        lambda s, d: evaluate.percentiles(table(s, d, "hits"), "score"),
        """WITH v AS (SELECT score, row_number() OVER (ORDER BY score) AS pos, count(*) OVER () AS n FROM hits WHERE score IS NOT NULL)
        SELECT round(quantile_cont(score, 0.5), 6) AS p50, round(max(CASE WHEN pos = CASE WHEN floor(n * 0.95) = 0 THEN n ELSE floor(n * 0.95) END THEN score END), 6) AS p95 FROM v""",
    ),
    "term_coverage": (
        _coverage,
        f"""WITH terms AS (SELECT DISTINCT id, lower(t) AS term FROM (SELECT id, unnest(expect_terms) AS t FROM questions)),
        met AS (SELECT id, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources FROM terms, documents WHERE text IS NOT NULL AND {_HAS('term', 'text')} GROUP BY id)
        SELECT q.id, coalesce(docs, 0)::BIGINT AS docs, coalesce(sources, 0)::BIGINT AS sources, CASE WHEN coalesce(docs, 0) = 0 THEN 'NOT IN CORPUS' WHEN docs <= 3 THEN 'THIN' ELSE 'ok' END AS label FROM questions q LEFT JOIN met USING (id)""",
    ),
}
