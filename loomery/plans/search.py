"""Queries that search: the questions against all documents, and every fiftieth vector against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import citation_label, tokens
from loomery.operators import retrieve
from loomery.operators.retrieve import Bm25, Filters, Index, hashing_vector, nearest, only_in
from loomery.sources.tables import table

DIM = 256


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select(F.col("id").alias("qid"), "question")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("company", F.col("source"))


def _index(spark: SparkSession, d: str) -> Index:
    return Index(_documents(spark, d), dim=DIM)


def _bm25(spark: SparkSession, d: str) -> Bm25:
    return Bm25(_documents(spark, d))


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).search(_questions(spark, d))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    asked = hashing_vector(_questions(spark, d), "qid", "question", DIM)
    return nearest(hashing_vector(_documents(spark, d), "doc_id", "text", DIM), asked, retrieve.FETCH, "doc_id")


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    index, asked = _index(spark, d), _questions(spark, d)
    return index.dense(asked), index.sparse(asked)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).fused(_questions(spark, d))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).retrieve(_questions(spark, d))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d).select("qid", "doc_id", "rank", "score", "sim", citation_label(F.col("company"), F.col("title")).alias("source"))


def _filters(spark: SparkSession, d: str) -> DataFrame:
    found = _index(spark, d).retrieve(_questions(spark, d), Filters(country="de").column(country="lang"), mode="dense")
    return found.select("qid", "doc_id", "rank", F.round("sim", 6).alias("sim"))


def longest(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in for a reranking model: longer texts score higher."""
    return [float(len(text or "")) for _, text in pairs]


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).retrieve(_questions(spark, d), scorer=longest).select("qid", "doc_id", "rank", "fused_rank", "rerank_score")


def _widened(spark: SparkSession, d: str) -> DataFrame:
    found = _index(spark, d).widened(_questions(spark, d), 0.7, k=3, first=9)
    return found.groupBy("qid", "widened").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("sim"), 6).alias("top_sim"))


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _cosine(spark: SparkSession, d: str, labels: tuple[int, ...] = ()) -> DataFrame:
    rows, asked = _embedded(spark, d)
    kept = rows.where(F.col("label").isin(*labels)) if labels else rows
    return nearest(kept, asked, retrieve.FETCH).withColumn("sim", F.round("sim", 6))


def _filtered_bm25(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d)
    keep = rows.where(Filters(companies=("jobs-speth",)).column(company="source") | (F.col("lang") == "en")).select("doc_id")
    return _bm25(spark, d).search(_questions(spark, d), 5, keep)


def _gate(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _embedded(spark, d)
    others = nearest(rows, asked, 2).where(F.col("qid") != F.col("vec_id"))
    return retrieve.confidence(others, least=0.9)


def _widen(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _embedded(spark, d)
    found = retrieve.widen(rows, asked, 3, 0.95)
    return found.groupBy("qid", "widened").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("sim"), 6).alias("top_sim"))


def _movement(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _index(spark, d), _questions(spark, d)
    return retrieve.movement(index.dense(asked).where("rank <= 5"), index.fused(asked))


_TOKENS = r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9+#./-]*') AS ts FROM documents),
qtoks AS (SELECT id AS qid, unnest(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9][a-z0-9+#./-]*')) AS term FROM questions),
words AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM toks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM toks) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""
_SPARSE = _TOKENS + """,
asked AS (SELECT qid, term, count(*) AS times FROM qtoks GROUP BY ALL),
scored AS (SELECT qid, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(ts)) FROM toks)))), 6) AS score FROM tf JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL HAVING score > 0),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20)
"""
_DENSE = f""",
places AS (SELECT term, (('0x' || sha1(term)[1:8])::BIGINT % {DIM}) AS place FROM (SELECT term FROM df UNION SELECT term FROM qtoks)),
dvec AS (SELECT doc_id, place, sum(tf)::DOUBLE AS w FROM tf JOIN places USING (term) GROUP BY ALL),
qvec AS (SELECT qid, place, count(*)::DOUBLE AS w FROM qtoks JOIN places USING (term) GROUP BY ALL),
dnorm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dvec GROUP BY doc_id),
qnorm AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qvec GROUP BY qid),
dots AS (SELECT qid, doc_id, sum(d.w * q.w) AS dot FROM dvec d JOIN qvec q USING (place) GROUP BY ALL),
sims AS (SELECT q.qid, t.doc_id, coalesce(dot / (dnorm.n * qnorm.n), 0) AS sim FROM toks t CROSS JOIN (SELECT DISTINCT qid FROM qtoks) q LEFT JOIN dots USING (qid, doc_id) LEFT JOIN dnorm USING (doc_id) LEFT JOIN qnorm USING (qid)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM sims) WHERE rank <= 20),
joined AS (SELECT qid, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + s.rank), 0), 9) AS score FROM dense d FULL JOIN sparse s USING (qid, doc_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM joined) WHERE rank <= 20)
"""
_FUSED = "WITH " + _TOKENS.strip() + _SPARSE[len(_TOKENS):] + _DENSE
wide_sql = lambda k: _FUSED.replace("rank <= 20", f"rank <= {k}")
_LABEL = "coalesce(nullif(source, ''), 'Unknown company') || ' - ' || coalesce(nullif(title, ''), 'Untitled role')"
_COS = """
WITH asked AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0),
sims AS (SELECT qid, vec_id, label, round(list_dot_product(x, embedding::DOUBLE[]) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS sim FROM asked CROSS JOIN embeddings)
"""
_TOPN = lambda k, where="TRUE": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM sims WHERE {where} QUALIFY rank <= {k}"

QUERIES = {
    "tokenize_counts": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_terms")),
        "WITH " + _TOKENS.strip() + " SELECT doc_id, len(ts)::BIGINT AS n_tokens, len(list_distinct(ts))::BIGINT AS n_terms FROM toks",
    ),
    "bm25_stats": (
        lambda s, d: _bm25(s, d).terms().select("term", "df", F.round("idf", 6).alias("idf")),
        "WITH " + _TOKENS.strip() + " SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf",
    ),
    "bm25_summary": (
        lambda s, d: _bm25(s, d).summary(),
        "WITH " + _TOKENS.strip() + " SELECT count(*)::BIGINT AS texts, (SELECT count(*) FROM df)::BIGINT AS vocabulary, round(avg(len(ts)), 6) AS mean_length FROM toks",
    ),
    "bm25_topk": (_sparse, "WITH " + _SPARSE.strip() + " SELECT qid, doc_id, score, rank::INTEGER AS rank FROM sparse"),
    "bm25_prefiltered": (
        _filtered_bm25,
        "WITH " + _SPARSE.strip() + """ SELECT qid, doc_id, score, rank::INTEGER AS rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
        FROM scored JOIN documents USING (doc_id) WHERE lower(source) = 'jobs-speth' OR lang = 'en') WHERE rank <= 5""",
    ),
    "cosine_topk": (_cosine, _COS + f"SELECT qid, vec_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM ({_TOPN(20)})"),
    "cosine_topk_prefiltered": (lambda s, d: _cosine(s, d, (1, 3, 5)), _COS + f"SELECT qid, vec_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM ({_TOPN(20, 'label IN (1, 3, 5)')})"),
    "dense_topk": (lambda s, d: _dense(s, d).withColumn("sim", F.round("sim", 6)), _FUSED + "SELECT qid, doc_id, round(round(sim, 9), 6) AS sim, rank::INTEGER AS rank FROM dense"),
    "rrf_fusion": (_fused, _FUSED + "SELECT qid, doc_id, dense_rank::INTEGER AS dense_rank, sparse_rank::INTEGER AS sparse_rank, score, rank::INTEGER AS rank FROM fused"),
    "rrf_dense_only": (
        lambda s, d: only_in(*_both(s, d)).select("qid", "doc_id", "rank"),
        _FUSED + "SELECT qid, doc_id, rank::INTEGER AS rank FROM dense WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM sparse s WHERE s.qid = dense.qid AND s.doc_id = dense.doc_id)",
    ),
    "rrf_sparse_only": (
        lambda s, d: only_in(*_both(s, d)[::-1]).select("qid", "doc_id", "rank"),
        _FUSED + "SELECT qid, doc_id, rank::INTEGER AS rank FROM sparse WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM dense s WHERE s.qid = sparse.qid AND s.doc_id = sparse.doc_id)",
    ),
    "hybrid_retrieve": (
        _hybrid,
        _FUSED + f"SELECT qid, doc_id, rank::INTEGER AS rank, score, round(sim, 6) AS sim, {_LABEL} AS source FROM fused JOIN sims USING (qid, doc_id) JOIN documents USING (doc_id) WHERE rank <= 5",
    ),
    "retrieve_dense_filtered": (
        _filters,
        _FUSED + """SELECT qid, doc_id, rank::INTEGER AS rank, round(round(sim, 9), 6) AS sim FROM (SELECT qid, doc_id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) AS rank
        FROM sims JOIN documents USING (doc_id) WHERE lower(lang) = 'de') WHERE rank <= 5""",
    ),
    "retrieve_reranked": (
        _reranked,
        wide_sql(40) + """SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY length(coalesce(text, '')) DESC, rank)::INTEGER AS rank, rank::INTEGER AS fused_rank, length(coalesce(text, ''))::DOUBLE AS rerank_score
        FROM fused JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(coalesce(text, '')) DESC, rank) <= 5""",
    ),
    "retrieve_widened": (
        _widened,
        wide_sql(9).replace("fused AS", "wide AS").rstrip() + """, narrow AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM (
          SELECT qid, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + s.rank), 0), 9) AS score
          FROM (FROM dense WHERE rank <= 3) d FULL JOIN (FROM sparse WHERE rank <= 3) s USING (qid, doc_id)) QUALIFY rank <= 3),
        first AS (SELECT qid, round(sim, 6) AS sim FROM narrow JOIN sims USING (qid, doc_id)), sure AS (SELECT qid FROM first GROUP BY qid HAVING max(sim) >= 0.7),
        again AS (SELECT qid, round(sim, 6) AS sim FROM wide JOIN sims USING (qid, doc_id) WHERE qid NOT IN (FROM sure))
        SELECT qid, widened, count(*)::BIGINT AS n, round(max(sim), 6) AS top_sim FROM (SELECT qid, sim, FALSE AS widened FROM first WHERE qid IN (FROM sure) UNION ALL SELECT qid, sim, TRUE FROM again) GROUP BY ALL""",
    ),
    "explain_hits": (
        lambda s, d: retrieve.explain(hybrid(s, d)),
        _FUSED + f"""SELECT qid, doc_id, rank::INTEGER AS rank, score AS fused, round(sim, 6) AS sim, coalesce(dense_rank::VARCHAR, '-') AS dense, coalesce(sparse_rank::VARCHAR, '-') AS bm25, {_LABEL} AS source
        FROM fused JOIN sims USING (qid, doc_id) JOIN documents USING (doc_id) WHERE rank <= 5""",
    ),
    "confidence_gate": (
        _gate,
        _COS + f"SELECT qid, round(max(sim), 6) AS top_sim, max(sim) >= 0.9 AS confident FROM ({_TOPN(2)}) WHERE qid <> vec_id GROUP BY qid",
    ),
    "widen_retry": (
        _widen,
        _COS + f""", first AS ({_TOPN(3)}), unsure AS (SELECT qid FROM first GROUP BY qid HAVING max(sim) < 0.95), again AS ({_TOPN(9)})
        SELECT qid, widened, count(*)::BIGINT AS n, round(max(sim), 6) AS top_sim FROM (SELECT qid, sim, FALSE AS widened FROM first WHERE qid NOT IN (SELECT qid FROM unsure) UNION ALL SELECT qid, sim, TRUE FROM again WHERE qid IN (SELECT qid FROM unsure)) GROUP BY ALL""",
    ),
    "rerank_movement": (
        _movement,
        _FUSED + """SELECT qid, doc_id, old_rank::INTEGER AS old_rank, new_rank::INTEGER AS new_rank, CASE WHEN new_rank < old_rank THEN 'up' ELSE 'down' END AS direction FROM (
        SELECT d.qid, d.doc_id, d.rank AS old_rank, f.rank AS new_rank FROM dense d JOIN fused f USING (qid, doc_id) WHERE d.rank <= 5 AND d.rank <> f.rank QUALIFY row_number() OVER (PARTITION BY d.qid ORDER BY f.rank) <= 4)""",
    ),
}
