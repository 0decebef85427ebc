"""Search for many questions at once: exact cosine, BM25, and their fusion by rank under one filter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomery.functions.text import citation_label, tokens
from loomery.session import small_enough, spread, stash

#: Defaults of the search: rank constant, candidates, results, least similarity that counts as an answer.
RRF, FETCH, TOP, LEAST_SIM = 60, 20, 5, 0.60


@dataclass(frozen=True)
class Filters:
    """One predicate on metadata, applied below both rankings. Null metadata matches no condition."""

    country: str | None = None
    work_modes: tuple[str, ...] = ()
    city: str | None = None
    companies: tuple[str, ...] = ()
    city_match: str = "exact"

    def column(self, country: str = "country", work_mode: str = "work_mode", city: str = "city", company: str = "company") -> Column:
        parts = []
        if self.country:
            parts.append(F.lower(country) == self.country.lower())
        if self.work_modes:
            parts.append(F.lower(work_mode).isin([m.lower() for m in self.work_modes]))
        if self.city:
            parts.append(F.lower(city) == self.city.lower() if self.city_match == "exact" else F.contains(F.lower(city), F.lit(self.city.lower())))
        if self.companies:
            parts.append(F.lower(company).isin([c.lower() for c in self.companies]))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def describe(self) -> str:
        said = [f"country={self.country}"] * bool(self.country) + [f"mode={'/'.join(self.work_modes)}"] * bool(self.work_modes) + [f"city={self.city}"] * bool(self.city) + [f"company={'/'.join(self.companies)}"] * bool(self.companies)
        return ", ".join(said) or "none"


def top_k(scored: DataFrame, k: int, query: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each query with their rank from 1; the limit runs before the shuffle (WindowGroupLimit)."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col(rank) <= k)


def best_rows(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best finite scores of each column, ties to the lower key."""
    rows, columns = [], []
    for q in range(scores.shape[1]):
        column = scores[:, q]
        at = np.flatnonzero(np.isfinite(column))
        if len(at) > k:
            least = np.partition(column[at], len(at) - k)[len(at) - k]
            at = at[column[at] >= least]
            if len(at) > k:
                at = at[np.lexsort((keys[at], -column[at]))[:k]]
        rows.append(at)
        columns.append(np.full(len(at), q))
    return np.concatenate(rows), np.concatenate(columns)


def query_blocks(queries: DataFrame, query: str, block: int) -> Iterator[list[Row]]:
    """The rows of a stated query set on the driver, all rows of a query together, ``block`` queries or so at a time: their
    number is the caller's, not the table's."""
    count = queries.select(query).distinct().count()
    blocks = -(-count // block)
    for number in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == number)).orderBy(query).collect()
        if rows:
            yield rows


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "qid", block: int = 4096) -> DataFrame:
    """query, key, sim (cosine, 9 decimals), rank: exact k nearest vectors of each query, ties to the lower key.

    A stated query set is compared with all rows, block by block: each batch of vectors is multiplied with a block of
    queries and keeps only its own k best, and the few survivors are ranked. Null vectors take no part; a zero vector has
    similarity 0.
    """
    spark = vectors.sparkSession
    qkind, kind = queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    found = []
    for held in query_blocks(asked, "q", block):
        names = [r.q for r in held]
        sent = spark.sparkContext.broadcast((names, _unit(np.array([r.v for r in held], np.float64))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, unit = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                sims = np.round(values @ unit.T, 9) + 0.0
                at, q = best_rows(sims, np.array(batch.column(0).to_pylist()), k)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q]), batch.column(0).take(pa.array(at)), pa.array(sims[at, q])], names=["q", "k", "sim"])

        found.append(rows.mapInArrow(run, f"q {qkind}, k {kind}, sim double"))
    if not found:
        found.append(spark.createDataFrame([], f"q {qkind}, k {kind}, sim double"))
    scored = reduce(DataFrame.unionAll, found).select(F.col("q").alias(query), F.col("k").alias(key), "sim")
    return top_k(scored, k, query, [F.desc("sim"), F.col(key)])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return matrix / np.where(norm == 0, 1.0, norm)


@dataclass(frozen=True)
class Provider:
    """An embedding model of the caller's: texts in, one row of numbers each out. It runs in Python workers, a batch at a
    time; a hosted model is called there as well. ``query_prefix`` is the instruction that asymmetric models want before
    questions, and questions alone."""

    encode: Callable[[list[str]], np.ndarray]
    query_prefix: str = ""

    def embed(self, rows: DataFrame, key: str, text: str, is_query: bool = False, size: int = 256) -> DataFrame:
        """key and embedding of each row; null texts are embedded as empty ones."""
        kind = rows.schema[key].dataType.simpleString()
        prefix = self.query_prefix if is_query else ""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    values = np.asarray(self.encode([prefix + (t or "") for t in part.column(1).to_pylist()]), np.float32)
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(values)], names=[key, "embedding"])

        return spread(rows.select(F.col(key).alias(key), F.col(text).alias("_text"))).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def tokenized(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and tokens of each text."""
    return spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text"))).select(F.col("key").alias(key), tokens(F.col("text")).alias("tokens"))


def hashing_vector(rows: DataFrame, key: str, text: str | None, dim: int = 256) -> DataFrame:
    """key and embedding: counts of a text's tokens, hashed into ``dim`` places by SHA-1. The default embedding provider,
    to be replaced by a model's; null texts have no tokens and give a zero vector. Without ``text``, ``rows`` hold tokens."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(1)
            distinct = lists.flatten().dictionary_encode()
            for t in distinct.dictionary.to_pylist():
                if t not in place:
                    if len(place) > 500_000:
                        place.clear()
                    place[t] = int(hashlib.sha1(t.encode()).hexdigest()[:8], 16) % dim
            places = np.array([place[t] if t in place else int(hashlib.sha1(t.encode()).hexdigest()[:8], 16) % dim for t in distinct.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = row * dim + places[distinct.indices.to_numpy()] if len(row) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.bincount(at, minlength=batch.num_rows * dim).astype(np.float32).reshape(-1, dim))], names=[key, "embedding"])

    held = rows.select(key, "tokens") if text is None else tokenized(rows, key, text)
    return held.mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


class Bm25:
    """BM25 over a table of texts. Statistics are global and never filtered; a filter only decides what is ranked."""

    def __init__(self, rows: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> None:
        self.key, self.k1, self.b, self.epsilon = key, k1, b, epsilon
        #: key and tokens, written once since counts, terms and scores all read them
        self.tokens = stash(tokenized(rows, key, text).withColumnRenamed(key, "key"))
        self._counts: tuple[int, float] | None = None
        self._terms: DataFrame | None = None

    def counts(self) -> tuple[int, float]:
        """Texts and mean length, in one pass; two numbers reach the driver."""
        if self._counts is None:
            row = self.tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean")).first()
            self._counts = (row.n, row.mean)
        return self._counts

    def terms(self) -> DataFrame:
        """term, df, idf; a negative idf is replaced by ``epsilon`` times the mean over the whole vocabulary. Counted once."""
        if self._terms is None:
            n = self.counts()[0]
            df = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            raw = stash(df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
            mean = raw.agg(F.avg("raw")).scalar()
            self._terms = raw.select("term", "df", F.when(F.col("raw") < 0, self.epsilon * mean).otherwise(F.col("raw")).alias("idf"))
        return self._terms

    def summary(self) -> DataFrame:
        """One row: texts, vocabulary, mean length."""
        vocabulary = self.tokens.select(F.explode("tokens").alias("term")).agg(F.count_distinct("term")).scalar()
        return self.tokens.agg(F.count(F.lit(1)).alias("texts"), F.max(vocabulary).alias("vocabulary"), F.round(F.avg(F.size("tokens")), 6).alias("mean_length"))

    def search(self, questions: DataFrame, k: int = FETCH, keep: DataFrame | None = None, query: str = "qid", text: str = "question", block: int = 4096) -> DataFrame:
        """query, key, score > 0, rank: the k best texts of each question; ``keep`` holds the keys that a filter lets through.

        A stated question set is scored against all texts, block by block: a block's terms and their weights travel to the
        texts; each batch counts its texts' terms, multiplies the counts' saturations with the weights, and keeps its own k
        best texts of each question, so what is shuffled are k rows a batch and question, never pairs of questions and texts.
        """
        qkind, kind = questions.schema[query].dataType.simpleString(), self.tokens.schema["key"].dataType.simpleString()
        asked = questions.select(F.col(query).alias("q"), F.explode(tokens(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
        weighted = stash(asked.join(self.terms(), "term").select("q", "term", (F.col("times") * F.col("idf")).alias("weight")))
        rows = self.tokens if keep is None else self.tokens.join(keep.select(F.col(self.key).alias("key")).distinct(), "key", "left_semi")
        mean, k1, b = self.counts()[1] or 1.0, self.k1, self.b
        found = []
        for held in query_blocks(weighted, "q", block):
            names, terms = list(dict.fromkeys(r.q for r in held)), sorted({r.term for r in held})
            row, column = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(names)}
            weights = np.zeros((len(terms), len(names)))
            for r in held:
                weights[row[r.term], column[r.q]] = r.weight
            sent = self.tokens.sparkSession.sparkContext.broadcast((names, terms, weights))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                names, terms, weights = sent.value
                known = pa.array(terms, pa.string())
                step = max(1, 4_000_000 // max(len(terms), len(names)))
                for whole in batches:
                    for start in range(0, whole.num_rows, step):
                        batch = whole.slice(start, step)
                        lists = batch.column(1)
                        length = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                        term = pa.compute.fill_null(pa.compute.index_in(lists.flatten(), known), -1).to_numpy()
                        at = np.repeat(np.arange(batch.num_rows), length)[term >= 0] * len(terms) + term[term >= 0]
                        cell, count = np.unique(at, return_counts=True)
                        tf = np.zeros(batch.num_rows * len(terms))
                        tf[cell] = count * (k1 + 1) / (count + k1 * (1 - b + b * length[cell // len(terms)] / mean))
                        scores = np.round(tf.reshape(-1, len(terms)) @ weights, 6)
                        scores[scores <= 0] = -np.inf
                        at, q = best_rows(scores, np.array(batch.column(0).to_pylist()), k)
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q]), batch.column(0).take(pa.array(at)), pa.array(scores[at, q])], names=["q", "k", "score"])

            found.append(rows.select("key", "tokens").mapInArrow(run, f"q {qkind}, k {kind}, score double"))
        if not found:
            found.append(self.tokens.sparkSession.createDataFrame([], f"q {qkind}, k {kind}, score double"))
        scored = reduce(DataFrame.unionAll, found).select(F.col("q").alias(query), F.col("k").alias(self.key), "score")
        return top_k(scored, k, query, [F.desc("score"), F.col(self.key)])


def fuse(dense: DataFrame, sparse: DataFrame, query: str = "qid", key: str = "doc_id", k: int = FETCH, constant: int = RRF) -> DataFrame:
    """query, key, dense_rank, sparse_rank, score, rank: reciprocal ranks of both lists summed.

    Ties go to the lower dense rank, then to the lower sparse rank. Either list may be empty.
    """
    a = dense.select(query, key, F.col("rank").alias("dense_rank"))
    b = sparse.select(query, key, F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    both = a.join(b, [query, key], "full_outer").withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    return top_k(both, k, query, [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")])


def only_in(one: DataFrame, other: DataFrame, query: str = "qid", key: str = "doc_id", first: int = TOP) -> DataFrame:
    """The first rows of one ranking that the whole other ranking lacks."""
    return one.where(F.col("rank") <= first).join(other.select(query, key), [query, key], "left_anti")


def hydrate(fused: DataFrame, rows: DataFrame, dense_vectors: DataFrame, query_vectors: DataFrame, query: str = "qid", key: str = "doc_id", columns: tuple[str, ...] = ("company", "title", "text"), first: int = TOP) -> DataFrame:
    """Final hits: the fused top with its texts and with the cosine of every hit, also of those only BM25 found.

    Texts and vectors are fetched for the fused keys alone, after ranking.
    """
    top = fused.where(F.col("rank") <= first)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    sized = norm(F.col("x")) * norm(F.col("y"))
    with_vectors = top.join(dense_vectors.select(F.col(key), F.col("embedding").alias("x")), key).join(query_vectors.select(F.col(query), F.col("embedding").alias("y")), query)
    sims = with_vectors.withColumn("sim", F.round(dot(F.col("x"), F.col("y")) / F.when(sized == 0, 1.0).otherwise(sized), 6)).drop("x", "y")
    return sims.join(rows.select(F.col(key), *columns), key)


def confidence(hits: DataFrame, query: str = "qid", least: float = LEAST_SIM) -> DataFrame:
    """query, top_sim (nulls ignored, 0 without any), confident. Judged by similarity, never by the fused score."""
    top = F.coalesce(F.max("sim"), F.lit(0.0))
    return hits.groupBy(query).agg(F.round(top, 6).alias("top_sim")).withColumn("confident", F.col("top_sim") >= least)


def widen(vectors: DataFrame, queries: DataFrame, k: int, least: float, factor: int = 3, key: str = "vec_id", query: str = "qid") -> DataFrame:
    """Search again, once, with ``factor`` times the candidates for the questions that stayed without confidence."""
    first = nearest(vectors, queries, k, key, query=query)
    unsure = confidence(first, query, least).where(~F.col("confident")).select(query)
    again = nearest(vectors, queries.join(unsure, query, "left_semi"), k * factor, key, query=query).withColumn("widened", F.lit(True))
    sure = first.join(unsure, query, "left_anti").withColumn("widened", F.lit(False))
    return sure.unionByName(again)


def movement(before: DataFrame, after: DataFrame, query: str = "qid", key: str = "doc_id", first: int = 4) -> DataFrame:
    """How reranking moved the hits: old and new rank, direction; the first few that moved, by new rank."""
    moved = before.select(query, key, F.col("rank").alias("old_rank")).join(after.select(query, key, F.col("rank").alias("new_rank")), [query, key]).where("old_rank <> new_rank")
    return top_k(moved.withColumn("direction", F.when(F.col("new_rank") < F.col("old_rank"), "up").otherwise("down")), first, query, [F.col("new_rank")], "n").drop("n")


#: A reranker: (question, text) pairs in, scores out.
Scorer = Callable[[list[tuple[str, str]]], list[float]]


def rerank(hits: DataFrame, scorer: Scorer | None, first: int = TOP, query: str = "qid") -> DataFrame:
    """The first hits by the scorer's rerank_score, ties in the fused order; without a scorer the fused order stands."""
    if scorer is None:
        return hits.where(F.col("rank") <= first).withColumn("rerank_score", F.lit(None).cast("double"))
    schema = StructType([*hits.schema.fields, StructField("rerank_score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(rerank_score=scorer(list(zip(batch["question"], batch["text"]))))

    scored = hits.mapInPandas(run, schema).withColumnRenamed("rank", "fused_rank")
    return top_k(scored, first, query, [F.desc("rerank_score"), F.col("fused_rank")])


class Index:
    """Texts with their tokens and vectors, each written once, and the whole retrieval over them."""

    def __init__(self, rows: DataFrame, key: str = "doc_id", text: str = "text", provider: Provider | None = None, dim: int = 256, columns: tuple[str, ...] = ("company", "title", "text")) -> None:
        self.rows, self.key, self.provider, self.dim, self.columns = rows, key, provider, dim, columns
        self.bm25 = Bm25(rows, key, text)
        held = self.bm25.tokens.withColumnRenamed("key", key)
        self.vectors = stash(provider.embed(rows, key, text) if provider else hashing_vector(held, key, None, dim))

    def asked(self, questions: DataFrame) -> DataFrame:
        """qid and embedding of questions."""
        return self.provider.embed(questions, "qid", "question", is_query=True) if self.provider else hashing_vector(questions, "qid", "question", self.dim)

    def kept(self, filters: Column | None) -> DataFrame | None:
        """Keys of the rows that a predicate on metadata lets through; None without one."""
        return None if filters is None else self.rows.where(filters).select(self.key)

    def dense(self, questions: DataFrame, k: int = FETCH, filters: Column | None = None) -> DataFrame:
        keep = self.kept(filters)
        return nearest(self.vectors if keep is None else self.vectors.join(keep, self.key, "left_semi"), self.asked(questions), k, self.key)

    def sparse(self, questions: DataFrame, k: int = FETCH, filters: Column | None = None) -> DataFrame:
        return self.bm25.search(questions, k, self.kept(filters))

    def rankings(self, questions: DataFrame, k: int = FETCH, filters: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Both rankings to a depth of ``k``, written, for several retrievals of the same questions."""
        return stash(self.dense(questions, k, filters)), stash(self.sparse(questions, k, filters))

    def fused(self, questions: DataFrame, k: int = FETCH, filters: Column | None = None, mode: str = "hybrid", ranked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        if mode not in ("hybrid", "dense"):
            raise ValueError(f"no such mode: {mode}")
        dense = self.dense(questions, k, filters) if ranked is None else ranked[0].where(F.col("rank") <= k)
        if mode == "dense":
            return fuse(dense, dense.limit(0), key=self.key, k=k)
        return fuse(dense, self.sparse(questions, k, filters) if ranked is None else ranked[1].where(F.col("rank") <= k), key=self.key, k=k)

    def retrieve(
        self, questions: DataFrame, filters: Column | None = None, mode: str = "hybrid", scorer: Scorer | None = None, k: int = FETCH, first: int = TOP, ranked: tuple[DataFrame, DataFrame] | None = None
    ) -> DataFrame:
        """Final hits of each question: qid, key, rank, score, dense_rank, sparse_rank, sim, rerank_score and the texts' columns.

        One predicate holds below both rankings; ``mode`` "dense" leaves BM25 out; with a scorer twice as many candidates
        are fetched and all of them reranked. Texts and vectors are read for the candidates alone. ``ranked`` may hold
        rankings of the same questions under the same filter that are deep enough.
        """
        fetch = 2 * k if scorer else k
        wanted = fetch if scorer else first
        fused = stash(self.fused(questions, fetch, filters, mode, ranked).where(F.col("rank") <= wanted))
        few = F.broadcast(fused) if small_enough(fused, 300_000) else fused
        found = hydrate(few, self.rows, self.vectors, self.asked(questions), key=self.key, columns=self.columns, first=wanted)
        return rerank(found.join(questions.select("qid", "question"), "qid"), scorer, first)

    def widened(self, questions: DataFrame, least: float = LEAST_SIM, factor: int = 3, k: int = FETCH, **options: object) -> DataFrame:
        """``retrieve``, and once more with ``factor`` times the candidates for the questions whose best similarity stays under
        ``least``; widened tells which those are."""
        once = stash(self.retrieve(questions, k=k, **options))
        sure = confidence(once, least=least).where("confident").select("qid")
        unsure = stash(questions.select("qid", "question").join(sure, "qid", "left_anti"))
        again = self.retrieve(unsure, k=factor * k, **options).withColumn("widened", F.lit(True))
        return once.join(sure, "qid", "left_semi").withColumn("widened", F.lit(False)).unionByName(again)


def explain(hits: DataFrame) -> DataFrame:
    """A readable table of hits: rank, fused, sim, dense, bm25, source."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return hits.select("qid", "doc_id", "rank", F.col("score").alias("fused"), "sim", show("dense_rank").alias("dense"), show("sparse_rank").alias("bm25"), citation_label(F.col("company"), F.col("title")).alias("source"))
