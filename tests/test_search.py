"""Search against brute force, and the plans that make it scale."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import retrieve
from loomery.operators.retrieve import Bm25, Filters, fuse, nearest, only_in


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_matches_brute_force(spark):
    texts = {1: "red fox red", 2: "blue fox", 3: "the red car the car", 4: None, 5: "", 6: "fox fox fox blue"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([("q", "red fox fox"), ("none", "zebra"), ("null", None)], "qid string, question string")
    docs = {k: (t or "").split() for k, t in texts.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df_of = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df_of.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    want = {}
    for k, d in docs.items():
        score = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in "red fox fox".split() if w in d)
        if score > 0:
            want[k] = round(score, 6)
    got = {r.doc_id: r.score for r in Bm25(df).search(asked).collect()}
    assert got == want
    kept = Bm25(df).search(asked, keep=df.where("doc_id > 2")).collect()
    assert {r.doc_id for r in kept} == {k for k in want if k > 2} and min(r["rank"] for r in kept) == 1
    assert Bm25(df.limit(0)).search(asked).count() == 0


def test_nearest_matches_brute_force_and_ties(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200, None), (201, [0.0] * 8)] + [(300 + i, [1.0] * 8) for i in range(5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("q", F.lit("clash"))
    asked = spark.createDataFrame([(1, [1.0] * 8), (2, vectors[7][1])], "qid long, embedding array<float>")
    got = {}
    for r in nearest(df.repartition(3), asked, 6).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[1])][:5] == [300, 301, 302, 303, 304]
    x = np.array([v for _, v in vectors[:200]])
    q = np.array(vectors[7][1])
    order = np.argsort(-(x @ q) / np.linalg.norm(x, axis=1))
    assert [v for _, v in sorted(got[2])][:3] == order[:3].tolist()
    again = nearest(df, asked, 6, block=1)
    assert {(r.qid, r.vec_id) for r in again.collect()} == {(q, v) for q, rows in got.items() for _, v in rows}
    assert nearest(df, asked.limit(0), 3).count() == 0 and nearest(df.limit(0), asked, 3).count() == 0


def test_rank_fusion_golden_case(spark):
    dense = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, doc_id string, rank int")
    sparse = spark.createDataFrame([("q", "c", 1), ("q", "d", 2)], "qid string, doc_id string, rank int")
    assert [r.doc_id for r in fuse(dense, sparse).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    assert [r.doc_id for r in only_in(sparse, dense).collect()] == ["d"]
    assert fuse(dense.limit(0), sparse).count() == 2


def test_filters(spark):
    rows = spark.createDataFrame([("US", "Remote", "Lake X", "A"), (None, None, None, None), ("de", "onsite", "x", "b")], "country string, work_mode string, city string, company string")
    assert rows.where(Filters(country="us", companies=("a",)).column()).count() == 1
    assert rows.where(Filters(city="x").column()).count() == 1 and rows.where(Filters(city="x", city_match="contains").column()).count() == 2
    assert rows.where(Filters().column()).count() == 3 and Filters(country="us").describe() == "country=us"


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("qid"), F.rand(1).alias("score"), F.col("id").alias("doc_id"))
    assert "WindowGroupLimit" in plan(retrieve.top_k(df, 3, "qid", [F.desc("score")]))


def test_prefilter_sits_below_the_ranking(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), (F.col("id") % 3).alias("label")).write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    text = plan(nearest(rows.where("label = 1"), rows.limit(2).select(F.col("vec_id").alias("qid"), "embedding"), 3))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,1)" in text and text.index("Window") < text.index("PushedFilters")


def test_explain_and_confidence(spark):
    hits = spark.createDataFrame([("q", 1, 1, 0.03, 0.7, 1, None, None, "t"), ("q", 2, 2, 0.02, None, None, 1, "c", None)], "qid string, doc_id long, rank int, score double, sim double, dense_rank int, sparse_rank int, company string, title string")
    shown = retrieve.explain(hits).orderBy("rank").collect()
    assert shown[0].source == "Unknown company - t" and shown[0].bm25 == "-" and shown[1].source == "c - Untitled role"
    assert retrieve.confidence(hits).first().confident


def length_first(pairs):
    return [float(len(text or "")) for _, text in pairs]


def numbers(texts):
    return np.array([[len(t), t.count("fox"), 1.0] for t in texts])


def test_whole_retrieval(spark):
    rows = [(i, "acme" if i % 2 else "beta", f"title {i}", " ".join(["red"] * (i % 4) + ["fox"] * (i % 3) + [f"w{i}"])) for i in range(40)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, company string, title string, text string")
    asked = spark.createDataFrame([("a", "red fox"), ("b", "zebra"), ("n", None)], "qid string, question string")
    index = retrieve.Index(df)
    hits = index.retrieve(asked, k=10, first=3).collect()
    assert {r["rank"] for r in hits if r.qid == "a"} == {1, 2, 3} and all(r.sim is not None for r in hits)
    only = index.retrieve(asked, Filters(companies=("acme",)).column(), mode="dense", k=4, first=4).collect()
    assert {r.company for r in only} == {"acme"} and all(r.sparse_rank is None for r in only)
    assert sorted(map(tuple, index.retrieve(asked, k=10, first=3, ranked=index.rankings(asked, 30)).collect())) == sorted(map(tuple, hits))
    reranked = index.retrieve(asked.where("qid = 'a'"), scorer=length_first, k=5, first=3).orderBy("rank").collect()
    assert [len(r.text) for r in reranked] == sorted((len(r.text) for r in reranked), reverse=True) and max(r.fused_rank for r in reranked) <= 10
    wide = index.widened(asked, 0.99, k=2, first=6)
    assert {(r.qid, r.widened) for r in wide.select("qid", "widened").distinct().collect()} >= {("b", True)} and wide.groupBy("qid").count().agg(F.max("count")).first()[0] <= 6
    with pytest.raises(ValueError):
        index.retrieve(asked, mode="guess")
    assert retrieve.Index(df.limit(0)).retrieve(asked).count() == 0 and index.retrieve(asked.limit(0)).count() == 0


def test_provider_gets_its_prefix_for_questions_alone(spark):
    df = spark.createDataFrame([(1, "fox"), (2, None)], "doc_id long, text string").withColumn("embedding", F.lit("clash"))
    provider = retrieve.Provider(numbers, query_prefix="find: ")
    assert [r.embedding for r in provider.embed(df, "doc_id", "text").orderBy("doc_id").collect()] == [[3.0, 1.0, 1.0], [0.0, 0.0, 1.0]]
    assert [r.embedding[0] for r in provider.embed(df, "doc_id", "text", is_query=True).orderBy("doc_id").collect()] == [9.0, 6.0]
    asked = spark.createDataFrame([("q", "fox")], "qid string, question string")
    assert retrieve.Index(df.withColumn("company", F.lit("c")).withColumn("title", F.lit("t")), provider=provider).retrieve(asked).count() == 2


def test_bm25_blocks_and_ties(spark):
    df = spark.createDataFrame([(i, "red fox" if i < 20 else "blue" if i < 30 else "grey") for i in range(60)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([("a", "fox"), ("b", "blue fox"), ("c", "red")], "qid string, question string")
    one, many = Bm25(df).search(asked, 4), Bm25(df).search(asked, 4, block=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert [r.doc_id for r in one.where("qid = 'a'").orderBy("rank").collect()] == [0, 1, 2, 3]
