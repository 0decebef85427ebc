"""Measures of retrieval and of answers, as aggregates over result tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import spread, stash

#: A term made of words, and what lies between words; underscores belong to words.
_WORDED, _BETWEEN = re.compile(r"[^\W_]+(?: [^\W_]+)*"), re.compile(r"\W+")


def term_in(term: Column, text: Column) -> Column:
    """A term of letters, digits and single blanks as whole words, any other as a substring; both lower-cased."""
    t, low = F.lower(term), F.lower(F.coalesce(text, F.lit("")))
    worded = F.contains(F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))
    return F.when(t.rlike(r"^[\p{L}\p{N}]+( [\p{L}\p{N}]+)*$"), worded).otherwise(F.contains(low, t))


def coverage(questions: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, docs, sources, label of each question: how many texts and sources hold any of its expected terms.

    The stated question set's terms make two automata, one of whole words and one of the terms that are not made of words;
    each text is read through once, whatever their number, and a task passes on counts by question and source alone.
    Rows count each, also those with equal ``key``; null texts hold nothing, a null source counts as none.
    """
    asked = [(r.id, t.lower()) for r in questions.select("id", "expect_terms").collect() for t in r.expect_terms or [] if t]
    spark = rows.sparkSession
    kind = questions.schema["id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(asked)

    def automata() -> list[object]:
        import ahocorasick

        held: list[dict[str, set]] = [defaultdict(set), defaultdict(set)]
        for name, term in sent.value:
            worded = _WORDED.fullmatch(term) is not None
            held[not worded][f" {term} " if worded else term].add(name)
        made = []
        for terms in held:
            automaton = ahocorasick.Automaton()
            for term, names in terms.items():
                automaton.add_word(term, names)
            if terms:
                automaton.make_automaton()
            made.append(automaton if terms else None)
        return made

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = automata()
        counts: Counter = Counter()
        for batch in batches:
            for t, origin in zip(batch.column(0), batch.column(1).to_pylist()):
                low, found = t.as_py().lower(), set()
                if words is not None:
                    for _, names in words.iter(f" {_BETWEEN.sub(' ', low)} "):
                        found |= names
                if parts is not None:
                    for _, names in parts.iter(low):
                        found |= names
                counts.update((name, origin) for name in found)
            if len(counts) > 300_000:
                yield counted_batch(counts)
                counts.clear()
        if counts:
            yield counted_batch(counts)

    def counted_batch(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["id", "source", "n"])

    read = spread(rows.select(F.col(text).alias("_text"), F.col(source).cast("string").alias("_source"))).where("_text IS NOT NULL")
    counted = read.mapInArrow(count, f"id {kind}, source string, n long").groupBy("id", "source").agg(F.sum("n").alias("n")).groupBy("id").agg(F.sum("n").alias("docs"), F.count("source").alias("sources"))
    n = F.coalesce("docs", F.lit(0))
    label = F.when(n == 0, "NOT IN CORPUS").when(n <= 3, "THIN").otherwise("ok")
    return questions.select("id").join(counted, "id", "left").select("id", n.alias("docs"), F.coalesce("sources", F.lit(0)).alias("sources"), label.alias("label"))


def first_hit(hits: DataFrame, questions: DataFrame, query: str = "qid", text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """query and first_rank: the least rank whose text holds any expected term; null if none does. ``by`` holds columns
    that tell rankings apart, as a configuration; each of them gets a row for each question."""
    asked = questions.select(F.col("id").alias(query), "expect_terms", "should_refuse", "category")
    held = F.exists("expect_terms", lambda t: term_in(t, F.col(text)))
    ranked = hits.join(asked, query).groupBy(*by, query).agg(F.min(F.when(held, F.col("rank"))).alias("first_rank"), F.round(F.coalesce(F.max("sim"), F.lit(0.0)), 4).alias("top_sim"), F.count(F.lit(1)).alias("n_hits"))
    every = asked.select(query, "should_refuse", "category")
    if by:
        every = hits.select(*by).distinct().crossJoin(every)  # a few configurations by the stated questions
    return every.join(ranked, [*by, query], "left").withColumn("top_sim", F.coalesce("top_sim", F.lit(0.0)))


def retrieval_metrics(per_question: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of ``by``): answerable, hit rate, MRR, mean first hit, mean similarities by kind of question
    and their separations."""
    answerable = ~F.col("should_refuse")
    mean = lambda cond: F.avg(F.when(cond, F.col("top_sim")))
    n = F.greatest(F.count_if(answerable), F.lit(1))
    found = F.when(answerable, F.col("first_rank"))
    return per_question.groupBy(*by).agg(
        F.count_if(answerable).alias("answerable"), F.round(F.count(found) / n, 4).alias("hit_rate"), F.round(F.coalesce(F.sum(1 / found), F.lit(0.0)) / n, 4).alias("mrr"),
        F.round(F.avg(found), 2).alias("mean_first_hit"), F.round(mean(answerable), 4).alias("sim_answerable"), F.round(mean(F.col("should_refuse")), 4).alias("sim_refuse"),
        F.round(mean(answerable) - mean(F.col("should_refuse")), 4).alias("separation"), F.round(mean(answerable) - mean(F.col("category") == "off_domain"), 4).alias("separation_off_domain"),
    )


def matrix(rankings: dict[str, DataFrame], questions: DataFrame, latencies: dict[str, float] | None = None) -> DataFrame:
    """config, seconds and the retrieval metrics of each named ranking (qid, rank, sim, text), such as of each chunking,
    mode and reranking; seconds are the caller's measurements."""
    hits = reduce(DataFrame.unionByName, [r.select("qid", "rank", "sim", "text", F.lit(name).alias("config")) for name, r in rankings.items()])
    took = F.create_map(*[F.lit(x) for item in (latencies or {"": 0.0}).items() for x in item])
    return retrieval_metrics(first_hit(hits, questions, by=("config",)), ("config",)).withColumn("seconds", F.try_element_at(took, F.col("config")))


def best_configuration(measured: DataFrame) -> DataFrame:
    """config of the highest MRR, then separation, and cleanest, the one of the highest separation alone, whose similarities
    a threshold should be tuned on; ties go to the first name."""
    first = lambda *c: F.min_by("config", F.struct(*[-F.coalesce(x, F.lit(float("-inf"))) for x in c], "config"))
    return measured.agg(first("mrr", "separation").alias("config"), first("separation").alias("cleanest"))


def percentiles(rows: DataFrame, value: str) -> DataFrame:
    """One row: p50 (interpolated median) and p95 (nearest rank at floor(0.95 n), the last value for n = 1), both exact.

    Equal values are counted together, the distinct ones parted by range and numbered inside their part; a part's place in
    the whole comes from the parts' sizes. No task holds more than its range, and nothing is counted beforehand.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                upto = before + np.cumsum(batch.column(1).to_numpy())
                before = int(upto[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns, pa.array(upto, pa.int64())], names=["part", "v", "n", "upto"])

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stash(counts.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(number, "part int, v double, n long, upto long"))
    sizes = ranged.groupBy("part").agg(F.max("upto").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))  # one row a part
    placed = ranged.join(F.broadcast(offsets), "part").select("v", (F.col("offset") + F.col("upto")).alias("upto"), "n")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    at = lambda position: F.max(F.when((F.col("upto") - F.col("n") <= position) & (position < F.col("upto")), F.col("v")))
    rank = F.floor(total * F.lit(0.95))
    return placed.agg(
        F.round((at(F.floor((total - 1) / 2)) + at(F.ceil((total - 1) / 2))) / 2, 6).alias("p50"), F.round(at(F.when(rank == 0, total).otherwise(rank) - 1), 6).alias("p95")
    )


def sweep(per_question: DataFrame) -> DataFrame:
    """thr, tp, fn, fp, tn, accuracy for each threshold 0.00 to 1.00 by 0.05; a question is refused under the threshold.

    Each question is counted at the 21 thresholds inside its row, so the cost is one small aggregation.
    """
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.round(i / 20, 2))).alias("thr")
    each = per_question.select("should_refuse", "top_sim", steps)
    refused, should = F.col("top_sim") < F.col("thr"), F.col("should_refuse")
    counted = each.groupBy("thr").agg(F.count_if(refused & should).alias("tp"), F.count_if(~refused & should).alias("fn"), F.count_if(refused & ~should).alias("fp"), F.count_if(~refused & ~should).alias("tn"))
    return counted.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.lit(1)), 3))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of highest accuracy, then fewest missed refusals, then lowest; ``works`` unless it refuses nothing."""
    return swept.orderBy(F.desc("accuracy"), "fn", "thr").limit(1).select("thr", "accuracy", "tp", "fn", "fp", ((F.col("thr") > 0) & (F.col("tp") > 0)).alias("works"))


def generation_metrics(answers: DataFrame) -> DataFrame:
    """One row over answers with should_refuse, refused, claims, unsupported (null where no judge ran), judge_failed,
    citations, bad_citations, widened, verified, overturned, prompt_tokens and latency_s."""
    refused, should = F.col("refused"), F.col("should_refuse")
    judged = ~refused & ~F.col("judge_failed")
    claims, bad = F.sum(F.when(judged, F.col("claims"))), F.sum(F.when(judged, F.col("unsupported")))
    told = answers.agg(
        F.count(F.lit(1)).alias("answers"), F.round(F.count_if(refused == should) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("refusal_accuracy"),
        F.count_if(should & ~refused).alias("missed"), F.count_if(~should & refused).alias("over_refusals"), F.round(1 - F.try_divide(bad, claims), 4).alias("faithfulness"),
        F.count_if(~refused & F.col("judge_failed")).alias("judge_failures"), F.count_if(~refused & (F.col("citations") > 0)).alias("cited"), F.sum("bad_citations").alias("dangling"),
        F.count_if(F.col("widened") & ~refused).alias("rescued"), F.count_if("verified").alias("checked"), F.count_if("overturned").alias("overturned"),
        F.count_if(F.col("overturned") & should).alias("overturned_rightly"), F.count_if(F.col("overturned") & ~should).alias("overturned_wrongly"),
        F.floor(F.avg(F.when(~refused, F.col("prompt_tokens")))).alias("mean_prompt_tokens"),
    )
    slow = percentiles(answers, "latency_s")
    return told.crossJoin(F.broadcast(slow.select(F.col("p50").alias("p50_latency_s"), F.col("p95").alias("p95_latency_s"))))  # one row each
