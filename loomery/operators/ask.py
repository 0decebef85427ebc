"""Answering many questions in one pass, with pluggable models for reranking, answering and verification."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomery.config import Config
from loomery.operators import answer, retrieve
from loomery.operators.retrieve import rerank  # noqa: F401
from loomery.session import stash

#: A model: prompts in, replies out; it runs in Python workers, one call for each batch.
Model = Callable[[list[str]], list[str]]


def call_model(rows: DataFrame, prompt: str, reply: str, model: Model) -> DataFrame:
    """``rows`` with the model's reply to a prompt column. Only rows that are to be asked may be passed: a model call is
    never put under a condition, since both branches would run."""
    schema = StructType([*rows.schema.fields, StructField(reply, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{reply: model(batch[prompt].tolist())})

    return rows.mapInPandas(run, schema)


def ask(hits: DataFrame, questions: DataFrame, model: Model, verifier: Model | None = None, config: Config = Config(), resume: str = "") -> DataFrame:
    """qid, outcome, reply, citations, dangling, top_sim, prompt_chars, total, unsupported, verified, widened, trace for each question.

    ``hits`` are final hits with sim, rank and their texts (and widened, if they were searched for again); ``questions``
    have qid and question. Questions whose best similarity is too low are refused without a model call; a reply with the
    refusal token is a refusal and is not verified; with a verifier a reply with too large a share of unsupported claims
    is withdrawn. A résumé is put before the question, its first 6,000 characters at most. Replies are written before they
    are read again, so each prompt is sent once.
    """
    least = config.least_similarity
    widened = F.bool_or("widened") if "widened" in hits.columns else F.lit(False)
    found = hits.groupBy("qid").agg(F.max("rank").cast("int").alias("hits"), widened.alias("widened"))
    top = retrieve.confidence(hits, least=least).join(found, "qid")
    asked = questions.select("qid", "question").join(top, "qid", "left").withColumn("top_sim", F.coalesce("top_sim", F.lit(0.0))).fillna({"hits": 0, "widened": False})
    said = f"Résumé:\n{resume[:6000]}\n\n" if resume else ""
    sure = asked.where(F.col("top_sim") >= least).join(answer.context(hits), "qid")
    sure = sure.withColumn("prompt", F.concat(F.lit("Answer from the numbered context alone, citing [n].\n\n"), "context", F.lit(f"\n\n{said}Question: "), "question"))
    replied = stash(call_model(sure.select("qid", "top_sim", "hits", "widened", "prompt"), "prompt", "reply", model))
    refuses = F.contains(F.coalesce("reply", F.lit("")), F.lit(answer.REFUSAL))
    unread = lambda df: df.withColumn("judged", F.lit(None).cast("string"))
    if verifier is None:
        judged = unread(replied)
    else:
        checks = replied.where(~refuses).withColumn("check", F.concat(F.lit("Count the claims and the unsupported ones as JSON.\n\n"), "prompt", F.lit("\n\nReply: "), F.coalesce("reply", F.lit(""))))
        judged = stash(call_model(checks, "check", "judged", verifier).drop("check")).unionByName(unread(replied.where(refuses)))
    none = F.lit(None).cast("string")
    low = asked.where(F.col("top_sim") < least).select("qid", "top_sim", "hits", "widened", none.alias("prompt"), none.alias("reply"), none.alias("judged"))
    verdict = answer.parse_verdict(F.col("judged"))
    both = judged.unionByName(low).withColumn("verdict", verdict)
    outcome = answer.outcome(F.col("top_sim"), F.col("reply"), F.col("verdict"), least, config.most_unsupported)
    reason = answer.reason(F.col("top_sim"), F.col("reply"), F.col("verdict"), least, config.most_unsupported)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    checked = F.when(F.col("judged").isNull(), None).when(~F.col("verdict.ran"), F.lit("verify: no verdict, the answer stands")).otherwise(line("verify: ", F.col("verdict.unsupported"), " of ", F.col("verdict.total"), " claims unsupported"))
    cited = answer.citations(F.col("reply"), F.col("hits"))
    trace = F.array_compact(
        F.array(
            line("retrieve: ", F.col("hits"), " hits, top similarity ", F.col("top_sim"), f" (threshold {least})"), F.when(F.col("widened"), F.lit("widen: searched again with more candidates")),
            F.when(F.col("reply").isNotNull(), line("generate: ", F.length("reply"), " characters, ", F.size(cited), " citations")), checked, F.when(outcome != "answered", line("refused: ", reason)),
        )
    )
    return both.select(
        "qid", outcome.alias("outcome"), "reply", cited.alias("citations"), answer.dangling(F.col("reply"), F.col("hits")).alias("dangling"), "top_sim", F.coalesce(F.length("prompt"), F.lit(0)).alias("prompt_chars"),
        "verdict.total", "verdict.unsupported", F.col("verdict.ran").alias("verified"), "widened", trace.alias("trace"),
    )


def answer_all(
    index: retrieve.Index, questions: DataFrame, model: Model, verifier: Model | None = None, scorer: retrieve.Scorer | None = None, filters: Column | None = None, mode: str = "hybrid",
    config: Config = Config(), resume: str = "",
) -> DataFrame:
    """The whole pipeline for a table of questions: retrieve, search once more where unsure, rerank, answer, verify.

    Columns of ``ask``, and elapsed_s, the wall-clock seconds of the whole batch. The result is written before it is returned.
    """
    began = time.perf_counter()
    hits = stash(index.widened(questions, config.least_similarity, k=config.candidates, filters=filters, mode=mode, scorer=scorer, first=config.results))
    done = stash(ask(hits, questions, model, verifier, config, resume))
    return done.withColumn("elapsed_s", F.lit(round(time.perf_counter() - began, 3)))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result table as Markdown, for reports."""
    held = rows.limit(most).collect()
    line = lambda values: "| " + " | ".join("-" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(rows.columns), "|" + "---|" * len(rows.columns), *[line(r) for r in held]])
