"""Readers, writers and the stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomery.sources.corpus import POSTING, docx_text, read_corpus, read_index, read_questions, vectors_of, write_corpus, write_index
from loomery.streaming.ingest import batch_delta, latest_by_key, merge_into, windowed_counts


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([tuple(f"{n} é" for n in POSTING.names)], POSTING)
    write_corpus(rows, str(tmp_path / "c"))
    assert read_corpus(spark, str(tmp_path / "c")).collect() == rows.collect()
    (tmp_path / "bad.json").write_text('{"id": "1"}\n\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_corpus(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "q.json").write_text('{"id": "q1", "expect_terms": ["a"], "should_refuse": false}\n')
    assert read_questions(spark, str(tmp_path / "q.json")).first().expect_terms == ["a"]


def test_index_keeps_other_strategies(spark, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark.createDataFrame([("1", "fixed"), ("2", "section")], "id string, strategy string"), path)
    write_index(spark.createDataFrame([("3", "fixed")], "id string, strategy string"), path)
    assert {r.id for r in read_index(spark, path).collect()} == {"2", "3"}
    assert "PartitionFilters: [isnotnull(strategy" in read_index(spark, path, "fixed")._jdf.queryExecution().executedPlan().toString()
    assert vectors_of(read_index(spark, path), spark.createDataFrame([("3",), ("3",)], "id string")).count() == 1


def test_docx():
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("One") + p("") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as file:
        file.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    assert docx_text(held.getvalue()) == "One\na | b"


def test_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "snapshot")
    before = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    before.write.parquet(state)
    spark.createDataFrame([(1, "a"), (3, "c")], "id long, text string").write.parquet(source)
    for full, want in ((False, {1: "same", 3: "new"}), (True, {1: "same", 2: "closed", 3: "new"})):
        got = []
        stream = spark.readStream.schema("id long, text string").parquet(source)
        merge_into(stream, lambda: spark.read.parquet(state), lambda d, n: got.extend(d.collect()), "id", ["text"], str(tmp_path / f"cp{full}"), full=full).awaitTermination()
        assert {r.id: r.state for r in got} == want


def test_batch_delta(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id long, text string")
    rows = [(1, "a", 1, None), (2, "x", 2, False), (2, "b", 1, True), (3, None, 1, None), (4, "d", 1, None), (4, "d", 2, True), (5, "new", 1, None)]
    batch = spark.createDataFrame(rows, "id long, text string, at int, gone boolean")
    got = {r.id: r.state for r in batch_delta(before, batch, "id", ["text"], "at", "gone").collect()}
    assert got == {1: "same", 2: "changed", 3: "same", 4: "closed", 5: "new"}
    assert batch_delta(before, batch.limit(0), "id", ["text"]).count() == 0


def test_windows_and_redelivery(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([(1, "2025-01-06 00:10:00"), (1, "2025-01-06 00:20:00"), (2, "2025-01-06 01:00:00")], "id long, at string").select("id", F.to_timestamp("at").alias("at")).write.parquet(path)
    stream = spark.readStream.schema("id long, at timestamp").parquet(path)
    for name, df, mode in (("once", latest_by_key(stream, "id", "at"), "append"), ("counts", windowed_counts(stream, "at", []), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2 and sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
