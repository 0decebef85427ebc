"""Cleaning, boilerplate and chunking against plain Python."""

import html
import re

import pytest
from pyspark.sql import functions as F

from loomery.functions.text import clean_lines, fingerprint, html_to_text, paragraphs, tokens
from loomery.operators import chunk
from loomery.operators.boilerplate import Boilerplate


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_html_to_text(spark):
    raw = "<p>A &amp;amp; B&nbsp;&nbsp;c</p><ul><LI class='x'>one</li><li>two</li></ul>x<br/>y<script>z</script>\n\n\n\nend"
    assert one(spark, html_to_text, raw, None, "") == ["A & B c\n\n- one\n\n- two\nx\ny z\n\nend", "", ""]


def test_clean_lines_and_paragraphs(spark):
    assert one(spark, clean_lines, " a\t\tb \r\n\r\n\r\n\r\nc\rd ", None) == ["a b\n\nc\nd", ""]
    assert one(spark, paragraphs, " a \n\n\n\n b\nc", None, " \n\n\xa0") == [["a", "b\nc"], [], []]


def test_fingerprint_deletes_other_characters(spark):
    a, b, c = one(spark, fingerprint, "Equal  Opportunity, employer!", "equal opportunity employer", "équal opportunity employer")
    assert a == b != c


def test_tokens_keep_joined_names(spark):
    assert one(spark, tokens, "CI/CD, c++ and node.js (ICD-10) -x", None) == [["ci/cd", "c++", "and", "node.js", "icd-10", "x"], []]


def python_windows(text, size, overlap, delimiter="\n\n"):
    if text is None or not text.strip():
        return []
    if len(text) <= size:
        return [text]
    out, current = [], ""
    for p in (q.strip() for q in text.split(delimiter)):
        if not p:
            continue
        if not current:
            current = p
        elif len(current) + len(p) + len(delimiter) <= size:
            current += delimiter + p
        else:
            out.append(current)
            current = current[-overlap:] + delimiter + p
        while len(current) > size:
            out.append(current[:size])
            current = current[size - overlap :]
    return out + ([current] if current.strip() else [])


@pytest.mark.parametrize("size,overlap", [(10, 3), (25, 5), (40, 10)])
def test_windows_match_a_plain_loop(spark, size, overlap):
    texts = ["aaaa\n\nbbbb\n\ncccc", "x" * 100, "a b\n\n" + "y" * 33 + "\n\nz", None, "", "  \n\n ", "short", "é" * 11 + "\n\n" + "ß" * 26, "\n\n".join(f"part {i} of it" for i in range(9))]
    got = one(spark, lambda c: chunk.windows(c, size, overlap), *texts)
    assert got == [python_windows(t, size, overlap) for t in texts]
    if (size, overlap) == (10, 3):
        assert got[0] == ["aaaa\n\nbbbb", "bbb\n\ncccc"]


def test_section_names(spark):
    asked = ["Preferred Qualifications", "Nice to have", "About the role", "What we offer", "Who we are", "Anything"]
    assert one(spark, chunk.section_of, *asked) == ["requirements", "nice_to_have", "responsibilities", "compensation", "about_company", "other"]


def test_sections_and_chunk_ids(spark):
    rows = spark.createDataFrame([(1, "intro\nRequirements:\nfirst\nsecond\n• Benefits\n\nAbout us\nwe", "c", "t"), (2, None, None, None), (3, "plain", "c", "t")], "doc_id long, text string, source string, title string")
    got = sorted((r.key, r.ord, r.section, r.body) for r in chunk.sections(rows, "doc_id", "text").collect())
    assert got == [(1, 0, "other", "intro"), (1, 1, "requirements", "first\nsecond"), (1, 3, "about_company", "we"), (3, 0, "other", "plain")]
    made = chunk.chunk(rows.withColumn("key", F.lit(9)).withColumn("section", F.lit("clash")), "section", least=1).orderBy("id").collect()
    assert [(r.id, r.text.split("\n\n")[0]) for r in made] == [("1::section::0", "c - t"), ("1::section::1", "c - t [requirements]"), ("1::section::2", "c - t [about company]"), ("3::section::0", "c - t")]
    assert chunk.stats(chunk.chunk(rows.limit(0), "fixed")).count() == 0


def test_boilerplate(spark):
    notice, shared = "equal opportunity notice of this company " * 2, "this line is shared by every single company here"
    rows = [(i, f"own text number {i}\n{notice if c == 'a' else 'x'}\n{shared}", c) for i, c in enumerate("aaaabbbbccccd")] + [(90, None, "a"), (91, "", None), (92, "", "")]
    df = spark.createDataFrame(rows, "hit_id long, text string, company string").withColumn("fp", F.lit("clash"))
    rules = Boilerplate()
    own = {(r.company, r.n, r.n_docs) for r in rules.of_company(df).collect()}
    assert ("a", 4, 5) in own
    assert [r.companies for r in rules.of_all(df).collect()] == [4]
    texts = {r.hit_id: r.text for r in rules.stripped(df).collect()}
    assert texts[0] == "own text number 0" and texts[4] == "own text number 4\nx" and texts[90] == "" and len(texts) == 16
    assert rules.stripped(df.limit(0)).count() == 0


def test_unescape_matches_python(spark):
    raw = "&lt;b&gt; &eacute; &#8212; &amp;quot;"
    assert one(spark, html_to_text, raw) == [re.sub(r"<[^>]+>", " ", html.unescape(raw)).strip().replace("&quot;", '"')]


def test_headings_alone_are_cut_as_a_whole_and_locations_are_told(spark):
    rows = spark.createDataFrame([(1, "Requirements:\nBenefits:\n", "Acme", "Engineer", "Ulm"), (2, "Requirements:\nknow it", "Acme", None, ""), (3, None, "x", "y", None)], "doc_id int, text string, source string, title string, place string")
    made = sorted((r.id, r.strategy, r.text) for r in chunk.chunk(rows, "section", location="place", least=1).collect())
    assert made == [("1::fixed::0", "fixed", "Acme - Engineer (Ulm)\n\nRequirements:\nBenefits:\n"), ("2::section::0", "section", "Acme - Untitled role [requirements]\n\nknow it")]


def test_chunking_does_not_shuffle(spark):
    rows = spark.createDataFrame([(1, "Requirements:\nknow it", "Acme", "t")], "doc_id int, text string, source string, title string")
    for strategy in ("fixed", "section"):
        assert "Exchange" not in chunk.chunk(rows, strategy)._jdf.queryExecution().executedPlan().toString()
    made = chunk.chunk(rows, "section", least=1)
    assert [tuple(r) for r in chunk.section_stats(made).collect()] == [("section", "requirements", 1, 1.0, 1)]


def test_long_drop_lists_strip_alike(spark):
    block = "We are an equal employer and we welcome all people."
    rows = spark.createDataFrame([(i, f"own words {i}\n{block}\nshort", c) for i, c in enumerate(["a", "a", "a", "b", None, None, None, ""])] + [(9, None, "a")], "hit_id int, text string, company string")
    short, long = Boilerplate(), Boilerplate(most_broadcast=0)
    assert sorted(map(tuple, short.stripped(rows).collect())) == sorted(map(tuple, long.stripped(rows).collect()))
    assert short.stripped(rows).where(F.contains("text", F.lit(block))).count() == 0
    assert [r.companies for r in short.most_shared(rows).collect()] == [3] and {r.sample for r in short.most_repeated(rows).collect()} == {block}
