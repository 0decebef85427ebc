"""Golden cases of the rule-based operators."""

import random
import statistics

from pyspark.sql import functions as F

from loomery.config import Config
from loomery.operators import answer, ask, evaluate, place, resume, skills
from loomery.operators.sample import first_of_each, round_robin, snapshot_delta


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column(F.col("x"))).collect()]


def test_seniority(spark):
    cases = [
        ("Director of Engineering", 14.0, "director"), ("Chief Technology Officer", 20.0, "executive"), ("VP of Platform", 16.0, "executive"), ("Engineering Manager", 9.0, "manager"),
        ("Staff Engineer", 11.0, "senior"), ("Sr. Analyst", 6.0, "senior"), ("Junior Developer", 1.0, "entry"), ("Frontend Developer", 1.5, "entry"), ("Frontend Developer", 8.0, "mid"),
        ("Team Lead", 7.0, "manager"), ("Leadership Coach", 5.0, "mid"),
    ]
    df = spark.createDataFrame(cases, "t string, y double, want string")
    assert [(r.got, r.want) for r in df.select(resume.seniority(F.array("t"), F.col("y")).alias("got"), "want").collect() if r.got != r.want] == []


def test_years(spark):
    asked = ["1.5 years of professional experience", "11 years of experience", "12+ years of progressive experience", "with 7 years of relevant experience", "2019 - 2023, then 03/2021 to present", "none", None]
    assert one(spark, resume.years, *asked) == [1.5, 11.0, 12.0, 7.0, 7.0, None, None]


def test_titles(spark):
    text = "Jane Doe\nSenior Data Engineer | Acme\nsenior data engineer\nData Analyst, Foo\nHobbies"
    assert one(spark, resume.titles, text, None) == [["Senior Data Engineer", "Data Analyst"], []]


def test_citations(spark):
    text = "x [2] y [1] z [2] w [9]"
    assert one(spark, lambda c: answer.citations(c, F.lit(3)), text, None, "[1, 2]") == [[2, 1], [], []]
    assert one(spark, lambda c: answer.dangling(c, F.lit(3)), text, None) == [1, 0]


def test_verdicts_and_guards(spark):
    assert [tuple(v)[:2] + (v.ran,) for v in one(spark, answer.parse_verdict, 'ok {"total_claims": 3, "unsupported_claims": 1}', "no", None)] == [(3, 1, True), (0, 0, False), (0, 0, False)]
    rows = spark.createDataFrame([(4, 7), (1, 3), (35, 100), (34, 100), (0, 0)], "u int, t int").select(F.struct(F.col("t").alias("total"), F.col("u").alias("unsupported"), F.lit(True).alias("ran")).alias("v"))
    said = [r[0] for r in rows.select(answer.outcome(F.lit(0.7), F.lit("fine"), F.col("v"))).collect()]
    assert said == ["refused: claims", "answered", "refused: claims", "answered", "answered"]


def test_fit(spark):
    row = skills.fit(spark.createDataFrame([("python kubernetes", "Kubernetes kubernetes python docker")], "resume string, job string")).first()
    assert (row.fit_percent, row.core_cut, row.core_met, row.gaps, row.confidence) == (75, 2, ["kubernetes"], ["docker"], "low")
    empty = skills.fit(spark.createDataFrame([(None, None)], "resume string, job string")).first()
    assert (empty.fit_percent, empty.matched, empty.confidence) == (0, [], "low")


def test_terms_and_opener(spark):
    assert one(spark, skills.terms_in, "Machine learning with Spark. and AWS, GCP!", None) == [["aws", "gcp", "machine learning", "spark"], []]
    assert one(spark, skills.opener, [], ["a"], ["a", "b"], ["a", "b", "c", "d", "e"], kind="array<string>") == ["", "My experience covers a.", "My experience covers a and b.", "My experience covers a, b, c and d."]


def test_places(spark):
    asked = ["Hybrid - Austin, TX", "Remote, United States", "Anywhere in the US", "London, UK", "", None]
    assert one(spark, place.work_mode, *asked) == ["hybrid", "remote", "remote", "onsite", "unknown", "unknown"]
    assert one(spark, place.parts, "A / B (c); d - e. or f", None) == [["a", "b", "c", "d", "e", "f"], []]
    assert one(spark, place.without_mode, "Remote - US", "Berlin (hybrid)") == ["us", "berlin"]
    assert one(spark, lambda c: place.authorization(c), "No visa sponsorship. Security clearance", None) == [["no_sponsorship", "clearance_required"], []]


def test_term_matching(spark):
    rows = spark.createDataFrame([("phi", "sophisticated"), ("go", "going"), ("ts/sci", "Active TS/SCI clearance"), ("big data", "Big data!")], "t string, x string")
    assert [r[0] for r in rows.select(evaluate.term_in(F.col("t"), F.col("x"))).collect()] == [False, False, True, True]


def test_percentiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert tuple(evaluate.percentiles(rows, "v").first()) == (10.5, 19.0)
    assert tuple(evaluate.percentiles(rows.limit(1), "v").first()) == (1.0, 1.0)
    assert tuple(evaluate.percentiles(rows.limit(0), "v").first()) == (None, None)


def test_samples_and_delta(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aaaabbc")] + [(9, None)], "doc_id long, source string")
    assert [r.doc_id for r in round_robin(rows, 5, "source", "doc_id").collect()] == [0, 4, 6, 9, 1]
    assert first_of_each(rows, 1, "source", "doc_id").count() == 4
    after = spark.createDataFrame([(0, "a"), (1, "z"), (20, "a")], "doc_id long, source string")
    states = {r.doc_id: r.state for r in snapshot_delta(rows.where("doc_id < 3"), after, "doc_id", ["source"]).collect()}
    assert states == {0: "same", 1: "changed", 2: "closed", 20: "new"}


def test_location_parse(spark):
    cases = {
        "Toronto, CA": ("ca", None, "toronto", "NOT_REMOTE", "high"), "San Francisco, CA": ("us", "ca", "san francisco", "NOT_REMOTE", "medium"), "Remote - CA, TX, NY": ("us", None, None, "US_STATES", "high"),
        "Remote": (None, None, None, "UNKNOWN", "low"), "Anywhere in the US": ("us", None, None, "US", "high"), "Remote, United States": ("us", None, None, "US", "high"),
        "Remote - North America": (None, None, None, "REGION", "medium"), "Worldwide": (None, None, None, "GLOBAL", "high"), "Bangalore, India": ("in", None, "bangalore", "NOT_REMOTE", "high"),
        "London, UK": ("gb", None, "london", "NOT_REMOTE", "high"), "Ulm, DE": ("us", "de", "ulm", "NOT_REMOTE", "medium"), "New York, NY": ("us", "ny", None, "NOT_REMOTE", "high"),
        "Hybrid - Austin, TX": ("us", "tx", None, "NOT_REMOTE", "high"), "South America": (None, None, None, "NOT_REMOTE", "medium"),
        "Remote - Central America": (None, None, None, "REGION", "medium"), "Remote Germany": ("de", None, None, "COUNTRY", "medium"), "Berlin office Germany": ("de", None, None, "NOT_REMOTE", "medium"),
        "Deutschland": ("de", None, "deutschland", "NOT_REMOTE", "high"), "Texas, America": ("us", "tx", None, "NOT_REMOTE", "high"), "Remote, Texas": ("us", "tx", None, "US_STATES", "high"),
        "Remote - TX, NY, USA": ("us", None, None, "US_STATES", "high"), "Springfield, OR, US": ("us", "or", "springfield", "NOT_REMOTE", "high"), "Northfield Park": (None, None, "northfield park", "NOT_REMOTE", "low"),
         "": (None, None, None, "NOT_REMOTE", "low"), None: (None, None, None, "NOT_REMOTE", "low"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", place.parse(F.col("x")).alias("p")).collect()
    assert {r.x: (r.p.country, r.p.state, r.p.city, r.p.remote_scope, r.p.confidence) for r in rows} == cases
    by = {r.x: r.p for r in rows}
    assert by["Remote - CA, TX, NY"].remote_states == ["ca", "ny", "tx"] and by["Remote - North America"].region_countries == ["ca", "mx", "us"] and by["Worldwide"].work_mode == "remote"


def test_config():
    held = Config.from_environment({"LOOMERY_CANDIDATES": "40", "LOOMERY_LEAST_SIMILARITY": "0.5", "OTHER": "x"})
    assert (held.candidates, held.least_similarity, held.problems()) == (40, 0.5, [])
    assert len(Config(chunk_overlap=2000, results=30, strategy="x").problems()) == 3
    assert "judge independent" in Config(generator="a", judge="b").describe() and "same as generator" in Config(generator="a", judge="a").describe()


def test_ask_many(spark):
    hits = spark.createDataFrame([("a", 1, 0.9, "t1"), ("a", 2, 0.7, "t2"), ("b", 1, 0.3, "t3"), ("c", 1, 0.8, "t4"), ("d", 1, 0.8, "t5")], "qid string, rank int, sim double, text string")
    for c in ("company", "title", "section", "location", "compensation"):
        hits = hits.withColumn(c, F.lit("x"))
    asked = spark.createDataFrame([(q, f"question {q}") for q in "abcde"], "qid string, question string")

    def model(prompts):
        return ["INSUFFICIENT_CONTEXT" if "question c" in p else "said [2] [9]" for p in prompts]

    def verifier(prompts):
        return ['{"total_claims": 2, "unsupported_claims": %d}' % ("question d" in p) for p in prompts]

    got = {r.qid: r for r in ask.ask(hits, asked, model, verifier).collect()}
    assert {q: r.outcome for q, r in got.items()} == {"a": "answered", "b": "refused: similarity", "c": "refused: model", "d": "refused: claims", "e": "refused: similarity"}
    assert got["a"].citations == [2] and got["a"].dangling == 1 and got["b"].reply is None and len(got["a"].trace) == 3
    assert ask.markdown(asked.orderBy("qid").limit(1)) == "| qid | question |\n|---|---|\n| a | question a |"


def test_rerank(spark):
    hits = spark.createDataFrame([("a", 1, "q", "x"), ("a", 2, "q", "yyy"), ("a", 3, "q", "zz")], "qid string, rank int, question string, text string")
    got = ask.rerank(hits, lambda pairs: [float(len(t)) for _, t in pairs], 2).orderBy("rank").collect()
    assert [(r.text, r.fused_rank) for r in got] == [("yyy", 2), ("zz", 3)]
    assert [r.text for r in ask.rerank(hits, None, 2).orderBy("rank").collect()] == ["x", "yyy"]


def test_coverage_keeps_punctuated_terms(spark):
    terms = [("a", ["c++"]), ("b", ["++"]), ("c", ["foo"]), ("d", ["Two Words", "zebra"]), ("e", None), ("f", ["r&d"]), ("g", ["x_y"])]
    questions = spark.createDataFrame(terms, "id string, expect_terms array<string>")
    texts = [("abc++", "s1"), ("foo_bar", "s1"), ("foo-bar TWO  words, zebra", "s2"), ("R&D x_y", None), (None, "s3"), ("two words zebra", "s2")]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id int, text string, source string").withColumn("id", F.lit("clash"))
    got = {r.id: (r.docs, r.sources, r.label) for r in evaluate.coverage(questions, rows).collect()}
    assert got == {"a": (1, 1, "THIN"), "b": (1, 1, "THIN"), "c": (1, 1, "THIN"), "d": (2, 1, "THIN"), "e": (0, 0, "NOT IN CORPUS"), "f": (1, 0, "THIN"), "g": (1, 0, "THIN")}
    each = questions.where("expect_terms IS NOT NULL").select("id", F.explode("expect_terms").alias("t")).crossJoin(rows.select("text")).where(evaluate.term_in(F.col("t"), F.col("text")))
    assert {r.id for r in each.collect()} == {k for k, v in got.items() if v[0]}
    assert evaluate.coverage(questions, rows.limit(0)).where("docs > 0").count() == 0 and evaluate.coverage(questions.limit(0), rows).count() == 0


def test_percentiles_equal_sorted_positions(spark):
    rng = random.Random(1)
    for values in ([3.0], [1.0, 2.0], [rng.choice([0.5, rng.random()]) for _ in range(999)], [7.0] * 50):
        row = evaluate.percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4), "v").first()
        held = sorted(values)
        assert row.p50 == round(statistics.median(held), 6) and row.p95 == round(held[int(len(held) * 0.95) - 1], 6)
    empty = evaluate.percentiles(spark.createDataFrame([], "v double"), "v").first()
    assert empty.p50 is None and empty.p95 is None


def test_market_counts_postings(spark):
    pairs = spark.createDataFrame([("python", j) for j in ["python sql", "python sql sql sql", "docker", "", None]], "resume string, job string")
    got = {(r.kind, r.term): (r.postings, r.core_in, r.total, r.low) for r in skills.market(skills.fit(pairs), 0.1).collect()}
    assert got == {("strength", "python"): (2, 0, 3, 3), ("gap", "sql"): (2, 1, 3, 3), ("gap", "docker"): (1, 0, 3, 3)}
    assert skills.market(skills.fit(pairs.limit(0))).count() == 0 and {r.term for r in skills.market(skills.fit(pairs), 0.5, 1).collect()} == {"python", "sql"}


def test_competencies_are_ordered_and_counted(spark):
    fitted = skills.fit(spark.createDataFrame([(1, "python", "python java kafka kafka kafka kafka"), (2, "python", "")], "id int, resume string, job string"))
    rows = skills.competencies(fitted, "id").orderBy("ord").collect()
    assert [(r.grp, r.matched, r.missing, r.weight, r.total, r.percent, r.ord) for r in rows] == [("Data", [], ["kafka"], 4, 1, 0, 1), ("Languages", ["python"], ["java"], 2, 2, 50, 2)]


def test_resume_structure(spark):
    text = "Senior Data Engineer | Acme\nFull-Stack Engineer\nPython, SQL, Spark, Kafka and Docker in CA and GA, with SOC audits.\n2015 - 2019 and 03/2019 to present. " + "x" * 400
    got = resume.load(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, text string"), taxonomy={"A": ["python", "sql"], "B": ["python", "kafka"], "C": ["rust"]}).orderBy("id").collect()
    assert got[0].skills == ["kafka", "python", "soc", "sql"] and [(c.grp, c.terms) for c in got[0].competencies] == [("A", ["python", "sql"]), ("B", ["kafka", "python"])]
    assert got[0].titles == ["Senior Data Engineer"] and got[0].years == 11.0 and got[0].seniority == "senior" and got[0].usable and got[0].warnings == ["few skills"]
    assert got[0].summary.endswith(" chars via text, 4 skill term(s), ~11 yrs, senior")
    assert [r.usable for r in got[1:]] == [False, False] and got[1].skills is None and got[1].warnings == ["little text"]


def test_templates_of_authorization(spark):
    assert place.expanded("a/b c? d|e") == ["a d/e", "a c d/e", "b d/e", "b c d/e"]
    asked = ["We do not provide sponsorship.", "Visa sponsorship available; U.S. citizens, TS/SCI", "must be legally authorized to work in the United States", "sponsored talks", None]
    assert one(spark, place.authorization, *asked) == [["no_sponsorship"], ["sponsorship_available", "clearance_required"], ["us_auth_required"], [], []]


def test_verifier_sees_answers_alone_and_each_prompt_is_sent_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def model(prompts):
        with open(log, "a") as file:
            file.writelines("model\n" for _ in prompts)
        return [answer.REFUSAL if "refuse" in p else "yes [1]" for p in prompts]

    def verifier(prompts):
        with open(log, "a") as file:
            file.writelines("verifier\n" for _ in prompts)
        return ['{"total_claims": 2, "unsupported_claims": 1, "worst": "w"}' for _ in prompts]

    hits = spark.createDataFrame([(q, 1, s, "t", "c", "x", None, None, None) for q, s in (("a", 0.9), ("b", 0.9), ("c", 0.1))], "qid string, rank int, sim double, text string, company string, title string, section string, location string, compensation string")
    asked = spark.createDataFrame([("a", "please refuse"), ("b", "please say"), ("c", "unsure"), ("d", "no hits")], "qid string, question string")
    done = ask.ask(hits, asked, model, verifier, resume="r" * 9000)
    got = {r.qid: (r.outcome, r.verified) for r in done.collect()}
    assert got == {"a": ("refused: model", False), "b": ("refused: claims", True), "c": ("refused: similarity", False), "d": ("refused: similarity", False)}
    assert {r.qid: r.prompt_chars > 6000 for r in done.collect()} == {"a": True, "b": True, "c": False, "d": False}
    with open(log) as file:
        assert sorted(file.read().split()) == ["model", "model", "verifier"]
    assert "refused: 1/2 claims unsupported" in {t for r in done.collect() for t in r.trace}


def test_best_configuration(spark):
    measured = spark.createDataFrame([("a", 0.5, 0.2), ("b", 0.5, 0.3), ("c", 0.4, 0.9), ("d", None, None)], "config string, mrr double, separation double")
    row = evaluate.best_configuration(measured).first()
    assert (row.config, row.cleanest) == ("b", "c")


def test_golden_replies(spark):
    rows = [
        (1, 0.72, 3, "x [2] y [1] z [2] w [9]", 'Sure: {"total_claims": 3, "unsupported_claims": 1, "worst": "w"}'), (2, 0.59, 3, "never shown [1]", '{"total_claims": 1, "unsupported_claims": 0, "worst": ""}'),
        (3, 0.81, 5, "INSUFFICIENT_CONTEXT", None), (4, 0.66, 5, "a [1] b [5] c [6] d [0]", '{"total_claims": 7, "unsupported_claims": 4, "worst_example": "b"}'), (5, 0.90, 2, "grouped [1, 2]", "no json here"),
        (6, 0.60, 0, None, '{"total_claims": 0, "unsupported_claims": 0, "worst": ""}'), (7, None, 4, "[4][3][4]", '{"total_claims": 100, "unsupported_claims": 35, "worst": "much"}'),
    ]
    df = spark.createDataFrame(rows, "id int, top_sim double, hits int, reply string, judged string")
    verdict = answer.parse_verdict(F.col("judged"))
    got = df.select("id", answer.citations(F.col("reply"), F.col("hits")).alias("c"), answer.dangling(F.col("reply"), F.col("hits")).alias("d"), answer.outcome(F.col("top_sim"), F.col("reply"), verdict).alias("o"), verdict.alias("v")).orderBy("id").collect()
    assert [r.c for r in got] == [[2, 1], [1], [], [1, 5], [], [], [4, 3]] and [r.d for r in got] == [1, 0, 0, 2, 0, 0, 0]
    assert [r.o for r in got] == ["answered", "refused: similarity", "refused: model", "refused: claims", "answered", "answered", "refused: similarity"]
    assert [(r.v.total, r.v.unsupported, r.v.worst, r.v.ran) for r in got] == [(3, 1, "w", True), (1, 0, "", True), (0, 0, None, False), (7, 4, "b", True), (0, 0, None, False), (0, 0, "", True), (100, 35, "much", True)]
