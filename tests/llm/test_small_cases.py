"""Each operator on small fixtures: nulls, empty and blank values, ties, repeated rows, empty tables, clashing names."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomery.llm import arrow, canonical, components, encoding, frequency, leak, lines, neardup, splitting, stuffing

WORD = re.compile(r"[^\W_]+")


# 1: canonical values


def places(spark):
    rows = [
        (1, "Pendrixstätt, Germany", "Pendrixstätt", None, "de", ["PNRQ", "The Lantern Mile"]), (2, "Quilmfield, CO", "Quilmfield", "CO", "us", []), (3, "Quilmfield, ID", "Quilmfield", "ID", "us", None),
        (4, "Mount Abrask, HI", "Mount Abrask", "HI", "us", []), (5, "Mount Dovrest, NV", "Mount Dovrest", "NV", "us", []), (6, "Mount Vorsk, NV", "Mount Vorsk", "NV", "us", []), (7, "Pendrixstead, MN", "Pendrixstead", "MN", "us", []),
        (8, "Vorskosa del Río, Spain", "Vorskosa del Río", None, "es", []), (9, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "place_id int, label string, city string, state_code string, country_code string, aliases array<string>")


CASES = {
    "pendrixstatt | DE": 1, "Greater Pendrxistätt Area": 1, "pnrq office": 1, "PNRZ": 0, "the lantern mile / onsite": 1, "Quilmfied, Colorado": 2, "ID - Quilmfield": 3, "Quilmfield": 0, "Quilmfield, USA": 0,
    "Quilmfield, I.D. or remote": 3, "Mt. Abrask": 4, "MountAbrask office, HI 96813": 4, "Mnt Dovrest": 5, "Mount Lumbrik, NV": 0, "Pendrixminster, MN": 0, "Vorskosa del RRío (main site), SPAIN": 8, "Remote": 0, "92101": 0, "Nevada": 0, "--": 0,
}


def test_typed_places(spark):
    values = [*CASES, "Quilmfield, CO", None, "", " \t", "Mt. Abrask"]
    rows = spark.createDataFrame(list(enumerate(values)), "row_id int, value string").withColumn("place_id", F.lit(7)).drop("place_id").withColumn("city", F.lit("clash"))
    got = canonical.map_rows(rows, places(spark)).collect()
    assert {r.value: r.place_id for r in got} == CASES and len(got) == len(CASES) + 1
    assert canonical.map_rows(rows.limit(0), places(spark)).count() == 0
    none = canonical.map_rows(rows, places(spark).limit(0)).collect()
    assert {r.place_id for r in none} == {0} and len(none) == len(CASES) + 2


def test_large_and_small_indexes_map_alike(spark):
    values = spark.createDataFrame([(v,) for v in [*CASES, *[f"Quilmfield {i}" for i in range(40)]]], "value string")
    sent = canonical.map_values(values, places(spark)).collect()
    shuffled = canonical.map_values(values, places(spark), most_broadcast=0).collect()
    assert sorted(map(tuple, sent)) == sorted(map(tuple, shuffled))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_large_and_small_indexes_map_alike_on_tables(spark):
    listed = spark.read.parquet("/root/testdata/sf0.01/places.parquet")
    values = spark.read.parquet("/root/testdata/sf0.01/job_locations.parquet").select(F.col("raw_location").alias("value"))
    sent = canonical.map_values(values, listed).select("value", "place_id").collect()
    shuffled = canonical.map_values(values, listed, most_broadcast=0).select("value", "place_id").collect()
    assert sorted(map(tuple, sent)) == sorted(map(tuple, shuffled))


def test_blanks_count_as_edits(spark):
    values = ["Mount Vorsk", "MountVorsk", "Pendrix stead", "Pendrxi stead", "Pendri stade", "Vorskosa delRio"]
    got = {r.value: r.place_id for r in canonical.map_values(spark.createDataFrame([(v,) for v in values], "value string"), places(spark)).collect()}
    assert got == {"Mount Vorsk": 6, "MountVorsk": 6, "Pendrix stead": 7, "Pendrxi stead": 7, "Pendri stade": 0, "Vorskosa delRio": 8}


@given(st.text("abcd", min_size=5, max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 11), st.sampled_from("abcd")), max_size=2))
@settings(max_examples=200, deadline=None)
def test_words_within_the_edits_share_a_deletion_key(word, changes):
    other = word
    for kind, at, letter in changes:
        at %= len(other)
        other = [other[:at] + other[at + 1 :], other[:at] + letter + other[at:], other[:at] + other[at + 1 : at + 2] + other[at : at + 1] + other[at + 2 :]][kind]
    if canonical.edits(word, other, 2) <= canonical.allowed(max(len(word), len(other))):
        one, two = canonical.deletion_keys([word, other])
        assert set(one) & set(two)


def test_join_hot_is_an_inner_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, v int")
    got = arrow.join_hot(big, small, "k", big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "n", most=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i] + [0] * len(b))
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i][j] = best
    for most in (1, 2, 3):
        assert canonical.edits(a, b, most) == min(rows[-1][-1], most + 1)


# 2: repeated lines


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(3)
    notices = ["Apply at ACME today!", "A-p-p-l-y at acme, 2024 today", "We are an equal employer no. 7", "ok", "Ω é ß"]
    rows = []
    for i in range(300):
        company = rng.choice([" Acme ", "ACME", "beta", "gamma", None, " ", "x" + str(i)])
        text = rng.choice([None, "", " \n\t", *["\n".join(rng.choice([*notices, f"unique line {rng.random()}", "", "123"]) for _ in range(rng.randint(1, 5))) for _ in range(6)]])
        rows.append((i, text, company))
    letters = lambda s: "".join(c for c in s.lower() if c.isalpha())
    kept = [(i, t, c.strip().lower()) for i, t, c in rows if t and t.strip() and c and c.strip()]
    size, held = Counter(c for *_, c in kept), defaultdict(set)
    for i, t, c in kept:
        for s in t.split("\n"):
            if letters(s):
                held[c, letters(s)].add(i)
    want = {(i, n) for i, t, c in kept for n, s in enumerate(t.split("\n"), 1) if letters(s) and len(held[c, letters(s)]) >= 5 and len(held[c, letters(s)]) / size[c] >= 0.1}
    df = spark.createDataFrame(rows, "hit_id long, text string, company string").withColumn("line", F.lit("clash")).withColumn("source", F.lit("clash"))
    found = lines.repeated_lines(df)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert {tuple(r) for r in lines.repeated_lines(df, near=True).collect()} >= want
    for most in (0, 100):
        assert {r.hit_id: r.text for r in lines.without_repeated(df, most_broadcast=most).collect()} == {r.hit_id: r.text for r in lines.without_lines(df, found).collect()}
    cleaned = {r.hit_id: r.text for r in lines.without_lines(df, found).collect()}
    for i, t, _ in rows:
        assert cleaned[i] == (None if t is None else "\n".join(s for n, s in enumerate(t.split("\n"), 1) if (i, n) not in want))
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_near_lines_are_one_group(spark):
    rows = [(i, f"this posting was written by our office in district {'abcdefghij'[i]} and checked twice by the team", "c") for i in range(10)]
    df = spark.createDataFrame(rows, "hit_id long, text string, company string")
    assert lines.repeated_lines(df, share=0.5).count() == 0 and lines.repeated_lines(df, share=0.5, near=True).count() == 10
    others = [(i, "".join(random.Random(i).choices("abcdefghijklmnop", k=30)), "c") for i in range(2, 30)]
    twice = spark.createDataFrame([(i, "\n".join(r[1] for r in rows), "c") for i in range(2)] + others, "hit_id long, text string, company string")
    assert lines.repeated_lines(twice, near=True).count() == 0  # 20 near-equal lines, but in two texts


def test_planted_near_lines_are_found_and_others_are_not(spark):
    rng = random.Random(11)
    nouns = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(800)]
    notices = [" ".join(rng.sample(nouns, 40)) for _ in range(12)]
    common = ["we are looking for", "with a background in", "to join our team of"]

    def varied(notice: str) -> str:
        held = notice.split()
        held[rng.randrange(40)] = rng.choice(nouns)
        return " ".join(held).capitalize() + rng.choice([".", "!", f" {rng.randint(1, 99)}"])

    rows, planted = [], set()
    for i in range(600):
        company = rng.choice(["one", "two", "three"])
        held = [f"{rng.choice(common)} {' '.join(rng.sample(nouns, 7))}" for _ in range(6)]
        if rng.random() < 0.6:
            at = rng.randrange(6)
            held[at] = varied(notices[4 * ["one", "two", "three"].index(company) + rng.randrange(3)])
            planted.add((i, at + 1))
        rows.append((i, "\n".join(held), company))
    found = {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, "hit_id long, text string, company string"), near=True).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)


def test_equal_lines_are_counted_without_bands(spark):
    df = spark.createDataFrame([(i, f"apply now {i}\nline {'abcdefghij'[i]}", "c") for i in range(10)], "hit_id long, text string, company string")
    repeated = lines.RepeatedLines(df)
    assert set(repeated.lines.columns) == {"hit_id", "line_no", "source", "line", "first", "head"}
    assert {tuple(r) for r in repeated.found().collect()} == {(i, 1) for i in range(10)}


def test_a_near_group_counts_over_all_its_clusters(spark, monkeypatch):
    rng = random.Random(6)
    nouns = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(800)]
    notice, rows = rng.sample(nouns, 40), []
    for i in range(400):
        held = [" ".join(rng.sample(nouns, 10)) for _ in range(3)]
        if i < 42:
            own = list(notice)
            own[rng.randrange(40)] = rng.choice(nouns)
            held[1] = " ".join(own)
        rows.append((i, "\n".join(held), "c"))
    df = spark.createDataFrame(rows, "hit_id long, text string, company string")
    want = {(i, 2) for i in range(42)}  # 10.5 % of the texts, but less in each band's largest cluster
    assert {tuple(r) for r in lines.repeated_lines(df, near=True).collect()} == want
    assert lines.repeated_lines(df, near=True, share=0.11).count() == 0 and lines.repeated_lines(df).count() == 0
    for most in (0, 100):
        got = {r.hit_id: r.text for r in lines.without_repeated(df, near=True, most_broadcast=most).collect()}
        assert got == {i: "\n".join(t.split("\n")[::2]) if i < 42 else t for i, t, _ in rows}
    monkeypatch.setattr(lines, "MOST_BROADCAST", 0)
    assert {tuple(r) for r in lines.repeated_lines(df, near=True).collect()} == want


# 3: near duplicates


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(60):
        base = rng.sample(vocabulary, 60)
        for n in (0, 0, 1, 3, 6, 12):
            rows.append((k, rng.choice([None, "Title " + base[0]]), " ".join(rng.sample(edited(rng, base, n), 60))))
            k += 1
    rows += [(k, "t", None), (k + 1, "t", "  "), (k + 2, None, "!!!"), (k + 3, None, "one"), (k + 4, None, "One one")]
    sets = {i: frozenset(WORD.findall(((t or "") + " " + x).lower())) for i, t, x in rows if x and x.strip()}
    ids = sorted(i for i in sets if sets[i])
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    df = spark.createDataFrame(rows, "hit_id long, title string, text string").withColumn("set_id", F.lit("clash")).withColumn("bits", F.lit(1))
    near = neardup.NearDuplicates(df)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.03 * len(want)
    groups = near.groups()
    assert groups.count() == len(ids)
    at = {r.hit_id: r.group_id for r in groups.collect()}
    assert all(at[a] == at[b] for a, b in got) and at[k + 3] == at[k + 4]
    assert neardup.NearDuplicates(df.limit(0)).pairs().count() == 0


def test_large_classes_stay_linear_and_keep_their_links(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, None, " ".join(words)) for i in range(30)] + [(100 + i, None, " ".join([*words[:-2], "x", "y"])) for i in range(4)]
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "hit_id long, title string, text string"))
    assert near.pairs().count() == 30 * 29 // 2 + 6 + 120
    few = {tuple(r) for r in near.pairs(expand=10).collect()}
    assert len(few) == 29 + 6 + 4 and (0, 29) in few and (0, 103) in few


def test_large_classes_of_different_texts_lose_no_pair(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, None, " ".join(words[i % 50 :] + words[: i % 50]) + "!" * (i // 50)) for i in range(1100)]
    rows += [(5000 + i, None, " ".join([*words[:-2], "x", "y"])) for i in range(4)]
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "hit_id long, title string, text string"))
    want = 1100 * 1099 // 2 + 6 + 4400
    for got in (near.pairs(), near.pairs(block=300), near.pairs(expand=1000)):
        assert got.count() == got.distinct().count() == want and got.where("hit_id_a >= hit_id_b").count() == 0
    few = {tuple(r) for r in near.pairs(expand=3).collect()}
    assert len(few) == 1100 * 1099 // 2 + 3 + 1100 and (1099, 5000) in few and (1099, 5003) not in few


def test_all_exact_copies_are_paired(spark):
    near = neardup.NearDuplicates(spark.range(1003).select(F.col("id").alias("hit_id"), F.lit("t").alias("title"), F.lit("one two").alias("text")))
    assert near.pairs().distinct().count() == 1003 * 1002 // 2


def test_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200_000)]
    rows = []
    for k in range(1500):  # 70 shared words of 100: exactly 0.7
        held = rng.sample(vocabulary, 100)
        rows += [(2 * k, None, " ".join(held[:85])), (2 * k + 1, None, " ".join(held[:70] + held[85:]))]
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "hit_id long, title string, text string"))
    assert near.pairs().count() >= 0.995 * 1500


def test_large_buckets_lose_no_pair(spark):
    sets = list(range(23))
    rows = [(i, [7, 100 + i % 2, 200 + i]) for i in sets] * 2 + [(50, [1000, 101, 8]), (51, [1001, 1002, 8]), (52, [1003, 1004, 1005]), (0, [])]
    held = spark.createDataFrame(rows, "set_id long, bands array<long>")
    want = {(a, b) for a in sets for b in sets if a < b} | {(i, 50) for i in sets if i % 2} | {(50, 51)}
    for most, block in ((1, 2), (2, 5), (4, 100), (22, 7), (23, 7), (100, 100)):
        got = [tuple(r) for r in neardup.bucket_pairs(held, most, block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_estimate_is_close(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.3, 0.5, 0.7, 0.9):
        both, own = int(200 * share), int(200 * (1 - share) / 2)
        shared = rng.integers(0, 2**32, both, dtype=np.uint64)
        sets = [np.concatenate([shared, rng.integers(0, 2**32, own, dtype=np.uint64)]) for _ in range(2)]
        flat = np.concatenate(sets).astype(np.uint32)
        minima = neardup.signatures(flat, np.cumsum([len(s) for s in sets]))
        bits = neardup.packed_bits(minima)
        row = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist())], "a array<long>, b array<long>")
        got = row.select(neardup.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - both / (both + 2 * own)) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_buckets_give_the_groups_of_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    bases = [rng.sample(vocabulary, 40) for _ in range(4)]
    rows = [(k, None, " ".join(edited(rng, rng.choice(bases), rng.choice([1, 2, 3, 5, 8])))) for k in range(300)]
    sets = {k: frozenset(WORD.findall(t)) for k, _, t in rows}
    at = {k: k for k in sets}

    def root(k: int) -> int:
        while at[k] != k:
            k = at[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
                at[root(a)] = root(b)
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "hit_id long, title string, text string"))
    for crowd in (4, 32):
        got = {r.hit_id: r.group_id for r in near.groups(crowd=crowd, block=16).collect()}
        assert len({(got[k], root(k)) for k in sets}) == len({root(k) for k in sets}) == len(set(got.values()))


# 4: splitting


@given(st.text(st.sampled_from("ab .\n\t!é。字😀"), max_size=400), st.sampled_from([(20, 5), (33, 0), (50, 24)]))
@settings(max_examples=300, deadline=None)
def test_pieces_join_to_the_text(text, bounds):
    size, overlap = bounds
    ends = splitting.cut_points(text, size, overlap)
    start, joined = 0, ""
    for n, end in enumerate(ends):
        piece = text[start:end]
        assert len(piece) <= size and (n == 0 or end > ends[n - 1])
        joined += piece[overlap:] if n else piece
        start = end - overlap
    assert joined == text and (len(ends) == 1) == (len(text) <= size)


def test_cut_falls_where_the_topic_turns(spark):
    one, two = "The baker kneads dough and bakes bread. " * 12, "A sailor steers ships across the sea. " * 12
    ends = splitting.cut_points(one + two, 700, 50)
    assert ends[0] == len(one)


def test_split_table(spark):
    rows = [(1, "x" * 5000, "a"), (1, "x" * 5000, "a"), (2, "short", "b"), (3, None, None), (4, "", ""), (5, " " * 1601, None), (6, "word " * 321, "c"), (7, "y" * 1600, "d")]
    df = spark.createDataFrame(rows, "hit_id long, text string, section string").withColumn("pieces", F.lit("clash")).withColumn("start", F.lit("clash"))
    got = splitting.split_oversized(df).collect()
    assert Counter(r.hit_id for r in got if r.piece_no == 0) == {1: 2, 5: 1, 6: 1}
    assert all(len(r.text) <= 1600 and r.pieces > 1 for r in got)
    assert all(r.text.endswith(" ") for r in got if r.hit_id == 6) and splitting.split_oversized(df.limit(0)).count() == 0


# 5: frequencies


def test_term_counts(spark):
    rows = [
        ("r1", "gap", "Data--Platform ", 3, None), ("r1", "gap", "Data--Platform ", 3, None), ("r1", "gap", "data_platform", 1, 5), ("r2", "gap", "data\tplatform", None, 5), ("r2", "gap", None, 9, 9),
        ("r3", "gap", " _- ", 9, 9), (None, "gap", "solo", 7, 1), ("r4", "gap", "solo", 0, 1), ("r4", "strength", "solo", 0, 1), ("r5", None, "x\ny", 50, 1),
    ]
    df = spark.createDataFrame(rows, "report_id string, kind string, term string, postings int, total int").withColumn("_salt", F.lit("clash")).withColumn("records", F.lit("clash"))
    counts = frequency.term_counts(df, "term", "report_id", "postings", ["kind", "total"])
    assert {r.term: (r.occurrences, r.weight, r.records) for r in counts.collect()} == {"data platform": (3, 4, 2), "solo": (3, 7, 1), "x\ny": (1, 50, 1)}
    marks = {r.term: r.marks for r in frequency.mark_terms(counts, df, "report_id").collect()}
    assert marks == {"data platform": ["rare", "common"], "solo": [], "x\ny": []}
    assert frequency.mark_terms(frequency.term_counts(df.limit(0), "term", "report_id", "postings", []), df.limit(0), "report_id").count() == 0


def test_hot_term_is_salted(spark):
    df = spark.range(5000).select(F.lit("hot").alias("term"), (F.col("id") % 700).cast("string").alias("report_id"), F.lit(1).alias("postings"), F.col("id").alias("n"))
    counts = frequency.term_counts(df, "term", "report_id", "postings", ["n"], salts=8)
    assert [tuple(r) for r in counts.collect()] == [("hot", 5000, 5000, 700)]
    assert "_salt" in counts._jdf.queryExecution().executedPlan().toString()


# 6: encoding


def test_encoding_equals_the_published_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = ["", None, "Hello  world\n\n it's <|endoftext|> 字 é​\x00 😀", " " * 50 + "x", "日本語" * 200, "a" * 3000, "don't 've 12345 ###"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = encoding.encode_corpus(df)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert all(got[i] == (reference.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts))
    back = {r.doc_id: bytes(r.bytes).decode() for r in encoding.decode_corpus(coded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert encoding.encode_corpus(df.limit(0)).count() == 0


@given(st.text(st.sampled_from("ab' \n\t.,1é字s't"), max_size=300), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_safe_parts_change_no_token(text, most):
    with open(encoding.default_rank_file(), "rb") as file:
        encoder = encoding.build_encoding(file.read())
    assert "".join(encoding.safe_parts(text, most)) == text
    assert encoding.encode_text(encoder, text, most) == encoder.encode_ordinary(text)


# 7: leaks


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    items = [(f"q{i}", " ".join(rng.choices(common, k=rng.choice([5, 12, 30]))), rng.choice([None, "", " ".join(rng.choices(common, k=40))])) for i in range(30)] + [("qn", None, None)]
    docs = []
    for i in range(200):
        ws = rng.choices(common, k=rng.randint(0, 40))
        if rng.random() < 0.5:
            source = (rng.choice(items)[rng.choice([1, 2])] or "").split()
            n, at = rng.choice([11, 12, 13, 25]), rng.randint(0, 10)
            ws[5:5] = source[at : at + n]
        docs.append((i, rng.choice([" ", ", ", "\n>> "]).join(w.upper() if rng.random() < 0.2 else w for w in ws)))
    docs += [(500, None), (501, ""), (502, docs[0][1])]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 11)}
    asked = {q: grams(a) | grams(b) for q, a, b in items}
    want = {(i, q) for i, t in docs for q, g in asked.items() if g & grams(t)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("question_id", F.lit("clash"))
    qs = spark.createDataFrame(items, "id string, question string, passage string")
    assert {tuple(r) for r in leak.leaked_items(df, qs).collect()} == want and len(want) > 20
    assert {tuple(r) for r in leak.leaked_items(df, qs, most_bits=64).collect()} == want  # a filter that lets all through
    many = spark.createDataFrame([(7, docs[k % 3][1] if k % 4 else " ".join(items[2][1].split() + items[1][1].split())) for k in range(400)], "doc_id long, text string")
    got = leak.leaked_items(many, qs)
    per = {q: sum(bool(g & grams(t)) for _, t in many.collect()) for q, g in asked.items()}
    assert {r.question_id: r["count"] for r in got.groupBy("question_id").count().collect()} == {q: n for q, n in per.items() if n}
    assert leak.leaked_items(df.limit(0), qs).count() == 0 and leak.leaked_items(df, qs.limit(0)).count() == 0


# 8: stuffed pages


def test_stuffed_pages(spark):
    rng = random.Random(4)
    nouns = [f"noun{i}" for i in range(400)]
    said = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} is in a {rng.choice(nouns)} and we are with the {rng.choice(nouns)} for it."
    rows = [(i, " ".join(said() for _ in range(rng.randint(4, 30))), "en") for i in range(300)]
    bad = {
        1000: ", ".join(rng.choice(nouns) for _ in range(150)), 1001: "cheap jobs here " * 80, 1002: "\n".join(f"- http://x{i}.example/tag/{i}" for i in range(90)),
        1003: said() + " " + " | ".join(rng.choice(["home", "login", "jobs"]) for _ in range(150)), 1004: "#".join(nouns[:120]),
    }
    good = {2000: " ".join(said() for _ in range(20)) + " Tools: noun1, noun2, noun3, http://a.example", 2001: "!!! ???", 2002: "Short ad.", 2003: " ".join(said() for _ in range(25))}
    rows += [(i, t, rng.choice(["en", None, "xx"])) for i, t in {**bad, **good}.items()] + [(3000, None, "en"), (3001, "", None), (3002, " \n", "en"), (3003, bad[1000], "EN-us")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("clash")).withColumn("row", F.lit(1))
    pages = stuffing.stuffed_pages(df)
    assert {r.doc_id for r in pages.where("stuffed").collect()} == {*bad, 3003}
    assert pages.count() == 300 + len(bad) + len(good) + 1
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_tags_between_sentences_that_score_well_are_stuffed(spark):
    rng = random.Random(6)
    nouns = [f"noun{i}" for i in range(4000)]
    said = lambda n=3: f"The {rng.choice(nouns)} of the {' '.join(rng.sample(nouns, n))} is in a {rng.choice(nouns)} and we are with the {rng.choice(nouns)} for it."
    dense = "It is in the and of a we are with it for the"
    tags = lambda n: " ".join(f"#{w}" for w in rng.sample(nouns, n))
    rows = [(i, " ".join(said() for _ in range(rng.randint(4, 30))), "en") for i in range(300)]
    rows += [(1000 + n, "\n".join(f"{tags(25)} {dense} {rng.choice(nouns)}." for _ in range(n)), None) for n in range(2, 8)]
    rows += [(2000 + n, "\n".join(f"{tags(12)}\n{said()} {said()}" for _ in range(n)), None) for n in range(2, 8)]
    pages = stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in pages.where("stuffed").collect()} == set(range(1002, 1008))


def test_slope_of_a_power_law(spark):
    steps = [{"f": max(1, round(1000 / r)), "c": 1} for r in range(1, 101)]
    merged = Counter()
    for s in steps:
        merged[s["f"]] += 1
    page = spark.createDataFrame([(1, 1, sorted(merged.items(), reverse=True))], "doc_id long, row long, steps array<struct<f:int,c:int>>")
    fitted = stuffing.fit_curves(page).first()
    assert abs(fitted.slope + 1) < 0.05 and fitted.residual < 0.05
