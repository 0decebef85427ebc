"""The subpackage's queries that have SQL, on the smallest tables."""

import os
import re

import pytest

from loomery.llm import queries
from tests.test_entry import FOLDER, canonical

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    want = connection.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


def rows_of(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


def read(spark, name, *columns):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def blank(text):
    return text is None or not re.sub(r"[\s\x1c-\x1f\x85]", "", text)


def test_every_open_value_is_mapped_or_told(spark):
    labels = {r.label for r in read(spark, "places", "label")}
    asked = {("job_locations", r[0]): r[1] for r in read(spark, "job_locations", "location_id", "raw_location")} | {("hits", r[0]): r[1] for r in read(spark, "hits", "hit_id", "location")}
    got = {(r.tbl, r.row_id): r.place_id for r in rows_of(spark, "p1_found")}
    assert set(got) == {k for k, v in asked.items() if not blank(v) and v not in labels}
    cities = {r.place_id: r for r in read(spark, "places", "place_id", "city", "aliases")}
    plain = [(asked[k].lower(), p) for k, p in got.items() if p]
    named = [any(n.lower() in v for n in [cities[p].city, *cities[p].aliases]) for v, p in plain]
    assert sum(named) > 0.4 * len(named)
    unmatched = {r.value: r.rows for r in rows_of(spark, "p1_unmatched")}
    assert sum(unmatched.values()) == sum(p == 0 for p in got.values()) and set(unmatched) == {asked[k] for k, p in got.items() if p == 0}


def test_near_lines_hold_the_equal_ones(spark):
    equal, near = ({(r.hit_id, r.line_no) for r in rows_of(spark, n)} for n in ("p2_found", "p2_near"))
    assert equal and equal <= near and len(near) <= 1.2 * len(equal)


def test_near_duplicates_equal_brute_force(spark):
    sets = {r.hit_id: set(words(f"{r.title or ''} {r.text}")) for r in read(spark, "hits", "hit_id", "title", "text") if not blank(r.text)}
    ids = sorted(k for k, v in sets.items() if v)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    found = [tuple(r) for r in rows_of(spark, "p3_found")]
    assert set(found) == want and len(found) == len(want)
    group = {r.hit_id: r.group_id for r in rows_of(spark, "p3_groups")}
    at = {k: k for k in ids}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in want:
        at[root(a)] = root(b)
    assert set(group) == set(ids) and len({(group[k], root(k)) for k in ids}) == len(set(group.values())) == len({root(k) for k in ids})


def test_pieces_join_to_their_texts(spark):
    texts = {r.hit_id: r.text for r in read(spark, "hits", "hit_id", "text") if r.text and len(r.text) > 1600}
    pieces = {}
    for r in sorted(rows_of(spark, "p4_pieces"), key=lambda r: (r.hit_id, r.piece_no)):
        pieces.setdefault(r.hit_id, []).append(r.text)
    assert set(pieces) == set(texts)
    for k, held in pieces.items():
        assert max(map(len, held)) <= 1600 and held[0] + "".join(p[200:] for p in held[1:]) == texts[k] and all(a[-200:] == b[:200] for a, b in zip(held, held[1:]))


def test_ids_decode_to_the_texts(spark):
    from loomery.llm.encoding import decode_corpus

    texts = {r.doc_id: (r.text or "").encode() for r in read(spark, "documents", "doc_id", "text")}
    ids = queries.queries()["p6_ids"](spark, FOLDER)
    assert {r.doc_id: bytes(r.bytes) for r in decode_corpus(ids).collect()} == texts


def test_leaks_equal_brute_force(spark):
    runs = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    asked = {r.id: runs(r.question) | runs(r.passage) for r in read(spark, "questions", "id", "question", "passage")}
    want = {(r.doc_id, q) for r in read(spark, "documents", "doc_id", "text") for held in [runs(r.text)] for q, g in asked.items() if held & g}
    found = [tuple(r) for r in rows_of(spark, "p7_found")]
    assert set(found) == want and len(found) == len(want)


def test_every_filled_page_is_judged(spark):
    pages = rows_of(spark, "p8_pages")
    assert sorted(r.doc_id for r in pages) == sorted(r.doc_id for r in read(spark, "documents", "doc_id", "text") if not blank(r.text))
    assert {r.doc_id for r in rows_of(spark, "p8_found")} == {r.doc_id for r in pages if r.stuffed} and any(r.stuffed for r in pages)
