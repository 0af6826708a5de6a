"""Personal data: spans by form against Python's re, contexts against planted ones and SQL, odd cases."""

import hashlib
import re

import duckdb
import pytest

from jobgrain.llm import pii, queries

EXTRA = "row long, base string, added string, loose string, known string, kind string, start string, value string, cue string, x string, o string, text_ string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else True, "phone": 9 <= len(d) <= 15}[kind]


def by_form(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if is_valid(k, m.group())]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(stem):
    return next(f"{stem}{c}" for c in range(10) if is_valid("card", f"{stem}{c}"))


TRICKY = [
    "a@b.c_d@e.f x@y.z_q r a@b a.b@c-d.e.f. ü@x.de é.a@b.cc@dd.ee", "1.2.3.4.5.6.7.8 256.1.1.1 007.0255.1.1 1.2.3 0.0.0.0300 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 5 4242424242424242", "+1 (377) 555-0271 +12 +123 +1-2-3-4-5-6-7-8-9 +1 23456789 (0) +49 30 123456 +",
    "İß😀 a@b.cc 😀 1.2.3.4 +1 (377) 555-0271\u0085", "", "   ", "x" * 4000 + " " + "9" * 4000, "a@b" + ".c" * 20_000, "1" + " 2" * 30_000,
]


def test_forms_equal_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(99, None)]
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = by_form(t or "")
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert got[i].base_sha256 == digest(spans)


def test_query_equals_python_by_form(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op12_pii(spark, small).collect()
    assert len(rows) == len(texts) and sum(r.n_email for r in rows)
    for r in rows:
        assert r.base_sha256 == digest(by_form(texts[r.doc_id]))


@pytest.fixture(scope="module")
def planted():
    """Cards after 'card:', phones between 'ring' and 'tonight'; a failing card and a phone without plus in the same places."""
    rows = []
    for i in range(30):
        rows.append((i, f"Payment by Card: {luhn(f'4000{i:03d}12345678')} was made. Please ring +49 30 55{i:02d}123 tonight or mail me@host{i}.example.com now"))
    rows += [(120, "payment by card: 4000999123456780 was made"), (121, "please ring 030 5512 399 tonight"), (122, "order 030 5512 399 again, and 4000999123456781 too")]
    rows += [(130 + i, f"the {i} and the other was there by the way, made of wood and stone {i}{i}-{i}{i}{i}") for i in range(40)]
    rows += [(80, "the card: four thousand"), (81, "mail jane [at] example [dot] org now"), (82, "mail joe@localhost now"), (83, "mailed a@b to x")]
    return rows


def test_contexts_find_unseen_identifiers(spark, planted):
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    assert got[120].spans == "card:17:33" and got[120].n_card == 0 and got[120].n_added == 1
    assert got[121].spans == "phone:12:24"
    assert got[122].spans == "phone:6:18"  # a trusted value is found where nothing vouches for it; the other card stays unknown
    assert got[81].spans == "email:5:32" and got[82].spans == "email:5:18"
    assert all(got[i].spans == "" for i in (*range(130, 170), 80, 83))
    assert all(got[i].n_added == 0 and got[i].base_sha256 == hashlib.sha256(got[i].spans.encode()).hexdigest() for i in range(30))


def test_sql_gives_the_same_rows(spark, planted):
    rows = [*planted, *[(300 + i, t) for i, t in enumerate(TRICKY) if len(t) < 1000], (200, None), (None, "mail a@b.cd now")]
    got = pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    want = con.sql(pii.oracle())
    order = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(order) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=key)


def test_one_hot_context_is_no_pattern(spark):
    rows = [(i, "the " * 50 + (f"10.0.0.{i}" if i < 10 else "1:2:3:4:5") + " the") for i in range(60)]
    got = pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_added for r in got) == 0 and sum(r.n_ip for r in got) == 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000 + " " + "9" * 300_000 + "a:" * 100_000), (None, "x@y.zz"), (None, None), (5, "x@y.zz"), (5, "x@y.zz")]
    odd = spark.createDataFrame([(*r, *([None] * 12)) for r in rows], f"doc_id long, text string, {EXTRA}")
    got = sorted((r.doc_id or 0, r.spans) for r in pii.pii_digest(odd).collect())
    assert got == [(0, ""), (0, "email:0:6"), (1, ""), (2, ""), (3, ""), (4, ""), (5, "email:0:6"), (5, "email:0:6")]
    assert pii.pii_digest(odd.where("false")).collect() == []


def test_no_python_worker_runs(spark, small):
    plan = queries.op12_pii(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
