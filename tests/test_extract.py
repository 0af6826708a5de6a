"""Extraction and matching on hand-made payloads."""

from pyspark.sql import functions as F

from jobgrain.operators import extract as X
from jobgrain.operators import planning as P


def test_json_ld(spark):
    pages = spark.createDataFrame(
        [
            (1, '<script type="application/ld+json">{"@type":"JobPosting","title":"Nurse","datePosted":"2024-01-02","jobLocationType":"TELECOMMUTE","jobLocation":{"address":{"addressLocality":"Oslo","addressCountry":"NO"}}}</script>'),
            (2, "<script type='application/ld+json'><!-- [{\"@type\":\"Organization\"},{\"@type\":\"JobPosting\",\"title\":\"Cook\"}] --></script>"),
            (3, '<script type="application/ld+json">{"@type":"JobPosting", broken</script>'), (4, "<p>none</p>"), (5, None),
        ], "page_id long, html string",
    )
    got = {(r.page_id, r.title, r.city, r.country, r.remote) for r in X.json_ld_postings(pages).collect()}
    assert got == {(1, "Nurse", "Oslo", "NO", True), (2, "Cook", None, None, None)}


def test_urls(spark):
    rows = spark.createDataFrame([("https://x.myworkdayjobs.com/a/job/R1",), ("https://boards.greenhouse.io/acme/jobs/12345?gh_src=x",), ("https://jobs.jobvite.com/acme/job/oAbc",), ("https://a.b/careers",), (None,)], "u string")
    got = [tuple(r) for r in rows.select(X.source_of_url(F.col("u")), X.source_job_id(F.col("u"))).collect()]
    assert got == [("workday", "R1"), ("greenhouse", "12345"), ("jobvite", "oAbc"), ("", ""), ("", "")]


def test_shapes_and_hashes(spark):
    rows = spark.createDataFrame([('{"b":[{"x":1}],"a":null,"c":[]}',), ("not json",), (None,), ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}',)], "j string")
    got = [r.s for r in rows.select(X.shape_paths(F.col("j")).alias("s")).collect()]
    assert got[0] == ["a:null", "b:array", "b[].x:number", "b[]:object", "c:array", "c[]:empty"] and got[1] == got[2] == []
    assert got[3][-1] == "a:object" and not any(":" in p and p.count(".") > 4 for p in got[3])
    same = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b": 2, "a": 1}',), ('{"a":1,"b":3}',)], "j string").select(X.payload_hash(F.col("j")).alias("h")).collect()
    assert same[0] == same[1] != same[2]


def test_fuzzy_terms_match_brute_force(spark):
    import random

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) for _ in range(250)})
    asked = words[::7]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "term string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {(r["query"], r["word"]) for r in X.fuzzy_terms(frame(words), frame(asked)).collect()}
    assert got == {(q, w) for q in asked for w in words if edits(q, w) <= (2 if len(q) >= 8 else 1 if len(q) >= 4 else 0)}


def test_ordered_prefixes(spark):
    rows = spark.createDataFrame([("senior data engineer",), ("engineer data",), ("mechanical engineering lead",), ("",)], "v string")
    hits = lambda q: [r.x for r in rows.select(P.prefix_match(F.col("v"), q).alias("x")).collect()]
    assert hits("data eng") == [True, False, False, False]
    assert hits("sen engi") == [True, False, False, False]
    assert hits("gineer lead") == [False, False, True, False]


def test_evidence_spans(spark):
    rows = spark.createDataFrame([(1, "Salary: 50k per year. Remote work is possible."), (2, None)], "id int, t string")
    got = {(r.id, r.kind, r.match.lower()) for r in X.evidence_spans(rows, "t", {"salary": r"salary", "remote": r"remote"}).collect()}
    assert got == {(1, "salary", "salary"), (1, "remote", "remote")}


def test_misspelt_queries_find_what_a_scan_finds(spark):
    import random

    from jobgrain.operators import term_index

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    words = ["engineer", "engineers", "nurse", "nurses", "data", "date", "senior", "junior", "berlin", "remote", "role"]
    pick = lambda n: " ".join(rng.choices(words, k=n))
    posts = [(f"u{i}", pick(2), pick(1), pick(1), rng.choice(["lever", "taleo"]), rng.random() < 0.1) for i in range(200)]
    asked = [(0, "enginer berlin"), (1, "Nurse, dates"), (2, "levr data"), (3, "lever data"), (4, "role"), (5, "senor nurse role"), (6, "")]
    frame = spark.createDataFrame(posts, "canonical_url string, position_name string, company_name string, city string, ats_key string, hidden boolean")
    got = sorted(tuple(r) for r in term_index.typo_search(spark.createDataFrame(asked, "query_id int, text string"), term_index.build_index(frame), 15).collect())
    want = []
    for q, text in asked:
        every = dict.fromkeys(w for w in text.lower().replace(",", " ").split())
        said = [w for w in every if w not in term_index.STOP_WORDS] or list(every)
        found = []
        for url, title, company, city, source, hidden in posts:
            fields = [*((w, 40) for w in title.split()), (company, 30), (city, 20)]
            total = [0, 0]
            for w in said:
                most = 0 if w in term_index.STOP_WORDS else 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0
                best = min([(e, -n) for x, n in fields if (e := edits(w, x)) <= most] + [(0, -10)] * (w == source), default=None)
                if best is None:
                    break
                total = [total[0] + best[0], total[1] + best[1]]
            else:
                if said and not hidden:
                    found.append((*total, url))
        want += [(q, k + 1, url, typos, -less) for k, (typos, less, url) in enumerate(sorted(found)[:15])]
    assert got == sorted(want) and {r[0] for r in got} == {0, 1, 3, 4, 5}


def test_search_moves_hits_once(spark):
    """The index needs no shuffle, the hits of a search move to their URL alone; the rows of a URL count together."""
    from jobgrain.operators import term_index

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    posts = [("u1", "nurse", "levers", "", False), ("u1", "", "", "Berlin", False), ("u2", "nurse", "taleo", "", False), ("u2", "berlin", "", "", True)]
    frame = spark.createDataFrame(posts, "canonical_url string, position_name string, ats_key string, city string, hidden boolean")
    frame = frame.withColumn("description_plain", F.when(F.col("city") != "", "levers").otherwise(""))
    index = term_index.build_index(frame)
    assert "Exchange" not in plan(index)
    found = term_index.typo_search(spark.createDataFrame([(0, "nurse berlin"), (1, "lever"), (2, "taleos"), (3, "nurse")], "query_id int, text string"), index)
    moves = [line.split("Exchange ")[1] for line in plan(found).splitlines() if "Exchange hashpartitioning" in line]
    assert sum("word" in m for m in moves) == 0 and sum(m.startswith("hashpartitioning(canonical_url") for m in moves) == 1
    assert sorted(map(tuple, found.collect())) == [(0, 1, "u1", 0, 60), (1, 1, "u1", 1, 10), (3, 1, "u1", 0, 40), (3, 2, "u2", 0, 40)]


def test_parity_audit_finds_each_kind_of_fault(spark):
    cases = spark.createDataFrame([(1, "Spain", "remote", "last_seen"), (2, "", "", "relevance")], "case_id int, wanted_country string, wanted_remote string, sort_by string")
    row = lambda case, store, at, url, **more: {"case_id": case, "store": store, "position": at, "canonical_url": url, "position_name": "t", "company_name": "c", "country": "Spain", "location_text": "", "remote_type": "remote", "last_seen_epoch": 10 - at} | more
    rows = [
        row(1, "a", 1, "http://x/1"), row(1, "a", 2, "http://x/2"), row(1, "b", 1, "http://x/1", country="", location_text="Madrid, spain"), row(1, "b", 2, "ftp://x", country="Peru", last_seen_epoch=99), row(1, "b", 3, "http://x/3", remote_type="unknown"),
        row(2, "a", 1, "http://x/9", position_name=" "), row(2, "b", 1, "http://x/9", company_name=None, country="Peru", last_seen_epoch=1),
    ]
    results = spark.createDataFrame(rows, "case_id int, store string, position int, canonical_url string, position_name string, company_name string, country string, location_text string, remote_type string, last_seen_epoch int")
    got = sorted((r.case_id, r.store, r.kind, r.position) for r in P.parity_audit(cases, results).collect())
    assert got == sorted([
        (1, "b", "no_url", 2), (1, "b", "wrong_country", 2), (1, "b", "out_of_order", 2), (1, "b", "wrong_mode", 3), (2, "a", "no_title", 1), (2, "b", "no_company", 1), (1, "b", "differs", 2), (1, "b", "differs", 3),
    ])


def test_feeds(spark):
    good = '<rss version="2.0"><channel><title>Acme</title><item><title>Clerk</title><link>https://a.b/1?utm_source=x</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item><item/></channel></rss>'
    rows = spark.createDataFrame([(1, good), (2, "<rss><channel><item>"), (3, None), (4, ""), (5, "<rss><channel><title>E</title></channel></rss>"), (6, "plain")], "id int, payload string")
    got = sorted(((r.id, r.feed_ok, r.company_name, r.position_name, r.canonical_url, r.posted_at_epoch) for r in X.rss_postings(rows).collect()), key=str)
    assert got == [(1, True, "Acme", "", "", None), (1, True, "Acme", "Clerk", "https://a.b/1", 1704161045), *[(i, i == 5, "E" if i == 5 else "", "", "", None) for i in (2, 3, 4, 5, 6)]]


def test_payloads_are_parsed_once(spark):
    """Fields by their paths, from one parse of each payload."""
    from jobgrain.operators import backfill

    odd = ['{"title": "  ", "name": " A ", "company": {"name": ["x"]}, "id": 7}', '{"company": "C", "location": {"city": "B"}}', "{broken", None]
    frame = backfill.payload_fields(spark.createDataFrame(list(enumerate(odd)), "n long, payload string"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    got = {r.n: (r.position_name, r.company_name, r.location_text, r.city, r.source_job_id) for r in frame.collect()}
    assert got == {0: ("A", "", "", "", "7"), 1: ("", "C", "", "B", ""), 2: ("",) * 5, 3: ("",) * 5}


def test_plan_summary_keeps_urls_once(spark):
    """Changes of a URL count once per value, repeats and all; the URLs are not kept apart for each level."""
    from jobgrain.operators import backfill

    rows = [("u1", "s", "city", "a"), ("u1", "s", "city", "a"), ("u1", None, "region", "a"), ("u2", "s", "city", "b"), (None, "s", "city", "b")]
    got = backfill.plan_summary(spark.createDataFrame(rows, "canonical_url string, ats_key string, field string, rule string"))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {("field", "city", 4, 2), ("field", "region", 1, 1), ("source", "s", 4, 2), ("source", None, 1, 1), ("rule", "a", 3, 1), ("rule", "b", 2, 1)}
    assert {(r.level, r.value, r.changes, r["rows"]) for r in got.collect()} == want and got.count() == len(want)


def test_postings_stay_where_they_are_for_their_places(spark):
    """Frequent location texts bring no rows together."""
    from jobgrain.operators import places

    rows = spark.range(1000).select(F.col("id").cast("string").alias("canonical_url"), F.when(F.col("id") % 4 == 0, "Berlin, Germany").otherwise("Remote").alias("location_text"))
    for found in (places.infer_places(rows), places.place_options(rows)):
        assert "Exchange hashpartitioning(location_text" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1000
