"""Column functions on hand-made values."""

import hashlib
from base64 import urlsafe_b64encode

import pytest
from pyspark.sql import functions as F

from jobgrain.functions import text as T
from jobgrain.operators import quality as Q


def evaluate(spark, function, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in frame.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_blank_vocabularies(spark):
    assert evaluate(spark, T.is_blank, [None, " ", "n/a", "x"]) == [True, True, False, False]
    assert evaluate(spark, T.is_blank_like, [None, " N/A ", "Unspecified", "x"]) == [True, True, True, False]
    assert evaluate(spark, T.is_suspicious_geo, ["", "Remote", "various locations", "Oslo"]) == [False, True, True, False]


def test_folding(spark):
    assert evaluate(spark, T.search_text, ["İstanbul, Şişli", "ığdır", "Crème-Brûlée!", "étude", None]) == ["istanbul sisli", "igdir", "creme brulee", "etude", ""]
    assert evaluate(spark, T.lookup_text, ["  São   Paulo, SP "]) == ["sao paulo, sp"]


def test_urls(spark):
    urls = ["https://a.b/c?utm_source=x&id=1&Ref=y#top", "https://a.b/c?gh_src=1", "https://a.b/c#x", None, "https://a.b/c?a=1&b=2"]
    assert evaluate(spark, T.canonical_url, urls) == ["https://a.b/c?id=1", "https://a.b/c", "https://a.b/c", "", "https://a.b/c?a=1&b=2"]
    want = urlsafe_b64encode(hashlib.sha256(b"https://a.b/c").digest()).decode().rstrip("=")
    assert evaluate(spark, T.document_id, ["https://a.b/c"]) == [want]


def test_remote(spark):
    values = ["true", "Hybrid (2 days)", "Fully Remote", "work from office", "on-site", "Berlin", None, "home based"]
    assert evaluate(spark, T.remote_type, values) == ["remote", "hybrid", "remote", "onsite", "onsite", "unknown", "unknown", "remote"]
    assert evaluate(spark, T.stored_remote_type, ["On_Site", "non-remote", "remote", "x"]) == ["onsite", "onsite", "remote", "unknown"]
    assert evaluate(spark, T.work_mode, ["Remote or hybrid", "anywhere", "Berlin", ""]) == ["hybrid", "remote", "non_remote", "unknown"]


def test_dates(spark):
    values = ["today", "Posted yesterday", "posted 3 days ago", "5 hours ago", "1700000000", "1700000000123", "2024-01-02", "2024-01-02T03:04:05+01:00", "soon", None]
    assert evaluate(spark, lambda c: T.posted_epoch(c, 1_000_000), values) == [
        1_000_000, 913_600, 740_800, 982_000, 1_700_000_000, 1_700_000_000, 1_704_153_600, 1_704_161_045, None, None,
    ]


def test_html_and_terms(spark):
    page = "<p>A&nbsp;&amp; B<br/>C</p><script>x<y</script><style>p{}</style> &lt;d&gt; &#39;"
    assert evaluate(spark, T.plain_text, [page, None]) == ["A & B C <d> '", ""]
    assert evaluate(spark, T.public_term, ["nurse", "a@b.co", "https://x.y", "x.com/cv", "+44 20 7946 0958", " "]) == ["nurse", None, None, None, None, None]


def test_user_agents(spark):
    agents = ["Mozilla Googlebot Chrome/1", "Chrome/99 Safari/1 Edg/99", "Chrome/99 Safari/5", "Version/15 Safari/6", "Firefox/1", "", "curl"]
    assert evaluate(spark, T.user_agent_family, agents) == ["bot", "edge", "chrome", "safari", "firefox", "unknown", "cli"]


@pytest.mark.parametrize(("stored", "want"), [(None, 65), (0.0, 65), (88.0, 88), (150.0, 100)])
def test_stored_scores_win(spark, stored, want):
    row = spark.createDataFrame([(["missing_title"], stored)], "f array<string>, s double")
    assert row.select(Q.quality_score(F.col("f"), F.col("s")).alias("x")).first().x == want


def test_unknown_flags_cost_two(spark):
    row = spark.createDataFrame([(["odd", "missing_city"],), (["missing_title", "missing_url", "rejected"],)], "f array<string>")
    assert [r.x for r in row.select(Q.quality_score(F.col("f")).alias("x")).collect()] == [94, 0]


def test_narrative_locations(spark):
    long = "You will be working with customers and external teams to develop and manage new products."
    assert evaluate(spark, Q.location_is_narrative, [long, "Berlin, Germany", None]) == [True, False, False]


def test_gate_partitions_its_input(spark, small):
    from jobgrain.sources.views import postings

    rows = Q.public_gate(postings(spark, small))
    counts = {r.gate_status: r.n for r in rows.groupBy("gate_status").agg(F.count("*").alias("n")).collect()}
    assert set(counts) <= {"accepted", "quarantined", "rejected"} and sum(counts.values()) == postings(spark, small).count()
    assert rows.where("(gate_status = 'accepted') <> (size(reason_codes) = 0)").count() == 0


def test_fold_keeps_the_letters_of_accented_words(spark):
    from jobgrain.functions.text import fold_text, search_text

    texts = ["Škoda Plzeň", "Ő Ńova", "Zürich", "İstanbul ığdır", "Thành phố"]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select(search_text(F.col("t")).alias("s")).collect()
    assert [r.s for r in row] == ["skoda plzen", "o nova", "zurich", "istanbul igdir", "thanh pho"]
    assert [fold_text(t) for t in texts] == ["skoda plzen", "o nova", "zurich", "istanbul igdir", "thanh pho"]


def test_dates_do_not_depend_on_the_session_zone(spark):
    from jobgrain.functions.text import posted_epoch

    texts = ["2024-01-05", "2024-01-05T10:00:00", "2024-01-05T10:00:00+02:00", "01/05/2024", "2024-01-05T10:00:00Z", "soon", "1704412800", "1704412800123"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(posted_epoch(F.col("t"), 0).alias("e"))
    want = [1704412800, 1704448800, 1704441600, 1704412800, 1704448800, None, 1704412800, 1704412800]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.e for r in rows.collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_countries_are_found_under_their_own_spelling(spark):
    from jobgrain.operators.search import country_filter

    rows = spark.createDataFrame([("Türkiye", ""), ("turkiye", ""), ("", "Izmir, TÜRKİYE"), ("France", "Paris")], "country string, location_text string")
    assert rows.where(country_filter({"Türkiye": ()})).count() == 3


def test_prefix_match_takes_any_sign(spark):
    from jobgrain.operators.planning import prefix_match

    rows = spark.createDataFrame([("senior engineer",), ("engineer senior",), ("resenior engineers",), ("sen eng",)], "v string")
    hits = lambda q: {r.v for r in rows.where(prefix_match(F.col("v"), q)).collect()}
    assert hits("senior eng") == {"senior engineer", "resenior engineers"} and hits("(senior") == set() and hits("se en") == {"senior engineer", "sen eng"}
