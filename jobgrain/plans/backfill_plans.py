"""Queries about gaps, evidence, detail pages and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.operators import backfill as B
from jobgrain.operators import extract as X
from jobgrain.plans.geo_plans import _EVIDENCE, _INFER
from jobgrain.plans.registry import query
from jobgrain.sources.views import companies, errors, located, posting_cache, postings, table

_MISSING = "(trim(country) = '' OR trim(region) = '' OR trim(city) = '')"
_WEAK = "remote_type NOT IN ('remote', 'hybrid', 'onsite')"
_CANDIDATE = f"NOT hidden AND ({_MISSING} OR {_WEAK} OR trim(posting_date) = '') AND (trim(location_text) <> '' OR trim(position_name) <> '' OR trim(description_plain) <> '')"


@query(f"SELECT ats_key, count(*) AS candidates FROM postings WHERE {_CANDIDATE} GROUP BY 1")
def f14_backfill_candidates(spark, sf_dir):
    """F14."""
    return B.backfill_candidates(postings(spark, sf_dir)).groupBy("ats_key").agg(F.count("*").alias("candidates"))


@query(f"SELECT canonical_url, ats_key FROM postings WHERE {_CANDIDATE} AND canonical_url > 'https://jobs.example/p/25' ORDER BY canonical_url LIMIT 200")
def s3_next_batch(spark, sf_dir):
    """S3: the keyset walk's next batch."""
    return B.next_batch(B.backfill_candidates(postings(spark, sf_dir)), "https://jobs.example/p/25", 200).select("canonical_url", "ats_key")


_REASON = f"CASE WHEN ats_key NOT IN ('building', 'machinery', 'furniture') THEN 'unsupported_source' WHEN hidden THEN 'hidden' WHEN NOT {_MISSING} AND NOT {_WEAK} AND trim(description_plain) <> '' THEN 'already_complete' ELSE '' END"
_SUPPORTED = ("building", "machinery", "furniture")


@query(f"SELECT ats_key, {_REASON} AS reason, count(*) AS total FROM postings GROUP BY 1, 2")
def f15_detail_reasons(spark, sf_dir):
    """F15."""
    return postings(spark, sf_dir).groupBy("ats_key", B.detail_reason(_SUPPORTED).alias("reason")).agg(F.count("*").alias("total"))


@query(f"""
WITH c AS (SELECT ats_key, 'jobs.example' AS host FROM postings WHERE {_REASON} = '')
SELECT ats_key, host, count(*) AS candidates FROM c GROUP BY 1, 2 UNION ALL SELECT ats_key, '(all)', count(*) FROM c GROUP BY 1 UNION ALL SELECT '(all)', '(all)', count(*) FROM c
""")
def a32_candidates_by_host(spark, sf_dir):
    """A32."""
    return B.candidates_by_host(postings(spark, sf_dir).where(B.detail_reason(_SUPPORTED) == ""))


@query(f"""
SELECT canonical_url, ats_key, CAST(row_number() OVER (PARTITION BY ats_key ORDER BY last_seen_epoch DESC, canonical_url) AS INTEGER) AS rank FROM postings WHERE {_REASON} = '' QUALIFY rank <= 7
""")
def w4_capped_per_host(spark, sf_dir):
    """W4."""
    return B.capped_per_host(postings(spark, sf_dir).where(B.detail_reason(_SUPPORTED) == ""), 7).select("canonical_url", "ats_key", "rank")


_URLS = (
    ("https://x.wd5.myworkdayjobs.com/en/job/New-York%2C-NY/Analyst_R1", "Analyst", "workday", "New York, NY"), ("https://c.icims.com/jobs/12/Austin%2C-TX/job", "Clerk", "icims", "Austin, TX"),
    ("https://c.icims.com/jobs/13/job", "Nurse (Remote - Canada)", "icims", "Remote - Canada"), ("https://c.icims.com/jobs/14/job", "Cook - Dallas, TX", "icims", "Dallas, TX"),
    ("https://c.icims.com/jobs/15/job", "Plain title", "icims", ""), ("https://a.example/1", "Remote Writer", "lever", "Remote"), ("https://a.example/2", "Writer", "lever", ""), ("https://x.wd5.myworkdayjobs.com/en/R2", "Hybrid Clerk", "workday", "Remote"),
)


@query(f"SELECT p_partkey, [{', '.join(repr(u[3]) for u in _URLS)}][p_partkey % {len(_URLS)} + 1] AS location FROM part")
def t32_places_from_urls(spark, sf_dir):
    """T32."""
    k = F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(u[i]) for u in _URLS]), (k % len(_URLS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", B.place_from_url(pick(0), pick(1), pick(2)).alias("location"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Stored' WHEN 1 THEN 'Category' WHEN 2 THEN 'Math' ELSE '' END AS department, p_partkey % 4 = 1 AS replaces FROM part
""")
def t33_departments(spark, sf_dir):
    """Departments, and the guard of a stored country."""
    k = F.col("p_partkey")
    department = B.department_of(F.when(k % 5 == 0, " Stored "), F.when(k % 5 == 1, "Category"), F.when(k % 5 == 4, "Job - Teacher").otherwise("Math - Teacher"), F.when(k % 5 == 3, "icims").otherwise("applitrack"))
    location = F.when(k % 4 == 3, "Berlin").otherwise("DE-Berlin")
    replaces = B.replaces_country(F.when(k % 4 == 0, "").otherwise("France"), F.lit("Germany"), F.when(k % 4 == 2, "lever").otherwise("icims"), location)
    return table(spark, sf_dir, "part").select("p_partkey", department.alias("department"), replaces.alias("replaces"))


def _with_city(rows):
    return rows.withColumn("city", F.when(F.col("posting_no") % 9 == 0, "Known City").otherwise(""))


_MODE = f"CASE WHEN regexp_matches({_EVIDENCE}, '\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches({_EVIDENCE}, '\\b(remote|work from home|work from anywhere|wfh|anywhere|home based|home office|telecommute|telework|virtual|distributed)\\b') THEN 'remote' WHEN regexp_matches({_EVIDENCE}, '\\b(on ?site|office based|in office|work from office)\\b') THEN 'onsite' ELSE 'unknown' END"
_PLAN = f"""
{_INFER},
lr AS (SELECT located.*, inferred_country, inferred_region, inferred_city, CASE WHEN posting_no % 9 = 0 THEN 'Known City' ELSE '' END AS city, {_MODE} AS told FROM located JOIN inferred USING (location_text)),
plan AS (SELECT canonical_url, ats_key, 'country' AS field, '' AS before, inferred_country AS after, 'location_country' AS rule, 0.9::DOUBLE AS confidence FROM lr WHERE trim(country) = '' AND inferred_country <> ''
  UNION ALL SELECT canonical_url, ats_key, 'region', '', inferred_region, 'location_region', 0.85 FROM lr WHERE trim(region) = '' AND inferred_region <> ''
  UNION ALL SELECT canonical_url, ats_key, 'city', '', inferred_city, 'location_city', 0.8 FROM lr WHERE trim(city) = '' AND inferred_city <> ''
  UNION ALL SELECT canonical_url, ats_key, 'remote_type', remote_type, told, 'location_or_title_mode', 0.75 FROM lr WHERE remote_type NOT IN ('remote', 'hybrid', 'onsite') AND told <> 'unknown')"""


@query(f"WITH {_PLAN} SELECT * FROM plan")
def q13_place_plan(spark, sf_dir):
    """Q13: what locations and titles justify to fill."""
    return B.place_plan(_with_city(located(spark, sf_dir)))


@query(f"""
WITH {_PLAN} SELECT 'field' AS level, field AS value, count(*) AS changes, count(DISTINCT canonical_url) AS rows FROM plan GROUP BY 2 UNION ALL SELECT 'source', ats_key, count(*), count(DISTINCT canonical_url) FROM plan GROUP BY 2
UNION ALL SELECT 'rule', rule, count(*), count(DISTINCT canonical_url) FROM plan GROUP BY 2
""")
def q14_a31_plan_summary(spark, sf_dir):
    """Changes of a backfill by field, source and rule."""
    return B.plan_summary(B.place_plan(_with_city(located(spark, sf_dir))))


@query("""
WITH d AS (SELECT canonical_url, 'Main St ' || (posting_no % 5) AS location_text, CASE WHEN posting_no % 2 = 0 THEN 'Freedonia' ELSE '' END AS country, CASE WHEN posting_no % 3 = 0 THEN 'hybrid' ELSE 'whatever' END AS remote_type FROM postings WHERE hidden)
SELECT canonical_url, 'location_text' AS field, '' AS before, d.location_text AS after FROM postings p JOIN d USING (canonical_url) WHERE trim(p.location_text) = ''
UNION ALL SELECT canonical_url, 'country', '', d.country FROM postings p JOIN d USING (canonical_url) WHERE trim(p.country) = '' AND d.country <> ''
UNION ALL SELECT canonical_url, 'remote_type', p.remote_type, d.remote_type FROM postings p JOIN d USING (canonical_url) WHERE p.remote_type = 'unknown' AND d.remote_type = 'hybrid'
""")
def q15_detail_plan(spark, sf_dir):
    """Q15: changes from detail pages."""
    rows, k = postings(spark, sf_dir), F.col("posting_no")
    details = rows.where("hidden").select("canonical_url", F.concat(F.lit("Main St "), (k % 5).cast("string")).alias("location_text"), F.when(k % 2 == 0, "Freedonia").otherwise("").alias("country"), F.when(k % 3 == 0, "hybrid").otherwise("whatever").alias("remote_type"))
    return B.detail_plan(rows, details, ("location_text", "country"))


_PIECES = """
ev AS (SELECT canonical_url, 'remote_type' AS field, remote_type AS value, 'list' AS origin, 'list_remote' AS rule, confidence FROM postings WHERE remote_type <> 'unknown'
  UNION ALL SELECT canonical_url, 'remote_type', 'onsite', 'structured', 'physical_location', 0.9 FROM postings WHERE city <> '' UNION ALL SELECT canonical_url, 'country', country, 'inferred', 'from_place', confidence FROM postings
  UNION ALL SELECT canonical_url, 'country', 'NATION_X', 'url', 'url_country', 0.2 FROM postings WHERE posting_no % 3 = 0),
sc AS (SELECT *, CASE origin WHEN 'structured' THEN 100 WHEN 'list' THEN 60 WHEN 'url' THEN 40 ELSE 20 END + CASE WHEN field = 'remote_type' THEN CASE WHEN value IN ('remote', 'hybrid') THEN CASE WHEN rule = 'list_remote' THEN 1000 ELSE 0 END WHEN rule = 'physical_location' THEN -10 ELSE 0 END ELSE 0 END AS score FROM ev WHERE trim(value) <> '')"""


@query(f"WITH {_PIECES} SELECT canonical_url, field, value, origin, rule, confidence FROM sc QUALIFY row_number() OVER (PARTITION BY canonical_url, field ORDER BY score DESC, confidence DESC, value DESC, rule DESC) = 1")
def q6_strongest_evidence(spark, sf_dir):
    """Q6: of several pieces of evidence the strongest per field."""
    rows = postings(spark, sf_dir)
    piece = lambda df, field, value, origin, rule, sure: df.select("canonical_url", F.lit(field).alias("field"), value.alias("value"), F.lit(origin).alias("origin"), F.lit(rule).alias("rule"), sure.cast("double").alias("confidence"))
    every = piece(rows.where("remote_type <> 'unknown'"), "remote_type", F.col("remote_type"), "list", "list_remote", F.col("confidence"))
    every = every.union(piece(rows.where("city <> ''"), "remote_type", F.lit("onsite"), "structured", "physical_location", F.lit(0.9)))
    every = every.union(piece(rows, "country", F.col("country"), "inferred", "from_place", F.col("confidence"))).union(piece(rows.where("posting_no % 3 = 0"), "country", F.lit("NATION_X"), "url", "url_country", F.lit(0.2)))
    return B.strongest_evidence(every)


@query("""
WITH r AS (SELECT *, CASE posting_no % 3 WHEN 0 THEN 'html_detail' WHEN 1 THEN 'direct_json' ELSE 'brittle' END AS fam, posting_no % 50 = 0 AS blocked, posting_no % 2 = 0 AS explicit,
  country <> '' OR region <> '' OR city <> '' AS place FROM postings),
n AS (SELECT *, remote_type = 'unknown' OR (remote_type IN ('remote', 'hybrid') AND NOT explicit) AS rem FROM r), d AS (SELECT *, NOT place OR rem OR posting_date = '' AS need, fam <> 'direct_json' AS can FROM n)
SELECT CASE WHEN blocked THEN 'blocked' WHEN NOT need THEN 'not_needed' WHEN can THEN 'needed' ELSE 'not_supported' END AS decision, concat_ws(',', CASE WHEN NOT place THEN 'list_missing_location' END, CASE WHEN rem THEN 'list_missing_remote' END, CASE WHEN need AND NOT can THEN 'detail_required_but_unavailable' END) AS reasons, count(*) AS total FROM d GROUP BY 1, 2
""")
def q7_detail_decisions(spark, sf_dir):
    """Q7: is the detail page needed?"""
    k = F.col("posting_no")
    rows = postings(spark, sf_dir).withColumns({"source_family": F.when(k % 3 == 0, "html_detail").when(k % 3 == 1, "direct_json").otherwise("brittle"), "detail_blocked": k % 50 == 0, "explicit_remote": k % 2 == 0})
    return rows.select(B.detail_decision().alias("d")).groupBy("d.decision", "d.reasons").agg(F.count("*").alias("total"))


@query("""
WITH p AS (SELECT page_id, 'para ' || page_id || ' ' || repeat('word ', 30) AS body FROM pages)
SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN '<div>inner</div>' || body WHEN 1 THEN '<p>' || body || '</p>' END) AS description_html, trim(regexp_replace(CASE page_id % 3 WHEN 0 THEN 'inner ' || body WHEN 1 THEN body END, '\\s+', ' ', 'g')) AS description_plain FROM p WHERE page_id % 3 < 2
""")
def t20_descriptions(spark, sf_dir):
    """Descriptions from balanced tags."""
    k = F.col("page_id")
    body = F.concat(F.lit("para "), k.cast("string"), F.lit(" "), F.repeat(F.lit("word "), F.lit(30)))
    page = F.when(k % 3 == 0, F.concat(F.lit("<html><div class='x job-description y'><div>inner</div>"), body, F.lit("</div><div>other</div>"))).when(k % 3 == 1, F.concat(F.lit("<section id=content><p>"), body, F.lit("</p></section>"))).otherwise(F.lit("<div class='description'>short</div>"))
    return B.descriptions(table(spark, sf_dir, "pages").select("page_id", page.alias("html")))


@query("""
SELECT posting_no, position_name, CASE WHEN posting_no % 3 = 0 THEN company_name ELSE '' END AS company_name, canonical_url, CASE posting_no % 3 WHEN 0 THEN location_text WHEN 1 THEN city ELSE '' END AS location_text, CASE posting_no % 3 WHEN 2 THEN '' ELSE city END AS city,
  CASE posting_no % 3 WHEN 1 THEN country ELSE '' END AS country, CASE WHEN posting_no % 3 = 2 THEN 'Team ' || ats_key ELSE '' END AS department, posting_date, CAST(posting_no AS VARCHAR) AS source_job_id, CASE posting_no % 3 WHEN 1 THEN 'true' ELSE '' END AS remote
FROM postings WHERE posting_no % 3 < 3
""")
def t22_s2_payload_fields(spark, sf_dir):
    """Payloads of three shapes as one record."""
    k = F.col("posting_no")
    a = F.to_json(F.struct(F.col("position_name").alias("title"), F.struct(F.col("company_name").alias("name")).alias("company"), F.col("canonical_url").alias("absolute_url"), F.struct(F.col("location_text").alias("name"), F.col("city").alias("city")).alias("location"), F.col("posting_date").alias("datePosted"), k.alias("id")))
    b = F.to_json(F.struct(F.col("position_name").alias("jobTitle"), F.col("canonical_url").alias("hostedUrl"), F.struct(F.struct(F.col("city").alias("addressLocality"), F.col("country").alias("addressCountry")).alias("address")).alias("jobLocation"), F.col("posting_date").alias("publishedAt"), k.alias("job_id"), F.lit(True).alias("isRemote")))
    c = F.to_json(F.struct(F.col("position_name").alias("text"), F.col("canonical_url").alias("applyUrl"), F.array(F.struct(F.concat(F.lit("Team "), F.col("ats_key")).alias("name"))).alias("departments"), F.col("posting_date").alias("createdAt"), k.cast("string").alias("requisitionId")))
    payload = F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    return B.payload_fields(postings(spark, sf_dir).select("posting_no", payload.alias("payload")))


@query("SELECT posting_no, company_name || '|' || posting_no || '|' || country || '|true' AS flat FROM postings")
def t30_flat_values(spark, sf_dir):
    """Values of nested JSON without secrets."""
    inner = F.struct(F.col("country").alias("place"), F.lit("hidden").alias("api_key"), F.lit(None).cast("string").alias("none"))
    payload = F.to_json(F.struct("company_name", F.array(F.col("posting_no")).alias("ids"), F.lit("x").alias("Session_Token"), inner.alias("deep"), F.lit(True).alias("ok")))
    return postings(spark, sf_dir).select("posting_no", F.array_join(B.flat_values(payload), "|").alias("flat"))


@query("""
SELECT ts AS at, CASE event_id % 3 WHEN 0 THEN 'good' ELSE 'unrated' END AS rating, 'message ' || event_id AS message, '/p' AS path FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, message LIMIT 40
""")
def s5_feedback(spark, sf_dir):
    """Feedback from a log of JSON lines, malformed lines among them."""
    e = F.col("event_id")
    context = F.struct(F.when(e % 3 == 0, " good ").alias("rating"), F.lit("/p").alias("path"))
    line = F.to_json(F.struct(F.when(F.col("event_type") == "click", "public_feedback").otherwise("view").alias("event"), F.col("ts").cast("string").alias("timestamp"), F.concat(F.lit("message "), e.cast("string")).alias("message"), context.alias("context")))
    lines = table(spark, sf_dir, "events").select(F.explode(F.array(line, F.when(e % 7 == 0, "{broken").otherwise("  "))).alias("value"))
    return B.feedback(lines, "2024-01-05 00:00:00", "2024-01-15 00:00:00", 40)


@query("SELECT 'ats' || (c_custkey % 12) AS ats_key, c_name AS company_name, 'https://c' || c_custkey || '.example' AS company_url, CAST(1700000000 + c_custkey * 4321 AS BIGINT) AS created_epoch, CAST(0 AS BIGINT) AS last_success_epoch, '' AS note FROM customer")
def s4_import(spark, sf_dir):
    """A snapshot under our names."""
    return B.imported(companies(spark, sf_dir), {"ats_key": "ats_key", "company_name": "company_name", "company_url": "company_url", "created_epoch": "created_epoch", "last_success_epoch": "succeeded", "note": "note"})


@query("""
SELECT o_orderkey AS application_id, c_name AS company_name, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'agent' WHEN o_orderkey % 3 = 1 THEN 'user' ELSE 'manual' END AS by_type FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def j15_applications(spark, sf_dir):
    """Applications with company and sender, newest first."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    sent = orders.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("application_id"), F.when(F.col("o_orderkey") % 3 == 0, "agent").otherwise("user").alias("by_type"))
    out = B.application_list(rows, companies(spark, sf_dir), sent)
    return out.orderBy(F.desc("at"), "application_id").limit(100).select("application_id", "company_name", "status", "by_type")


@query("""
WITH a AS (SELECT ats_key, parser_version, count(*) FILTER (country = '') AS gaps FROM postings WHERE NOT hidden GROUP BY 1, 2), v AS (SELECT ats_key, parser_version, count(*) AS cached, count(*) FILTER (validation_status = 'valid') AS valid FROM posting_cache GROUP BY 1, 2),
t AS (SELECT ats_key, 'v1' AS parser_version, count(*) AS attention FROM run_errors WHERE error_type LIKE 'parser%' GROUP BY 1)
SELECT ats_key, parser_version, gaps, cached, valid, attention FROM a FULL JOIN v USING (ats_key, parser_version) FULL JOIN t USING (ats_key, parser_version)
""")
def a11_parser_stats(spark, sf_dir):
    """Audit, visibility and attention by source and parser."""
    key = ["ats_key", "parser_version"]
    a = postings(spark, sf_dir).where("not hidden").groupBy(*key).agg(F.count_if(F.col("country") == "").alias("gaps"))
    v = posting_cache(spark, sf_dir).groupBy(*key).agg(F.count("*").alias("cached"), F.count_if(F.col("validation_status") == "valid").alias("valid"))
    t = errors(spark, sf_dir).where(F.col("error_type").startswith("parser")).groupBy("ats_key").agg(F.count("*").alias("attention")).select("ats_key", F.lit("v1").alias("parser_version"), "attention")
    return B.parser_stats(a, v, t)


@query("""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'broken' ELSE 'none' END AS kind FROM pages)
SELECT page_id, 'Title ' || page_id AS title, 'Bonn' AS city, page_id % 8 < 2 AS remote FROM p WHERE kind IN ('object', 'array')
""")
def t19_json_ld(spark, sf_dir):
    """Postings of JSON-LD blocks, malformed blocks among them."""
    k = F.col("page_id")
    one = F.concat(F.lit('{"@type":"JobPosting","title":"Title '), k.cast("string"), F.lit('","jobLocation":{"address":{"addressLocality":"Bonn"}},"jobLocationType":"'), F.when(k % 8 < 2, "telecommute").otherwise("office"), F.lit('"}'))
    body = F.when(k % 4 == 0, one).when(k % 4 == 1, F.concat(F.lit('[{"@type":"Organization"},'), one, F.lit("]"))).when(k % 4 == 2, F.lit("{broken"))
    html = F.coalesce(F.concat(F.lit("<html><script type='application/ld+json'>"), body, F.lit("</script></html>")), F.lit("<html/>"))
    return X.json_ld_postings(table(spark, sf_dir, "pages").select("page_id", html.alias("html"))).select("page_id", "title", "city", "remote")


