"""Decision, parity, extraction and matching queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrain.functions.text import search_text
from jobgrain.operators import extract as X
from jobgrain.operators import planning as P
from jobgrain.plans.registry import query
from jobgrain.sources.views import EARLIER, EVENTS_AS_OF, errors, posting_cache, postings, sync_state, table

_SCAN = """
s AS (SELECT ats_key, parser_version, count(*) AS rows_parsed, count(*) FILTER (validation_status = 'valid') AS clean, count(*) FILTER (validation_status = 'quarantined') AS quarantined,
  count(*) FILTER (validation_status = 'invalid') AS rejected, count(*) FILTER (validation_status = 'valid' AND posting_no % 9 = 0) AS net_new, count(*) FILTER (posting_no % 4001 = 10) AS no_geo_no_remote FROM posting_cache GROUP BY 1, 2)"""


def scan_figures(spark, sf_dir):
    is_ = lambda v: F.col("validation_status") == v
    out = posting_cache(spark, sf_dir).groupBy("ats_key", "parser_version").agg(
        F.count("*").alias("rows_parsed"), F.count_if(is_("valid")).alias("clean"), F.count_if(is_("quarantined")).alias("quarantined"), F.count_if(is_("invalid")).alias("rejected"),
        F.count_if(is_("valid") & (F.col("posting_no") % 9 == 0)).alias("net_new"), F.count_if(F.col("posting_no") % 4001 == 10).alias("no_geo_no_remote"),
    )
    zero = {c: F.lit(0) for c in ("fetch_failures", "missing_any_geo", "weak_remote")}
    return out.withColumns({"configured_targets": F.lit(5), "targets_scanned": F.lit(5), "rows_fetched": F.col("rows_parsed"), **zero})


@query(f"""
WITH {_SCAN} SELECT ats_key, parser_version, CASE WHEN clean = 0 AND quarantined + rejected > 0 OR quarantined * 100 / (clean + quarantined + rejected) >= 70 OR rejected * 100 / (clean + quarantined + rejected) >= 30
  THEN 'needs_parser_quality_fix' WHEN no_geo_no_remote > 0 THEN 'fails_no_geo_no_remote' WHEN net_new > 0 THEN 'candidate_after_full_inventory' WHEN clean > 0 THEN 'already_covered_or_update_only' ELSE 'needs_review' END AS decision FROM s
""")
def q17_a37_estimate_decisions(spark, sf_dir):
    """Q17, A37."""
    return scan_figures(spark, sf_dir).select("ats_key", "parser_version", P.estimate_decision().alias("decision"))


_PCT = "round(count(*) FILTER ({}) * 100 / count(*), 2)"


@query(f"""
WITH g AS (SELECT ats_key, count(*) AS total, {_PCT.format("country = ''")} AS c, {_PCT.format("city = ''")} AS t, {_PCT.format("country = '' OR region = '' OR city = ''")} AS a, {_PCT.format("remote_type = 'unknown'")} AS w FROM postings WHERE NOT hidden GROUP BY 1),
r AS (SELECT ats_key, round(c * 0.45 + t * 0.25 + a * 0.55 + w * 0.35 + log10(total + 1) * 10 + CASE WHEN ats_key < 'g' THEN 0 ELSE 18 END, 2) AS risk, total FROM g)
SELECT ats_key, risk, CASE WHEN risk >= 180 THEN 'wave-1-live-gap' WHEN risk >= 130 THEN 'wave-2-live-gap' WHEN ats_key >= 'g' THEN 'wave-3-certification' ELSE 'monitor' END AS wave FROM r
""")
def k8_q25_risk_scores(spark, sf_dir):
    """K8, Q25."""
    from jobgrain.functions.text import is_blank, percent

    b = lambda c: is_blank(F.col(c))
    p = lambda c: percent(F.count_if(c), F.count("*"))
    rows = postings(spark, sf_dir).where("not hidden").groupBy("ats_key").agg(
        F.count("*").alias("total"), p(b("country")).alias("missing_country_percent"), p(b("city")).alias("missing_city_percent"), p(b("country") | b("region") | b("city")).alias("missing_any_percent"),
        p(F.col("remote_type") == "unknown").alias("weak_remote_percent"), F.lit(0).alias("attention"),
    )
    status = F.when(F.col("ats_key") < "g", "certified").otherwise("partial")
    rows = rows.withColumn("risk", P.risk_score(status))
    return rows.select("ats_key", "risk", P.wave(status, F.col("risk"), F.col("total")).alias("wave"))


_RC = "count(*) FILTER (error_type LIKE 'parser%') AS parser_bug, count(*) FILTER (error_type = 'validation') AS source_quality, count(*) FILTER (http_status = 429) AS rate_limit, count(*) FILTER (error_type IN ('network', 'timeout')) AS network, count(*) FILTER (http_status = 403) AS auth"


@query(f"""
WITH e AS (SELECT ats_key, {_RC} FROM run_errors GROUP BY 1), s AS (SELECT ats_key, count(*) FILTER (next_sync_epoch <= {EVENTS_AS_OF}) AS due, sum(consecutive_failures) AS pressure FROM sync_state GROUP BY 1)
SELECT ats_key, CASE WHEN parser_bug > 0 THEN 'parser_bug' WHEN source_quality > 0 THEN 'source_quality' WHEN rate_limit + network + auth > 0 THEN 'stability' ELSE 'due_backlog' END AS lane,
  CAST(due + pressure * 10 + parser_bug * 100 + source_quality * 80 + rate_limit * 40 + network * 30 + auth * 40 AS BIGINT) AS score FROM e JOIN s USING (ats_key)
""")
def k10_recovery_priorities(spark, sf_dir):
    """K10."""
    kind, status = F.col("error_type"), F.col("http_status")
    e = errors(spark, sf_dir).groupBy("ats_key").agg(
        F.count_if(kind.startswith("parser")).alias("parser_bug"), F.count_if(kind == "validation").alias("source_quality"), F.count_if(status == 429).alias("rate_limit"),
        F.count_if(kind.isin("network", "timeout")).alias("network"), F.count_if(status == 403).alias("auth"), F.lit(0).alias("unknown"), F.lit(0).alias("empty_no_jobs"),
    )
    s = sync_state(spark, sf_dir).groupBy("ats_key").agg(F.count_if(F.col("next_sync_epoch") <= EVENTS_AS_OF).alias("targets_due"), F.sum("consecutive_failures").alias("failure_pressure"))
    return P.recovery_priorities(e.join(s, "ats_key"))


@query("""
SELECT 'target' AS level, company_url AS value, count(*) AS total FROM run_errors GROUP BY 2 UNION ALL SELECT 'source', ats_key, count(*) FROM run_errors GROUP BY 2 UNION ALL SELECT 'error', error_type, count(*) FROM run_errors GROUP BY 2
""")
def a38_reason_groups(spark, sf_dir):
    """A38."""
    return P.reason_groups(errors(spark, sf_dir))


@query(f"""
WITH a AS (SELECT country, count(*) AS expected FROM postings WHERE NOT hidden GROUP BY 1), b AS (SELECT country, count(*) AS actual FROM postings WHERE first_seen_epoch < {EARLIER} GROUP BY 1)
SELECT country, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - coalesce(expected, 0) AS delta FROM a FULL JOIN b USING (country) WHERE coalesce(actual, 0) <> coalesce(expected, 0)
""")
def a28_facet_delta(spark, sf_dir):
    """A28."""
    rows = postings(spark, sf_dir)
    return P.facet_delta(rows.where("not hidden"), rows.where(F.col("first_seen_epoch") < EARLIER), "country")


@query("""
WITH b AS (SELECT ats_key, count(*) AS before FROM posting_cache WHERE validation_status = 'valid' AND parser_version = 'v0' GROUP BY 1), a AS (SELECT ats_key, count(*) AS after FROM posting_cache WHERE validation_status = 'valid' AND parser_version = 'v1' GROUP BY 1)
SELECT ats_key, before, coalesce(after, 0) AS after, before - coalesce(after, 0) AS lost FROM b LEFT JOIN a USING (ats_key) WHERE coalesce(after, 0) < before
""")
def a33_regressions(spark, sf_dir):
    """A33."""
    of = lambda v: posting_cache(spark, sf_dir).where(f"validation_status = 'valid' and parser_version = '{v}'").groupBy("ats_key").agg(F.count("*").alias("accepted"))
    return P.regressions(of("v0"), of("v1"))


@query("SELECT ats_key, count(*) AS total, count(*) FILTER (trim(country) = '') AS no_country, count(*) FILTER (trim(region) = '') AS no_region, count(*) FILTER (remote_type = 'unknown') AS weak_remote FROM postings WHERE NOT hidden GROUP BY 1 HAVING no_country > 0 OR no_region > 0 OR weak_remote > 0")
def a15_gap_sources(spark, sf_dir):
    """A15."""
    return P.gap_sources(postings(spark, sf_dir).where("not hidden"))


@query("""
WITH g AS (SELECT ats_key, company_url, error_type, count(*) AS n, max(created_epoch) AS latest FROM run_errors GROUP BY 1, 2, 3)
SELECT ats_key, company_url, CAST(sum(n) AS BIGINT) AS errors, max(latest) AS latest, array_to_string(list(error_type || '=' || n ORDER BY n DESC, error_type)[1:3], ',') AS groups FROM g GROUP BY 1, 2
""")
def a18_failure_pressure(spark, sf_dir):
    """A18."""
    return P.failure_pressure(errors(spark, sf_dir)).withColumn("groups", F.array_join("groups", ","))


@query("""
WITH m AS (SELECT ats_key, count(*) AS total, max(created_epoch) AS newest, 'label ' || ats_key AS label FROM run_errors GROUP BY 1), c AS (SELECT *, CASE WHEN ats_key IN ('ats10', 'ats11') THEN 'ats1' ELSE ats_key END AS canonical FROM m)
SELECT canonical, CAST(sum(total) AS BIGINT) AS total, max(newest) AS newest, arg_min(label, row(ats_key <> canonical, ats_key)) AS label, count(*) AS keys FROM c GROUP BY 1
""")
def a24_a34_fold_aliases(spark, sf_dir):
    """A24, A34."""
    metrics = errors(spark, sf_dir).groupBy("ats_key").agg(F.count("*").alias("total"), F.max("created_epoch").alias("newest")).withColumn("label", F.concat(F.lit("label "), F.col("ats_key")))
    return P.fold_aliases(metrics, spark.createDataFrame([("ats10", "ats1"), ("ats11", "ats1")], "ats_key string, canonical string"))


_CHANGE = EVENTS_AS_OF - 10 * 86400


@query(f"""
SELECT ats_key, before, after, CASE WHEN before > 0 THEN round((after - before) * 100 / before, 2) END AS change_percent FROM (SELECT ats_key, count(*) FILTER (created_epoch < {_CHANGE}) AS before, count(*) FILTER (created_epoch >= {_CHANGE}) AS after
FROM run_errors WHERE created_epoch BETWEEN {_CHANGE} - 120 * 3600 AND {_CHANGE} + 120 * 3600 - 1 GROUP BY 1) x
""")
def a36_patch_effect(spark, sf_dir):
    """A36."""
    return P.patch_effect(errors(spark, sf_dir), _CHANGE, 120)


@query("SELECT DISTINCT 'region' AS kind, region AS value FROM postings WHERE NOT hidden AND region <> '' UNION SELECT DISTINCT 'city', city FROM postings WHERE NOT hidden AND city <> '' AND country IN ('NATION_1', 'NATION_2')")
def a41_place_options(spark, sf_dir):
    """A41."""
    return P.place_options(postings(spark, sf_dir).where("not hidden"), ["NATION_1", "NATION_2"])


def _answers(spark, sf_dir):
    """Cases (a source and a country, some with a work mode) and the first ten answers of two stores; the second knows an older state and orders by first sighting in some cases."""
    rows = postings(spark, sf_dir).where("not hidden")
    cases = rows.where("country <> ''").select("ats_key", F.col("country").alias("wanted_country")).distinct()
    nation = F.regexp_extract("wanted_country", r"(\d+)$", 1).cast("int")
    cases = cases.select(
        F.concat_ws(":", "ats_key", "wanted_country").alias("case_id"), "ats_key", "wanted_country", F.when(nation % 3 == 0, "remote").otherwise("").alias("wanted_remote"), F.when(nation % 4 == 3, "relevance").otherwise("last_seen").alias("sort_by"),
    )
    old = F.col("first_seen_epoch") < EARLIER
    stores = {"database": (rows, F.col("country"), F.col("remote_type"), F.col("last_seen_epoch")), "index": (rows, F.when(old & (F.col("confidence") > 0.7), "").otherwise(F.col("country")), F.when(old, "remote").otherwise(F.col("remote_type")), F.col("first_seen_epoch"))}
    out = []
    for name, (df, country, mode, order) in stores.items():
        held = df.select("ats_key", "canonical_url", "position_name", "company_name", "country", "location_text", "remote_type", "last_seen_epoch", country.alias("k"), mode.alias("m"), order.alias("o"))
        named = held.withColumn("k", F.when(F.col("k") != "", F.col("k")).otherwise(F.regexp_extract("location_text", r"(NATION_\d+)$", 1)))
        met = named.join(cases, (named["k"] == cases["wanted_country"]) & (named["ats_key"] == cases["ats_key"])).where("wanted_remote = '' or m = wanted_remote")
        w = W.partitionBy("case_id").orderBy(F.desc("o"), "canonical_url")
        top = met.withColumn("position", F.row_number().over(w)).where("position <= 10").withColumn("store", F.lit(name))
        out.append(top.select("case_id", "store", "position", "canonical_url", "position_name", "company_name", "country", "location_text", "remote_type", "last_seen_epoch"))
    return cases, out[0].union(out[1])


_NAMED = "CASE WHEN {0} <> '' THEN {0} ELSE regexp_extract(location_text, '(NATION_\\d+)$', 1) END"


@query(f"""
WITH c AS (SELECT DISTINCT ats_key || ':' || country AS case_id, ats_key, country AS wanted_country, CASE WHEN regexp_extract(country, '(\\d+)$', 1)::INTEGER % 3 = 0 THEN 'remote' ELSE '' END AS wanted_remote,
  CASE WHEN regexp_extract(country, '(\\d+)$', 1)::INTEGER % 4 = 3 THEN 'relevance' ELSE 'last_seen' END AS sort_by FROM postings WHERE NOT hidden AND country <> ''),
h AS (SELECT 'database' AS store, *, {_NAMED.format('country')} AS k, remote_type AS m, last_seen_epoch AS o FROM postings WHERE NOT hidden
  UNION ALL SELECT 'index', *, {_NAMED.format(f"(CASE WHEN first_seen_epoch < {EARLIER} AND confidence > 0.7 THEN '' ELSE country END)")}, CASE WHEN first_seen_epoch < {EARLIER} THEN 'remote' ELSE remote_type END, first_seen_epoch FROM postings WHERE NOT hidden),
r AS MATERIALIZED (SELECT case_id, store, wanted_country, wanted_remote, sort_by, h.* EXCLUDE (store), CAST(row_number() OVER (PARTITION BY case_id, store ORDER BY o DESC, canonical_url) AS INTEGER) AS position FROM h JOIN c ON h.k = c.wanted_country AND h.ats_key = c.ats_key
  WHERE wanted_remote = '' OR m = wanted_remote QUALIFY position <= 10),
l AS (SELECT *, lag(last_seen_epoch) OVER (PARTITION BY case_id, store ORDER BY position) AS earlier FROM r),
f AS (SELECT case_id, store, unnest(list_filter([CASE WHEN trim(position_name) = '' THEN 'no_title' END, CASE WHEN trim(company_name) = '' THEN 'no_company' END,
    CASE WHEN lower(country) <> lower(wanted_country) AND NOT (country = '' AND contains(lower(location_text), lower(wanted_country))) THEN 'wrong_country' END, CASE WHEN wanted_remote = 'remote' AND remote_type <> 'remote' THEN 'wrong_mode' END,
    CASE WHEN sort_by = 'last_seen' AND last_seen_epoch > earlier THEN 'out_of_order' END], lambda x: x IS NOT NULL)) AS kind, canonical_url, position FROM l)
SELECT * FROM f UNION ALL SELECT coalesce(a.case_id, b.case_id), 'index', 'differs', b.canonical_url, coalesce(a.position, b.position)
FROM (SELECT * FROM r WHERE store = 'database') a FULL JOIN (SELECT * FROM r WHERE store = 'index') b ON a.case_id = b.case_id AND a.position = b.position WHERE a.canonical_url IS DISTINCT FROM b.canonical_url
""")
def q21_parity_audit(spark, sf_dir):
    """Q21: many searches at two stores, judged together."""
    cases, results = _answers(spark, sf_dir)
    return P.parity_audit(cases.drop("ats_key"), results)


@query("""
WITH a AS (SELECT CAST(row_number() OVER (ORDER BY last_seen_epoch DESC, canonical_url) AS INTEGER) AS position, canonical_url AS expected FROM postings WHERE NOT hidden QUALIFY position <= 50),
b AS (SELECT CAST(row_number() OVER (ORDER BY last_seen_epoch DESC, canonical_url) AS INTEGER) AS position, canonical_url AS actual FROM postings WHERE NOT hidden AND remote_type <> 'unknown' QUALIFY position <= 50)
SELECT coalesce(a.position, b.position) AS position, expected, actual FROM a FULL JOIN b ON a.position = b.position WHERE expected IS DISTINCT FROM actual
""")
def o5_q21_top_lists(spark, sf_dir):
    """O5, Q21."""
    rows = postings(spark, sf_dir).where("not hidden")
    return P.top_list_mismatches(rows, rows.where("remote_type <> 'unknown'"), [F.desc("last_seen_epoch"), F.asc("canonical_url")], 50)


@query(f"""
WITH i AS (SELECT canonical_url, CASE WHEN confidence >= 0.9 THEN 'old' ELSE company_name END AS indexed FROM postings WHERE first_seen_epoch < {EARLIER} UNION ALL SELECT canonical_url || '/gone', 'x' FROM postings WHERE city = ''),
j AS (SELECT coalesce(p.canonical_url, i.canonical_url) AS canonical_url, p.canonical_url AS k, i.canonical_url AS t, hidden, company_name, indexed FROM postings p FULL JOIN i ON p.canonical_url = i.canonical_url)
SELECT canonical_url, CASE WHEN k IS NULL OR (t IS NOT NULL AND hidden) THEN 'delete' ELSE 'upsert' END AS action, CASE WHEN k IS NULL THEN 'absent' WHEN t IS NOT NULL AND hidden THEN 'hidden' WHEN t IS NULL THEN 'missing' ELSE 'changed' END AS reason
FROM j WHERE k IS NULL OR (t IS NOT NULL AND hidden) OR (t IS NULL AND NOT hidden) OR (t IS NOT NULL AND company_name <> indexed)
""")
def q22_index_repairs(spark, sf_dir):
    """Q22, J12."""
    rows = postings(spark, sf_dir)
    index = rows.where(F.col("first_seen_epoch") < EARLIER).select("canonical_url", F.when(F.col("confidence") >= 0.9, "old").otherwise(F.col("company_name")).alias("company_name"))
    return P.index_repairs(rows, index.union(rows.where("city = ''").select(F.concat("canonical_url", F.lit("/gone")), F.lit("x"))))


#: URLs as systems write them, with the system and the id that each tells.
_POSTED = (
    ("https://acme.wd5.myworkdayjobs.com/en/job/Bonn/Clerk_R12", "workday", "Clerk_R12"), ("https://jobs.ashbyhq.com/acme/7f-1", "ashby", "7f-1"), ("https://boards.greenhouse.io/acme/jobs/4455?gh_src=x", "greenhouse", "4455"),
    ("https://jobs.lever.co/acme/ab12/", "lever", "ab12"), ("https://acme.recruitee.com/o/clerk", "recruitee", "clerk"), ("https://recruiting.ultipro.com/ACME/JobBoard/9/", "ultipro", "9"), ("https://acme.taleo.net/careersection/2/jobdetail.ftl", "taleo", "jobdetail.ftl"),
    ("https://jobs.jobvite.com/acme/job/oX1", "jobvite", "oX1"), ("https://acme.icims.com/jobs/991/clerk/job", "icims", "991"), ("https://acme.breezy.hr/p/11-clerk", "breezy", "11-clerk"), ("https://acme.bamboohr.com/careers/31", "bamboohr", "31"),
    ("https://www.governmentjobs.com/jobs/3312-0/clerk", "governmentjobs", "3312"), ("https://jobs.smartrecruiters.com/Acme/743-clerk#top", "smartrecruiters", "743-clerk"), ("https://www.usajobs.gov/job/80", "usajobs", "80"), ("https://acme.teamtailor.com/jobs/55-clerk", "teamtailor", "55"),
    ("https://ats.rippling.com/acme/jobs/x-0a", "rippling", "x-0a"), ("https://acme.example/careers", "", ""), ("https://acme.example/jobs/", "", ""), ("", "", ""),
)


@query(f"""
WITH u AS (SELECT page_id, [{', '.join(f"'{u}'" for u, _, _ in _POSTED)}][page_id % {len(_POSTED)} + 1] AS posted, [{', '.join(f"'{s}'" for _, s, _ in _POSTED)}][page_id % {len(_POSTED)} + 1] AS system, [{', '.join(f"'{i}'" for _, _, i in _POSTED)}][page_id % {len(_POSTED)} + 1] AS source_id, url FROM pages)
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, system, source_id FROM u
""")
def t9_t10_url_facts(spark, sf_dir):
    """System and id of posting URLs, host of page URLs."""
    posted = F.element_at(F.array(*[F.lit(u) for u, _, _ in _POSTED]), (F.col("page_id") % len(_POSTED) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", X.host_of(F.col("url")).alias("host"), X.source_of_url(posted).alias("system"), X.source_job_id(posted).alias("source_id"))


_WORDS = "string_split(trim(regexp_replace(lower(position_name), '[^a-z0-9]+', ' ', 'g')), ' ')"
_MODEL = f"""
w AS (SELECT posting_no, industry, {_WORDS} AS x FROM postings WHERE position_name <> ''),
g AS (SELECT DISTINCT posting_no, industry, n, array_to_string(x[i:i + n - 1], ' ') AS gram FROM (SELECT posting_no, industry, x, n, unnest(range(1, len(x) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(x) >= n) q),
c AS (SELECT gram, n, industry, count(*) AS titles FROM g GROUP BY 1, 2, 3),
m AS (SELECT gram, n, industry, titles FROM c WHERE titles >= CASE WHEN n = 1 THEN 3 ELSE 2 END AND gram IN (SELECT gram FROM c GROUP BY gram HAVING count(*) <= 1))"""


def _titles(spark, sf_dir):
    return postings(spark, sf_dir).where("position_name <> ''").select(F.col("posting_no").alias("id"), F.col("position_name").alias("title"), "industry")


@query(f"WITH {_MODEL} SELECT * FROM m")
def t26_title_model(spark, sf_dir):
    """T26."""
    return X.train_title_model(_titles(spark, sf_dir).select("title", "industry"))


@query(f"WITH {_MODEL} SELECT g.posting_no AS id, arg_max(m.industry, row(m.n, m.titles, m.industry)) AS industry FROM g JOIN m ON g.gram = m.gram AND g.n = m.n GROUP BY 1")
def t27_title_matches(spark, sf_dir):
    """T27."""
    titles = _titles(spark, sf_dir)
    return X.match_titles(titles, X.train_title_model(titles.select("title", "industry")))


@query("""
WITH v AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(position_name || ' ' || region), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM postings), q AS (SELECT unnest(['machinry', 'buildng', 'furnitre', 'houshold', 'automobill', 'regon', 'urgnt', 'meduim', 'asia', 'lo', 'furnituer']) AS query)
SELECT query, word, levenshtein(query, word) AS distance FROM v, q WHERE levenshtein(query, word) <= CASE WHEN length(query) >= 8 THEN 2 WHEN length(query) >= 4 THEN 1 ELSE 0 END
""")
def t6_fuzzy_terms(spark, sf_dir):
    """Query words against the vocabulary of the postings."""
    words = postings(spark, sf_dir).select(F.explode(F.split(search_text(F.concat_ws(" ", "position_name", "region")), " ")).alias("term")).distinct()
    asked = spark.createDataFrame([(w,) for w in ("machinry", "buildng", "furnitre", "houshold", "automobill", "regon", "urgnt", "meduim", "asia", "lo", "furnituer")], "term string")
    return X.fuzzy_terms(words, asked)


_NAMES = "(SELECT DISTINCT trim(regexp_replace(lower(position_name), '[^a-z0-9]+', ' ', 'g')) AS value FROM postings WHERE position_name <> '')"


@query(f"""
SELECT value FROM {_NAMES} n WHERE value LIKE '%urg%' AND value LIKE '%mach%' AND list_position(string_split(value, ' '), list_filter(string_split(value, ' '), lambda w: w LIKE 'mach%' OR w LIKE '%mach%')[1]) < list_position(string_split(value, ' '), list_filter(string_split(value, ' '), lambda w: w LIKE 'urg%')[1])
UNION ALL SELECT value || '#2' FROM {_NAMES} n WHERE value LIKE '%1 ur%'
""")
def k6_prefix_suggestions(spark, sf_dir):
    """K6: words in order, inside a word from four letters on; signs of a query are plain letters."""
    names = postings(spark, sf_dir).where("position_name <> ''").select(search_text(F.col("position_name")).alias("value")).distinct()
    first, second = names.where(P.prefix_match(F.col("value"), "mach urg")), names.where(P.prefix_match(F.col("value"), "1 ur"))
    return first.union(second.select(F.concat("value", F.lit("#2")))).union(names.where(P.prefix_match(F.col("value"), "(mach")))
