"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.operators import quality as Q
from jobgrain.operators import search as S
from jobgrain.plans.quality_plans import _FLAGGED, _PENALTY, flagged
from jobgrain.plans.registry import query
from jobgrain.sources.views import AS_OF, application_state, postings, table

_VISIBLE = "NOT hidden"
_LOC = "lower(strip_accents(coalesce(location_text, '')))"
_REMOTE_NAMED = f"({_LOC} LIKE '%remote%' OR {_LOC} LIKE '%work from home%' OR {_LOC} LIKE '%wfh%' OR {_LOC} LIKE '%anywhere%')"
_UNKNOWN = "(coalesce(trim(remote_type), '') = '' OR remote_type = 'unknown')"
_IN_COUNTRY = f"(lower(country) IN ('nation_3', 'nation_8') OR (trim(coalesce(country, '')) = '' AND ({_LOC} LIKE '%nation_3%' OR {_LOC} LIKE '%nation_8%')))"
_IS_REMOTE = f"(remote_type = 'remote' OR ({_UNKNOWN} AND {_REMOTE_NAMED}))"
_HAS = "({0} LIKE '%{1}%')"


def _rank(q: str) -> str:
    has = lambda *cs: "(" + " OR ".join(f"lower(coalesce({c}, '')) LIKE '%{q}%'" for c in cs) + ")"
    return (
        f"CASE WHEN {has('position_name')} THEN 40 WHEN {has('company_name')} THEN 30 WHEN {has('location_text', 'city', 'country', 'region')} THEN 20 "
        f"WHEN {has('ats_key')} THEN 10 WHEN {has('description_plain')} THEN 5 ELSE 0 END"
    )


_OPTIONS = S.SearchOptions(countries={"NATION_3": ("NATION_8",)}, remote="remote", tokens=(("building", "machinery", "household"),))
_TOKENS = "(" + " OR ".join(f"lower(coalesce({c}, '')) LIKE '%{a}%'" for c in S.SEARCHED for a in ("building", "machinery", "household")) + ")"


@query(f"""
SELECT canonical_url, company_name, position_name, ats_key, country, remote_type, {_rank('building')} AS relevance, last_seen_epoch
FROM postings WHERE {_VISIBLE} AND {_IN_COUNTRY} AND {_IS_REMOTE} AND {_TOKENS}
ORDER BY relevance DESC, last_seen_epoch DESC, canonical_url LIMIT 50
""")
def f1_k1_ranked_search(spark, sf_dir):
    """Remote jobs in two countries, ranked."""
    found = postings(spark, sf_dir).where(S.search_filter(_OPTIONS, AS_OF)).withColumn("relevance", S.relevance("building"))
    found = found.orderBy(F.desc("relevance"), F.desc("last_seen_epoch"), "canonical_url").limit(50)
    return found.select("canonical_url", "company_name", "position_name", "ats_key", "country", "remote_type", "relevance", "last_seen_epoch")


@query(f"SELECT canonical_url, country, location_text FROM postings WHERE {_VISIBLE} AND {_IN_COUNTRY}")
def f2_country_filter(spark, sf_dir):
    """F2."""
    options = S.SearchOptions(countries={"NATION_3": ("NATION_8",)})
    return postings(spark, sf_dir).where(S.search_filter(options, AS_OF)).select("canonical_url", "country", "location_text")


@query(f"""
SELECT canonical_url, remote_type, location_text FROM postings
WHERE {_VISIBLE} AND remote_type NOT IN ('remote', 'hybrid') AND NOT ({_UNKNOWN} AND ({_REMOTE_NAMED} OR {_LOC} LIKE '%hybrid%'))
""")
def f3_non_remote_filter(spark, sf_dir):
    """F3, negated."""
    return postings(spark, sf_dir).where(S.search_filter(S.SearchOptions(remote="non_remote"), AS_OF)).select("canonical_url", "remote_type", "location_text")


@query(f"SELECT canonical_url, last_seen_epoch FROM postings WHERE {_VISIBLE} AND trim(posting_date) <> '' AND last_seen_epoch >= {AS_OF} - 30 * 86400 AND industry IN ('1-urgent', '2-high')")
def f4_fresh_dated(spark, sf_dir):
    """fresh and dated postings of two industries."""
    options = S.SearchOptions(require_date=True, freshness_days=30, industries=("1-urgent", "2-high"))
    return postings(spark, sf_dir).where(S.search_filter(options, AS_OF)).select("canonical_url", "last_seen_epoch")


@query("""
SELECT p.canonical_url, p.company_name FROM postings p WHERE NOT hidden AND NOT EXISTS
  (SELECT 1 FROM application_state s WHERE s.canonical_url = p.canonical_url AND (s.applied OR s.ignored))
  AND lower(trim(p.company_name)) NOT IN (SELECT lower(trim(c_name)) FROM customer WHERE c_custkey % 7 = 0)
""")
def f12_f13_hidden_by_user(spark, sf_dir):
    """Without applied, ignored and blocked."""
    blocked = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_name").alias("company_name"))
    rows = S.without_state(postings(spark, sf_dir).where("not hidden"), application_state(spark, sf_dir))
    return S.without_companies(rows, blocked).select("canonical_url", "company_name")


@query("""
SELECT p.canonical_url, p.company_name, coalesce(s.applied, false) AS applied, coalesce(s.ignored, false) AS ignored
FROM postings p LEFT JOIN application_state s USING (canonical_url) WHERE NOT p.hidden
""")
def j1_state_overlay(spark, sf_dir):
    """J1."""
    rows = postings(spark, sf_dir).where("not hidden").join(application_state(spark, sf_dir), "canonical_url", "left")
    return rows.select("canonical_url", "company_name", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("applied", "ignored")])


_PAGE = """
SELECT canonical_url, CAST(row_number() OVER (ORDER BY {0}) AS INTEGER) AS position FROM postings WHERE NOT hidden QUALIFY position > 40 AND position <= 90
"""


@query(_PAGE.format("lower(ats_key), lower(company_name), lower(position_name), last_seen_epoch DESC, canonical_url"))
def k3_w1_page_by_source(spark, sf_dir):
    """A page in source order."""
    b = S.page_bounds(50, 40)
    return S.ranked_page(postings(spark, sf_dir).where("not hidden"), S.order_of(S.sort_mode("company asc")), b["limit"], b["offset"]).select("canonical_url", "position")


@query(_PAGE.format("coalesce(posted_at_epoch, 0) DESC, last_seen_epoch DESC, canonical_url"))
def k3_page_by_posted_date(spark, sf_dir):
    """K3 by posting date."""
    return S.ranked_page(postings(spark, sf_dir).where("not hidden"), S.order_of(S.sort_mode("posted_at")), 50, 40).select("canonical_url", "position")


@query(_PAGE.format("confidence DESC, last_seen_epoch DESC, canonical_url"))
def k3_page_by_confidence(spark, sf_dir):
    """K3 by confidence."""
    return S.ranked_page(postings(spark, sf_dir).where("not hidden"), S.order_of(S.sort_mode("quality")), 50, 40).select("canonical_url", "position")


@query("""
SELECT canonical_url, company_name, position, last_seen_epoch FROM (
  SELECT canonical_url, company_name, last_seen_epoch, hidden, CAST(row_number() OVER (ORDER BY last_seen_epoch DESC, canonical_url) AS INTEGER) AS position FROM postings) r
WHERE position <= 100 AND NOT hidden
""")
def j2_hydrate(spark, sf_dir):
    """A ranked URL list with hidden rows among it, hydrated in its order."""
    rows = postings(spark, sf_dir)
    return S.hydrate(S.ranked_page(rows, S.order_of("last_seen"), 100).select("canonical_url", "position"), rows).select("canonical_url", "company_name", "position", "last_seen_epoch")


@query("SELECT count(*) AS total, count(DISTINCT nullif(trim(company_name), '')) AS companies, count(DISTINCT ats_key) AS sources FROM postings WHERE NOT hidden AND remote_type = 'remote'")
def a1_result_summary(spark, sf_dir):
    """A1."""
    return S.result_summary(postings(spark, sf_dir).where("not hidden and remote_type = 'remote'"))


@query(f"""
{_FLAGGED}, sc AS (SELECT canonical_url, CAST(greatest(0, least(100, 100 - coalesce(list_sum(list_transform(quality_flags, lambda f: {_PENALTY})), 0))) AS INTEGER) AS score FROM fl)
SELECT ats_key, count(*) AS total, round(avg(confidence), 4) AS avg_confidence, round(avg(score), 2) AS avg_quality, max(last_seen_epoch) AS newest_seen,
  count(*) FILTER (last_seen_epoch >= {AS_OF} - 3 * 86400) AS fresh, round(count(*) FILTER (last_seen_epoch >= {AS_OF} - 3 * 86400) * 100 / count(*), 2) AS fresh_percent
FROM postings JOIN sc USING (canonical_url) WHERE NOT hidden GROUP BY 1
""")
def a2_source_facets(spark, sf_dir):
    """A2: with the quality score of each posting's flags."""
    scored = flagged(spark, sf_dir).withColumn("quality_score", Q.quality_score(F.col("quality_flags")))
    return S.source_facets(scored.where("not hidden"), AS_OF)


@query("""
SELECT 'source' AS kind, ats_key AS value, '' AS detail, count(*) AS total FROM postings WHERE NOT hidden AND ats_key <> '' GROUP BY 1, 2
UNION ALL SELECT 'country', country, region, count(*) FROM postings WHERE NOT hidden AND country <> '' GROUP BY country, region
UNION ALL SELECT 'region', region, '', count(*) FROM postings WHERE NOT hidden AND region <> '' GROUP BY region
UNION ALL SELECT 'industry', industry, '', count(*) FROM postings WHERE NOT hidden AND industry <> '' GROUP BY industry
""")
def a3_filter_options(spark, sf_dir):
    """A3: four facets in one pass."""
    return S.filter_options(postings(spark, sf_dir).where("not hidden"))


@query("""
SELECT * FROM (
  SELECT position_name AS value, count(*) AS total, 'title' AS kind FROM postings WHERE NOT hidden AND lower(position_name) LIKE '%i%' GROUP BY 1
  UNION ALL SELECT company_name, count(*), 'company' FROM postings WHERE NOT hidden AND lower(company_name) LIKE '%i%' GROUP BY 1
  UNION ALL SELECT location_text, count(*), 'location' FROM postings WHERE NOT hidden AND trim(location_text) <> '' AND lower(location_text) LIKE '%i%' GROUP BY 1) s
ORDER BY total DESC, kind, value LIMIT 20
""")
def k5_o1_suggestions(spark, sf_dir):
    """K5, O1."""
    return S.suggestions(postings(spark, sf_dir).where("not hidden"), "i", 20)


@query("""
SELECT canonical_url, (CASE WHEN lower(position_name) LIKE '%city%' THEN 40 ELSE 0 END) + (CASE WHEN lower(company_name) LIKE '%city%' THEN 30 ELSE 0 END)
  + (CASE WHEN lower(location_text) LIKE '%city%' THEN 20 ELSE 0 END) + (CASE WHEN lower(ats_key) LIKE '%city%' THEN 10 ELSE 0 END) AS score
FROM postings WHERE NOT hidden ORDER BY score DESC, last_seen_epoch DESC, canonical_url LIMIT 60
""")
def k2_additive_relevance(spark, sf_dir):
    """K2."""
    rows = postings(spark, sf_dir).where("not hidden").withColumn("score", S.additive_relevance("city"))
    return rows.orderBy(F.desc("score"), F.desc("last_seen_epoch"), "canonical_url").limit(60).select("canonical_url", "score")


@query("""
WITH p AS (SELECT canonical_url FROM postings WHERE NOT hidden AND country = 'NATION_4' ORDER BY last_seen_epoch DESC, canonical_url LIMIT 26)
SELECT canonical_url, (SELECT count(*) FROM p) > 25 AS has_more FROM p ORDER BY canonical_url IN (SELECT canonical_url FROM p) LIMIT 26
""")
def k4_page_with_more(spark, sf_dir):
    """K4: one row more than the page tells whether there is another page."""
    rows = postings(spark, sf_dir).where("not hidden and country = 'NATION_4'").orderBy(*S.order_of("last_seen")).limit(26).select("canonical_url")
    return rows.withColumn("has_more", F.count("*").over(W.partitionBy()) > 25)  # 26 rows at most
