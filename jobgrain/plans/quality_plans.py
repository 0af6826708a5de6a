"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.operators import audit as A
from jobgrain.operators import quality as Q
from jobgrain.plans.registry import query
from jobgrain.sources.views import AS_OF, EARLIER, posting_cache, postings

_BLANKS = "('', 'unknown', 'n/a', 'na', 'none', 'null', 'undefined', 'not available', 'not applicable', 'not specified', 'unspecified')"
_ODD = "('unknown', 'n/a', 'na', 'none', 'null', 'undefined', 'not available', 'not applicable', 'not specified', 'unspecified', 'remote', 'remote only', 'work from home', 'wfh', 'multiple', 'multiple locations', 'various', 'various locations', 'global', 'worldwide')"
_B = "(lower(trim(coalesce({0}, ''))) IN " + _BLANKS + ")"
_S = "(lower(trim(coalesce({0}, ''))) IN " + _ODD + ")"
_country, _region, _city, _place, _remote = (_B.format(c) for c in ("country", "region", "city", "location_text", "remote_type"))
_none = f"({_country} AND {_region} AND {_city})"
_GAP_SQL = dict(zip(Q.GAPS, (
    _country, _place, _region, _city, f"({_country} OR {_region} OR {_city})", _none, f"({_place} AND {_none})", "(" + " OR ".join(_S.format(c) for c in ("location_text", "country", "region", "city")) + ")",
    "(lower(trim(coalesce(remote_type, ''))) IN ('', 'n/a', 'na', 'not available'))", _remote, f"({_none} AND {_remote})",
), strict=True))

_FLAGS = {
    "missing_title": "trim(position_name) = ''", "missing_company": "trim(company_name) = ''", "missing_url": "trim(canonical_url) = ''",
    "missing_source_job_id": "trim(source_job_id) = ''", "missing_parser_version": "trim(parser_version) = ''", "parser_confidence_low": "confidence > 0 AND confidence < 0.55",
    "missing_parser_confidence": "confidence <= 0", "missing_location_text": "trim(location_text) = ''",
    "suspicious_location_parsing": "trim(location_text) <> '' AND lower(trim(location_text)) NOT IN ('remote', 'worldwide', 'global', 'anywhere', 'work from home', 'wfh') AND (country = '' OR region = '')",
    "missing_city": "(country <> '' OR region <> '') AND city = ''", "missing_country": "country = ''", "missing_region": "region = ''", "weak_remote_classification": "remote_type NOT IN ('remote', 'hybrid', 'onsite')",
    "missing_posted_at": "trim(posting_date) = '' AND coalesce(posted_at_epoch, 0) = 0",
    "invalid_posted_at": f"coalesce(posted_at_epoch, 0) > 0 AND (posted_at_epoch < 631152000 OR posted_at_epoch > {AS_OF} + 86400)",
    "stale_cache": f"last_seen_epoch > 0 AND last_seen_epoch < {AS_OF} - 90 * 86400", "quarantined": "validation_status = 'quarantined'",
    "rejected": "validation_status IN ('invalid', 'rejected') OR trim(validation_error) <> ''", "duplicate": "trim(duplicate_of) <> ''", "hidden": "hidden", "missing_description": "trim(description_plain) = ''",
}
_FLAG_LIST = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _FLAGS.items()) + "], lambda x: x IS NOT NULL))"
_PENALTY = "CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.PENALTIES.items()) + " ELSE 2 END"
_FLAGGED = f"""
WITH r AS (SELECT p.*, c.validation_status, c.validation_error, CASE WHEN p.posting_no % 41 = 0 THEN 'x' ELSE '' END AS duplicate_of FROM postings p JOIN posting_cache c USING (canonical_url)),
fl AS (SELECT canonical_url, ats_key, parser_version, validation_error, {_FLAG_LIST} AS quality_flags FROM r)
"""


def flagged(spark, sf_dir):
    cache = posting_cache(spark, sf_dir).select("canonical_url", "validation_status", "validation_error")
    rows = postings(spark, sf_dir).join(cache, "canonical_url").withColumn("duplicate_of", F.when(F.col("posting_no") % 41 == 0, "x").otherwise(""))
    return rows.withColumn("quality_flags", Q.quality_flags(AS_OF))


@query(f"""{_FLAGGED} SELECT canonical_url, array_to_string(quality_flags, ',') AS flags,
  CAST(greatest(0, least(100, 100 - coalesce(list_sum(list_transform(quality_flags, lambda f: {_PENALTY})), 0))) AS INTEGER) AS score FROM fl""")
def q1_q2_flags_and_score(spark, sf_dir):
    """Q1, Q2."""
    return flagged(spark, sf_dir).select("canonical_url", F.array_join("quality_flags", ",").alias("flags"), Q.quality_score(F.col("quality_flags")).alias("score"))


@query(f"""{_FLAGGED} SELECT canonical_url, CASE WHEN trim(validation_error) <> '' THEN substr(trim(validation_error), 1, 240) ELSE
  array_to_string(list_filter(quality_flags, lambda f: f IN ('missing_title', 'missing_company', 'missing_url', 'rejected')), ', ') END AS reason FROM fl""")
def q3_rejection_reason(spark, sf_dir):
    """Q3."""
    return flagged(spark, sf_dir).select("canonical_url", Q.rejection_reason(F.col("quality_flags")).alias("reason"))


@query(f"""{_FLAGGED}, q AS (SELECT canonical_url, array_to_string(quality_flags, ',') AS quality_flags, CAST(greatest(0, least(100, 100 - coalesce(list_sum(list_transform(quality_flags, lambda f: {_PENALTY})), 0))) AS INTEGER) AS quality_score FROM fl)
SELECT {', '.join(f'p.{c}' for c in A.SHOWN)}, quality_score, quality_flags, {', '.join(f'k.{c}' for c in A.CACHED_SHOWN)}, k.last_seen_epoch AS cache_seen_epoch
FROM postings p JOIN q USING (canonical_url) LEFT JOIN (SELECT * FROM posting_cache WHERE last_seen_epoch < {EARLIER}) k ON p.canonical_url = k.canonical_url
""")
def j16_diagnostics(spark, sf_dir):
    """Postings with their quality and an earlier state of the cache."""
    scored = flagged(spark, sf_dir).select("canonical_url", Q.quality_score(F.col("quality_flags")).alias("quality_score"), F.array_join("quality_flags", ",").alias("quality_flags"))
    return A.diagnostics(postings(spark, sf_dir), posting_cache(spark, sf_dir).where(F.col("last_seen_epoch") < EARLIER), scored)


@query(f"{_FLAGGED} SELECT ats_key, parser_version, flag, count(*) AS total FROM (SELECT ats_key, parser_version, unnest(quality_flags) AS flag FROM fl) u GROUP BY 1, 2, 3")
def a7_flag_counts(spark, sf_dir):
    """A7."""
    return Q.flag_counts(flagged(spark, sf_dir))


_LOW_PLACE = "trim(regexp_replace(lower(trim(location_text)), '\\s+', ' ', 'g'))"
_AMBIG = (
    f"({_LOW_PLACE} <> '' AND ({_LOW_PLACE} IN ({', '.join(repr(x) for x in Q.AMBIGUOUS_PLACES)}) OR regexp_matches({_LOW_PLACE}, '^(multiple|various)\\b') "
    f"OR regexp_matches({_LOW_PLACE}, '\\b(multiple|various) locations?\\b')))"
)
_PLACE_OK = (
    f"(NOT {_country} OR NOT {_region} OR NOT {_city} OR ({_LOW_PLACE} <> '' AND NOT {_AMBIG} AND NOT regexp_matches({_LOW_PLACE}, '\\b(remote|anywhere|worldwide|global|work from home|wfh)\\b')))"
)
_MODE = "remote_type IN ('remote', 'hybrid')"


@query(f"""
WITH g AS (SELECT *, list_filter([CASE WHEN {_B.format('position_name')} THEN 'missing_title' END, CASE WHEN {_B.format('company_name')} THEN 'missing_company' END], lambda x: x IS NOT NULL) AS req,
  list_filter([CASE WHEN {_B.format('source_job_id')} THEN 'missing_source_job_id' END, CASE WHEN CAST(round(confidence * 100) AS INTEGER) < 35 THEN 'low_quality_score' END,
    CASE WHEN confidence < 0.35 THEN 'low_parser_confidence' END, CASE WHEN {_AMBIG} AND NOT {_MODE} THEN 'ambiguous_location' END,
    CASE WHEN NOT {_PLACE_OK} AND NOT {_MODE} THEN 'no_geo_no_remote' END], lambda x: x IS NOT NULL) AS doubts FROM postings)
SELECT canonical_url, CASE WHEN len(req) > 0 THEN 'rejected' WHEN len(doubts) > 0 THEN 'quarantined' ELSE 'accepted' END AS gate_status,
  array_to_string(CASE WHEN len(req) > 0 THEN req ELSE doubts END, ',') AS reasons,
  round(CASE WHEN len(req) > 0 THEN greatest(0, confidence - 0.25) ELSE greatest(0, round(confidence - CASE WHEN source_job_id = '' THEN 0.1 ELSE 0 END - CASE WHEN posting_date = '' THEN 0.04 ELSE 0 END, 3)) END, 3) AS gate_confidence
FROM g
""")
def q4_public_gate(spark, sf_dir):
    """Q4, T17."""
    return Q.public_gate(postings(spark, sf_dir)).select("canonical_url", "gate_status", F.array_join("reason_codes", ",").alias("reasons"), F.round("gate_confidence", 3).alias("gate_confidence"))


@query("""
SELECT error, count(*) AS total FROM (SELECT CASE WHEN trim(canonical_url) = '' THEN 'missing job_posting_url' WHEN NOT regexp_matches(canonical_url, '(?i)^https?://') THEN 'invalid job_posting_url'
  WHEN trim(company_name) = '' THEN 'missing company_name' WHEN trim(position_name) = '' THEN 'missing position_name' ELSE '' END AS error FROM postings) v GROUP BY 1
""")
def q5_validation(spark, sf_dir):
    """Q5."""
    return postings(spark, sf_dir).groupBy(Q.validation_error().alias("error")).agg(F.count("*").alias("total"))


_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {n}_count" for n, c in _GAP_SQL.items())
_PERCENTS = ", ".join(f"round({n}_count * 100 / total, 2) AS {n}_percent" for n in Q.GAPS)


@query(f"""
WITH a AS (
  SELECT 'all' AS level, '' AS source_ats, '' AS parser_version, count(*) AS total, {_COUNTS} FROM postings WHERE NOT hidden
  UNION ALL SELECT 'source', ats_key, '', count(*), {_COUNTS} FROM postings WHERE NOT hidden GROUP BY ats_key
  UNION ALL SELECT 'parser', ats_key, parser_version, count(*), {_COUNTS} FROM postings WHERE NOT hidden GROUP BY ats_key, parser_version)
SELECT *, {_PERCENTS} FROM a
""")
def a6_gap_audit(spark, sf_dir):
    """All three levels in one pass."""
    return Q.gap_audit(postings(spark, sf_dir).where("not hidden"))


_FIELDS = {"company": "company_name", "title": "position_name", "location": "location_text", "country": "country", "region": "region", "city": "city", "posting_date": "posting_date", "source_job_id": "source_job_id"}


@query(f"""
WITH c AS (SELECT ats_key, count(*) AS total, {', '.join(f"count(*) FILTER (trim({c}) = '') AS missing_{n}" for n, c in _FIELDS.items())},
  count(*) FILTER (remote_type NOT IN ('remote', 'hybrid', 'onsite')) AS unknown_remote FROM postings WHERE NOT hidden GROUP BY 1)
SELECT *, {' + '.join(f'missing_{n}' for n in _FIELDS)} + unknown_remote AS impact_score FROM c
""")
def a5_field_gaps(spark, sf_dir):
    """A5, A26."""
    return Q.field_gaps(postings(spark, sf_dir).where("not hidden"))


_VIS = (
    "count(*) AS total, count(*) FILTER (validation_status = 'valid') AS valid, count(*) FILTER (validation_status = 'quarantined') AS quarantined, "
    "count(*) FILTER (validation_status IN ('invalid', 'rejected')) AS rejected, count(*) FILTER (hidden) AS hidden"
)


@query(f"SELECT ats_key, parser_version, {_VIS} FROM posting_cache GROUP BY 1, 2")
def a8_cache_visibility(spark, sf_dir):
    """A8."""
    return Q.cache_visibility(posting_cache(spark, sf_dir), "ats_key", "parser_version")


@query(f"SELECT validation_status, {_VIS} FROM posting_cache GROUP BY 1")
def a8_cache_by_status(spark, sf_dir):
    """A8 by status."""
    return Q.cache_visibility(posting_cache(spark, sf_dir), "validation_status")


@query("""
SELECT ats_key, coalesce(nullif(trim(validation_error), ''), 'unspecified') AS reason, parser_version, count(*) AS total, max(last_seen_epoch) AS newest_seen
FROM posting_cache WHERE validation_status = 'quarantined' GROUP BY 1, 2, 3 ORDER BY total DESC, 1, 2, 3 LIMIT 100
""")
def a9_quarantine_summary(spark, sf_dir):
    """A9."""
    return Q.quarantine_summary(posting_cache(spark, sf_dir))


@query("""
SELECT ats_key, CASE WHEN trim(validation_error) <> '' THEN validation_error WHEN trim(position_name) = '' THEN 'missing_title' ELSE 'other' END AS reason, count(*) AS total
FROM posting_cache WHERE validation_status <> 'valid' GROUP BY 1, 2
""")
def a27_rejected_reasons(spark, sf_dir):
    """A27."""
    reason = F.when(F.trim("validation_error") != "", F.col("validation_error")).when(F.trim("position_name") == "", "missing_title").otherwise("other")
    return posting_cache(spark, sf_dir).where("validation_status <> 'valid'").groupBy("ats_key", reason.alias("reason")).agg(F.count("*").alias("total"))
