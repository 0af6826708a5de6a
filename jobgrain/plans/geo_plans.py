"""Queries about places: inference, filters, options, and the listing's projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.functions import geo as G
from jobgrain.operators import places as P
from jobgrain.plans.registry import query
from jobgrain.sources.views import located


def _values(rows) -> str:
    cell = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_CLEAN = "translate(lower(strip_accents({0})), 'ı', 'i')"
_TEXT = f"trim(regexp_replace({_CLEAN}, '[^a-z0-9]+', ' ', 'g'))"
_TABLES = f"""
terms AS (SELECT * FROM (VALUES {_values(G.place_terms())}) v(term, kind, country, rank)),
country_rows AS (SELECT * FROM (VALUES {_values([r[:4] for r in G.COUNTRIES])}) v(code, country, sales_region, business_region)),
texts AS (SELECT DISTINCT location_text, {_TEXT.format('location_text')} AS t, trim(location_text) AS raw FROM located WHERE trim(location_text) <> '')"""
_US, _CA = "|".join(G.US_STATES), "|".join(G.CANADIAN_PROVINCES)


def _state(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(upper({x}), '(?:^|,\\s*|\\s-\\s)(?:{_US})(?:\\s|,|$)') OR regexp_matches(upper({x}), '^(?:{_US})[-\\s]') THEN 'United States' "
        f"WHEN regexp_matches(upper({x}), '(?:^|,\\s*|\\s-\\s)(?:{_CA})(?:\\s|,|$)') OR regexp_matches(upper({x}), '^(?:{_CA})[-\\s]') THEN 'Canada' ELSE '' END"
    )


_WORDS = "string_split(t, ' ')"
_STATE_WORDS = ", ".join(f"'{w}'" for w in [*G.US_STATES.values(), *(c.lower() for c in G.US_STATES)])
_PROVINCE_WORDS = ", ".join(f"'{w}'" for w in [*G.CANADIAN_PROVINCES.values(), *(c.lower() for c in G.CANADIAN_PROVINCES)])
_INFER = f"""
{_TABLES},
known AS (SELECT * FROM texts WHERE NOT (length(raw) >= 45 AND raw LIKE 'You will be working with customers%')),
pieces AS (SELECT location_text, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT location_text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT location_text, {_WORDS} AS w FROM known), (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n)),
named AS (SELECT location_text, arg_min(country, rank) AS named FROM pieces JOIN terms USING (term) WHERE kind <> 'code' AND length(term) > 2 GROUP BY 1),
codes AS (SELECT DISTINCT term AS code, country FROM terms WHERE length(term) BETWEEN 2 AND 3),
front AS (SELECT location_text, lower(regexp_extract(raw, '(?i)^([a-z]{{2,3}})(?:-?$|[-\\s].+$)', 1)) AS code, regexp_extract(raw, '(?i)^[a-z]{{2,3}}[-\\s](.+)$', 1) AS rest FROM known),
fronted AS (SELECT location_text, country AS front FROM front JOIN codes USING (code) WHERE country NOT IN ('United States', 'Canada') OR rest = '' OR regexp_matches(rest, '(?i)^(remote|hybrid|virtual)$')
  OR regexp_matches(rest, '^[A-Z]{{2}}[-\\s]') OR {_state("', ' || regexp_extract(rest, '^([^-\\s,]+)', 1)")} = country),
parts AS (SELECT location_text, list_filter(list_transform(regexp_split_to_array(lower(raw), '[,\\n\\r/|;]+'), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS ps FROM known),
listed AS (SELECT location_text, i, ps[i] AS code, len(ps) AS n FROM (SELECT location_text, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
between_ AS (SELECT location_text, arg_min(country, i) AS coded FROM listed JOIN codes USING (code) WHERE country NOT IN ('United States', 'Canada') AND (length(code) = 3 OR (length(code) = 2 AND n <= 2)) GROUP BY 1),
c AS (SELECT location_text, raw, coalesce(front, nullif({_state('raw')}, ''), coded, named, '') AS country FROM known LEFT JOIN fronted USING (location_text) LEFT JOIN between_ USING (location_text) LEFT JOIN named USING (location_text)),
ct AS (SELECT texts.location_text, coalesce(c.country, '') AS country, trim(regexp_split_to_array(regexp_replace(texts.raw, '^(?:remote|hybrid|onsite|on[- ]?site|work from home|wfh|virtual|telework)\\s*[-:,]\\s*', '', 'i'), '\\s*,\\s*|\\s+-\\s+|\\s+\\|\\s+')[1]) AS first
  FROM texts LEFT JOIN c USING (location_text)),
ck AS (SELECT *, {_TEXT.format('first')} AS key FROM ct),
inferred AS (SELECT location_text, ck.country AS inferred_country, coalesce(business_region, '') AS inferred_region, CASE WHEN first = '' OR length(first) > 80
  OR regexp_matches(first, '(?i)\\b(?:work from home|home based|remote|hybrid|onsite|on[- ]?site|wfh|worldwide|anywhere)\\b') OR regexp_matches(first, '(?i)^\\(?\\s*(multiple|various|several|all)\\b')
  OR regexp_matches(first, '(?i)^(district[- ]?wide|statewide|nationwide|tbd|n/?a|unknown)$') OR (ck.country <> '' AND key = {_TEXT.format('ck.country')}) OR key IN (SELECT term FROM terms WHERE kind <> 'place')
  OR (key IN ({_STATE_WORDS}) AND ck.country IN ('', 'United States')) OR (key IN ({_PROVINCE_WORDS}) AND ck.country IN ('', 'Canada')) THEN '' ELSE first END AS inferred_city
  FROM ck LEFT JOIN country_rows r ON r.country = ck.country)"""


@query(f"WITH {_INFER} SELECT canonical_url, location_text, inferred_country, inferred_region, inferred_city FROM located JOIN inferred USING (location_text)")
def t12_t13_t14_places(spark, sf_dir):
    """Country, region and city of location texts."""
    return P.infer_places(located(spark, sf_dir)).select("canonical_url", "location_text", "inferred_country", "inferred_region", "inferred_city")


_SEGMENT = "trim(regexp_replace(regexp_replace({0}, '\\b(country|republic|federation|state)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_STATE_LIST = ", ".join(f"'{w}'" for w in [*G.US_STATES.values(), *G.NO_COUNTRY])
_HINTS = " ".join(
    "WHEN " + " OR ".join(f"' ' || t || ' ' LIKE '% {h} %'" for h in hints) + f" THEN '{region}'" for region, hints in G.REGION_HINTS.items()
)
_OPTIONS = f"""
{_TABLES},
sg AS (SELECT location_text, t, list_transform(list_filter(list_transform(regexp_split_to_array(location_text, '[,/|;]+|\\s+-\\s+'), lambda s: {_TEXT.format('s')}), lambda s: s <> ''), lambda s: {_SEGMENT.format('s')}) AS segs FROM texts),
sr AS (SELECT location_text, len(segs) - i AS r, segs[i] AS s, string_split(segs[i], ' ') AS w FROM (SELECT location_text, segs, unnest(range(1, len(segs) + 1)) AS i FROM sg)),
tail AS (SELECT location_text, r * 10 AS pos, s AS term FROM sr UNION ALL SELECT location_text, r * 10 + 5 - n, array_to_string(w[len(w) - n + 1:len(w)], ' ') FROM sr, (VALUES (4), (3), (2), (1)) v(n) WHERE len(w) >= n),
hit AS (SELECT location_text, arg_min(country, pos) AS country FROM tail JOIN terms USING (term) WHERE kind = 'name' AND term <> '' GROUP BY 1),
rawc AS (SELECT location_text, arg_min(s, r) AS raw FROM sr JOIN (SELECT location_text, len(segs) AS n FROM sg) USING (location_text) WHERE r < n - 1 AND length(s) BETWEEN 3 AND 40 AND len(w) <= 4 AND NOT regexp_matches(s, '\\d') AND s NOT IN ({_STATE_LIST}) GROUP BY 1),
opts AS (SELECT location_text, coalesce(code, 'RAW:' || raw, '') AS country_value, coalesce(hit.country, array_to_string(list_transform(string_split(raw, ' '), lambda x: upper(x[1]) || x[2:]), ' '), '') AS country_label,
  coalesce(CASE {_HINTS} END, sales_region, '') AS sales_region FROM sg LEFT JOIN hit USING (location_text) LEFT JOIN rawc USING (location_text) LEFT JOIN country_rows r ON r.country = hit.country)"""


@query(f"WITH {_OPTIONS} SELECT canonical_url, location_text, country_value, country_label, sales_region FROM located JOIN opts USING (location_text)")
def t15_place_options(spark, sf_dir):
    """What a country filter offers for each location, with the raw fallback."""
    return P.place_options(located(spark, sf_dir)).select("canonical_url", "location_text", "country_value", "country_label", "sales_region")


def _has_state(code: str) -> str:
    return f"(regexp_matches(upper(location_text), '(^|[^A-Z]){code}([^A-Z]|$)') OR lower(location_text) LIKE '%{G.US_STATES[code]}%')"


@query(f"SELECT canonical_url, location_text FROM located WHERE NOT hidden AND ({_has_state('CA')} OR {_has_state('OR')} OR {_has_state('MO')})")
def f7_states(spark, sf_dir):
    """F7, F6 by state: codes between other than letters, or names."""
    rows = P.place_options(located(spark, sf_dir).where("not hidden"))
    return P.place_filter(rows, states=("CA", "or", "MO")).select("canonical_url", "location_text")


@query(f"""
WITH {_OPTIONS}
SELECT canonical_url, location_text FROM located JOIN opts USING (location_text) WHERE NOT hidden AND (lower(location_text) LIKE '%greene%' AND {_has_state('MO')} OR lower(location_text) LIKE '%zürich%')
UNION ALL SELECT canonical_url || '#2', location_text FROM located JOIN opts USING (location_text) WHERE NOT hidden AND (country_value = 'DE' OR ' ' || {_TEXT.format('location_text')} || ' ' SIMILAR TO '.* (germany|deu|deutschland|lost kingdom) .*') AND sales_region IN ('EMEA', '')
""")
def f6_place_filters(spark, sf_dir):
    """counties with and without a state; country values by code and raw, and regions."""
    rows = P.place_options(located(spark, sf_dir).where("not hidden"))
    first = P.place_filter(rows, counties=("MO|Greene County", "Zürich")).select("canonical_url", "location_text")
    second = P.place_filter(rows, country_values=("DE", "RAW:lost kingdom"), regions=("EMEA", ""))
    return first.union(second.select(F.concat("canonical_url", F.lit("#2")), "location_text"))


_MODE = f"CASE WHEN {_TEXT.format('location_text')} SIMILAR TO '(.* )?hybrid( .*)?' THEN 'hybrid' WHEN ' ' || {_TEXT.format('location_text')} || ' ' SIMILAR TO '.* (remote|work from home|wfh|anywhere) .*' THEN 'remote' ELSE 'non_remote' END"


@query(f"""
WITH {_OPTIONS}
SELECT canonical_url FROM located JOIN opts USING (location_text) WHERE country_value = 'TR' OR concat_ws('|', {', '.join(_TEXT.format(c) for c in ('company_name', 'position_name', 'location_text', 'ats_key'))}, replace({_MODE}, '_', ' ')) LIKE '%turkiye%'
""")
def f9_token_matches(spark, sf_dir):
    """a search word that also names a country."""
    return P.place_options(located(spark, sf_dir)).where(P.token_matches("Türkiye")).select("canonical_url")


_EVIDENCE = _TEXT.format("location_text || ' ' || position_name")
_STORED = "CASE lower(trim(remote_type)) WHEN 'remote' THEN 'remote' WHEN 'hybrid' THEN 'hybrid' WHEN 'onsite' THEN 'onsite' ELSE 'unknown' END"


@query(f"""
WITH {_INFER}
SELECT canonical_url, company_name, position_name, location_text AS location, CASE WHEN trim(located.country) <> '' THEN trim(located.country) ELSE inferred_country END AS country, CASE WHEN trim(region) <> '' THEN trim(region) ELSE inferred_region END AS region,
  CASE WHEN {_STORED} <> 'unknown' THEN {_STORED} WHEN regexp_matches({_EVIDENCE}, '\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches({_EVIDENCE}, '\\b(remote|work from home|work from anywhere|wfh|anywhere|home based|home office|telecommute|telework|virtual|distributed)\\b') THEN 'remote'
  WHEN regexp_matches({_EVIDENCE}, '\\b(on ?site|office based|in office|work from office)\\b') THEN 'onsite' ELSE 'unknown' END AS remote_type, ats_key, last_seen_epoch
FROM located JOIN inferred USING (location_text) WHERE NOT hidden
""")
def f16_response_rows(spark, sf_dir):
    """F16: the listing's projection with inferred places and remote types."""
    return P.response_rows(located(spark, sf_dir).where("not hidden"))
