"""Functions on texts as they arrive, dealt to the rows of a table; the SQL holds what each should give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobgrain.functions import text as T
from jobgrain.operators import extract as X
from jobgrain.operators import usage as U
from jobgrain.plans.registry import query
from jobgrain.sources.views import postings, table

#: type, query, result count, countries, country, language, session, referrer, agent; then what they become, and the term that may be published.
_EVENTS = (
    (("Search Suggest", "  data   engineer ", "7.9", "Germany, ,France ", "de", "en_us", "A" * 64, "https://Www.X.example:8080/a?b", "Mozilla Chrome/120 Safari/5"), ("suggest", "data engineer", 7, "Germany,France", "DE", "en-US", "a" * 64, "www.x.example", "chrome", "data   engineer")),
    (("postings filter-options", "a@b.example", "-3", "", "DEU", "english", "zz", "-", "Googlebot/2 Chrome/1"), ("filter_options", "a@b.example", 0, "", "", "", "", "", "bot", None)),
    (("POSTINGS", "+49 30 1234 56789", "", "x,,y,", " fr ", "tr", "0" * 64, "", "curl/8"), ("postings", "+49 30 1234 56789", None, "x,y", "FR", "tr", "0" * 64, "", "cli", None)),
    (("other", "nurse", "99999999", "one", "", "pt-br-x", "", "http://news.example", "Mozilla Edg/1 Chrome/2"), ("postings", "nurse", 2_000_000, "one", "", "pt-BR", "", "news.example", "edge", "nurse")),
    (("", "https://x.example/cv", "n/a", "", "1a", "e", "", "nonsense", ""), ("postings", "https://x.example/cv", None, "", "", "", "", "", "unknown", None)),
)
_RAW = ("type", "query", "result_count", "countries", "country", "language", "session", "referrer", "agent")
_DONE = ("event_type", "query", "result_count", "country_filters", "country_scope", "language_code", "anonymous_session_key", "referrer_host", "user_agent_family", "public_term")


def _cell(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_cell, (i, *r))) + ")" for i, r in enumerate(rows))


def _dealt(key: str, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


@query(f"SELECT event_id, {', '.join('v.' + c for c in _DONE)} FROM events JOIN (VALUES {_values([d for _, d in _EVENTS])}) v(k, {', '.join(_DONE)}) ON event_id % {len(_EVENTS)} = v.k")
def u11_u12_u13_normalised_events(spark, sf_dir):
    """Landed events in their stored form, and terms that may be published."""
    raw = table(spark, sf_dir, "events").select("event_id", *[_dealt("event_id", [r[i] for r, _ in _EVENTS]).alias(c) for i, c in enumerate(_RAW)])
    return U.normalised_events(raw)


_TEXTS = (
    ("  São   Paulo, SP ", "sao paulo, sp", "unknown", "unknown"), ("Hybrid (2 days)", "hybrid (2 days)", "hybrid", "unknown"), ("Fully Remote", "fully remote", "remote", "unknown"), ("On_Site", "on_site", "onsite", "onsite"),
    ("remote", "remote", "remote", "remote"), ("Work from Office", "work from office", "onsite", "unknown"), ("", "", "unknown", "unknown"), ("İZMİR", "izmir", "unknown", "unknown"),
)


@query(f"SELECT event_id, lookup, told, stored FROM events JOIN (VALUES {_values([t[1:] for t in _TEXTS])}) v(k, lookup, told, stored) ON event_id % {len(_TEXTS)} = v.k")
def t2_t16_text_functions(spark, sf_dir):
    """Lookup texts and remote types."""
    t = _dealt("event_id", [x[0] for x in _TEXTS])
    return table(spark, sf_dir, "events").select("event_id", T.lookup_text(t).alias("lookup"), T.remote_type(t).alias("told"), T.stored_remote_type(t).alias("stored"))


@query("""SELECT posting_no, sha256('{"a":' || posting_no || ',"b":"' || ats_key || '"}') AS hash FROM postings""")
def t24_payload_hashes(spark, sf_dir):
    """Hashes of payloads do not depend on the order of keys."""
    first, second = F.struct(F.col("ats_key").alias("b"), F.col("posting_no").alias("a")), F.struct(F.col("posting_no").alias("a"), F.col("ats_key").alias("b"))
    payload = F.when(F.col("posting_no") % 2 == 0, F.to_json(first)).otherwise(F.to_json(second))
    return postings(spark, sf_dir).select("posting_no", X.payload_hash(payload).alias("hash"))


@query("""
SELECT posting_no, 'place' AS kind, 'based in' AS match FROM postings WHERE country <> '' UNION ALL SELECT posting_no, 'mode', remote_type FROM postings WHERE remote_type IN ('remote', 'onsite')
""")
def t21_evidence_spans(spark, sf_dir):
    """Labelled evidence with its surroundings."""
    text = F.concat(F.lit("We are "), F.when(F.col("country") != "", F.lit("Based in ")).otherwise(""), F.lit("x. Mode: "), F.col("remote_type"), F.lit("."))
    found = X.evidence_spans(postings(spark, sf_dir).select("posting_no", text.alias("t")), "t", {"place": "based in", "mode": "remote|onsite"})
    return found.select("posting_no", "kind", F.lower("match").alias("match"))
