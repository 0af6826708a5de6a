"""Filling gaps: who is a candidate, where evidence comes from, what would change, and detail pages."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from jobgrain.functions.text import is_blank, lowered, plain_text, remote_type, stored_remote_type, trimmed
from jobgrain.operators.extract import host_of
from jobgrain.operators.places import infer_places

#: Strength of where a field's value comes from.
EVIDENCE_STRENGTH = {"structured": 100, "detail": 90, "api": 80, "list": 60, "url": 40, "inferred": 20}
#: Parts of a key that tell a secret.
SECRET_KEY = re.compile("token|secret|password|key|authorization|cookie")


def missing_place() -> Column:
    return is_blank(F.col("country")) | is_blank(F.col("region")) | is_blank(F.col("city"))


def weak_remote() -> Column:
    return stored_remote_type(F.col("remote_type")) == "unknown"


def backfill_candidates(postings: DataFrame) -> DataFrame:
    """Visible rows with a gap and something that could fill it, in the order of their URLs, numbered within hash buckets of bounded size."""
    gap = missing_place() | weak_remote() | is_blank(F.col("posting_date"))
    evidence = ~is_blank(F.col("location_text")) | ~is_blank(F.col("position_name")) | ~is_blank(F.col("description_plain"))
    return postings.where(~F.col("hidden") & gap & evidence)


def next_batch(rows: DataFrame, after: str, limit: int) -> DataFrame:
    """Keyset walk: the next rows by URL after a given one."""
    return rows.where(F.col("canonical_url") > after).orderBy("canonical_url").limit(limit)


def detail_reason(supported: tuple[str, ...]) -> Column:
    """Why a row is no candidate for its detail page; empty if it is one."""
    complete = ~missing_place() & ~weak_remote() & ~is_blank(F.col("description_plain"))
    return (
        F.when(~F.col("ats_key").isin(*supported), "unsupported_source").when(F.col("hidden"), "hidden").when(is_blank(F.col("canonical_url")), "missing_url")
        .when(complete, "already_complete").when(~F.col("canonical_url").rlike("(?i)^https?://"), "missing_detail_url").otherwise("")
    )


def candidates_by_host(candidates: DataFrame) -> DataFrame:
    """Candidates by source and host, with the totals of each source and of all."""
    out = candidates.withColumn("host", host_of(F.col("canonical_url"))).rollup("ats_key", "host").agg(F.grouping_id().alias("g"), F.count("*").alias("candidates"))
    return out.select(F.when(F.col("g") == 3, "(all)").otherwise(F.col("ats_key")).alias("ats_key"), F.when(F.col("g") > 0, "(all)").otherwise(F.col("host")).alias("host"), "candidates")


def capped_per_host(candidates: DataFrame, most: int) -> DataFrame:
    """At most so many rows of each source and host (or company, without a host), the newest first."""
    host = F.coalesce(F.nullif(host_of(F.col("canonical_url")), F.lit("")), F.nullif(lowered(F.col("company_name")), F.lit("")), F.lit("unknown"))
    w = W.partitionBy("ats_key", "host").orderBy(F.desc("last_seen_epoch"), "canonical_url")
    return candidates.withColumn("host", host).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def place_from_url(url: Column, title: Column, source: Column) -> Column:
    """A location that the URL's path or the title holds, or an empty text."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", "")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.try_url_decode(c), r"[-_]+", " "), r"\s+", " "))
    after_job, after_id = F.regexp_extract(path, r"(?i)/job/([^/]+)", 1), F.regexp_extract(path, r"(?i)/jobs/[^/]+/([^/]+)", 1)
    t = F.coalesce(title, F.lit(""))
    options = F.array(F.regexp_extract(t, r"\(([^)]+)\)", 1), F.regexp_extract(t, r"\s[-–—]{1,2}\s([^-–—]+)$", 1), F.coalesce(clean(after_id), F.lit("")))
    likely = lambda x: (F.length(x).between(1, 100)) & (x.rlike(r"(?i)\b(remote|hybrid|work from home|telework|virtual)\b") | x.rlike(r"[A-Za-z][A-Za-z .'-]+,\s*[A-Z]{2}\b") | x.rlike(r"(?i)\b(united states|usa|us|canada|turkey|turkiye|netherlands|austria|taiwan|china|korea)\b"))
    found = F.coalesce(F.try_element_at(F.filter(F.transform(options, F.trim), likely), F.lit(1)), F.lit(""))
    mode = F.when(t.rlike(r"(?i)\b(remote|hybrid|work from home|telework|virtual)\b"), "Remote").otherwise("")
    return F.when((source == "workday") & (after_job != ""), F.coalesce(clean(after_job), F.lit(""))).when(source == "icims", found).otherwise(mode)


def department_of(department: Column, industry: Column, title: Column, source: Column) -> Column:
    """The stored department, else the source's category, else the first part of a title of boards that write it there."""
    first = F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"^(.+?)\s+-\s+", 1))
    usable = (source == "applitrack") & F.length(first).between(1, 80) & ~first.rlike(r"(?i)^(job|position|opening|unknown|untitled|n/?a)$")
    return F.when(~is_blank(department), trimmed(department)).when(~is_blank(industry), trimmed(industry)).when(usable, first).otherwise("")


def replaces_country(stored: Column, inferred: Column, source: Column, location: Column) -> Column:
    """A stored country gives way to another inferred one only where the board writes a country's code in front of the location."""
    differs = ~is_blank(stored) & ~is_blank(inferred) & (trimmed(stored) != trimmed(inferred))
    return differs & (source == "icims") & F.coalesce(location, F.lit("")).rlike(r"^[A-Z]{2,3}[-\s]")


def place_plan(postings: DataFrame) -> DataFrame:
    """One row for each change that location and title justify: canonical_url, field, before, after, rule, confidence; blanks are filled, stored values stay."""
    rows = infer_places(postings.withColumns({c: F.coalesce(c, F.lit("")) for c in ("country", "region", "city", "location_text")}))
    told = remote_type(F.concat_ws(" ", "location_text", "position_name"))
    cell = lambda field, after, rule, sure: F.struct(F.lit(field).alias("field"), trimmed(F.col(field)).alias("before"), after.alias("after"), F.lit(rule).alias("rule"), F.lit(sure).alias("confidence"))
    fill = [F.when(is_blank(F.col(f)) & ~is_blank(F.col(f"inferred_{f}")), cell(f, F.col(f"inferred_{f}"), f"location_{f}", sure)) for f, sure in (("country", 0.9), ("region", 0.85), ("city", 0.8))]
    remote = F.when(weak_remote() & (told != "unknown"), cell("remote_type", told, "location_or_title_mode", 0.75))
    return rows.select("canonical_url", "ats_key", F.explode(F.array_compact(F.array(*fill, remote))).alias("c")).select("canonical_url", "ats_key", "c.*")


def plan_summary(changes: DataFrame) -> DataFrame:
    """Changes by field, by source and by rule: (level, value, changes, rows).

    The changes of a URL are brought together once, without sums before, and leave as its counts; the first change of a value counts the row. So no task keeps the URLs of each level apart.
    """
    columns = {"field": "field", "source": "ats_key", "rule": "rule"}
    each = changes.select("canonical_url", *columns.values()).repartition("canonical_url").groupBy("canonical_url", *columns.values()).agg(F.count("*").alias("n"))
    of_row = each.groupBy("canonical_url").agg(F.collect_list(F.struct(*columns.values(), "n")).alias("c"))

    def counts(level: str, column: str) -> Column:
        first = lambda x, i: ~F.exists(F.slice("c", F.lit(1), i), lambda y: y[column].eqNullSafe(x[column]))
        return F.transform("c", lambda x, i: F.struct(F.lit(level).alias("level"), x[column].alias("value"), x["n"].alias("n"), first(x, i).alias("first")))

    levels = of_row.select("canonical_url", F.explode(F.concat(*[counts(level, column) for level, column in columns.items()])).alias("x"))
    named = F.col("x.first") & F.col("canonical_url").isNotNull()
    return levels.groupBy("x.level", "x.value").agg(F.sum("x.n").alias("changes"), F.count_if(named).alias("rows"))


def detail_plan(postings: DataFrame, details: DataFrame, fields: tuple[str, ...] = ("location_text", "country", "region", "city", "posting_date", "department", "description_plain")) -> DataFrame:
    """Changes from detail pages (canonical_url and the fields, remote_type): blanks are filled, a weak remote type is strengthened, nothing is overwritten."""
    both = postings.join(details.select("canonical_url", *[F.col(f).alias(f"d_{f}") for f in (*fields, "remote_type")]), "canonical_url")
    cell = lambda f: F.struct(F.lit(f).alias("field"), trimmed(F.col(f)).alias("before"), trimmed(F.col(f"d_{f}")).alias("after"))
    fill = [F.when(is_blank(F.col(f)) & ~is_blank(F.col(f"d_{f}")), cell(f)) for f in fields]
    remote = F.when(weak_remote() & (stored_remote_type(F.col("d_remote_type")) != "unknown"), cell("remote_type"))
    return both.select("canonical_url", F.explode(F.array_compact(F.array(*fill, remote))).alias("c")).select("canonical_url", "c.*")


def strongest_evidence(evidence: DataFrame) -> DataFrame:
    """Of each row's pieces of evidence (canonical_url, field, value, origin, rule, confidence) the strongest per field.

    An explicitly stated remote or hybrid type beats everything, an onsite type that was inferred from a place is weaker than its origin.
    """
    base = F.element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE_STRENGTH.items() for x in kv]), F.col("origin"))
    explicit = F.lower("rule").rlike(r"\bsource|explicit|remote|workplace|labeled")
    remote = F.when(F.col("value").isin("remote", "hybrid") & explicit, 1000).when((F.col("value") == "onsite") & F.lower("rule").rlike("infer|physical|location"), -10).otherwise(0)
    score = F.coalesce(base, F.lit(0)) + F.when(F.col("field") == "remote_type", remote).otherwise(0)
    rows = evidence.where(~is_blank(F.col("value")))
    best = F.max_by(F.struct("value", "origin", "rule", "confidence"), F.struct(score.alias("s"), F.col("confidence"), F.col("value"), F.col("rule")))
    return rows.groupBy("canonical_url", "field").agg(best.alias("b")).select("canonical_url", "field", "b.*")


def detail_decision(families: tuple[str, ...] = ("enterprise_api", "html_detail", "public_sector", "brittle")) -> DataFrame | Column:
    """needed, not_needed, not_supported or blocked, with reasons, for rows with source_family, detail_blocked and explicit_remote."""
    place = ~is_blank(F.col("country")) | ~is_blank(F.col("region")) | ~is_blank(F.col("city"))
    kind = stored_remote_type(F.col("remote_type"))
    remote = (kind == "unknown") | (kind.isin("remote", "hybrid") & ~F.col("explicit_remote"))
    need = ~place | remote | is_blank(F.col("posting_date"))
    can = F.col("source_family").isin(*families)
    decision = F.when(F.col("detail_blocked"), "blocked").when(~need, "not_needed").when(can, "needed").otherwise("not_supported")
    reasons = F.array_compact(F.array(F.when(~place, "list_missing_location"), F.when(remote, "list_missing_remote"), F.when(need & ~can, "detail_required_but_unavailable")))
    return F.struct(decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"))


#: Names of the elements that hold a description, tried in order, as class or id.
DESCRIPTION_NAMES = ("job-details-content", "job__description", "job-description", "jobDesc", "jobDetail", "reqDescription", "description", "content")
_STARTS = [re.compile(rf"""<(div|section|span)\b[^>]*(?:class|id)=["']?[^"'>]*\b{re.escape(n)}\b[^>]*>""", re.IGNORECASE) for n in DESCRIPTION_NAMES]


def balanced_content(html: str, start: re.Match) -> str:
    """What stands between an opening tag and its closing one, nested tags of the name counted; to the end without one."""
    depth = 1
    for m in re.compile(rf"<(/?){start[1]}\b[^>]*?(/?)>", re.IGNORECASE).finditer(html, start.end()):
        depth += -1 if m[1] else 0 if m[2] else 1
        if depth == 0:
            return html[start.end() : m.start()].strip()
    return html[start.end() :].strip()


@F.pandas_udf(T.StringType())
def description_html(html: pd.Series) -> pd.Series:
    """The first described element with more than a hundred characters, or null."""

    def one(page):
        for pattern in _STARTS:
            if page and (m := pattern.search(page)) and len(inner := balanced_content(page, m)) > 100:
                return inner
        return None

    return html.map(one)


def descriptions(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) with a description, as HTML and text."""
    found = pages.select("page_id", description_html(F.col("html")).alias("description_html")).where("description_html is not null")
    return found.withColumn("description_plain", plain_text(F.col("description_html")))


#: Where payloads keep a field, the first that holds something counts.
FIELD_PATHS = {
    "position_name": ("title", "position_name", "name", "jobTitle", "text"), "company_name": ("company.name", "company", "company_name", "hiringOrganization.name"),
    "canonical_url": ("canonical_url", "url", "absolute_url", "hostedUrl", "applyUrl"), "location_text": ("location.name", "location", "locations[0].name", "jobLocation.address.addressLocality", "categories.location"),
    "city": ("location.city", "city", "jobLocation.address.addressLocality"), "country": ("location.country", "country", "jobLocation.address.addressCountry"),
    "department": ("department.name", "department", "departments[0].name", "categories.team"), "posting_date": ("posting_date", "datePosted", "publishedAt", "updated_at", "createdAt"),
    "source_job_id": ("id", "job_id", "requisitionId", "source_job_id"), "remote": ("remote", "isRemote", "workplaceType", "jobLocationType"),
}


def payload_fields(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One flat record per JSON payload: each field from the first of its paths that holds a value; malformed payloads give empty fields."""
    others = [c for c in payloads.columns if c != column]
    read = payloads.select(*others, F.try_parse_json(F.col(column)).alias("_parsed_payload"))  # a column of its own, so each payload is parsed once
    at = lambda path: F.try_variant_get("_parsed_payload", f"$.{path}", "string")
    said = lambda paths: F.filter(F.transform(F.array(*map(at, paths)), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[\[{]"))
    return read.select(*others, *[F.coalesce(F.get(said(paths), F.lit(0)), F.lit("")).alias(f) for f, paths in FIELD_PATHS.items()])


def _flat(value, depth: int = 0) -> list[str]:
    if value is None or depth > 4:
        return []
    if isinstance(value, dict):
        return [x for k, v in value.items() if not SECRET_KEY.search(k.lower()) for x in _flat(v, depth + 1)]
    if isinstance(value, list):
        return [x for v in value for x in _flat(v, depth + 1)]
    return [json.dumps(value) if isinstance(value, bool) else str(value)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def flat_values(payload: pd.Series) -> pd.Series:
    """The values of a JSON text, five levels deep, without those under keys that tell a secret."""

    def one(text):
        try:
            return _flat(json.loads(text))
        except (TypeError, ValueError):
            return []

    return payload.map(one)


def feedback(lines: DataFrame, since: str, until: str, newest: int) -> DataFrame:
    """Feedback entries of a log of JSON lines (value): the newest of a window; other events and malformed lines are passed over."""
    e = F.from_json("value", "event string, timestamp string, message string, context struct<rating: string, path: string>")
    rows = lines.where(F.trim("value") != "").select(e.alias("e")).where("e.event = 'public_feedback'").withColumn("at", F.col("e.timestamp").try_cast("timestamp_ntz"))
    rows = rows.where(F.col("at").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    rating = F.coalesce(F.nullif(trimmed(F.col("e.context.rating")), F.lit("")), F.lit("unrated"))
    return rows.select("at", rating.alias("rating"), trimmed(F.col("e.message")).alias("message"), trimmed(F.col("e.context.path")).alias("path")).orderBy(F.desc("at"), "message").limit(newest)


def imported(rows: DataFrame, spelled: dict[str, str]) -> DataFrame:
    """A snapshot's rows under our names (ours: theirs), text trimmed, sources in their standard spelling, missing epochs zero."""
    def one(ours: str, theirs: str) -> Column:
        c = F.col(theirs) if theirs in rows.columns else F.lit(None).cast("string")
        if ours == "ats_key":
            return F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9]+", "").alias(ours)
        return (F.coalesce(c.cast("long"), F.lit(0)) if ours.endswith("_epoch") else trimmed(c)).alias(ours)

    return rows.select(*[one(o, t) for o, t in spelled.items()])


def application_list(applications: DataFrame, companies: DataFrame, attribution: DataFrame) -> DataFrame:
    """Applications with their company and who sent them, the newest first where they are listed."""
    out = applications.join(companies.select("company_id", "company_name"), "company_id", "left").join(attribution, "application_id", "left")
    return out.withColumn("by_type", F.coalesce("by_type", F.lit("manual")))


def parser_stats(*parts: DataFrame) -> DataFrame:
    """Figures of several reports side by side by (ats_key, parser_version)."""
    key = ["ats_key", "parser_version"]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
