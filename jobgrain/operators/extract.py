"""Evidence and fields from landed payloads: URLs, JSON-LD, JSON shapes, titles."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.functions.text import canonical_url, plain_text, search_text, trimmed

#: Fixed values, first match wins: parts that a lower-case posting URL must all hold, and the system it belongs to.
URL_RULES = (
    (("myworkdayjobs.com",), "workday"), (("jobs.ashbyhq.com",), "ashby"), (("job-boards.greenhouse.io",), "greenhouse"), (("boards.greenhouse.io",), "greenhouse"), (("jobs.lever.co",), "lever"),
    ((".recruitee.com",), "recruitee"), (("recruiting.ultipro.com/", "/jobboard/"), "ultipro"), ((".taleo.net/careersection/",), "taleo"), (("jobs.jobvite.com/", "/job/"), "jobvite"),
    ((".applicantpro.com/jobs",), "applicantpro"), ((".applytojob.com/apply",), "applytojob"), ((".icims.com/jobs/",), "icims"), ((".breezy.hr/p/",), "breezy"), ((".bamboohr.com/careers",), "bamboohr"),
    ((".getro.com/jobs",), "getro"), (("governmentjobs.com/jobs/",), "governmentjobs"), (("jobs.smartrecruiters.com/",), "smartrecruiters"), (("usajobs.gov/job/",), "usajobs"),
    ((".teamtailor.com/jobs",), "teamtailor"), ((".freshteam.com/jobs",), "freshteam"), ((".pinpointhq.com/", "/postings/"), "pinpointhq"), (("recruitcrm.io/jobs/",), "recruitcrm"),
    (("ats.rippling.com/", "/jobs"), "rippling"), ((".careerplug.com/jobs",), "careerplug"), (("join.com/companies/",), "join"), ((".oraclecloud.com/hcmui/candidateexperience/", "/job/"), "oracle"),
    (("careers.pageuppeople.com/", "/job/"), "pageup"), (("recruiting.paylocity.com/recruiting/jobs/details/",), "paylocity"), (("eightfold.ai/careers/job",), "eightfold"),
)
#: Path parts that are no posting id.
NO_ID = ("jobs", "careers", "employment", "job-opening.php")


def source_of_url(url: Column) -> Column:
    """The system of a posting URL, or an empty text."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    out = F.lit("")
    for parts, name in reversed(URL_RULES):
        hit = F.lit(True)
        for p in parts:
            hit = hit & F.contains(low, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def source_job_id(url: Column) -> Column:
    """The id in a posting URL: a digit run after /jobs/, else the last path part; an empty text without either."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", "")
    digits, last = F.regexp_extract(path, r"(?i)/jobs/(\d+)", 1), F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(digits != "", digits).when(F.lower(last).isin(*NO_ID), "").otherwise(last)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))


POSTING_LD = "`@type` string, title string, datePosted string, description string, jobLocationType string, jobLocation struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"


def json_ld_postings(pages: DataFrame) -> DataFrame:
    """Job postings of the JSON-LD blocks of pages (page_id, html): objects, arrays; malformed blocks are passed over."""
    block = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
    raw = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(block), 1)).alias("raw"))
    raw = raw.withColumn("raw", F.trim(F.regexp_replace(F.regexp_replace("raw", r"^\s*<!--", ""), r"-->\s*$", "")))
    array = F.when(F.col("raw").startswith("["), F.col("raw")).otherwise(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    found = raw.select("page_id", F.explode(F.from_json(array, f"array<struct<{POSTING_LD.replace(' string', ':string').replace(' struct', ':struct')}>>")).alias("p"))
    place = F.col("p.jobLocation.address")
    return found.where("p.`@type` = 'JobPosting'").select(
        "page_id", "p.title", F.col("p.datePosted").alias("posted"), place["addressLocality"].alias("city"), place["addressRegion"].alias("region"), place["addressCountry"].alias("country"),
        (F.upper("p.jobLocationType") == "TELECOMMUTE").alias("remote"), F.col("p.description").alias("description"),
    )


RSS = "channel struct<title: string, item: array<struct<title: string, link: string, description: string, pubDate: string, guid: string, category: string>>>, _corrupt string"
#: Zones that feeds write by name.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_time(c: Column) -> Column:
    """Epoch seconds of a feed's date (day month year time zone, perhaps with a weekday); null for anything else."""
    v = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    for name, offset in ZONES.items():
        v = F.regexp_replace(v, rf"\s{name}$", f" {offset}")
    return F.unix_timestamp(F.try_to_timestamp(v, F.lit("d MMM yyyy HH:mm:ss xx")))


def rss_postings(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Postings of RSS payloads in the fields of JSON ones: the payload's other columns, feed_ok, and one row per item; a malformed feed keeps one row without fields.

    company_name is the channel's title; canonical_url has no tracking parameters; description_plain is text; posted_at_epoch is null where the date cannot be read.
    """
    others = [c for c in payloads.columns if c != column]
    feed = payloads.select(*others, F.from_xml(F.col(column), RSS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_f"))
    ok = F.col("_f.channel").isNotNull() & F.col("_f._corrupt").isNull()
    items = feed.select(*others, F.coalesce(ok, F.lit(False)).alias("feed_ok"), F.col("_f.channel.title").alias("company_name"), F.explode_outer(F.when(ok, F.col("_f.channel.item"))).alias("_i"))
    text = lambda name: trimmed(F.col(f"_i.{name}"))
    return items.select(
        *others, "feed_ok", F.when(F.col("feed_ok"), trimmed(F.col("company_name"))).otherwise("").alias("company_name"), text("title").alias("position_name"), canonical_url(text("link")).alias("canonical_url"),
        plain_text(text("description")).alias("description_plain"), text("guid").alias("source_job_id"), text("category").alias("department"), feed_time(F.col("_i.pubDate")).alias("posted_at_epoch"),
    )


def shape_of(value, prefix: str = "", depth: int = 0) -> set[str]:
    """Typed paths of a JSON value: five levels, the first item of an array, a hundred keys of an object."""
    if depth > 5:
        return set()
    kind = "array" if isinstance(value, list) else "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "object"
    out = {f"{prefix}:{kind}"} if prefix else set()
    if kind == "array":
        return out | (shape_of(value[0], f"{prefix}[]", depth + 1) if value else {f"{prefix}[]:empty"} if prefix else set())
    if kind == "object":
        for key in sorted(value)[:100]:
            out |= shape_of(value[key], f"{prefix}.{key}" if prefix else key, depth + 1)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def shape_paths(payload: pd.Series) -> pd.Series:
    """Sorted typed paths of JSON texts; an empty array for anything else."""

    def one(text):
        try:
            return sorted(shape_of(json.loads(text)))
        except (TypeError, ValueError):
            return []

    return payload.map(one)


def shape_hash(paths: Column) -> Column:
    return F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 24)


@F.pandas_udf(T.StringType())
def payload_hash(payload: pd.Series) -> pd.Series:
    """SHA-256 of JSON texts with sorted keys, so that the order of keys does not matter."""

    def one(text):
        try:
            text = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            text = text or ""
        return hashlib.sha256(text.encode()).hexdigest()

    return payload.map(one)


def evidence_spans(df: DataFrame, text: str, patterns: dict[str, str], context: int = 40) -> DataFrame:
    """One row per match of the labelled patterns (at most one group of hits per label and text): kind, match, excerpt."""
    def spans(kind: str, pattern: str) -> Column:
        hit = F.regexp_extract_all(text, F.lit(f"(?is)(.{{0,{context}}}(?:{pattern}).{{0,{context}}})"), 1)
        return F.transform(hit, lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x, f"(?is)({pattern})", 1).alias("match"), x.alias("excerpt")))

    rows = [spans(kind, pattern) for kind, pattern in patterns.items()]
    return df.withColumn("span", F.explode(F.concat(*rows))).select(*[c for c in df.columns if c != text], "span.*")


def title_grams(df: DataFrame, title: str, low: int = 1, high: int = 3) -> DataFrame:
    """Distinct word n-grams of each title, as column ``gram`` with its length ``n``."""
    words = F.filter(F.split(search_text(F.col(title)), " "), lambda w: w != "")
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_w", i + 1, n), " ").alias("gram")))
    every = F.flatten(F.array(*[F.when(F.size("_w") >= n, of(n)).otherwise(F.array()) for n in range(low, high + 1)]))
    return df.withColumn("_w", words).withColumn("_g", F.explode(F.array_distinct(every))).select(*df.columns, "_g.n", "_g.gram")


def train_title_model(titles: DataFrame, least_word: int = 3, least_phrase: int = 2, most_industries: int = 1) -> DataFrame:
    """(title, industry) rows -> (gram, n, industry, titles): n-grams frequent enough and of few industries."""
    counts = title_grams(titles, "title").groupBy("gram", "n", "industry").agg(F.count("*").alias("titles"))
    wide = counts.groupBy("gram").agg(F.count("*").alias("industries"))
    enough = F.when(F.col("n") == 1, F.col("titles") >= least_word).otherwise(F.col("titles") >= least_phrase)
    return counts.where(enough).join(wide, "gram").where(F.col("industries") <= most_industries).select("gram", "n", "industry", "titles")


def match_titles(titles: DataFrame, model: DataFrame) -> DataFrame:
    """The industry of each title (id, title): its longest, then most frequent known n-gram decides."""
    hits = title_grams(titles.select("id", "title"), "title").join(model, ["gram", "n"])
    return hits.groupBy("id").agg(F.max_by("industry", F.struct("n", "titles", "industry")).alias("industry"))


def fuzzy_terms(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """Vocabulary words within one edit of a query word (from four letters on) or two (from eight): query, word, distance.

    Both sides are spread into the words that one deletion leaves (a pair within one edit shares one of them); two edits use two deletions for long
    words only. So candidates meet in an equi-join, and Levenshtein decides.
    """
    def cut(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.length(c))))

    def keys(df: DataFrame, name: str) -> DataFrame:
        w = F.col(name)
        once = F.concat(F.array(w), F.when(F.length(w) > 3, cut(w)).otherwise(F.array()))
        twice = F.when(F.length(w) >= 7, F.concat(once, F.flatten(F.transform(once, cut)))).otherwise(once)
        return df.select(name, F.explode(F.array_distinct(twice)).alias("k"))

    met = keys(queries.select(F.col("term").alias("query")).distinct(), "query").join(keys(vocabulary.select(F.col("term").alias("word")).distinct(), "word"), "k").select("query", "word").distinct()
    most = F.when(F.length("query") >= 8, 2).when(F.length("query") >= 4, 1).otherwise(0)
    return met.withColumn("distance", F.levenshtein("query", "word")).where(F.col("distance") <= most)
