"""Where a posting is: country, region and city from a location text, and filters by place.

Location texts repeat, so each distinct text is resolved once, by joins with the gazetteer, and written; joined back by its size, it leaves the postings where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.functions.geo import COUNTRIES, NO_COUNTRY, REGION_HINTS, US_STATES, city_of, countries, gazetteer, has_state, plain, state_country, word_runs
from jobgrain.functions.text import any_of, is_blank, remote_type, search_text, stored_remote_type, trimmed, work_mode
from jobgrain.operators.quality import location_is_narrative
from jobgrain.sources.storage import written


def _words(c: Column) -> Column:
    return F.filter(F.split(search_text(c), " "), lambda w: w != "")


def _named(texts: DataFrame) -> DataFrame:
    """(location_text) -> its first country by name, else by city or state name."""
    runs = texts.select("location_text", F.explode(word_runs(_words(F.col("location_text")))).alias("term"))
    terms = gazetteer(texts.sparkSession).where("kind <> 'code' and length(term) > 2").select("term", "country", "rank")
    return runs.join(terms, "term").groupBy("location_text").agg(F.min_by("country", "rank").alias("named"))


def _coded(texts: DataFrame) -> DataFrame:
    """(location_text) -> the country of a code in front of it, or between delimiters."""
    codes = gazetteer(texts.sparkSession).where("length(term) between 2 and 3").select(F.col("term").alias("code"), "country").distinct()
    t = trimmed(F.col("location_text"))
    prefix = F.lower(F.regexp_extract(t, r"(?i)^([a-z]{2,3})(?:-?$|[-\s].+$)", 1))
    rest = F.regexp_extract(t, r"(?i)^[a-z]{2,3}[-\s](.+)$", 1)
    parts = F.filter(F.transform(F.split(F.lower(t), r"[,\n\r/|;]+"), lambda x: F.regexp_replace(x, "[^a-z0-9]+", "")), lambda x: x != "")
    listed = F.filter(parts, lambda x: (F.length(x) == 3) | ((F.length(x) == 2) & (F.size(parts) <= 2)))
    tokens = F.concat(F.array(F.struct(F.lit(0).alias("at"), prefix.alias("code"))), F.transform(listed, lambda x, i: F.struct((i + 1).alias("at"), x.alias("code"))))
    rows = texts.select("location_text", rest.alias("rest"), F.explode(tokens).alias("x")).select("location_text", "rest", "x.at", "x.code").where("code <> ''")
    found = rows.join(codes, "code")
    north = F.col("country").isin("United States", "Canada")
    head = F.col("rest").rlike(r"(?i)^(remote|hybrid|virtual)$") | F.col("rest").rlike(r"^[A-Z]{2}[-\s]") | (state_country(F.concat(F.lit(", "), F.regexp_extract("rest", r"^([^-\s,]+)", 1))) == F.col("country")) | (F.col("rest") == "")
    good = F.when(F.col("at") == 0, ~north | head).otherwise(~north)
    return found.where(good).groupBy("location_text").agg(F.min(F.struct("at", "country")).alias("x")).select("location_text", F.col("x.country").alias("coded"), (F.col("x.at") == 0).alias("in_front"))


def infer_places(postings: DataFrame) -> DataFrame:
    """The rows with inferred_country, inferred_region and inferred_city.

    Narrative texts tell nothing. Else the first that is there: a code in front, a state abbreviation, a code between
    delimiters, a country's name, the name of a state or city.
    """
    texts = postings.select("location_text").where(~is_blank(F.col("location_text"))).distinct()
    known = texts.where(~location_is_narrative(F.col("location_text")))
    found = known.join(_coded(known), "location_text", "left").join(_named(known), "location_text", "left")
    state = F.nullif(state_country(F.col("location_text")), F.lit(""))
    country = F.coalesce(F.when(F.col("in_front"), F.col("coded")), state, F.col("coded"), F.col("named"))
    found = found.withColumn("country_name", country).join(countries(postings.sparkSession).select(F.col("country").alias("country_name"), "business_region"), "country_name", "left")
    resolved = texts.join(found.select("location_text", "country_name", "business_region"), "location_text", "left").select(
        "location_text", F.coalesce("country_name", F.lit("")).alias("inferred_country"), F.coalesce("business_region", F.lit("")).alias("inferred_region"),
        city_of(F.col("location_text"), F.col("country_name")).alias("inferred_city"),
    )
    return postings.join(written(resolved, "places"), "location_text", "left").fillna("", ["inferred_country", "inferred_region", "inferred_city"])


def place_options(postings: DataFrame) -> DataFrame:
    """Each location with the value and label a country filter offers for it, and its sales region.

    The last segment that names a country decides, whole or by its last words; without one, the last segment that could be a
    country is offered as it is (RAW:...).
    """
    spark = postings.sparkSession
    texts = postings.select("location_text").where(~is_blank(F.col("location_text"))).distinct()
    segments = F.filter(F.transform(F.split("location_text", r"[,/|;]+|\s+-\s+"), search_text), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(country|republic|federation|state)\b", " "), r"\s+", " ")))
    texts = texts.withColumn("segments", segments)
    last = lambda ws, n: F.array_join(F.slice(ws, F.size(ws) - (n - 1), n), " ")
    tails = lambda s: F.array(s, *[F.when(F.size(F.split(s, " ")) >= n, last(F.split(s, " "), n)) for n in (4, 3, 2, 1)])
    rows = texts.select("location_text", F.posexplode(F.flatten(F.transform(F.reverse("segments"), tails))).alias("at", "term")).where("term is not null and term <> ''")
    names = gazetteer(spark).where("kind = 'name'").select("term", "country")
    found = rows.join(names, "term").groupBy("location_text").agg(F.min_by("country", "at").alias("country"))
    found = found.join(countries(spark), "country")
    likely = lambda s: (F.length(s).between(3, 40)) & (F.size(F.split(s, " ")) <= 4) & ~s.rlike(r"\d") & ~s.isin(*NO_COUNTRY, *US_STATES.values())
    raw = F.try_element_at(F.filter(F.reverse(F.slice("segments", 2, 1000)), likely), F.lit(1))  # not the first segment
    text = F.concat(F.lit(" "), search_text(F.col("location_text")), F.lit(" "))
    hinted = reduce(lambda rest, r: F.when(any_of(*[F.contains(text, F.lit(f" {h} ")) for h in REGION_HINTS[r]]), r).otherwise(rest), reversed(tuple(REGION_HINTS)), F.lit(None))
    out = texts.join(found, "location_text", "left").withColumn("raw", raw)
    resolved = out.select(
        "location_text", F.coalesce("code", F.concat(F.lit("RAW:"), F.col("raw")), F.lit("")).alias("country_value"),
        F.coalesce("country", F.initcap("raw"), F.lit("")).alias("country_label"), F.coalesce(hinted, F.col("sales_region"), F.lit("")).alias("sales_region"),
    )
    return postings.join(written(resolved, "places"), "location_text", "left").fillna("", ["country_value", "country_label", "sales_region"])


def place_filter(rows: DataFrame, states: tuple[str, ...] = (), counties: tuple[str, ...] = (), country_values: tuple[str, ...] = (), regions: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``place_options`` that match all kinds of filters asked for, each by any of its values.

    counties are names or STATE|name; country values are codes or RAW:name.
    """
    location = F.col("location_text")
    low = F.regexp_replace(F.lower(trimmed(location)), r"\s+", " ")
    phrase = lambda x: F.contains(F.concat(F.lit(" "), search_text(location), F.lit(" ")), F.lit(f" {plain(x)} "))
    parts = []
    if states:
        parts.append(any_of(*[has_state(location, s) for s in states]))
    if counties:
        def county(value: str) -> Column:
            state, _, name = value.rpartition("|")
            name = " ".join(w for w in name.lower().split() if w not in ("county", "parish", "borough", "municipality"))
            return F.contains(low, F.lit(name)) & (has_state(location, state) if state else F.lit(True))

        parts.append(any_of(*[county(c) for c in counties]))
    if country_values:
        names = {c[0]: (c[1], *filter(None, c[4].split(","))) for c in COUNTRIES}
        parts.append(any_of(*[phrase(v[4:]) if v.upper().startswith("RAW:") else (F.col("country_value") == v.upper()) | any_of(*[phrase(n) for n in names.get(v.upper(), (v,))]) for v in country_values]))
    if regions:
        parts.append(F.col("sales_region").isin(*regions))
    return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


def token_matches(token: str, fields: tuple[str, ...] = ("company_name", "position_name", "location_text", "ats_key")) -> Column:
    """A search word against rows of ``place_options``: in company, title, location, source (or the ``fields`` given) or work mode, or the name of the row's country."""
    word = plain(token)
    texts = [search_text(F.col(c)) for c in fields]
    hit = any_of(*[F.contains(t, F.lit(word)) for t in texts], F.contains(search_text(work_mode(F.col("location_text"))), F.lit(word)))
    code = next((c[0] for c in COUNTRIES if word in {plain(n) for n in (c[1], *filter(None, c[4].split(",")))}), None)
    return hit | (F.col("country_value") == code) if code else hit


def response_rows(postings: DataFrame) -> DataFrame:
    """What a listing shows: stored country, region and remote type, or what location and title tell where they are missing."""
    rows = infer_places(postings)
    country = F.when(is_blank(F.col("country")), F.col("inferred_country")).otherwise(trimmed(F.col("country")))
    region = F.when(is_blank(F.col("region")), F.col("inferred_region")).otherwise(trimmed(F.col("region")))
    stored = stored_remote_type(F.col("remote_type"))
    evidence = remote_type(F.concat_ws(" ", "location_text", "position_name"))
    return rows.select(
        "canonical_url", "company_name", "position_name", F.nullif(F.col("location_text"), F.lit("")).alias("location"), country.alias("country"), region.alias("region"),
        F.when(stored == "unknown", evidence).otherwise(stored).alias("remote_type"), "ats_key", F.coalesce("last_seen_epoch", F.lit(0)).alias("last_seen_epoch"),
    )
