"""Places: the fixed tables of countries, states and cities, as rows to join and as small Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.functions.text import fold_text, search_text, trimmed

#: Code, country, sales region, business region, other names (comma-separated).
COUNTRIES = tuple(
    tuple(part.strip() for part in line.split("|"))
    for line in """
US|United States|AMER|North America|usa,u.s.,u.s.a.,united states of america
CA|Canada|AMER|North America|can
MX|Mexico|AMER|LATAM|mex
BR|Brazil|AMER|LATAM|brasil,bra
AR|Argentina|AMER|LATAM|arg
CL|Chile|AMER|LATAM|chl
CO|Colombia|AMER|LATAM|col
PE|Peru|AMER|LATAM|per
UY|Uruguay|AMER|LATAM|ury
PY|Paraguay|AMER|LATAM|pry
BO|Bolivia|AMER|LATAM|bol
EC|Ecuador|AMER|LATAM|ecu
CR|Costa Rica|AMER|LATAM|cri
PA|Panama|AMER|LATAM|pan
GT|Guatemala|AMER|LATAM|gtm
SV|El Salvador|AMER|LATAM|slv
HN|Honduras|AMER|LATAM|hnd
NI|Nicaragua|AMER|LATAM|nic
DO|Dominican Republic|AMER|North America|dom
PR|Puerto Rico|AMER|North America|pri
JM|Jamaica|AMER|North America|jam
TT|Trinidad and Tobago|AMER|North America|tto,trinidad
BS|Bahamas|AMER|North America|bhs,the bahamas
BB|Barbados|AMER|North America|brb
GB|United Kingdom|EMEA|EMEA|uk,u.k.,gbr,great britain,britain,england,scotland,wales,northern ireland
IE|Ireland|EMEA|EMEA|irl,republic of ireland
FR|France|EMEA|EMEA|fra
DE|Germany|EMEA|EMEA|deu,deutschland
ES|Spain|EMEA|EMEA|esp
PT|Portugal|EMEA|EMEA|prt
IT|Italy|EMEA|EMEA|ita
NL|Netherlands|EMEA|EMEA|nld,holland
BE|Belgium|EMEA|EMEA|bel
LU|Luxembourg|EMEA|EMEA|lux
CH|Switzerland|EMEA|EMEA|che,schweiz,suisse
AT|Austria|EMEA|EMEA|aut
SE|Sweden|EMEA|EMEA|swe
NO|Norway|EMEA|EMEA|nor
DK|Denmark|EMEA|EMEA|dnk
FI|Finland|EMEA|EMEA|fin
IS|Iceland|EMEA|EMEA|isl
PL|Poland|EMEA|EMEA|pol
CZ|Czechia|EMEA|EMEA|cze,czech republic
SK|Slovakia|EMEA|EMEA|svk
HU|Hungary|EMEA|EMEA|hun
RO|Romania|EMEA|EMEA|rou
BG|Bulgaria|EMEA|EMEA|bgr
HR|Croatia|EMEA|EMEA|hrv,hrvatska
SI|Slovenia|EMEA|EMEA|svn
RS|Serbia|EMEA|EMEA|srb
GR|Greece|EMEA|EMEA|grc
CY|Cyprus|EMEA|EMEA|cyp
MT|Malta|EMEA|EMEA|mlt
EE|Estonia|EMEA|EMEA|est
LV|Latvia|EMEA|EMEA|lva
LT|Lithuania|EMEA|EMEA|ltu
UA|Ukraine|EMEA|EMEA|ukr
TR|Turkey|EMEA|EMEA|tur,turkiye,turkish,turkyie,turksih
AE|United Arab Emirates|EMEA|EMEA|are,uae,u.a.e.
SA|Saudi Arabia|EMEA|EMEA|sau,ksa
QA|Qatar|EMEA|EMEA|qat
IL|Israel|EMEA|EMEA|isr
EG|Egypt|EMEA|EMEA|egy
MA|Morocco|EMEA|EMEA|mar
ZA|South Africa|EMEA|EMEA|zaf
NG|Nigeria|EMEA|EMEA|nga
KE|Kenya|EMEA|EMEA|ken
GH|Ghana|EMEA|EMEA|gha
IN|India|APAC|APAC|ind
CN|China|APAC|APAC|chn,prc
JP|Japan|APAC|APAC|jpn
KR|South Korea|APAC|APAC|kor,korea,republic of korea
SG|Singapore|APAC|APAC|sgp
MY|Malaysia|APAC|APAC|mys
TH|Thailand|APAC|APAC|tha
VN|Vietnam|APAC|APAC|vnm,viet nam
ID|Indonesia|APAC|APAC|idn
PH|Philippines|APAC|APAC|phl
AU|Australia|APAC|APAC|aus
NZ|New Zealand|APAC|APAC|nzl
HK|Hong Kong|APAC|APAC|hkg,hong kong sar
TW|Taiwan|APAC|APAC|twn
PK|Pakistan|APAC|APAC|pak
BD|Bangladesh|APAC|APAC|bgd
LK|Sri Lanka|APAC|APAC|lka
""".strip().splitlines()
)
#: States and provinces by code.
US_STATES = dict(
    line.split(" ", 1)
    for line in (
        "AL alabama,AK alaska,AZ arizona,AR arkansas,CA california,CO colorado,CT connecticut,DE delaware,FL florida,GA georgia,HI hawaii,ID idaho,IL illinois,IN indiana,"
        "IA iowa,KS kansas,KY kentucky,LA louisiana,ME maine,MD maryland,MA massachusetts,MI michigan,MN minnesota,MS mississippi,MO missouri,MT montana,NE nebraska,NV nevada,"
        "NH new hampshire,NJ new jersey,NM new mexico,NY new york,NC north carolina,ND north dakota,OH ohio,OK oklahoma,OR oregon,PA pennsylvania,RI rhode island,SC south carolina,"
        "SD south dakota,TN tennessee,TX texas,UT utah,VT vermont,VA virginia,WA washington,WV west virginia,WI wisconsin,WY wyoming,DC district of columbia"
    ).split(",")
)
CANADIAN_PROVINCES = dict(
    line.split(" ", 1)
    for line in (
        "AB alberta,BC british columbia,MB manitoba,NB new brunswick,NL newfoundland and labrador,NS nova scotia,NT northwest territories,NU nunavut,ON ontario,"
        "PE prince edward island,QC quebec,SK saskatchewan,YT yukon"
    ).split(",")
)
#: Cities that tell a country.
CITIES = {
    "Turkey": "istanbul,ankara,izmir,antalya,bursa,gebze,kocaeli,konya,adana",
    "United States": "los angeles,san francisco,seattle,chicago,boston,austin,dallas,houston,washington dc",
    "United Kingdom": "london,manchester,birmingham,edinburgh,glasgow,bristol,leeds,cambridge",
    "Canada": "toronto,vancouver,montreal,ottawa,calgary,edmonton,waterloo",
    "Germany": "berlin,munich,munchen,hamburg,frankfurt,cologne,stuttgart,heidelberg",
    "France": "paris,lyon,marseille,toulouse,lille",
    "Netherlands": "amsterdam,rotterdam,utrecht,eindhoven",
    "Spain": "madrid,barcelona,valencia,malaga",
    "Italy": "rome,roma,milan,milano,turin",
    "Ireland": "dublin,cork,galway",
    "India": "bengaluru,bangalore,hyderabad,pune,mumbai,delhi,gurgaon,gurugram,noida,chennai",
    "Australia": "sydney,melbourne,brisbane,perth,adelaide",
    "Japan": "tokyo,osaka,kyoto",
    "Brazil": "sao paulo,rio de janeiro,curitiba",
    "Mexico": "mexico city,ciudad de mexico,guadalajara,monterrey",
    "Poland": "warsaw,krakow,wroclaw",
    "Portugal": "lisbon,lisboa,porto",
    "United Arab Emirates": "dubai,abu dhabi",
    "South Korea": "seoul,busan,incheon",
    "Taiwan": "taipei,hsinchu,kaohsiung",
}
#: Words of a location that name a sales region; and those that are no country.
REGION_HINTS = {
    "AMER": ("amer", "americas", "north america", "south america", "latin america", "latam", "caribbean"),
    "EMEA": ("emea", "europe", "middle east", "africa"),
    "APAC": ("apac", "asia pacific", "asia", "oceania"),
}
NO_COUNTRY = ("remote", "hybrid", "onsite", "on site", "worldwide", "global", "international", *(h for hints in REGION_HINTS.values() for h in hints))


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", fold_text(name)).strip()


def place_terms() -> list[tuple[str, str, str, int]]:
    """(term, kind, country, rank): names, codes, states and cities; a smaller rank wins."""
    rows: dict[tuple[str, str], tuple[str, str, str]] = {}
    for code, label, _, _, names in COUNTRIES:
        for name in (label, *filter(None, names.split(","))):
            rows.setdefault((plain(name), "name"), (plain(name), "name", label))
        rows.setdefault((code.lower(), "code"), (code.lower(), "code", label))
    for country, states in (("United States", US_STATES), ("Canada", CANADIAN_PROVINCES)):
        for name in states.values():
            rows.setdefault((name, "place"), (name, "place", country))
    for country, cities in CITIES.items():
        for name in cities.split(","):
            rows.setdefault((name, "place"), (name, "place", country))
    order = {"name": 0, "code": 1, "place": 2}
    return [(*r, i) for i, r in enumerate(sorted(rows.values(), key=lambda r: order[r[1]]))]


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(place_terms(), "term string, kind string, country string, rank int")


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in COUNTRIES], "code string, country string, sales_region string, business_region string")


def _codes(table: dict[str, str]) -> str:
    return "|".join(table)


US_STATE = rf"(?:^|,\s*|\s-\s)(?:{_codes(US_STATES)})(?:\s|,|$)"
US_PREFIX = rf"^(?:{_codes(US_STATES)})[-\s]"
CANADA_PROVINCE = rf"(?:^|,\s*|\s-\s)(?:{_codes(CANADIAN_PROVINCES)})(?:\s|,|$)"
CANADA_PREFIX = rf"^(?:{_codes(CANADIAN_PROVINCES)})[-\s]"


def state_country(location: Column) -> Column:
    """The country whose state or province abbreviation stands in the location, or an empty text."""
    t = F.upper(trimmed(location))
    return F.when(t.rlike(US_STATE) | t.rlike(US_PREFIX), "United States").when(t.rlike(CANADA_PROVINCE) | t.rlike(CANADA_PREFIX), "Canada").otherwise("")


def has_state(location: Column, code: str) -> Column:
    """The location holds the state's code between other than letters, or its name."""
    code = code.strip().upper()
    coded = F.upper(F.coalesce(location, F.lit(""))).rlike(rf"(^|[^A-Z]){re.escape(code)}([^A-Z]|$)")
    name = US_STATES.get(code)
    return coded | F.contains(F.lower(F.coalesce(location, F.lit(""))), F.lit(name)) if name else coded


def word_runs(words: Column, most: int = 4) -> Column:
    """All runs of up to ``most`` words, joined by spaces."""
    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<string>"))

    runs = [of(n) for n in range(1, most + 1)]
    return F.array_distinct(F.flatten(F.array(*runs)))


def city_of(location: Column, country: Column) -> Column:
    """The first part of a location if it can be a city: no work mode, no state, no country, nothing like `various`."""
    t = F.regexp_replace(trimmed(location), r"(?i)^(?:remote|hybrid|onsite|on[- ]?site|work from home|wfh|virtual|telework)\s*[-:,]\s*", "")
    first = F.trim(F.split(t, r"\s*,\s*|\s+-\s+|\s+\|\s+")[0])
    key = search_text(first)
    states, provinces = [*US_STATES.values(), *(c.lower() for c in US_STATES)], [*CANADIAN_PROVINCES.values(), *(c.lower() for c in CANADIAN_PROVINCES)]
    names = sorted({term for term, kind, _, _ in place_terms() if kind != "place"})
    blank = (
        (first == "") | (F.length(first) > 80) | first.rlike(r"(?i)\b(?:work from home|home based|remote|hybrid|onsite|on[- ]?site|wfh|worldwide|anywhere)\b")
        | first.rlike(r"(?i)^\(?\s*(multiple|various|several|all)\b") | first.rlike(r"(?i)^(district[- ]?wide|statewide|nationwide|tbd|n/?a|unknown)$")
        | (key == search_text(country)) | key.isin(*names)
        | (key.isin(*states) & F.coalesce(country, F.lit("")).isin("", "United States")) | (key.isin(*provinces) & F.coalesce(country, F.lit("")).isin("", "Canada"))
    )
    return F.when(blank, "").otherwise(first)
