"""Text, URL, date and vocabulary functions as Columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that count as a missing value.
BLANK_WORDS = ("", "unknown", "n/a", "na", "none", "null", "undefined", "not available", "not applicable", "not specified", "unspecified")
#: Geographic values that say nothing, beside the blank words.
SUSPICIOUS_GEO_WORDS = ("remote", "remote only", "work from home", "wfh", "multiple", "multiple locations", "various", "various locations", "global", "worldwide")
#: No remote type at all.
MISSING_REMOTE_WORDS = ("", "n/a", "na", "not available")
#: Query parameters that only track the visitor (beside utm_*).
TRACKING_PARAMETERS = ("_ga", "_gl", "gh_src", "iis", "iisn", "lever-source", "ref", "referrer", "source", "src")
def _accented() -> dict[str, str]:
    """Latin letters whose decomposition is an ASCII letter with marks, and that letter; the Turkish dotless i beside them."""
    out = {"ı": "i"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            out[chr(code)] = base
    return out


PLAIN_LETTERS = _accented()
ACCENTED, PLAIN = "".join(PLAIN_LETTERS), "".join(PLAIN_LETTERS.values())


def fold_text(text: str) -> str:
    """``fold`` of a constant."""
    marked = re.sub("[\u0300-\u036f]", "", text)
    return "".join(PLAIN_LETTERS.get(c, c) for c in marked).lower()


def trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def lowered(c: Column) -> Column:
    return F.lower(trimmed(c))


def is_blank(c: Column) -> Column:
    """Null or white space."""
    return trimmed(c) == ""


def is_blank_like(c: Column) -> Column:
    """Blank, or a word that stands for a missing value."""
    return lowered(c).isin(*BLANK_WORDS)


def is_suspicious_geo(c: Column) -> Column:
    return lowered(c).isin(*(w for w in BLANK_WORDS if w), *SUSPICIOUS_GEO_WORDS)


def is_missing_remote(c: Column) -> Column:
    return lowered(c).isin(*MISSING_REMOTE_WORDS)


def fold(c: Column) -> Column:
    """Accents off, lower case; combining marks dropped."""
    return F.lower(F.translate(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[̀-ͯ]", ""), ACCENTED, PLAIN))


def search_text(c: Column) -> Column:
    """Folded, only letters and digits, single spaces."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def lookup_text(c: Column) -> Column:
    """Folded with punctuation kept, single spaces."""
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def canonical_url(c: Column) -> Column:
    """Without fragment and tracking parameters; other parameters keep their order."""
    url = F.regexp_replace(trimmed(c), "#.*$", "")
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: ~(name(p).isin(*TRACKING_PARAMETERS) | name(p).startswith("utm_")) & (p != ""))
    return F.when(F.contains(url, F.lit("?")) & (F.size(kept) > 0), F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def remote_type(c: Column) -> Column:
    """hybrid, remote, onsite or unknown from free text."""
    t = search_text(c)
    remote = r"\b(remote|work from home|work from anywhere|wfh|anywhere|home based|home office|telecommute|telework|virtual|distributed)\b"
    return (
        F.when(t == "true", "remote").when(t.rlike(r"\bhybrid\b"), "hybrid").when(t.rlike(remote), "remote")
        .when(t.rlike(r"\b(on ?site|office based|in office|work from office)\b"), "onsite").otherwise("unknown")
    )


def stored_remote_type(c: Column) -> Column:
    """The stored value in its standard spelling."""
    v = F.regexp_replace(lowered(c), r"[_\s]+", "-")
    return F.when(v.isin("remote", "hybrid", "onsite"), v).when(v.isin("on-site", "on-site-only", "non-remote"), "onsite").otherwise("unknown")


def work_mode(c: Column) -> Column:
    """From a location text: hybrid before remote before non_remote."""
    t = search_text(c)
    return F.when(t == "", "unknown").when(t.rlike(r"\bhybrid\b"), "hybrid").when(t.rlike(r"\b(remote|work from home|wfh|anywhere)\b"), "remote").otherwise("non_remote")


def plain_text(c: Column) -> Column:
    """HTML to text."""
    t = F.coalesce(c, F.lit(""))
    for pattern, by in (
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|tr|td|th|h[1-6])>", "\n"),
        (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"), (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def posted_epoch(c: Column, as_of: int | Column) -> Column:
    """Epoch seconds of a posting date as boards write it, against ``as_of`` (a time, or each row's own)."""
    v = trimmed(c)
    low = F.regexp_replace(F.lower(v), r"^posted\s+", "")
    hours, days = (F.regexp_extract(low, rf"^(\d+)\s+{unit}s?\s+ago$", 1) for unit in ("hour", "day"))
    iso = F.regexp_replace(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2")
    zoned = F.unix_timestamp(iso.try_cast("timestamp"))
    local = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), iso.try_cast("timestamp_ntz"))  # without a zone: UTC, whatever the session's
    parsed = F.when(~iso.rlike(r"^\d{4}-"), None).when(iso.rlike(r"\d:\d\d(:\d\d(\.\d+)?)?\s*(Z|[+-]\d\d:?\d\d)$"), zoned).otherwise(local)
    return (
        F.when(v == "", None).when(low == "today", as_of).when(low == "yesterday", as_of - 86_400)
        .when(hours != "", F.lit(as_of) - hours.cast("long") * 3600).when(days != "", F.lit(as_of) - days.cast("long") * 86_400)
        .when(v.rlike(r"^\d{10}$"), v.cast("long")).when(v.rlike(r"^\d{13}$"), F.floor(v.cast("long") / 1000).cast("long")).otherwise(parsed)
    ).cast("long")


def document_id(c: Column) -> Column:
    """SHA-256 of the URL as unpadded URL-safe Base64."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(F.coalesce(c, F.lit("")), 256))), "+/", "-_"), F.lit("="))


def percent(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """Two decimals; ``empty`` where the whole is zero."""
    return F.when(whole > 0, F.round(part * 100 / whole, 2)).otherwise(F.lit(empty).cast("double"))


#: Fixed values, first match wins: families of user agents.
AGENT_RULES = (
    ("bot", "bot|crawler|spider|slurp|preview|prefetch"), ("cli", "curl|wget|httpie"), ("powershell", "powershell"), ("firefox", "firefox/?"), ("edge", "edge?/"), ("chrome", "chrome|chromium|crios"), ("safari", "safari"),
    ("android", "android"), ("ios", "iphone|ipad|ios"),
)


def user_agent_family(c: Column) -> Column:
    v = lowered(c)
    out = F.lit("other")
    for family, pattern in reversed(AGENT_RULES):
        out = F.when(v.rlike(pattern), family).otherwise(out)
    return F.when(v == "", "unknown").otherwise(out)


def is_personal(c: Column) -> Column:
    """A search term that looks like an e-mail address, a URL, a domain with a path or a telephone number."""
    v = trimmed(c)
    return v.rlike(r"\S+@\S+\.\S+") | v.rlike(r"(?i)^(https?://|www\.)") | v.rlike(r"(?i)\b[a-z0-9-]+\.[a-z]{2,}/") | (F.length(F.regexp_replace(v, r"\D", "")) >= 10)


def public_term(c: Column) -> Column:
    """The term, at most 80 characters, or null if it looks personal."""
    return F.when(is_personal(c) | is_blank(c), None).otherwise(F.substring(trimmed(c), 1, 80))


def failure_reason(kind: Column, status: Column, message: Column) -> Column:
    """One reason per error: by status first, then by type and message."""
    text = F.concat_ws(" ", F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(message, F.lit(""))))
    return (
        F.when(status == 429, "rate_limited").when(status.isin(401, 403), "blocked").when(status.isin(404, 410), "not_found").when(status >= 500, "server_error")
        .when(text.rlike("timeout|timed out"), "timeout").when(text.rlike("parser_|schema"), "parser").when(text.rlike("validation"), "validation")
        .when(text.rlike("network|socket|dns"), "network").otherwise("other")
    )


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)
