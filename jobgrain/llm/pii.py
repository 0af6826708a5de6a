"""Personal data: identifiers by their form, and more of them by bootstrapped contexts.

Identifiers of a fixed form (emails, IP addresses, cards, phones) are the seeds. The word before and the word after a seed are
its lexical patterns; a pattern's slots are all places in the corpus where that word stands. Patterns and instances form a graph
whose edges count how often an instance fills a slot of a pattern. Rounds of scoring go back and forth on it:

* pattern: the share of its slots that hold instances, each weighed by its score, times s / (s + 2) for s trusted ones;
* instance: certainty 1 for a seed, else what the best pattern before it and the best one after it say together.

Instances to be found have a looser form of a kind (a card number that fails its checksum, a phone without a plus sign, an IPv6
address, an email without a dot or with "[at]"), so a pattern's kind and the form must agree. Those that high-confidence patterns
vouch for are added wherever they stand, unless they overlap what the forms gave. Scores are whole thousandths, so sums do not
depend on their order. Only built-in functions run here.
"""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import materialize, require

KINDS = ("email", "ip", "card", "phone")
SPACE, BLANKS = r"\x20\x09-\x0D", " \t\n\x0b\f\r"
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Identifiers by form, as Java patterns that read a text once: a match starts where a run of its first characters starts or the
#: last match ended, and takes runs whole. They find what the plain forms find.
FORMS = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Looser forms of the same kinds.
LOOSE = (
    ("email", rf"(?:\G|(?<![^{SPACE}@]))[^{SPACE}@]++@[^{SPACE}@]++"),
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++\x20?+[(\[]at[)\]]\x20?+[{LOCAL}]++(?:\x20?+[(\[]dot[)\]]\x20?+[{LOCAL}]++)*+"),
    ("ip", r"(?:\G|(?<![0-9A-Fa-f]))[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){3,7}"),
    ("card", r"[0-9]++(?:[\x20./-][0-9]++)*+"),
    ("phone", r"[0-9]++(?:[\x20().-]++[0-9]++)*+"),
)
#: Words of a context end at white space or after these signs.
SIGNS = r"=:\"'(<\["
WORD = rf"[^{SPACE}{SIGNS}]*+[{SIGNS}]++|[^{SPACE}{SIGNS}]++"
BEFORE = rf"(?:[^{SPACE}{SIGNS}]*[{SIGNS}]+[{SPACE}]*|[^{SPACE}{SIGNS}]+[{SPACE}]+)\z"
AFTER = rf"^[,.;:!?)\"'\]>]*[{SPACE}]+([^{SPACE}{SIGNS}]*[{SIGNS}]+|[^{SPACE}{SIGNS}]+)"
#: Letters of the text beside a match that are looked at, and of the longest context word.
REACH, LONGEST = 64, 40
#: Seeds that a pattern needs, thousandths that a pattern and an instance need, and rounds.
SEEDS, PATTERN, INSTANCE, ROUNDS = 3, 500, 800, 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "array<struct<kind: int, start: long, end: long, value: string, before: string, after: string>>"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def folded(text: Column) -> Column:
    """ASCII letters in lower case, digits as zeros."""
    return F.translate(text, UPPER + "123456789", LOWER + "0" * 9)


def _lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    """The checksum of a string of digits: from the right, every second digit is doubled and its digits are added."""

    def digit(i: Column) -> Column:
        d = F.substring(value, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(value)), digit), F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_valid(kind: str, hit: Column) -> Column:
    """What a form cannot say itself."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(once(F.regexp_replace(p, "^0+", ""), lambda x: F.when((F.length(x) < 3) | (F.length(x) == 3) & (x <= "255"), F.lit("")).otherwise(F.lit("-")))) == 0)
    if kind == "card":
        return once(digits(hit), lambda d: F.when(F.length(d).between(13, 19), passes_luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def _is_plausible(kind: str, hit: Column) -> Column:
    """The like for looser forms."""
    if kind == "card":
        return F.length(digits(hit)).between(12, 19)
    if kind == "phone":
        return F.length(digits(hit)).between(7, 15)
    return F.length(hit).between(5, 320)


def _short(word: Column) -> Column:
    return once(word, lambda w: F.when((F.length(w) > 0) & (F.length(w) <= LONGEST), folded(w)))


def _spans(text: Column, number: int, pattern: str, valid) -> Column:
    """Spans of a pattern: text splits into what stands between the matches, whose lengths give the places."""

    def placed(parts: Column) -> Column:
        gaps, hits = parts["gaps"], parts["hits"]

        def item(gap: Column, i: Column) -> Column:
            hit = F.get(hits, i)
            return F.struct(
                F.length(gap).alias("gap"), F.length(hit).alias("size"), F.when(hit.isNotNull(), valid(hit)).otherwise(False).alias("valid"), hit.alias("hit"), i.alias("i")
            )

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(
                F.lit(number).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"), _lower(x["hit"]).alias("value"),
                _short(F.rtrim(F.regexp_extract(F.right(F.get(gaps, x["i"]), F.lit(REACH)), BEFORE, 0), F.lit(BLANKS))).alias("before"),
                _short(F.regexp_extract(F.left(F.get(gaps, x["i"] + 1), F.lit(REACH)), AFTER, 1)).alias("after"),
            )
            return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(x["valid"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(F.transform(gaps, item), start, step, lambda acc: acc["spans"])

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return once(parts, placed)


#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]*:", "card": "[0-9]", "phone": "[0-9]"}


def found_spans(text: Column, forms: tuple[tuple[str, str], ...], valid) -> Column:
    """Spans of several forms, form by form, each by its start."""
    each = [F.when(F.rlike(text, F.lit(NEEDS[kind])), _spans(text, KINDS.index(kind), p, partial(valid, kind))).otherwise(F.array().cast(SPAN)) for kind, p in forms]
    return F.concat(*each)


def base_spans(text: Column) -> Column:
    """Identifiers by form, by kind and start."""
    return found_spans(text, FORMS, _is_valid)


def loose_spans(text: Column, base: Column) -> Column:
    """Spans of looser forms that overlap none of ``base``."""
    return F.filter(found_spans(text, LOOSE, _is_plausible), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: reduce(lambda out, i: F.when(k == i, F.lit(KINDS[i])).otherwise(out), range(len(KINDS)), F.lit(None).cast("string"))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def slot_counts(texts: DataFrame) -> DataFrame:
    """(cue, total): how often each context word stands in the corpus."""
    words = texts.select(F.explode(F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0))).alias("cue"))
    return words.where(F.length("cue") <= LONGEST).groupBy("cue").agg(F.count("*").alias("total"))


def trusted_instances(spans: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value) of the loose instances that patterns vouch for.

    ``spans`` holds (kind, value, known, before, after), one row per occurrence; ``totals`` (cue, total).
    """
    sides = F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("cue")), F.struct(F.lit("a").alias("side"), F.col("after").alias("cue")))).alias("s")
    edges = spans.select("kind", "value", "known", sides).select("kind", "value", "known", "s.side", "s.cue").where("cue is not null")
    edges = materialize(edges.groupBy("kind", "side", "cue", "value").agg(F.max("known").alias("known"), F.count("*").alias("n")))
    pattern = ["kind", "side", "cue"]
    cues = edges.groupBy(*pattern).agg(F.sum(F.col("known").cast("long")).alias("seeds"), F.sum("n").alias("filled")).where(F.col("seeds") >= SEEDS)
    # what cannot be a pattern of high confidence even if all that fills it were true is left out
    cues = cues.join(totals, "cue").where(F.col("filled") * 1000 >= F.col("total") * PATTERN).select(*pattern, "total")
    graph = materialize(edges.join(cues, pattern).withColumn("score", F.when(F.col("known"), 1000).otherwise(0).cast("long")))
    for _ in range(rounds):
        patterns = graph.groupBy(*pattern).agg(
            F.sum(F.col("n") * F.col("score")).alias("hits"), F.count_if(F.col("score") >= INSTANCE).alias("sure"), F.max("total").alias("total")
        )
        worth = F.expr("least(1000L, hits * sure div (total * (sure + 2)))")
        patterns = patterns.where(F.col("sure") >= SEEDS).select(*pattern, worth.alias("worth")).where(F.col("worth") >= PATTERN)
        best = graph.join(patterns, pattern).groupBy("kind", "value").agg(
            F.coalesce(F.max(F.when(F.col("side") == "b", F.col("worth"))), F.lit(0)).alias("b"), F.coalesce(F.max(F.when(F.col("side") == "a", F.col("worth"))), F.lit(0)).alias("a")
        )
        scores = best.select("kind", "value", F.expr("1000L - (1000L - b) * (1000L - a) div 1000L").alias("found"))
        score = F.when(F.col("known"), 1000).otherwise(F.coalesce("found", F.lit(0))).cast("long")
        graph = materialize(graph.join(scores, ["kind", "value"], "left").withColumn("score", score).drop("found"))
    return graph.where((F.col("score") >= INSTANCE) & ~F.col("known")).select("kind", "value").distinct()


def personal_data(docs: DataFrame) -> DataFrame:
    """documents -> one row per row: doc_id, base and added (arrays of spans by kind and start: kind number, start, end, value, the
    words before and after).

    Places are code points from 0, ends exclusive. Null and empty texts have no spans. Equal texts get equal spans whatever their
    doc_id, repeated rows stay repeated, an empty table gives an empty result, further columns are ignored. A value found by
    context is added wherever it stands in its loose form, in the order of kinds and starts. Texts are read by regular expressions
    that take each run of characters once, so very long ones cost in proportion.
    """
    texts = require(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = texts.withColumn("base", base_spans(F.col("text"))).withColumn("loose", loose_spans(F.col("text"), F.col("base")))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "loose"))
    both = rows.select("row", F.explode(F.concat(F.transform("base", lambda x: F.struct(F.lit(True).alias("known"), x.alias("x"))), F.transform("loose", lambda x: F.struct(F.lit(False).alias("known"), x.alias("x"))))).alias("o"))
    spans = both.select("row", "o.known", "o.x.*")
    trusted = trusted_instances(spans, slot_counts(texts))
    span = F.struct("kind", "start", "end", "value", "before", "after")
    added = spans.where("not known").join(trusted, ["kind", "value"]).groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("added"))
    return rows.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """``personal_data`` as counts, a digest of what the forms gave, and all spans."""
    found = personal_data(docs)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(both).alias("spans"), F.size("added").cast("long").alias("n_added"))


def oracle() -> str:
    """The digest in SQL, with plain patterns and one row per match."""
    plain = lambda p: re.sub(r"\(\?:\\G\|\(\?<!.*?\]\)\)|\(\?<!\[0-9\]\)", "", p).replace("++", "+").replace("*+", "*").replace("?+", "?")
    text = lambda x: "'" + x.replace("'", "''") + "'"
    digit = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digit}) + 1), lambda i: case when i % 2 = 1 then substr(d, -i, 1)::int "
        "when substr(d, -i, 1)::int > 4 then 2 * substr(d, -i, 1)::int - 9 else 2 * substr(d, -i, 1)::int end)) % 10 = 0"
    )
    forms = ", ".join(f"({i}, {KINDS.index(k)}, {known}, {text(plain(p))})" for known, group in (("true", FORMS), ("false", LOOSE)) for i, (k, p) in enumerate(group))
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    short = lambda x: f"case when length({x}) between 1 and {LONGEST} then translate({x}, '{UPPER}123456789', '{LOWER}000000000') end"
    rounds = ""
    for k in range(ROUNDS):
        rounds += f"""
patterns{k} as materialized (select kind, side, cue, least(1000, sum(n * score)::bigint * count_if(score >= {INSTANCE}) // (max(total) * (count_if(score >= {INSTANCE}) + 2))) worth
    from graph{k} group by all having count_if(score >= {INSTANCE}) >= {SEEDS}),
best{k} as (select kind, value, coalesce(max(worth) filter (side = 'b'), 0) b, coalesce(max(worth) filter (side = 'a'), 0) a
    from graph{k} join patterns{k} using (kind, side, cue) where worth >= {PATTERN} group by all),
graph{k + 1} as materialized (select g.* exclude (score), case when known then 1000 else coalesce(1000 - (1000 - b) * (1000 - a) // 1000, 0) end score from graph{k} g left join best{k} using (kind, value)),"""
    return f"""with texts as materialized (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
forms(form, kind, known, pattern) as (values {forms}),
split as (select r, form, kind, known, string_split_regex(t, pattern) gaps, regexp_extract_all(t, pattern) hits from texts, forms),
each as (select r, form, kind, known, gaps, unnest(hits) hit, generate_subscripts(hits, 1) i from split where len(hits) > 0),
placed as (select *, sum(length(gaps[i]) + length(hit)) over (partition by r, form, known order by i) "end" from each),
checked as (select r, kind, known, form, "end" - length(hit) start, "end", hit, {digit} d, gaps[i] gap, gaps[i + 1] then_ from placed),
valid as materialized (select *, rtrim(regexp_extract(right(gap, {REACH}), {text(BEFORE)}), {blanks}) bw, regexp_extract(left(then_, {REACH}), {text(AFTER)}, 1) aw from checked where case
    when known and kind = 1 then len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 or length(ltrim(p, '0')) = 3 and ltrim(p, '0') > '255')) = 0
    when known and kind = 2 then length(d) between 13 and 19 and {luhn}
    when known and kind = 3 then length(d) between 9 and 15
    when kind = 2 and not known then length(d) between 12 and 19
    when kind = 3 and not known then length(d) between 7 and 15
    when not known then length(hit) between 5 and 320 else true end),
spans as materialized (select r, kind, known, start, "end", translate(hit, '{UPPER}', '{LOWER}') as value, {short("bw")} "before", {short("aw")} "after" from valid v
    where known or not exists (select 1 from valid b where b.known and b.r = v.r and b.start < v."end" and v.start < b."end")),
edges as (select kind, value, side, cue, bool_or(known) known, count(*) n from (
    select kind, value, known, 'b' side, "before" cue from spans union all select kind, value, known, 'a', "after" from spans) where cue is not null group by kind, value, side, cue),
words as (select unnest(regexp_extract_all(translate(t, '{UPPER}123456789', '{LOWER}000000000'), {text(plain(WORD))})) cue from texts),
totals as (select cue, count(*) total from words where length(cue) <= {LONGEST} group by cue),
cues as (select kind, side, cue, total from (select kind, side, cue, count_if(known) seeds, sum(n) filled from edges group by all) join totals using (cue)
    where seeds >= {SEEDS} and filled * 1000 >= total * {PATTERN}),
graph0 as materialized (select e.*, total, case when known then 1000 else 0 end score from edges e join cues using (kind, side, cue)),{rounds}
trusted as (select distinct kind, value from graph{ROUNDS} where score >= {INSTANCE} and not known),
kept as (select r, kind, known, start, "end" from spans where known
    union all select distinct r, kind, known, start, "end" from spans join trusted using (kind, value) where not known),
named as (select r, kind, known, start, "end", ['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || "end" span from kept),
sums as (select r, count_if(known and kind = 0) n_email, count_if(known and kind = 1) n_ip, count_if(known and kind = 2) n_card, count_if(known and kind = 3) n_phone, count_if(not known) n_added,
    string_agg(span, ',' order by kind, start, "end") filter (known) base, string_agg(span, ',' order by kind, start, "end") spans from named group by r)
select doc_id, coalesce(n_email, 0)::bigint n_email, coalesce(n_ip, 0)::bigint n_ip, coalesce(n_card, 0)::bigint n_card, coalesce(n_phone, 0)::bigint n_phone,
    sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_added, 0)::bigint n_added from texts left join sums using (r)"""
