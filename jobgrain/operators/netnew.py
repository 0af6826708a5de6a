"""Which rows of a batch are new: matches with known postings on several keys, and among the batch by order of arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.functions.text import canonical_url, is_blank, is_blank_like, lowered, stored_remote_type, trimmed
from jobgrain.sources.storage import written

#: Fields that a candidate can fill in a posting that lacks them.
FILLED = ("country", "region", "city", "location_text", "source_job_id")
#: Classes of candidates.
CLASSES = ("batch_source_id", "batch_url", "reactivation", "update", "same_source_id", "same_url", "same_normalized_url", "net_new")
#: What postings of a key say, as bits: there is one, one is shown, one is hidden; above them which fields a shown one lacks. Standard URLs have theirs above those of plain ones.
MATCHED, SHOWN, HIDDEN, LACKS, STANDARD = 1, 2, 4, 3, 9
#: What is said of a candidate, as bits beside those three: it fills a field, it is shown by its source id or its URL, one before it in the batch has its source id or a URL of it.
FILLS, BY_ID, BY_URL, BATCH_ID, BATCH_URL = 8, 16, 32, 64, 128


def _source_id() -> Column:
    return F.when(~is_blank(F.col("source_job_id")), F.concat_ws("|", lowered(F.col("ats_key")), trimmed(F.col("source_job_id"))))


def _fields() -> list[Column]:
    """Whether a row has each of the fields that one can fill in another."""
    return [*(~is_blank_like(F.col(c)) for c in FILLED), stored_remote_type(F.col("remote_type")) != "unknown"]


def _bits(flags: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, (F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(flags)))


def _any(bits: Column, mask: int | Column) -> Column:
    return bits.bitwiseAND(mask) != 0


def _with_keys(rows: DataFrame, *keep: Column) -> DataFrame:
    """(keep..., ids, plain, standard): the keys of rows as arrays; a letter in front tells the kind."""
    urls = [trimmed(F.col(c)) for c in ("canonical_url", "apply_url")]
    several = lambda letter, ks: F.transform(F.array_distinct(F.array_compact(F.array(*[F.when(k != "", k) for k in ks]))), lambda k: F.concat(F.lit(letter), k))
    return rows.select(*keep, several("i", [_source_id()]).alias("ids"), several("u", urls).alias("plain"), several("u", [canonical_url(u) for u in urls]).alias("standard"))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds ``number``, which grows in the order named, to rows that lie in ranges of it."""
    return rows.sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())


def known_keys(existing: DataFrame) -> DataFrame:
    """(key, facts) of known postings, summed up by key: that is all that the rules ask, so a key that thousands of postings share costs one row."""
    lacks = _bits([~x for x in _fields()])
    facts = F.lit(MATCHED).bitwiseOR(F.when(~F.col("hidden"), F.lit(SHOWN).bitwiseOR(F.shiftleft(lacks, LACKS))).when(F.col("hidden"), HIDDEN).otherwise(0))
    rows = _with_keys(existing, facts.alias("facts"))
    said = lambda ks, by: F.transform(ks, lambda k: F.struct(k.alias("key"), F.shiftleft("facts", by).alias("facts")))
    rows = rows.select(F.explode(F.concat(said("ids", 0), said("plain", 0), said("standard", STANDARD))).alias("k")).select("k.*")
    return rows.groupBy("key").agg(F.bit_or("facts").alias("facts"))


def asked_keys(candidates: DataFrame) -> DataFrame:
    """(key, at, asks) of numbered candidates: ``at`` is eight times the number and the place of the key among the candidate's, 0 for a source id;
    ``asks`` are the fields that the candidate has and, above them, whether it asks for a standard URL. A candidate without keys has one that is its own."""
    rows = _with_keys(candidates, "number", _bits(_fields()).alias("has"))
    one = lambda k, place, standard: F.struct(k.alias("key"), place.alias("place"), standard.alias("standard"))
    urls = F.transform(F.array_union("plain", "standard"), lambda k, i: one(k, i + 1, F.array_contains("standard", k)))
    keys = F.concat(F.transform("ids", lambda k: one(k, F.lit(0), F.lit(False))), urls)
    alone = F.array(one(F.concat(F.lit("n"), F.col("number").cast("string")), F.lit(1), F.lit(False)))
    rows = rows.select("number", "has", F.explode(F.when(F.size(keys) > 0, keys).otherwise(alone)).alias("k"))
    asks = F.col("has").bitwiseOR(F.when(F.col("k.standard"), F.lit(1 << len(_fields()))).otherwise(F.lit(0)))
    return rows.select("k.key", (F.col("number") * 8 + F.col("k.place")).alias("at"), asks.alias("asks"))


def held_keys(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(number, key, said) of numbered candidates: the keys that another candidate has too, each as the ``at`` of its first holder (null for others, of which at
    least one row of a candidate is kept), and what known postings say of the candidate."""
    fields = (1 << len(_fields())) - 1
    facts, asks, ident = F.coalesce("facts", F.lit(0)), F.col("asks"), F.col("at") % 8 == 0
    plain = facts.bitwiseAND((1 << STANDARD) - 1)
    both = plain.bitwiseOR(F.when(_any(asks, fields + 1), F.shiftright(facts, STANDARD)).otherwise(F.lit(0)))
    said = both.bitwiseAND(MATCHED | SHOWN | HIDDEN)
    said = said.bitwiseOR(F.when(_any(F.shiftright(both, LACKS), asks.bitwiseAND(fields)), F.lit(FILLS)).otherwise(F.lit(0)))
    said = said.bitwiseOR(F.when(_any(plain, SHOWN), F.when(ident, F.lit(BY_ID)).otherwise(F.lit(BY_URL))).otherwise(F.lit(0)))
    holders = Window.partitionBy("key")
    rows = asked_keys(candidates).join(known_keys(existing), "key", "left").select("at", said.alias("said"), F.min("at").over(holders).alias("first"), (F.count("*").over(holders) > 1).alias("shared"))
    rows = rows.where("shared or said <> 0 or at % 8 < 2").select(F.shiftright("at", 3).alias("number"), F.when(F.col("shared"), F.col("first")).alias("key"), "said")
    return rows.withColumn("said", F.bit_or("said").over(Window.partitionBy("number")))


def entering(held: DataFrame) -> DataFrame:
    """Of (number, key) the rows of the candidates that enter if they come one by one in the order of their numbers and one enters that shares no key with any that
    entered before it.

    In each round those enter that come first for all their keys, and those that share a key with them leave; the rest go on. Rounds end when none is left: a few,
    unless candidates block each other in long chains.
    """
    rest, rounds = held.select("number", "key"), []
    of_key, of_number = Window.partitionBy("key"), Window.partitionBy("number")
    while not rounds or not rest.isEmpty():
        rows = rest.withColumn("first", F.min("number").over(of_key) == F.col("number")).select("number", "key", F.bool_and("first").over(of_number).alias("enters"))
        rows = rows.withColumn("taken", F.bool_or("enters").over(of_key))
        rows = written(rows.select("number", "key", "enters", F.bool_or("taken").over(of_number).alias("settled")), "round", free=True)
        rounds.append(rows.where("enters").select("number", "key"))
        rest = rows.where("not settled").select("number", "key")
    return reduce(DataFrame.union, rounds)


def first_come(keys: DataFrame) -> DataFrame:
    """Of (candidate_id, arrival, kind, key) the candidates that enter if they come one by one and one enters that shares no key with any before it."""
    rows = keys.select(F.struct("arrival", "candidate_id").alias("number"), F.struct("kind", "key").alias("key"))
    return entering(rows).select("number.candidate_id").distinct()


def said_of(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(number, said) of candidates with a ``number`` of their own that grows by arrival. Candidates are read once."""
    held = written(held_keys(candidates, existing), "held", free=True)
    entered = entering(held.where("said = 0 and key is not null"))
    # the first of all holders of a key has none before it
    others = held.where("key is not null and number <> shiftright(key, 3)").select("number", "key")
    later = others.join(entered.select("key", F.col("number").alias("by")), "key").where("by < number")
    later = later.select("number", F.when(F.col("key") % 8 == 0, F.lit(BATCH_ID)).otherwise(F.lit(BATCH_URL)).alias("said"))
    said = held.select("number", "said").union(later).groupBy("number").agg(F.bit_or("said").alias("said"))
    return written(said, "said", free=True)


def with_classes(candidates: DataFrame, said: DataFrame) -> DataFrame:
    """Numbered candidates of which something is said, with their ``class``; the number goes."""
    what = F.col("said")
    verdict = F.when(_any(what, BATCH_ID), "batch_source_id").when(_any(what, BATCH_URL), "batch_url").when(_any(what, HIDDEN) & ~_any(what, SHOWN), "reactivation")
    verdict = verdict.when(_any(what, FILLS), "update").when(_any(what, BY_ID), "same_source_id").when(_any(what, BY_URL), "same_url").when(_any(what, MATCHED), "same_normalized_url")
    return candidates.join(said, "number").withColumn("class", verdict.otherwise("net_new")).drop("number", "said")


def classify_candidates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (candidate_id, arrival, ats_key, canonical_url, apply_url, source_job_id, country, region, city, location_text, remote_type, and more) with their
    class, the first that holds:

    batch_source_id, batch_url: a net-new candidate before it has the same source id or one of its URLs; reactivation: only hidden postings match; update: it fills
    a field that a shown match lacks; same_source_id, same_url (canonical or apply URL), same_normalized_url: shown already; net_new.

    Inside, a candidate goes by its number in the order of arrival and a shared key by that of its first holder.
    """
    candidates = written(candidates, "candidates", free=True)  # made once: sorting samples its rows
    order = ("arrival", "candidate_id")
    candidates = written(numbered(candidates.repartitionByRange(*order), *order), "numbered", free=True)
    return with_classes(candidates, said_of(candidates, existing))


def risks() -> dict[str, Column]:
    """What a posting lacks."""
    no = {c: is_blank_like(F.col(c)) for c in ("country", "region", "city")}
    weak = stored_remote_type(F.col("remote_type")) == "unknown"
    every = no["country"] & no["region"] & no["city"]
    return {**{f"no_{c}": x for c, x in no.items()}, "any_gap": no["country"] | no["region"] | no["city"], "no_place": every, "weak_remote": weak, "no_place_weak_remote": every & weak}


def tenant_summary(classified: DataFrame, tenant: str = "company_name") -> DataFrame:
    """Per source and tenant: candidates by class, and what the net-new ones lack."""
    new = F.col("class") == "net_new"
    return classified.groupBy("ats_key", F.col(tenant).alias("tenant")).agg(
        F.count("*").alias("candidates"), *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES], *[F.count_if(new & x).alias(f"new_{n}") for n, x in risks().items()]
    )
