"""An inverted index of posting words, and typo-tolerant search that reads it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import search_text
from jobgrain.operators.extract import fuzzy_terms
from jobgrain.operators.intent import STOP_WORDS
from jobgrain.sources.storage import written

#: Fields with their weights; the words of a source's key must be spelled right.
FIELDS = {"position_name": 40, "company_name": 30, "location_text": 20, "city": 20, "country": 20, "region": 20, "ats_key": 10, "description_plain": 5}
EXACT_FIELDS = frozenset(("ats_key",))
#: Parts that the postings of a query are ranked in before they are ranked together.
PARTS = 64


def build_index(postings: DataFrame) -> DataFrame:
    """(term, canonical_url, weight, tolerant): each word of each visible posting with the weight of its best field; tolerant: a field that allows typos holds it.

    One row per word and posting, made where the posting is read, without a shuffle; searches bring the rows of a URL together, so a URL may stand in several postings.
    """
    fields = sorted((f for f in FIELDS if f in postings.columns), key=lambda f: -FIELDS[f])
    words = lambda f: F.array_remove(F.array_distinct(F.split(search_text(F.col(f)), " ")), "")
    each = postings.where("not hidden").select("canonical_url", *[words(f).alias(f) for f in fields])
    weight = lambda w: F.coalesce(*[F.when(F.array_contains(f, w), FIELDS[f]) for f in fields])
    tolerant = lambda w: reduce(or_, [F.array_contains(f, w) for f in fields if f not in EXACT_FIELDS], F.lit(False))
    items = F.transform(F.array_distinct(F.concat(*fields)), lambda w: F.struct(w.alias("term"), weight(w).alias("weight"), tolerant(w).alias("tolerant")))
    return each.select("canonical_url", F.explode(items).alias("i")).select("i.term", "canonical_url", "i.weight", "i.tolerant")


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word) of queries (query_id, text): stop words are left out unless nothing else is there."""
    every = queries.select("query_id", F.array_remove(F.array_distinct(F.split(search_text(F.col("text")), " ")), "").alias("w"))
    stop = F.array(*map(F.lit, sorted(STOP_WORDS)))
    said = F.array_except("w", stop)
    return every.select("query_id", F.explode(F.when(F.size(said) > 0, said).otherwise(F.col("w"))).alias("word"))


def typo_search(queries: DataFrame, index: DataFrame, limit: int = 20) -> DataFrame:
    """Postings in which every word of a query stands, or one within one edit (from four letters on) or two (from eight): (query_id, position, canonical_url, typos, weight).

    Fewest edits first, then the greatest sum of field weights, then the URL; ``limit`` of each query. Query words meet the vocabulary by the words that deletions leave, and only
    the rows of the terms found move, once, to their URL. There the query's rarest word leads to the query, and its other words are looked up among the URL's hits. The postings of a
    query are ranked in parts, and the best of the parts together, so no task ranks all that a frequent word matches. Small tables are written, so that Spark joins by their size.
    """
    words = written(query_words(queries).distinct(), "query-words")
    vocabulary = written(index.groupBy("term").agg(F.count("*").alias("n"), F.bool_or("tolerant").alias("tolerant")), "vocabulary")
    asked = words.select(F.col("word").alias("term")).distinct()
    stop = F.col("query").isin(*sorted(STOP_WORDS))
    near = fuzzy_terms(vocabulary.where("tolerant").select("term"), asked).where(~stop | (F.col("distance") == 0)).select(F.col("query").alias("word"), F.col("word").alias("term"), F.col("distance").cast("int").alias("edits"))
    exact = asked.select(F.col("term").alias("word"), "term", F.lit(0).alias("edits"))
    terms = written(exact.union(near.where("edits > 0")).join(vocabulary.select("term", "n"), "term"), "terms")
    frequency = terms.groupBy("word").agg(F.sum("n").alias("n"))
    led = words.join(frequency, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("lead"), F.collect_list("word").alias("words"))
    led = written(led, "led-queries")
    hits = index.join(terms.drop("n"), "term").repartition("canonical_url")
    hits = hits.groupBy("canonical_url", "word", "term", "edits").agg(F.max("weight").alias("weight"), F.bool_or("tolerant").alias("tolerant")).where("tolerant or edits = 0")
    found = hits.groupBy("canonical_url").agg(F.collect_list(F.struct("word", F.struct("edits", (-F.col("weight")).alias("less")).alias("b"))).alias("hits"))
    found = found.withColumn("lead", F.explode(F.array_distinct("hits.word"))).join(led, "lead").where(F.size(F.array_except("words", "hits.word")) == 0)
    best = found.select("query_id", "canonical_url", F.transform("words", lambda w: F.array_min(F.filter("hits", lambda h: h["word"] == w)["b"])).alias("best"))
    total = lambda c: F.aggregate(F.col("best")[c], F.lit(0), lambda a, x: a + x)
    both = best.select("query_id", "canonical_url", total("edits").alias("typos"), (-total("less")).alias("weight"))
    rows = both.withColumn("part", F.pmod(F.xxhash64("canonical_url"), F.lit(PARTS)))
    order = [F.asc("typos"), F.desc("weight"), F.asc("canonical_url")]
    some = rows.withColumn("position", F.row_number().over(W.partitionBy("query_id", "part").orderBy(*order))).where(F.col("position") <= limit)
    top = some.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= limit)
    return top.select("query_id", "position", "canonical_url", F.col("typos").cast("long"), F.col("weight").cast("long"))
