"""Payload drift, in batch and as a stream over the same payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.operators import drift as D
from jobgrain.operators.extract import shape_paths
from jobgrain.plans.registry import query
from jobgrain.sources.views import epoch, table
from jobgrain.streaming import jobs


def observations(orders: DataFrame, spark, sf_dir) -> DataFrame:
    """A payload for each order: a list of jobs, the same with further fields or with pages by address, an empty list with and without a count, an error."""
    k = F.col("o_orderkey") % 8
    company, place = F.struct(F.col("c_name").alias("name")).alias("company"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).alias("place")
    jobs_ = F.array(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("id"))).alias("jobs")
    none = F.array().cast("array<string>").alias("jobs")
    by_url = F.create_map(F.concat(F.lit("https://jobs.example/p/"), F.col("o_orderkey").cast("string")), F.lit("<p>")).alias("__detailHtmlByUrl")
    body = (
        F.when(k < 3, F.to_json(F.struct(company, jobs_, place))).when(k == 3, F.to_json(F.struct(company, jobs_, place, F.lit(1).alias("page"), F.col("o_totalprice").alias("size"))))
        .when(k == 4, F.to_json(F.struct(company, none, place))).when(k == 5, F.to_json(F.struct(company, none, place, F.col("c_custkey").alias("total"))))
        .when(k == 6, F.to_json(F.struct(company, F.struct(F.col("c_custkey").alias("code")).alias("error")))).otherwise(F.to_json(F.struct(company, jobs_, place, by_url)))
    )
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(
        F.lower("c_mktsegment").alias("ats_key"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("parser_version"), epoch("o_orderdate").alias("observed_epoch"),
        F.col("o_orderkey").alias("ident"), body.alias("payload"),
    )
    return rows.withColumn("shape_paths", shape_paths(F.col("payload"))).withColumn("observed_at", F.timestamp_seconds("observed_epoch"))


_OBSERVED = """
j AS (SELECT lower(c_mktsegment) AS ats_key, 'v' || (o_orderkey % 3) AS parser_version, CAST(epoch(o_orderdate) AS BIGINT) AS observed_epoch, o_orderkey AS ident, CASE
    WHEN o_orderkey % 8 < 3 THEN json_object('company', json_object('name', c_name), 'jobs', json_array(json_object('title', o_orderpriority, 'id', o_orderkey)), 'place', json_object('segment', c_mktsegment, 'priority', o_orderpriority))
    WHEN o_orderkey % 8 = 3 THEN json_object('company', json_object('name', c_name), 'jobs', json_array(json_object('title', o_orderpriority, 'id', o_orderkey)), 'place', json_object('segment', c_mktsegment, 'priority', o_orderpriority), 'page', 1, 'size', o_totalprice)
    WHEN o_orderkey % 8 = 4 THEN json_object('company', json_object('name', c_name), 'jobs', json_array(), 'place', json_object('segment', c_mktsegment, 'priority', o_orderpriority))
    WHEN o_orderkey % 8 = 5 THEN json_object('company', json_object('name', c_name), 'jobs', json_array(), 'place', json_object('segment', c_mktsegment, 'priority', o_orderpriority), 'total', c_custkey)
    WHEN o_orderkey % 8 = 6 THEN json_object('company', json_object('name', c_name), 'error', json_object('code', c_custkey))
    ELSE json_object('company', json_object('name', c_name), 'jobs', json_array(json_object('title', o_orderpriority, 'id', o_orderkey)), 'place', json_object('segment', c_mktsegment, 'priority', o_orderpriority),
      '__detailHtmlByUrl', json_object('https://jobs.example/p/' || o_orderkey, '<p>')) END AS payload FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT ident, replace(replace(substr(t.fullkey, 3), '"', ''), '[0]', '[]') AS stem, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
    t.type = 'ARRAY' AND json_array_length(j.payload, t.fullkey) = 0 AS is_empty FROM j, json_tree(j.payload) t WHERE t.fullkey <> '$' AND NOT regexp_matches(t.fullkey, '\\[[1-9]')),
p AS (SELECT DISTINCT ident, unnest(CASE WHEN is_empty THEN [stem || ':' || kind, stem || '[]:empty'] ELSE [stem || ':' || kind] END) AS path FROM n),
s AS MATERIALIZED (SELECT ident, list_sort(list(path)) AS paths FROM p GROUP BY 1),
x AS (SELECT ident, list_filter(paths, lambda p: NOT starts_with(p, '__detailHtmlByUrl')) AS core, list_transform(list_filter(paths, lambda p: ends_with(p, '[]:empty')), lambda p: left(p, -8)) AS bare,
    list_transform(list_filter(paths, lambda p: regexp_matches(p, '\\[\\]:[^:]*$') AND NOT ends_with(p, '[]:empty')), lambda p: regexp_extract(p, '^(.*)\\[\\]:[^:]*$', 1)) AS filled FROM s),
g AS (SELECT j.*, core, bare, filled, len(bare) > 0 AND NOT regexp_matches(payload, '"total": ?[0-9.]*[1-9]') AS no_jobs FROM j JOIN x USING (ident)),
o AS MATERIALIZED (SELECT ats_key, parser_version, observed_epoch, ident, dense_rank() OVER (ORDER BY core, bare, filled, no_jobs) AS shape, row_number() OVER (PARTITION BY ats_key, parser_version ORDER BY observed_epoch, ident) AS i FROM g),
z AS MATERIALIZED (SELECT DISTINCT shape, core, bare, filled, no_jobs FROM g JOIN o USING (ident)),
r AS MATERIALIZED (SELECT a.shape AS base, b.shape, round(len(list_intersect(a.core, b.core)) / len(list_distinct(a.core || b.core)), 4) AS alike,
    CASE WHEN b.no_jobs THEN 'empty_no_jobs' WHEN list_has_any(b.filled, a.bare) THEN 'baseline_replaced' WHEN b.core = a.core THEN 'same_core' ELSE '' END AS what FROM z a, z b
  UNION ALL SELECT 0, shape, NULL, CASE WHEN no_jobs THEN 'empty_no_jobs' ELSE 'bootstrapped' END FROM z),
f AS (SELECT ats_key, parser_version, 0::BIGINT AS i, 0::BIGINT AS base, 0::BIGINT AS ident, 0::BIGINT AS observed_epoch, ''::VARCHAR AS outcome, NULL::DOUBLE AS similarity FROM o GROUP BY 1, 2
  UNION ALL
  SELECT f.ats_key, f.parser_version, o.i, CASE WHEN what IN ('bootstrapped', 'baseline_replaced') THEN o.shape ELSE f.base END, o.ident, o.observed_epoch, CASE WHEN what <> '' THEN what WHEN alike >= 0.55 THEN 'similar' ELSE 'drift' END, CASE WHEN what = '' THEN alike END
  FROM f JOIN o ON f.ats_key = o.ats_key AND f.parser_version = o.parser_version AND o.i = f.i + 1 JOIN r ON r.base = f.base AND r.shape = o.shape)"""
_COLUMNS = "ats_key, parser_version, observed_epoch, ident, outcome, similarity"


@query(f"WITH RECURSIVE {_OBSERVED} SELECT {_COLUMNS} FROM f WHERE i > 0")
def q11_t23_drift(spark, sf_dir):
    """Every payload against its parser's baseline, which moves with them."""
    return D.drift_outcomes(observations(table(spark, sf_dir, "orders"), spark, sf_dir))


@query(f"WITH RECURSIVE {_OBSERVED} SELECT {_COLUMNS} FROM f WHERE i > 0 AND observed_epoch <= (SELECT max(observed_epoch) - 7200 FROM j)")
def st6_shape_drift(spark, sf_dir):
    """ST6: the same outcomes from a stream, as far as the watermark has come."""
    orders = table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parquet*")
    return jobs.run_to_table(jobs.shape_drift(observations(stream, spark, sf_dir)), spark, "shapes")


@query(f"""
WITH RECURSIVE {_OBSERVED}, d AS (SELECT * FROM f WHERE outcome = 'drift' ORDER BY observed_epoch DESC, ident DESC LIMIT 100)
SELECT ats_key, parser_version, ident, observed_epoch, similarity, left(sha256(array_to_string(paths, chr(10))), 24) AS shape_hash FROM d JOIN s USING (ident)
""")
def s10_newest_drift(spark, sf_dir):
    """The newest drift events with their shapes' hashes."""
    return D.newest_drift(observations(table(spark, sf_dir, "orders"), spark, sf_dir))
