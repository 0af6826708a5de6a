"""Invariants of merges and streams."""

import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobgrain.operators import audit as A
from jobgrain.operators import drift as D
from jobgrain.operators import merge as M
from jobgrain.operators import search as S
from jobgrain.operators import sources as O
from jobgrain.operators.extract import shape_paths
from jobgrain.plans import merge_plans, streaming_plans
from jobgrain.sources.storage import Version, VersionedTables
from jobgrain.sources.views import incoming, posting_cache
from jobgrain.streaming import jobs


def as_set(df):
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


def test_a_batch_applied_twice_changes_nothing_more(spark, small):
    batch = incoming(spark, small)
    once = M.upsert(merge_plans.snapshot(spark, small), batch).drop("change")
    assert as_set(M.upsert(once, batch).drop("change")) == as_set(once)


def test_two_batches_equal_their_union(spark, small):
    batch = incoming(spark, small)
    cut = batch.agg(F.percentile_approx("seen_epoch", 0.5)).first()[0]
    start = merge_plans.snapshot(spark, small)
    one = M.upsert(start, batch).drop("change")
    two = M.upsert(M.upsert(start, batch.where(F.col("seen_epoch") <= cut)).drop("change"), batch.where(F.col("seen_epoch") > cut)).drop("change")
    assert as_set(one) == as_set(two)


def test_state_merge_and_backoff(spark):
    now = spark.createDataFrame([("a", True), ("b", False)], "k string, applied boolean")
    new = spark.createDataFrame([("b", True), ("c", None)], "k string, applied boolean")
    assert as_set(M.merge_state(now, new, "k", ["applied"])) == {(True, "a"), (True, "b"), (None, "c")}
    rows = spark.createDataFrame([(0,), (1,), (2,), (40,)], "n int").select(M.next_sync_epoch(F.lit(0), F.col("n"), 3600, F.lit("x")).alias("t"))
    t = [r.t for r in rows.collect()]
    assert 3600 <= t[0] <= 3960 and 900 <= t[1] <= 990 and 1800 <= t[2] <= 1980 and 7 * 86400 <= t[3] <= 7.7 * 86400


def test_interval_join_equals_the_plain_one(spark):
    points = spark.range(500).select(F.col("id"), (F.col("id") * 997 % 90_000).alias("t"))
    spans = spark.createDataFrame([(1, 0, 50_000), (2, 40_000, 41_000), (3, 80_000, 80_000), (4, 10, 9)], "run int, s long, e long")
    got = {(r.id, r.run) for r in A.interval_join(points, "t", spans, "s", "e", bucket=7_000).collect()}
    want = {(p.id, s.run) for p in points.collect() for s in spans.collect() if s.s <= p.t <= s.e}
    assert got == want


def test_pages_do_not_overlap(spark, small):
    from jobgrain.sources.views import postings

    rows, order = postings(spark, small), S.order_of("last_seen")
    pages = [{r.canonical_url for r in S.ranked_page(rows, order, 20, k * 20).collect()} for k in range(3)]
    assert all(len(p) == 20 for p in pages) and len(set.union(*pages)) == 60


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def landed_files(spark, small, files):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    at = folder()
    day = F.to_unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    part = F.ntile(files).over(Window.orderBy(day, "l_orderkey", "l_linenumber"))  # a small fixture
    parts = lines.withColumn("part", part).persist()
    for i in range(files):
        parts.where(F.col("part") == i + 1).drop("part").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(at)
    return streaming_plans.landed(stream, spark, small), streaming_plans.landed(lines, spark, small)


def started(spark, small, buckets=8):
    tables = VersionedTables(spark, folder(), buckets)
    cache = posting_cache(spark, small).where("posting_no % 2 = 0").withColumn("remote_type", F.lit(""))
    jobs.start_tables(tables, merge_plans.snapshot(spark, small), cache)
    return tables


def contents(tables):
    return {t: as_set(tables.read(t)) for t in ("postings", "posting_cache", "rejections")}


def test_streamed_merges_equal_one_batch(spark, small):
    stream, all_ = landed_files(spark, small, 3)
    tables, once = started(spark, small), started(spark, small)
    start = tables.read("postings", -1)
    jobs.run_batches(stream, jobs.ingest_sink(tables), folder())
    jobs.ingest_sink(once)(all_, 0)
    assert tables.batches() == [-1, 0, 1, 2]
    assert contents(tables) == contents(once)
    assert as_set(tables.read("postings")) == as_set(M.upsert(start, jobs.normalised(all_)).drop("change"))


@pytest.mark.parametrize("broken", ["rejections", "commit"])
def test_a_batch_that_failed_half_way_is_run_again(spark, small, monkeypatch, broken):
    stream, all_ = landed_files(spark, small, 2)
    tables, whole = started(spark, small), started(spark, small)
    jobs.run_batches(stream, jobs.ingest_sink(whole), folder())
    state, before, failed = folder(), contents_of_start(tables), []

    def once(name, call):
        def run(self, *args):
            if not failed and broken in (name, *(x for x in args if isinstance(x, str))) and self is tables:
                failed.append(1)
                raise OSError("executor lost")
            return call(self, *args)

        monkeypatch.setattr(VersionedTables, name, run)

    for name in ("write_buckets", "append", "commit"):
        once(name, getattr(VersionedTables, name))
    with pytest.raises(Exception, match="executor lost"):
        jobs.run_batches(stream, jobs.ingest_sink(tables), state)
    assert failed and tables.batches() == [-1] and contents_of_start(tables) == before
    jobs.run_batches(stream, jobs.ingest_sink(tables), state)
    assert contents(tables) == contents(whole)
    jobs.ingest_sink(tables)(all_, 1)  # a batch that is there is not applied twice
    assert contents(tables) == contents(whole)
    assert tables.vacuum(keep=1) > 0 and contents(tables) == contents(whole)


def contents_of_start(tables):
    return {t: as_set(tables.read(t)) for t in ("postings", "posting_cache")}


def test_only_touched_buckets_are_rewritten(spark, small):
    tables = started(spark, small, buckets=32)
    one = streaming_plans.landed(spark.read.parquet(f"{small}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(1), spark, small)
    jobs.ingest_sink(tables)(one, 0)
    old, new = tables.version(-1).buckets, tables.version(0).buckets
    for t in ("postings", "posting_cache"):
        assert sum(old[t].get(b) != p for b, p in new[t].items()) == 1
        assert len(new[t]) >= len(old[t])
    assert tables.read("postings", -1).count() <= tables.read("postings").count() <= tables.read("postings", -1).count() + 1


def test_stream_keeps_first_sightings(spark):
    landed = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.range(60).select(F.concat(F.lit("u"), (F.col("id") % 20).cast("string")).alias("canonical_url"), F.timestamp_seconds(F.col("id") * 60).alias("seen_at"))
    rows.coalesce(1).write.mode("overwrite").parquet(landed)
    stream = jobs.first_sightings(spark.readStream.schema(rows.schema).parquet(landed))
    assert jobs.run_to_table(stream, spark, "sightings").count() == 20


def test_rows_that_fail_the_gate_hide_and_emit_deletes(spark):
    now = spark.createDataFrame([("a", "A", False, 1, "city a"), ("b", "B", True, 1, "city b"), ("c", "C", False, 1, "city c")], "canonical_url string, company_name string, hidden boolean, last_seen_epoch long, city string")
    now = now.withColumns({"remote_type": F.lit("unknown"), "first_seen_epoch": F.lit(1).cast("long")})
    rows = [("a", "bad", 5, 1, False), ("b", "B2", 5, 1, True), ("d", "bad", 5, 1, False), ("e", "E", 5, 1, True), ("e", "bad", 6, 2, False)]
    batch = spark.createDataFrame(rows, "canonical_url string, company_name string, seen_epoch long, arrival long, accepted boolean").withColumn("remote_type", F.lit("remote"))
    merged = M.upsert(now, batch)
    got = {r.canonical_url: (r.company_name, r.hidden, r.city, r.change) for r in merged.collect()}
    assert got == {"a": ("A", True, "city a", "hidden"), "b": ("B2", False, "city b", "unhidden"), "c": ("C", False, "city c", "untouched"), "e": ("E", True, None, "new_hidden")}
    assert {tuple(r) for r in M.outbox_of(merged).collect()} == {("a", "delete"), ("b", "upsert")}


SHAPES = "ats_key string, parser_version string, observed_epoch long, ident long, shape_paths array<string>, payload string"
JOBS, MORE = ["jobs:array", "jobs[]:object", "jobs[].id:number", "jobs[].title:string"], ["jobs:array", "jobs[]:object", "jobs[].id:number", "jobs[].title:string", "page:number"]
NONE, ERROR, BY_URL = ["jobs:array", "jobs[]:empty"], ["error:string"], ["__detailHtmlByUrl:object", "__detailHtmlByUrl.https://a.b/c:string"]


def test_drift_machine(spark):
    rows = [
        ("a", NONE, "{}", "empty_no_jobs"), ("a", NONE, '{"total": 4}', "bootstrapped"), ("a", ERROR, "", "drift"), ("a", JOBS, "", "baseline_replaced"), ("a", MORE, "", "similar"), ("a", JOBS + BY_URL, "", "same_core"),
        ("a", NONE, '{"jobCount": "0"}', "empty_no_jobs"), ("a", [], "", "skipped"), ("a", ERROR, "", "drift"), ("b", ERROR, "", "bootstrapped"), ("b", NONE, "", "empty_no_jobs"), ("b", JOBS, "", "drift"),
    ]
    frame = spark.createDataFrame([(k, "v", 10 + i // 2, i, paths, payload) for i, (k, paths, payload, _) in enumerate(rows)], SHAPES)
    got = {r.ident: (r.outcome, r.similarity) for r in D.drift_outcomes(frame.repartition(5)).collect()}
    assert [got[i][0] for i in range(len(rows))] == [x[3] for x in rows]
    assert got[2] == ("drift", 0.0) and got[4] == ("similar", 0.8) and got[5][1] is None
    settled = D.drift_outcomes(frame, ignored=("error",), job_lists=()).where("ats_key = 'b'").orderBy("ident").collect()
    assert [r.outcome for r in settled] == ["bootstrapped", "empty_no_jobs", "drift"]
    assert D.drift_outcomes(frame.where("false")).collect() == []


def test_streamed_drift_equals_the_batch_whatever_the_order_of_arrival(spark):
    import random

    rng, landed = random.Random(3), folder()
    rows = [(rng.choice("ab"), "v", 1_000 + 600 * i + rng.randrange(500), i, rng.choice([JOBS, MORE, NONE, ERROR, JOBS + BY_URL]), rng.choice(["", '{"total": 2}'])) for i in range(120)]
    for k in range(4):
        part = rows[30 * k : 30 * k + 30]
        rng.shuffle(part)
        if k:
            part, late = part[3:], part[:3]
        spark.createDataFrame(part, SHAPES).coalesce(1).write.mode("append").parquet(landed)
        if k:  # rows that come a batch later, within the allowed time
            spark.createDataFrame(late, SHAPES).coalesce(1).write.mode("append").parquet(landed)
    spark.createDataFrame([("z", "v", 1_000_000, 999, JOBS, "")], SHAPES).coalesce(1).write.mode("append").parquet(landed)
    all_ = spark.read.schema(SHAPES).parquet(landed)
    stream = spark.readStream.schema(SHAPES).option("maxFilesPerTrigger", 1).parquet(landed).withColumn("observed_at", F.timestamp_seconds("observed_epoch"))
    got = as_set(jobs.run_to_table(jobs.shape_drift(stream, late="8 hours"), spark, "drift"))
    assert len(got) == 120 and got == as_set(D.drift_outcomes(all_).where("ats_key <> 'z'"))


def test_failed_operations_come_back_until_a_newer_one_cancels_them(spark):
    rows = [
        (0, 1, "u", "upsert"), (10, 2, "u", "failed"), (100, 3, "u", "failed"), (400, 4, "u", "failed"), (430, 5, "u", "delete"), (440, 6, "u", "failed"),
        (0, 7, "v", "failed"), (5, 8, "w", "upsert"), (6, 9, "w", "failed"), (66, 10, "w", "failed"), (100_000, 11, "z", "upsert"),
    ]
    landed = folder()
    frame = spark.createDataFrame(rows, "s long, id long, canonical_url string, operation string").withColumn("at", F.timestamp_seconds(F.col("s") + 1000)).drop("s")
    for part in (frame.where("id in (3, 1, 7, 9)"), frame.where("id in (2, 4, 5, 8)"), frame.where("id in (6, 10)"), frame.where("id = 11")):
        part.coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    got = sorted((*r[:4], r[4] - 1000) for r in jobs.run_to_table(jobs.deliveries(stream), spark, "deliveries").collect())
    assert got == [("u", 1, "upsert", 1, 0), ("u", 1, "upsert", 2, 70), ("u", 1, "upsert", 3, 220), ("u", 5, "delete", 1, 430), ("u", 5, "delete", 2, 500), ("w", 8, "upsert", 1, 5), ("w", 8, "upsert", 3, 186)]


def test_deliveries_change_the_index(spark):
    tables = VersionedTables(spark, folder(), 4)
    posts = spark.createDataFrame([("a", "A2"), ("b", "B"), ("c", "C")], "canonical_url string, title string")
    version = Version(-1)
    tables.write_buckets(posts, "postings", "canonical_url", version, range(4))
    tables.write_buckets(spark.createDataFrame([("a", "A"), ("b", "B"), ("x", "X")], posts.schema), "documents", "canonical_url", version, range(4))
    tables.commit(version)
    batch = spark.createDataFrame([("a", 1, "delete"), ("a", 2, "upsert"), ("b", 3, "delete"), ("c", 4, "upsert"), ("gone", 5, "upsert")], "canonical_url string, id long, operation string")
    for _ in range(2):
        jobs.index_sink(tables)(batch, 0)
    assert as_set(tables.read("documents")) == {("a", "A2"), ("c", "C"), ("x", "X")}


def test_intents_of_queries_without_names(spark):
    from jobgrain.operators.intent import token_groups, understand

    assert understand("").cleaned == "" and understand(None).groups == ()
    assert understand("(senior [dev").cleaned == "(senior [dev"
    assert token_groups("jobs") == (("jobs",),) and token_groups("software jobs") == (("software",),)


def test_tenants_are_skipped_where_the_sum_would_break_a_guard(spark):
    """Each of 2 000 tenants passes alone, as percentages are rounded; together only six do."""
    whole = spark.createDataFrame([("a", 1_000_000, 200_000, 0)], "ats_key string, visible long, missing long, weak long")
    rows = [("a", f"t{i:04d}", 10, 10, 0, 0) for i in range(2000)] + [("a", "clean", 10, 0, 0, 0), ("a", "tiny", 9, 0, 0, 0)]
    tenants = spark.createDataFrame(rows, "ats_key string, tenant string, gain long, missing long, weak long, no_place long")
    projected = O.project(whole, tenants)
    assert projected.where(F.size("fails") == 0).count() == 2002
    got = [tuple(r) for r in O.safe_tenants(projected).orderBy("before").select("tenant", "before").collect()]
    assert got == [("clean", 0), *((f"t{i:04d}", 10 + 10 * i) for i in range(6)), ("tiny", 70)]
    assert [tuple(r) for r in O.safe_batches(projected, (20, 10000)).orderBy("stage").collect()] == [("a", 20, 2, 20, 10, 0, True), ("a", 10000, 8, 79, 60, 0, False)]


def test_events_are_appended_once(spark):
    tables = VersionedTables(spark, folder())
    columns = ["event_id", "type", "query", "result_count", "countries", "country", "language", "session", "referrer", "agent"]
    row = lambda i, q: (i, "postings", q, "3", "", "", "", "", "", "")
    first, second = (spark.createDataFrame([row(*r) for r in rows], columns) for rows in ([(1, "a"), (1, "b"), (2, "c")], [(3, "d")]))
    sink = jobs.event_sink(tables)
    for batch, epoch in ((first, 0), (first, 0), (second, 1), (second, 1)):
        sink(batch, epoch)
    assert sorted((r.event_id, r.query) for r in tables.read("events").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_waiting_observations_share_their_facts(spark, tmp_path):
    """The state grows by a few bytes an observation, not by the paths of its shape."""
    wide = [f"field_{i}.of_a_wide_payload:string" for i in range(100)]
    rows = spark.range(4000).select(F.lit("a").alias("ats_key"), F.lit("v1").alias("parser_version"), "id", F.lit("{}").alias("payload"), F.array(*map(F.lit, wide)).alias("shape_paths"))
    rows.select("*", F.timestamp_seconds(F.col("id") + 10**9).alias("observed_at"), F.col("id").alias("ident")).drop("id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    run = jobs.shape_drift(stream, late="8 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(s["memoryUsedBytes"] for p in run.recentProgress for s in p["stateOperators"]) < 2_000_000


def test_newest_drift_reads_each_payload_once(spark):
    frame = spark.createDataFrame([("a", "v1", 1, 1, "{}"), ("a", "v1", 2, 2, '{"x": 1}')], "ats_key string, parser_version string, observed_epoch long, ident long, payload string")
    newest = D.newest_drift(frame.withColumn("shape_paths", shape_paths(F.col("payload"))))
    assert newest._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_rows_of_a_url_meet_before_they_are_folded(spark, small):
    """What is shuffled are rows, not their sums with a copy of the arrival each."""
    plan = M.fold_batch(incoming(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") < plan.index("Exchange hashpartitioning(canonical_url")


def test_ingest_brings_the_rows_of_a_url_together_once(spark, small, monkeypatch):
    """Snapshot and cache are made from rows that are dealt by URL already."""
    seen = []

    class Tables:
        batches, next, touched, read = lambda s: [], lambda s, n: None, lambda s, *a: [], lambda s, *a, **k: None

    def upsert(current, rows, gathered=False):
        seen.append((gathered, rows._jdf.queryExecution().logical().toString()))
        raise InterruptedError

    monkeypatch.setattr(jobs, "upsert", upsert)
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    with pytest.raises(InterruptedError):
        jobs.ingest_sink(Tables())(streaming_plans.landed(lines, spark, small), 0)
    assert seen[0][0] and "RepartitionByExpression" in seen[0][1].split("\n")[0]


def test_observations_travel_packed(spark, tmp_path):
    """Observations of a parser that share their facts reach its state in one row of a batch, and each is judged."""
    rows = spark.range(4000).select(F.lit("a").alias("ats_key"), F.lit("v1").alias("parser_version"), "id", F.lit("{}").alias("payload"), F.array(F.lit("a:string")).alias("shape_paths"))
    rows.select("*", F.timestamp_seconds(F.col("id") * 60).alias("observed_at"), F.col("id").alias("ident")).drop("id").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = shuffled()
    run = jobs.shape_drift(stream, late="8 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 100
    got = spark.read.parquet(f"{tmp_path}/out")
    assert [tuple(r) for r in got.orderBy("ident").select("ident", "observed_epoch").collect()] == [(i, 60 * i) for i in range(4000 - 480)]


def test_observations_older_than_those_judged_are_passed_over(spark, tmp_path):
    """Together with a newer one, too."""
    for n, rows in enumerate([[(100_000, 1), (200_000, 2)], [(300_000, 3)], [(50_000, 4), (400_000, 5)], [(900_000, 6)]]):
        frame = spark.createDataFrame([("a", "v1", t, i, JOBS, "") for t, i in rows], SHAPES).coalesce(1)
        frame.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SHAPES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("observed_at", F.timestamp_seconds("observed_epoch"))
    got = jobs.run_to_table(jobs.shape_drift(stream, late="8 hours"), spark, "drift")
    assert sorted((r.ident, r.outcome) for r in got.collect()) == [(1, "bootstrapped"), (2, "same_core"), (3, "same_core"), (5, "same_core")]
