"""Net-new classes against candidates taken one by one."""

import random

from jobgrain.operators import netnew as N
from jobgrain.plans import netnew_plans

SCHEMA = "ats_key string, canonical_url string, apply_url string, source_job_id string, country string, region string, city string, location_text string, remote_type string"


def standard(url):
    return url.split("#")[0].replace("?utm_source=x", "")


def one_by_one(candidates, existing):
    filled = ("country", "region", "city", "location_text", "source_job_id")
    seen_ids, seen_urls, out = set(), set(), {}
    for c in sorted(candidates, key=lambda r: r["arrival"]):
        ident = (c["ats_key"], c["source_job_id"]) if c["source_job_id"] else None
        plain = [u for u in (c["canonical_url"], c["apply_url"]) if u]
        urls = {*plain, *map(standard, plain)}
        if ident in seen_ids:
            out[c["candidate_id"]] = "batch_source_id"
            continue
        if urls & seen_urls:
            out[c["candidate_id"]] = "batch_url"
            continue
        by = {"id": [], "url": [], "standard": []}
        for e in existing:
            theirs = [u for u in (e["canonical_url"], e["apply_url"]) if u]
            if ident and ident == (e["ats_key"], e["source_job_id"]):
                by["id"].append(e)
            if urls & {*theirs}:
                by["url"].append(e)
            if {standard(u) for u in urls} & {standard(u) for u in theirs}:
                by["standard"].append(e)
        all_ = [e for es in by.values() for e in es]
        shown = [e for e in all_ if not e["hidden"]]
        if all_ and not shown:
            verdict = "reactivation"
        elif any((c[f] and not e[f] for e in shown for f in filled)) or any(e["remote_type"] == "unknown" and c["remote_type"] != "unknown" for e in shown):
            verdict = "update"
        else:
            verdict = next((n for n, k in (("same_source_id", "id"), ("same_url", "url"), ("same_normalized_url", "standard")) if any(not e["hidden"] for e in by[k])), "net_new")
        out[c["candidate_id"]] = verdict
        if verdict == "net_new":
            seen_ids |= {ident} - {None}
            seen_urls |= urls
    return out


def test_classes_equal_candidates_taken_one_by_one(spark):
    rng = random.Random(8)

    def row(n, **more):
        url = rng.choice([f"https://a.b/{rng.randrange(n)}", f"https://a.b/{rng.randrange(n)}?utm_source=x"])
        place = {c: rng.choice(["", "x"]) for c in ("country", "region", "city", "location_text")}
        return {"ats_key": rng.choice("st"), "canonical_url": url, "apply_url": rng.choice(["", "", f"https://a.b/{rng.randrange(n)}"]), "source_job_id": rng.choice(["", "", f"j{rng.randrange(n)}"]), **place, "remote_type": rng.choice(["unknown", "remote"])} | more

    full = {"country": "x", "region": "x", "city": "x", "location_text": "x", "remote_type": "remote"}
    existing = [row(150, hidden=rng.random() < 0.5, **(full | {"source_job_id": f"j{i}"} if i % 3 else {})) for i in range(60)]
    candidates = [row(200, candidate_id=str(i), arrival=rng.randrange(10**9)) for i in range(400)]
    want = one_by_one(candidates, existing)
    assert set(want.values()) == set(N.CLASSES)
    left = spark.createDataFrame(candidates, f"{SCHEMA}, candidate_id string, arrival long")
    right = spark.createDataFrame(existing, f"{SCHEMA}, hidden boolean")
    got = {r.candidate_id: r["class"] for r in N.classify_candidates(left, right).collect()}
    assert got == want
    assert {r["class"] for r in N.classify_candidates(left, right.where("false")).collect()} == {"net_new", "batch_source_id", "batch_url"}
    assert N.classify_candidates(left.where("false"), right).collect() == []


def test_chains_of_shared_keys_are_followed(spark):
    """Each candidate shares a key with the next one: every second enters."""
    keys = [(i, i, "url", f"k{j}") for i in range(9) for j in (i, i + 1)]
    entered = N.first_come(spark.createDataFrame(keys, "candidate_id long, arrival long, kind string, key string"))
    assert sorted(r[0] for r in entered.collect()) == [0, 2, 4, 6, 8]


def test_query_has_all_classes(spark, small):
    got = N.classify_candidates(netnew_plans.candidates(spark, small), netnew_plans.existing(spark, small))
    assert {r["class"] for r in got.select("class").distinct().collect()} == set(N.CLASSES)


def test_candidates_are_made_once(spark):
    """What makes the candidates runs once, not again for their keys, their matches and the result."""
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    row = {"ats_key": "s", "canonical_url": "https://a.b/1", "apply_url": "", "source_job_id": "", "country": "", "region": "", "city": "", "location_text": "", "remote_type": "remote"}
    left = spark.createDataFrame([row | {"candidate_id": str(i), "arrival": i} for i in range(8)], f"{SCHEMA}, candidate_id string, arrival long")
    right = spark.createDataFrame([], f"{SCHEMA}, hidden boolean")
    got = {r.candidate_id: r["class"] for r in N.classify_candidates(left.mapInArrow(one, left.schema), right).collect()}
    assert got == {"0": "net_new"} | {str(i): "batch_url" for i in range(1, 8)}
    assert made.value == 8


def test_each_candidate_moves_few_bytes(spark, small):
    """Candidates go by numbers: what is shuffled and written of one is a few times its keys, not its id, arrival and texts at every step."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def moved():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in map(stages.apply, range(stages.size()))}

    before = moved()
    assert netnew_plans.j10_net_new_classes(spark, small).count() == 6000
    assert sum(n for stage, n in moved().items() if stage not in before) < 300 * 6000


def test_candidates_without_keys_and_rows_that_are_no_candidates(spark):
    row = {"ats_key": "s", "canonical_url": "", "apply_url": " ", "source_job_id": None, "country": "", "region": "", "city": "", "location_text": "", "remote_type": "remote"}
    left = spark.createDataFrame([row | {"number": i} for i in range(2)], f"{SCHEMA}, number long")
    said = N.said_of(left, spark.createDataFrame([], f"{SCHEMA}, hidden boolean"))
    got = N.with_classes(spark.createDataFrame([(i, f"row {i}") for i in range(3)], "number long, name string"), said)
    assert sorted(map(tuple, got.collect())) == [("row 0", "net_new"), ("row 1", "net_new")]
