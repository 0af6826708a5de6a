"""Registered queries over whole tables, where their SQL covers a part."""

from jobgrain.plans import registry
from jobgrain.sources.views import postings


def test_duplicate_of_covers_groups_of_every_size(spark, small, monkeypatch):
    from jobgrain.plans import audit_plans

    source = [("u1", "s", "7", 10), ("u2", "s", "7", 30), ("u3", "s", "7", 20), ("u4", "s", "8", 5), ("u5", "s", "8", 5), ("u6", "t", "7", 9), ("u7", "t", "", 9), ("u8", "t", "", 9)]
    rows = spark.createDataFrame(source, "canonical_url string, ats_key string, source_job_id string, last_seen_epoch long")
    monkeypatch.setattr(audit_plans, "postings", lambda *_: rows)
    got = {(r.canonical_url, r.duplicate_of) for r in registry.queries()["j9_duplicate_of"](spark, small).collect()}
    assert got == {("u1", "u2"), ("u2", "u3"), ("u3", "u2"), ("u4", "u5"), ("u5", "u4")}


def test_candidates_hold_the_word_in_their_texts(spark, small, monkeypatch):
    """A source's key does not count as a text: a blank title of the source `building` is no candidate."""
    from jobgrain.plans import intent_plans

    source = [(f"https://jobs.example/p/{n}", company, title, "building", "Remote - California") for n, company, title in ((1, "c", ""), (2, "c", "BUILDING 1"), (3, "Building Ltd", ""))]
    rows = spark.createDataFrame(source, "canonical_url string, company_name string, position_name string, ats_key string, location_text string")
    monkeypatch.setattr(intent_plans, "located", lambda *_: rows)
    monkeypatch.setattr(intent_plans, "application_state", lambda *_: spark.createDataFrame([], "canonical_url string, applied boolean, ignored boolean"))
    assert [r.canonical_url[-1] for r in registry.queries()["k11_candidates"](spark, small).collect()] == ["3", "2"]
