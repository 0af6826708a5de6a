"""Merges into snapshots, retention, the index outbox, and rollback. Copy on write: every job returns the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.functions.text import is_blank, trimmed

DAY = 86_400
#: Fields that a new value overwrites, and those that keep the old one under a blank new value. A field that a batch lacks stays as it is.
OVERWRITTEN = ("company_name", "position_name", "apply_url", "confidence", "parser_version")
KEPT = ("country", "region", "city", "industry", "department", "employment_type", "location_text", "posting_date", "posted_at_epoch", "source_job_id", "description_plain", "description_html", "ats_key")


def fold_batch(batch: DataFrame, gathered: bool = False) -> DataFrame:
    """One row per URL, as if its rows had been applied one by one in the order of ``arrival``.

    ``accepted`` (all, if the batch has no such column) tells which rows passed the gate: only those give values, and the last row
    decides whether the posting is shown. The rows of a URL are brought together before they are folded, unless they are ``gathered`` by URL already: a row is
    smaller than its sums, each of which would take its own copy of the arrival along.
    """
    rows = batch if "accepted" in batch.columns else batch.withColumn("accepted", F.lit(True))
    ok = F.coalesce("accepted", F.lit(False))
    at = lambda value, when: F.max_by(value, F.when(when, F.col("arrival")))
    last = [at(F.col(c), ok).alias(c) for c in OVERWRITTEN if c in rows.columns]
    kept = [c for c in KEPT if c in rows.columns]
    filled = [at(F.col(c), ok & ~is_blank(F.col(c))).alias(c) for c in kept]
    remote = F.coalesce(at(F.col("remote_type"), ok & (trimmed(F.col("remote_type")) != "unknown")), F.lit("unknown")).alias("remote_type")
    seen = lambda f: f(F.when(ok, F.col("seen_epoch")))
    used = [c for c in ("canonical_url", *OVERWRITTEN, *KEPT, "remote_type", "seen_epoch", "arrival", "accepted") if c in rows.columns]
    rows = rows if gathered else rows.select(*used).repartition("canonical_url")
    return rows.groupBy("canonical_url").agg(
        *last, *filled, remote, seen(F.min).alias("first_seen_epoch"), seen(F.max).alias("last_seen_epoch"), F.count("*").alias("rows_in_batch"), F.count_if(ok).alias("accepted_rows"), F.max_by(ok, "arrival").alias("shown")
    )


def upsert(current: DataFrame, batch: DataFrame, gathered: bool = False) -> DataFrame:
    """The next snapshot: all columns of the snapshot, and change in new / updated / unhidden / hidden / untouched.

    Title, company and confidence are overwritten; places, dates, texts and ids keep the old value under a blank new one; the remote
    type keeps it under unknown; the earliest first and the latest last sighting stay; a seen posting is shown again. A posting whose last
    row failed the gate is hidden, and one that never passed it does not enter. Columns that only the snapshot has stay as they are.
    """
    n = fold_batch(batch, gathered)
    own = [c for c in (*OVERWRITTEN, *KEPT) if c in n.columns]
    n = n.select("canonical_url", *[F.col(c).alias(f"n_{c}") for c in (*own, "remote_type", "first_seen_epoch", "last_seen_epoch")], (F.col("accepted_rows") > 0).alias("passed"), "shown", F.lit(True).alias("seen"))
    both = current.withColumn("known", F.lit(True)).join(n, "canonical_url", "full_outer")
    no = lambda c: F.coalesce(c, F.lit(False))
    seen, known, passed, shown = no("seen"), no("known"), no("passed"), no("shown")
    both = both.where(known | passed)

    def value(c: str) -> Column:
        if c == "canonical_url":
            return F.col(c)
        if c == "remote_type":
            return F.when(passed & (F.col("n_remote_type") != "unknown"), F.col("n_remote_type")).otherwise(F.coalesce(c, F.lit("unknown"))).alias(c)
        if c == "first_seen_epoch":
            return F.least(c, f"n_{c}").alias(c)
        if c == "last_seen_epoch":
            return F.greatest(c, f"n_{c}").alias(c)
        if c == "hidden":
            return F.when(seen, ~shown).otherwise(F.col(c)).alias(c)
        if c in own and c in OVERWRITTEN:
            return F.when(passed, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
        if c in own:
            return F.when(passed & ~is_blank(F.col(f"n_{c}")), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    change = (
        F.when(~seen, "untouched").when(~known, F.when(shown, "new").otherwise("new_hidden")).when(~shown, F.when(F.col("hidden"), "untouched").otherwise("hidden"))
        .when(F.col("hidden"), "unhidden").otherwise("updated")
    )
    return both.select(*[value(c) for c in current.columns], change.alias("change"))


def outbox_of(merged: DataFrame) -> DataFrame:
    """Index operations: postings that became visible are written, those that were hidden are deleted."""
    operation = F.when(F.col("change") == "hidden", "delete").otherwise("upsert")
    return merged.where(F.col("change").isin("new", "unhidden", "hidden")).select("canonical_url", operation.alias("operation"))


def compact_outbox(outbox: DataFrame) -> DataFrame:
    """The last operation of each URL (outbox: id, canonical_url, operation)."""
    return outbox.groupBy("canonical_url").agg(F.max_by("operation", "id").alias("operation"), F.max("id").alias("id"), F.count("*").alias("entries"))


def apply_outbox(index: DataFrame, operations: DataFrame, postings: DataFrame) -> DataFrame:
    """The index documents after the operations (canonical_url, operation: upsert or delete, one of each URL).

    An upsert takes the document's columns from the posting as it is now; an upsert whose posting is gone changes nothing.
    """
    fields = index.columns
    split = operations.where("operation in ('upsert', 'delete')").select("canonical_url", (F.col("operation") == "delete").alias("_delete"))
    payload = postings.select(F.col("canonical_url"), F.struct(*fields).alias("_new"))
    rows = split.join(payload, "canonical_url", "left").where("_delete or _new is not null")
    both = index.select("canonical_url", F.struct(*fields).alias("_old")).join(rows, "canonical_url", "full_outer")
    return both.where("not coalesce(_delete, false)").select(F.coalesce("_new", "_old").alias("_d")).select("_d.*")


def retention(postings: DataFrame, as_of: int, hot_days: int = 30, hidden_days: int = 180) -> DataFrame:
    """What happens to each posting: hide when not seen for some days, delete when long hidden, else keep."""
    seen = F.coalesce("last_seen_epoch", F.lit(0))
    action = F.when(F.col("hidden") & (seen < as_of - hidden_days * DAY), "delete").when(~F.col("hidden") & (seen < as_of - hot_days * DAY), "hide").otherwise("keep")
    return postings.withColumn("action", action)


#: Days that rows of a table are kept, by the time in a column.
KEPT_DAYS = {"posting_cache": 365, "ingestion_run_errors": 90, "ingestion_runs": 365, "search_index_outbox": 7}


def prune(rows: DataFrame, epoch: str, as_of: int, days: int) -> DataFrame:
    """The rows whose time is no older than so many days; rows without a time go."""
    return rows.where(F.coalesce(epoch, F.lit(0)) >= as_of - days * DAY)


def pruned_counts(tables: dict[str, tuple[DataFrame, str]], as_of: int) -> DataFrame:
    """Rows that each table keeps and loses (tables: name -> rows, time column)."""
    parts = []
    for name, (rows, epoch) in tables.items():
        old = F.coalesce(epoch, F.lit(0)) < as_of - KEPT_DAYS[name] * DAY
        parts.append(rows.agg(F.lit(name).alias("name"), F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted")))
    return reduce(DataFrame.union, parts)


def date_window(rows: DataFrame, epoch: str, start: int, end: int) -> DataFrame:
    """The rows inside [start, end), for a snapshot of a date window."""
    return rows.where((F.col(epoch) >= start) & (F.col(epoch) < end))


def change_log(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """Images of what changed: (canonical_url, change_type, before, after)."""
    image = lambda df, name: df.select("canonical_url", F.struct(*fields).alias(name))
    both = image(before, "before").join(image(after, "after"), "canonical_url", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated")
    return both.select("canonical_url", kind.alias("change_type"), "before", "after")


def rollback(after: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """The snapshot before the logged changes: created rows go, updated and deleted ones get their old image."""
    undo = log.select("canonical_url", "change_type", F.col("before").alias("old"))
    both = after.select("canonical_url", F.struct(*fields).alias("now")).join(undo, "canonical_url", "full_outer").where("change_type is null or change_type <> 'created'")
    image = F.when(F.col("change_type").isNull(), F.col("now")).otherwise(F.col("old"))
    return both.select("canonical_url", image.alias("image")).select("canonical_url", "image.*")


def cache_changes(current: DataFrame, batch: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """new, changed or same for each row of the batch, comparing some fields null-safe."""
    old = current.select(key, F.struct(*compared).alias("_old"))
    rows = batch.withColumn("_new", F.struct(*compared)).join(old, key, "left")
    return rows.withColumn("change", F.when(F.col("_old").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")).drop("_old", "_new")


def upsert_cache(current: DataFrame, batch: DataFrame, compared: list[str], key: str = "canonical_url") -> DataFrame:
    """The next cache: the last row of each key wins (batch: the cache's columns and ``arrival``), all others stay.

    Adds change: new, changed, same (by the compared fields, null-safe; the new row is taken all the same, as it was seen later), or untouched.
    """
    columns = current.columns
    new = batch.groupBy(key).agg(F.max_by(F.struct(*columns), "arrival").alias("_new"))
    both = current.select(F.col(key), F.struct(*columns).alias("_old")).join(new, key, "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    change = F.when(F.col("_new").isNull(), "untouched").when(F.col("_old").isNull(), "new").when(same, "same").otherwise("changed")
    return both.select(F.coalesce("_new", "_old").alias("_row"), change.alias("change")).select("_row.*", "change")


def first_of_batch(batch: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each URL, with how many more there were."""
    w = W.partitionBy("canonical_url")
    rows = batch.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("duplicates", F.count("*").over(w) - 1)
    return rows.where("_rn = 1").drop("_rn")


def merge_state(current: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Key merge: the update's fields where there is one (also null), else the current ones."""
    u = updates.select(key, *[F.col(f).alias(f"_u_{f}") for f in fields], F.lit(True).alias("_hit"))
    both = current.join(u, key, "full_outer")
    return both.select(key, *[F.when(F.coalesce("_hit", F.lit(False)), F.col(f"_u_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def next_sync_epoch(last: Column, failures: Column, ttl: int, key: Column, base: int = 900, most: int = 7 * DAY) -> Column:
    """After success the source's interval, after n failures an exponential wait; up to a tenth more by a hash of the target."""
    wait = F.when(failures > 0, F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.least(failures, F.lit(16)) - 1))).otherwise(F.lit(float(ttl)))
    share = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(1000)) / 10_000
    return (last + F.floor(wait * (1 + share))).cast("long")


def sync_after(state: DataFrame, outcomes: DataFrame, ttl: int = DAY // 4) -> DataFrame:
    """The sync state (company_url, last_success_epoch, last_failure_epoch, consecutive_failures) after the outcomes (company_url, at_epoch, ok) of some runs, with the time of the next one.

    A success ends a row of failures; failures after it, or further ones without it, count up. A target that was not tried keeps its figures; new targets enter.
    """
    o = outcomes.groupBy("company_url").agg(F.max(F.when(F.col("ok"), F.col("at_epoch"))).alias("success"), F.max(F.when(~F.col("ok"), F.col("at_epoch"))).alias("failure"))
    after = outcomes.join(o.select("company_url", "success"), "company_url").where(~F.col("ok") & (F.col("success").isNull() | (F.col("at_epoch") > F.col("success"))))
    o = o.join(after.groupBy("company_url").agg(F.count("*").alias("failed")), "company_url", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    both = state.select("company_url", "last_success_epoch", "last_failure_epoch", "consecutive_failures").join(o, "company_url", "full_outer")
    failures = F.when(F.col("failed").isNull(), F.col("consecutive_failures")).when(F.col("success").isNotNull(), F.col("failed")).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + F.col("failed")).cast("int")
    out = both.select("company_url", F.greatest("last_success_epoch", "success").alias("last_success_epoch"), F.greatest("last_failure_epoch", "failure").alias("last_failure_epoch"), failures.alias("consecutive_failures"))
    last = F.greatest(F.col("last_success_epoch"), F.col("last_failure_epoch"))
    return out.withColumn("next_sync_epoch", next_sync_epoch(F.coalesce(last, F.lit(0)), F.col("consecutive_failures"), ttl, F.col("company_url")))
