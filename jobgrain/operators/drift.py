"""Payload drift: observations of a parser's payload shapes, in time order, against a baseline that moves with them.

What a rule needs of one shape (its core paths, job lists that are empty, array stems that are bare or filled) is computed as columns. What depends
on the observations before is a small state machine, folded over each parser's observations by ``drift_outcomes`` and by the
streaming job alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.operators.extract import shape_hash

#: Maps whose keys are addresses, fields that the crawler adds itself, and names of job lists.
ADDRESS_MAPS = ("__detailHtmlByUrl", "detailHtmlByUrl", "__detailStatusByUrl", "detailStatusByUrl", "__detailFailureByUrl", "detailFailureByUrl")
OWN_FIELDS = r"^(__source.*|__listUrl|__legacyParsed(\[\].*)?|__companyNameForPostings|detail_fetch_count|(__)?detail(Html|Status|Failure)ByUrl(\..*)?)$"
JOB_LISTS = r"^(jobs?|postings?|positions?|openings?|offers?|result|items|records)$"
COUNTS = r'(?i)"(total|totalcount|total_count|totalnumber|total_number|totaljobscount|total_jobs_count|jobcount|job_count|count)"\s*:\s*"?[0-9.]*[1-9]'
#: Least similarity of a shape that is no drift.
SIMILAR = 0.55
EMPTY = "[]:empty"
FACTS = ("core", "bare", "filled", "no_jobs", "no_shape")


def _below(stem: Column, prefixes: tuple[str, ...]) -> Column:
    """The stem is one of the prefixes or stands under it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (stem == p) | stem.startswith(f"{p}.") | stem.startswith(f"{p}[]")
    return out


def shape_facts(observed: DataFrame, ignored: tuple[str, ...] = (), job_lists: tuple[str, ...] = ()) -> DataFrame:
    """Adds what the rules ask of a shape (needs shape_paths; payload, if there, tells whether a source counts more jobs than it lists).

    core: paths without the crawler's own fields and the ``ignored`` stems, maps by address as one path; bare: stems of arrays that are only empty; filled: stems of
    arrays with items; no_jobs: a job list is empty, and no count says otherwise; no_shape: nothing was seen.
    """
    maps = "|".join(ADDRESS_MAPS)
    paths = F.array_distinct(F.coalesce("shape_paths", F.array().cast("array<string>")))
    named = F.transform(paths, lambda p: F.regexp_replace(p, rf"^((?:.*\.)?(?:{maps}))\..*:([^:]*)$", "$1.*:$2"))
    stem = lambda p: F.regexp_replace(p, r":[^:]*$", "")
    core = F.array_sort(F.array_distinct(F.filter(named, lambda p: ~F.rlike(stem(p), F.lit(OWN_FIELDS)) & ~_below(stem(p), ignored))))
    item = r"^(.*)\[\]:(?!empty$).*$"
    with_items = F.array_distinct(F.transform(F.filter(paths, lambda p: F.rlike(p, F.lit(item))), lambda p: F.regexp_extract(p, item, 1)))
    empty = F.transform(F.filter(paths, lambda p: F.endswith(p, F.lit(EMPTY))), lambda p: F.regexp_replace(p, r"\[\]:empty$", ""))
    rows = observed.withColumns({"core": core, "_items": with_items, "_empty": empty})
    lists = lambda s: F.rlike(F.lower(F.element_at(F.split(s, r"\."), -1)), F.lit(JOB_LISTS)) | _below(s, job_lists)
    counted = F.rlike(F.coalesce(F.col("payload"), F.lit("")), F.lit(COUNTS)) if "payload" in observed.columns else F.lit(False)
    bare = F.array_except("_empty", "_items")
    return rows.withColumns({
        "bare": bare, "filled": F.filter("_items", lambda s: F.array_contains(paths, F.concat(s, F.lit(":array")))),
        "no_jobs": ~counted & F.exists(bare, lists), "no_shape": F.size(paths) == 0,
    }).drop("_items", "_empty")


#: Facts whose outcome a baseline remembers at most; others are judged each time.
MOST_SAID = 10_000


def facts_text() -> Column:
    """The facts of a shape as JSON: one short text in the place of arrays of paths."""
    return F.to_json(F.struct(*FACTS)).alias("facts")


@dataclass
class Baseline:
    """The shape that a parser's payloads are held against."""

    core: list[str] | None = None
    bare: list[str] = field(default_factory=list)
    #: Outcomes of facts that this baseline has met.
    said: dict[str, tuple[str, float | None]] = field(default_factory=dict)

    def take(self, core: list[str], bare: list[str]) -> None:
        self.core, self.bare, self.said = core, bare, {}

    def meet_text(self, facts: str) -> tuple[str, float | None]:
        """``meet`` for facts as JSON, which are the same for most observations of a parser."""
        if (out := self.said.get(facts)) is None:
            read = json.loads(facts)
            out = self.meet(*(read[c] for c in FACTS))
            if out[0] not in ("bootstrapped", "baseline_replaced") and len(self.said) < MOST_SAID:
                self.said[facts] = out
        return out

    def meet(self, core: list[str], bare: list[str], filled: list[str], no_jobs: bool, no_shape: bool) -> tuple[str, float | None]:
        """The outcome of the next observation, and its similarity where that was asked for; the baseline may move."""
        if no_shape:
            return "skipped", None
        if no_jobs:
            return "empty_no_jobs", None
        if self.core is None:
            self.take(core, bare)
            return "bootstrapped", None
        if not set(filled).isdisjoint(self.bare):
            self.take(core, bare)
            return "baseline_replaced", None
        if core and core == self.core:
            return "same_core", None
        ours, theirs = set(self.core), set(core)
        both = ours | theirs
        similarity = round(len(ours & theirs) / len(both), 4) if both else 1.0
        return ("similar" if similarity >= SIMILAR else "drift"), similarity


KEY = ("ats_key", "parser_version")
IDENTITY, JUDGED = "ats_key string, parser_version string, observed_epoch long, ident long", "outcome string, similarity double"
OUTCOME = f"{IDENTITY}, {JUDGED}"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted observations of whole parsers; one baseline is kept at a time."""
    key, base = None, Baseline()
    for b in batches:
        outcome, similarity = [], []
        facts = b.column("facts").dictionary_encode()
        texts = facts.dictionary.to_pylist()
        for *k, n in zip(*(b.column(c).to_pylist() for c in KEY), facts.indices.to_pylist(), strict=True):
            if k != key:
                key, base = k, Baseline()
            o, s = base.meet_text(texts[n])
            outcome.append(o)
            similarity.append(s)
        names = [c for c in b.schema.names if c != "facts"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(outcome, pa.string()), pa.array(similarity, pa.float64())], [*names, "outcome", "similarity"])


def drift_outcomes(observed: DataFrame, keep: tuple[str, ...] = (), **rules) -> DataFrame:
    """What each observation (ats_key, parser_version, observed_epoch, ident, shape_paths, perhaps payload) means, in the order of time and ident.

    bootstrapped: the first shape is the baseline; baseline_replaced: an array that the baseline knows only as empty has items now; same_core;
    similar (Jaccard of core paths 0.55 or more); drift; empty_no_jobs and skipped say nothing about the parser. A parser's observations are read in sorted order by
    one task, which keeps its baseline only. Columns to ``keep`` go along.
    """
    rows = shape_facts(observed, **rules).select(*KEY, F.col("observed_epoch").cast("long"), F.col("ident").cast("long"), *keep, facts_text())
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    out = rows.repartition(*KEY).sortWithinPartitions(*KEY, "observed_epoch", "ident").mapInArrow(_fold, f"{IDENTITY}{kept}, {JUDGED}")
    return out.select(*KEY, "observed_epoch", "ident", "outcome", "similarity", *keep)


def newest_drift(observed: DataFrame, limit: int = 100) -> DataFrame:
    """The newest drift events: (ats_key, parser_version, ident, observed_epoch, similarity, shape_hash)."""
    hashed = observed.withColumn("shape_hash", shape_hash(F.col("shape_paths")))
    newest = drift_outcomes(hashed, ("shape_hash",)).where("outcome = 'drift'").orderBy(F.desc("observed_epoch"), F.desc("ident")).limit(limit)
    return newest.select(*KEY, "ident", "observed_epoch", "similarity", "shape_hash")
