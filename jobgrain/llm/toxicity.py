"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of three lexicons (a fixed list of insults; words and word beginnings learned from labelled texts),
their nearness to second-person pronouns, capitals, punctuation, lengthened and disguised words. Trees and calibration are
fitted by Spark's ML library on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest hashes of
their ids): three quarters for the trees, one for the calibration. The learned lexicons are fitted out of fold: the features
of a sampled text come from lexicons that its own fold (and copies of it) had no part in, so neither trees nor calibration see
features that know their label; other documents get the lexicons of the whole sample. The score is the isotonic value
itself. Scoring reads every document once and shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import MARKS, Memo, chunked, materialize, require, rows_of, text_marks, without_rows

#: Labelled rows that are used to fit, at most.
SAMPLE_ROWS = 40_000
#: Folds of the sample.
FOLDS = 4
#: An entry is learned if its log-likelihood ratio is at least this and so large a share of its texts is toxic.
LEAST_G2, LEAST_SHARE = 18.0, 0.8
PREFIXES = (4, 5, 6, 7)
#: Words that a task remembers, twice over at most (some 50 MB).
CACHE_WORDS = 200_000

#: Common insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers pathetic worthless scum trash garbage clown disgusting filth filthy "
    "vermin imbecile ugly bastard jerk freak creep coward liar shut hate kill die "
    "dumm idiotin trottel arsch abschaum connard imbécile crétin débile ordure idiota imbécil estúpido basura asqueroso".split()
)
#: Second-person pronouns of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself you're youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes tus vosotros".split()
)
#: Signs that stand for letters.
DISGUISE = str.maketrans("@4310$57!|", "aaeiosstil")
EDGE = re.compile(r"^\W+|\W+$")
LENGTHENED = re.compile(r"([^\W\d_])\1{2,}")
INSULT, LEARNED, BEGINNING, SECOND, CAPITALS, DISGUISED, LOUD, LONG = (1 << i for i in range(8))
FEATURES = (
    "log_words", "insults", "learned", "beginnings", "any_insult", "any_learned", "any_beginning", "hits", "log_hits", "second", "nearness",
    "near_second", "capital_words", "capital_letters", "disguised", "loud", "long", "exclaims", "asks", "signs",
)


def core(word: str) -> str:
    """Lower case, without signs at the edges."""
    return EDGE.sub("", word).lower()


def undisguised(word: str) -> str:
    """Letters for look-alike signs, signs between letters dropped, runs of three or more letters cut to one."""
    plain = re.sub(r"[\W_]+", "", word.lower().translate(DISGUISE))
    return re.sub(r"(.)\1{2,}", r"\1", plain)


class WordMarks(Memo):
    """Word as bytes -> its marks as bits."""

    def __init__(self, words: frozenset[str], beginnings: frozenset[str]) -> None:
        super().__init__(CACHE_WORDS)
        self.words, self.beginnings = words, beginnings

    def __missing__(self, raw: bytes) -> int:
        known = self.old.get(raw)
        if known is not None:
            return self.keep(raw, known)
        word = raw.decode("utf-8", "replace")
        if raw.isalpha() and raw.islower() and not LENGTHENED.search(word):  # a plain ASCII word
            marks = INSULT * (word in INSULTS) | LEARNED * (word in self.words) | BEGINNING * any(word[:k] in self.beginnings for k in PREFIXES if len(word) >= k) | SECOND * (word in SECOND_PERSON)
            return self.keep(raw, marks)
        c, marks = core(word), 0
        d = c if c.isalpha() else undisguised(word)
        for x in {c, d}:
            marks |= INSULT * (x in INSULTS) | LEARNED * (x in self.words) | BEGINNING * any(x[:k] in self.beginnings for k in PREFIXES if len(x) >= k)
        marks |= SECOND * (c in SECOND_PERSON) | CAPITALS * (len(c) > 1 and word.isupper()) | LOUD * ("!!" in word or "?!" in word or "??" in word)
        marks |= DISGUISED * (d != c and len(d) > 2 and any(not x.isalpha() and x != "'" and x != "-" for x in c)) | LONG * bool(LENGTHENED.search(c))
        return self.keep(raw, marks)


def features(text: str | None, marks: WordMarks) -> list[float]:
    """The dense features of a whole text, in the order of ``FEATURES``; all zero for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    m = np.fromiter(map(marks.__getitem__, words), dtype=np.uint8, count=len(words))
    n = len(words)
    rate = lambda bit: float(np.count_nonzero(m & bit)) / n
    hit, second = np.flatnonzero(m & (INSULT | LEARNED | BEGINNING)), np.flatnonzero(m & SECOND)
    nearness = close = 0.0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        gap = np.minimum(np.abs(hit - second[np.minimum(at, len(second) - 1)]), np.abs(hit - second[np.maximum(at - 1, 0)]))
        nearness, close = 1.0 / (1 + float(gap.min())), float(np.count_nonzero(gap <= 5)) / n
    letters = np.frombuffer(raw, dtype=np.uint8)
    upper = float(np.count_nonzero((letters >= 65) & (letters <= 90))) / len(letters)
    signs = float(np.count_nonzero(((letters >= 33) & (letters <= 47)) | ((letters >= 58) & (letters <= 64)))) / len(letters)
    one = lambda bit: float(bool((m & bit).any()))
    return [
        math.log1p(n), rate(INSULT), rate(LEARNED), rate(BEGINNING), one(INSULT), one(LEARNED), one(BEGINNING), len(hit) / n, math.log1p(len(hit)), rate(SECOND),
        nearness, close, rate(CAPITALS), upper, rate(DISGUISED), rate(LOUD), rate(LONG), raw.count(b"!") / n, raw.count(b"?") / n, signs,
    ]


Lexicons = tuple[frozenset[str], frozenset[str]]


def _featurise(lexicons: tuple[Lexicons, ...], carried: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [WordMarks(*x) for x in lexicons]
        for b in chunked(batches):
            which = rows_of(b, "lexicon").to_pylist()
            rows = np.array([features(t, marks[k]) for t, k in zip(rows_of(b, "text").to_pylist(), which, strict=True)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(rows_of(b, c) for c in carried), *(pa.array(x) for x in rows.T)], [*carried, *FEATURES])

    return run


def featurise(df: DataFrame, lexicons: tuple[Lexicons, ...], carried: dict[str, str], which: Column | None = None) -> DataFrame:
    """``which`` is the number of the row's lexicons."""
    schema = ", ".join([f"{c} {t}" for c, t in carried.items()] + [f"{f} double" for f in FEATURES])
    rows = df.select(*carried, "text", (F.lit(0) if which is None else which).cast("int").alias("lexicon"))
    return rows.mapInArrow(_featurise(lexicons, tuple(carried)), schema)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label and fold that hold a word or a beginning, counted within the task."""
    count: Counter[tuple[str, str, int, int]] = Counter()

    def out() -> pa.RecordBatch:
        kind, entry, label, part = zip(*count, strict=True) if count else ((), (), (), ())
        arrays = [pa.array(kind, pa.string()), pa.array(entry, pa.string()), pa.array(label, pa.int32()), pa.array(part, pa.int32()), pa.array(list(count.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "entry", "label", "fold", "n"])

    for b in chunked(batches):
        for text, label, part in zip(*(rows_of(b, c).to_pylist() for c in ("text", "label", "fold")), strict=True):
            held = {core(w) for w in set(text.split())} - {""}
            count.update(("word", w, label, part) for w in held)
            count.update(("beginning", p, label, part) for p in {w[:k] for w in held for k in PREFIXES if len(w) >= k})
        if len(count) > 100_000:
            yield out()
            count.clear()
    yield out()


def text_fold(text: Column) -> Column:
    """By the text, so that copies share a fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def learn_lexicons(sample: DataFrame) -> tuple[Lexicons, ...]:
    """(words, beginnings) that mark toxic texts of (text, label): of all folds, then without fold 0, 1, ...

    Equal texts count once. An entry needs its evidence (``LEAST_G2``) from the sample, whose size is bounded, so the lexicons
    are bounded too and nothing is cut off.
    """
    texts = sample.where("text is not null").groupBy("text").agg(F.max("label").alias("label"))
    texts = materialize(texts.withColumn("fold", text_fold(F.col("text"))))
    n = {(r["label"], r["fold"]): r["n"] for r in texts.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    table = texts.mapInArrow(_entries, "kind string, entry string, label int, fold int, n long")
    count = lambda label, k: F.sum(F.when((F.col("label") == label) & (F.lit(True) if k is None else F.col("fold") != k), F.col("n")).otherwise(0)).cast("double")
    views = [None, *range(FOLDS)]
    counts = table.groupBy("kind", "entry").agg(*[count(y, k).alias(f"{c}{i}") for i, k in enumerate(views) for c, y in (("a", 1), ("b", 0))])
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    def strong(i: int, k: int | None) -> Column:
        bad, good = (sum(v for (y, f), v in n.items() if y == label and f != k) for label in (1, 0))
        if not bad or not good:
            return F.lit(False)
        a, b, share = F.col(f"a{i}"), F.col(f"b{i}"), bad / (bad + good)
        g2 = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
        return F.coalesce((g2 >= LEAST_G2) & (a >= LEAST_SHARE * (a + b)), F.lit(False))

    found = counts.select("kind", "entry", *[strong(i, k).alias(f"s{i}") for i, k in enumerate(views)])
    found = found.where(" or ".join(f"s{i}" for i in range(len(views)))).collect()
    return tuple(tuple(frozenset(r["entry"] for r in found if r["kind"] == kind and r[f"s{i}"]) for kind in ("word", "beginning")) for i in range(len(views)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5))


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicons, trees and calibration; ``prior`` alone if the sample holds one class only."""

    lexicons: Lexicons
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame, carried: dict[str, str]) -> DataFrame:
        """``carried`` columns and score: the isotonic value of the trees' probability."""
        if self.trees is None:
            return docs.select(*carried).withColumn("score", F.lit(self.prior))
        rows = self.trees.transform(_assembled(featurise(docs, (self.lexicons,), carried)))
        rows = rows.withColumn("raw", vector_to_array("probability")[1])
        if self.calibration is None:
            return rows.select(*carried, F.col("raw").alias("score"))
        rows = self.calibration.transform(rows.drop("features", "prediction").withColumn("features", F.col("raw")))
        return rows.select(*carried, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on the labelled documents outside fold 0; label rows without a document, an id or a label are passed over."""
    labels = require(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
    chosen = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    sample = materialize(require(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    every, *of_fold = learn_lexicons(sample)
    part = F.pmod(F.xxhash64(F.lit("calibration"), F.coalesce("text", F.lit(""))), F.lit(4)) == 0
    table = materialize(featurise(sample.withColumn("part", part), tuple(of_fold), {"label": "int", "part": "boolean"}, text_fold(F.col("text"))).coalesce(6))
    seen = {(r["part"], r["label"]): r["n"] for r in table.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    bad, total = sum(n for (_, y), n in seen.items() if y == 1), sum(seen.values())
    if not all(seen.get((False, y)) for y in (0, 1)):
        return ToxicityModel(every, None, None, bad / total if total else 0.0)
    data = _assembled(table).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(maxIter=24, maxDepth=3, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=7).fit(data.where("not part").select("features", "label").coalesce(6))
    calibration = None
    if all(seen.get((True, y)) for y in (0, 1)):
        held = trees.transform(data.where("part")).select(vector_to_array("probability")[1].alias("features"), "label")
        calibration = IsotonicRegression().fit(held.coalesce(1))
    return ToxicityModel(every, trees, calibration, bad / total)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents, labels (doc_id, toxic) -> doc_id, held_out, score, predicted for every row.

    Null and empty texts score like a text without words; rows with a null id are held out and scored; repeated rows are
    scored each; without both classes in the sample every score is the share of toxic rows in it (0 without labels); an
    empty table gives an empty result; further columns are ignored, and lang, source and the id never enter a score.
    """
    docs = require(docs, "doc_id", "text")
    scored = fit(docs, labels, rows).score(docs, {"doc_id": "long"})
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half; all columns. Rows that share a doc_id, or have none, are judged each by its text."""
    rows = text_marks(require(docs, "doc_id", "text"))
    scored = fit(docs, labels).score(rows, {"doc_id": "long"} | dict.fromkeys(MARKS, "long"))
    return without_rows(docs, scored.where("score >= 0.5"))
