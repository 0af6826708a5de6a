"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Of two words one edit apart, with m letters in the shorter, the first m // 2 letters agree or the last m - m // 2 do. So every word
goes to the lists of its half prefixes and, read backwards, of its half suffixes, for m = its length and one less. Spark sorts each list;
a task scans sorted lists. Prefixes that neighbours share (their LCPs) are ranges of the list: the three-cell band of the edit
matrix of a query and a prefix is computed once for the whole range, starts below the half that all words of the list share,
and a range whose band holds nothing up to one edit is passed over with all its words. All queries of a scan move through the
list together, one letter at a time, as vector operations.

Lists above ``block`` words are cut into blocks, and every pair of blocks is scanned by itself. A list's findings leave the
task as counts and the best neighbour of each word; pairs are never written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import chunked, materialize, require, rows_of

#: Letters of a word, occurrences of a word, and how many times as frequent a form must be.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: Occurrences of one run in one document are garbled alike where this divides their hash.
GARBLE = 199
#: Words of a block; rows that are scanned together; queries that move together; distinct words a task counts before it hands them on.
BLOCK, ROWS, QUERIES, DISTINCT = 8192, 1 << 16, 2048, 1 << 18


def _counts(garble: int | None, letters: int):
    """(word, n) of the runs of ASCII letters and U+00C0-U+00FF, ASCII letters in lower case."""
    runs = re.compile(f"[a-z\\u00c0-\\u00ff]{{{letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in chunked(batches):
            for d, text in zip(rows_of(b, "doc_id").to_pylist(), rows_of(b, "text").cast(pa.binary()), strict=True):
                found = Counter(runs.findall((text.as_py() or b"").lower().decode("utf-8", "replace")))
                if garble is not None and d is not None:
                    start = zlib.crc32(b"%d:" % d)
                    for w in [w for w in found if zlib.crc32(w.encode(), start) % garble == 0]:
                        k = zlib.crc32(w.encode(), start) % len(w)
                        n = found.pop(w)
                        if len(w) > letters:
                            seen[w[:k] + w[k + 1 :]] += n
                seen.update(found)
                if len(seen) >= DISTINCT:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, garble: int | None = None) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    counts = require(docs, "doc_id", "text").mapInArrow(_counts(garble, letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class SortedList:
    """Words in sorted lists one after the other, with what the scan needs of them."""

    def __init__(self, words: list[bytes], lists: np.ndarray, shared: np.ndarray) -> None:
        """``lists``: the number of each word's list; ``shared``: leading letters that its list has in common."""
        n = self.n = len(words)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size + 2)])[:-1] + 2
        self.letters = np.frombuffer(b"\0\0" + b"".join(w + b"\0\0" for w in words), dtype=np.uint8)
        self.shared = shared
        #: Letters beyond the shared ones that a word has in common with the one before it; -1 for the first of a list.
        self.lcp = np.full(n, -1, dtype=np.int64)
        live = np.flatnonzero(lists[1:] == lists[:-1]) + 1
        depth = 0
        while len(live):
            self.lcp[live] = depth
            live = live[self.letter(live, shared[live] + depth) == self.letter(live - 1, shared[live] + depth)]
            depth += 1

    def letter(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Letters by place from 0; zero where a word has none."""
        inside = (place >= 0) & (place < self.size[word])
        return np.where(inside, self.letters[self.begin[word] + np.where(inside, place, 0)], 0)


def near(words: SortedList) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) numbers of the pairs of a list that are exactly one edit apart."""
    n = words.n
    every = np.arange(n)
    for lo in range(0, n, QUERIES):
        query = every[lo : lo + QUERIES]
        start = np.maximum.accumulate(np.where(words.lcp < 0, every, 0))[query]  # a range goes by its first word
        band = np.tile(np.array([1, 0, 1], dtype=np.int8)[:, None], (1, len(query)))
        depth = 0
        while len(query):
            at = words.shared[start] + depth  # letters of the range's prefix
            last = words.size[start] == at  # a word that ends here stands first in its range
            if last.any():
                q, w = query[last], start[last]
                gap = words.size[q] - at[last]
                cell = np.where(np.abs(gap) < 2, band[np.clip(gap + 1, 0, 2), np.flatnonzero(last)], 2)
                hit = cell == 1
                yield q[hit], w[hit]
            outer, firsts = np.flatnonzero(words.lcp < depth), np.flatnonzero(words.lcp <= depth)  # of prefixes this long, and one letter longer
            end = np.append(outer, n)[np.searchsorted(outer, start) + 1]
            a, b = np.searchsorted(firsts, start), np.searchsorted(firsts, end)
            a = a + last  # past the word that ends
            many = b - a
            of = np.repeat(np.arange(len(query)), many)
            child = firsts[np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)]
            place = at[of]
            c = words.letter(child, place)
            q = query[of]
            old = band[:, of]
            low = np.minimum(old[0] + (words.letter(q, place - 1) != c), old[1] + 1)
            mid = np.minimum(np.minimum(old[1] + (words.letter(q, place) != c), old[2] + 1), low + 1)
            top = np.minimum(old[2] + (words.letter(q, place + 1) != c), mid + 1)
            keep = np.flatnonzero(np.minimum(np.minimum(low, mid), top) <= 1)
            query, start = q[keep], child[keep]
            band = np.minimum(np.stack([low[keep], mid[keep], top[keep]]), 2).astype(np.int8)
            depth += 1


def _findings(rows: list[tuple]) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of some lists; a row is (backwards, m, key, bi, bj, side, scan, n)."""
    backwards, m, key, bi, bj, side, scan, n = (list(x) for x in zip(*rows, strict=True))
    fresh = [True, *(a[:5] != b[:5] for a, b in pairwise(rows))]
    m, n, backwards = np.array(m, dtype=np.int64), np.array(n, dtype=np.int64), np.array(backwards)
    half = np.where(backwards, m - m // 2, m // 2)
    words = SortedList([w.encode("latin-1") for w in scan], np.cumsum(fresh), half)
    side, apart = np.array(side), np.array(bi) != np.array(bj)
    count, best = np.zeros(words.n, dtype=np.int64), np.full(words.n, -1, dtype=np.int64)
    text = [w[::-1] if r else w for w, r in zip(scan, backwards.tolist(), strict=True)]
    order = np.lexsort((np.array(text, dtype=object), -n))
    place = np.empty(words.n, dtype=np.int64)
    place[order] = np.arange(words.n)  # the best neighbour has the smallest place
    for q, w in near(words):
        ok = np.flatnonzero((np.minimum(words.size[q], words.size[w]) == m[q]) & ~(apart[q] & (side[q] == side[w])))
        q, w = q[ok], w[ok]
        both = backwards[q].copy()  # those that agree in the other half too are found in its list
        live, x = np.flatnonzero(both), 0
        while len(live):
            same = words.letter(q[live], words.size[q[live]] - 1 - x) == words.letter(w[live], words.size[w[live]] - 1 - x)
            both[live[~same]] = False
            x += 1
            live = live[same]
            live = live[m[q[live]] // 2 > x]
        q, w = q[~both], w[~both]
        np.add.at(count, q, 1)
        rank = np.full(words.n, words.n, dtype=np.int64)
        np.minimum.at(rank, q, place[w])
        better = np.flatnonzero((rank < words.n) & ((best < 0) | (rank < place[best])))
        best[better] = order[rank[better]]
    got = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays(
        [pa.array([text[i] for i in got], pa.string()), pa.array(count[got]), pa.array(n[best[got]]), pa.array([text[i] for i in best[got]], pa.string())],
        ["word", "n_near", "best_n", "best"],
    )


LIST = ("backwards", "m", "key", "bi", "bj")
COLUMNS = (*LIST, "side", "scan", "n")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists of a sorted partition, some at a time."""
    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(rows_of(b, c).to_pylist() for c in COLUMNS), strict=True):
            if len(rows) >= ROWS and r[:5] != rows[-1][:5]:
                yield _findings(rows)
                rows = []
            rows.append(r)
    if rows:
        yield _findings(rows)


def neighbours(words: DataFrame, letters: int = LETTERS, block: int = BLOCK) -> DataFrame:
    """(word, n) -> (word, n_near, best_n, best): words one edit apart, and the most frequent of them (ties: the smallest)."""
    m = F.explode(F.array_distinct(F.array(F.greatest(F.length("word") - 1, F.lit(letters)), F.length("word")))).alias("m")
    each = words.select("word", "n", m).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backwards"))
    half = F.when(F.col("backwards"), F.col("m") - F.floor(F.col("m") / 2)).otherwise(F.floor(F.col("m") / 2)).cast("int")
    rows = each.withColumn("scan", F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word"))).withColumn("key", F.substring(F.col("scan"), F.lit(1), half))
    sizes = rows.groupBy("backwards", "m", "key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    rows = rows.join(sizes, ["backwards", "m", "key"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "backwards", "m", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "scan", "n",
    )
    found = rows.repartition(*LIST).sortWithinPartitions(*LIST, "scan").mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, by doubling; a form is several times as frequent, so there is no circle."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("then"))
        step = materialize(at.join(next_, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, factor: int = FACTOR, garble: int | None = None, block: int = BLOCK) -> DataFrame:
    """documents -> one row per word: word, form, root (string), n, n_near, form_n (long).

    Words are maximal runs of ASCII letters and U+00C0-U+00FF with at least ``letters`` letters and ``occurrences`` occurrences, A-Z in
    lower case. A word's form is its most frequent neighbour (ties: the smallest by code points) if that is ``factor`` times as
    frequent as the word or more; the root is where forms lead, the word itself without one. ``garble``: where it divides
    crc32(doc_id:run), the run loses the letter at that hash modulo its length (never with a null doc_id). Null and empty texts
    give no words; repeated rows count as often as they stand there; an empty table gives an empty result; further columns are
    ignored. A task holds the words of one row's text, 262 144 distinct words, or two blocks of a list.
    """
    if letters < 2 or factor < 2:
        raise ValueError("words need two letters, and forms twice the occurrences, at least")
    words = materialize(vocabulary(docs, letters, occurrences, garble))
    found = materialize(neighbours(words, letters, block).withColumnRenamed("word", "near_of"))
    known = words.join(found, F.col("word") == F.col("near_of"), "left")
    good = F.col("best_n") >= factor * F.col("n")
    known = materialize(known.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")))
    last = roots(known.where("form is not null")).withColumnRenamed("word", "of")
    return known.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
