"""Runs of repeated words, found with difference-cover LCE queries on a harmonic grid.

A run with period q and exponent 4 or more holds a stretch of at least 3q positions whose words equal the words q later. So
for each q a grid of step 3q meets every run; each grid point asks how far the text agrees with itself q words later, forward
and backward (longest common extension). The grids of all periods have n/3 * ln(n/4) points, whatever the text looks like.

LCE: a perfect difference set modulo 31 names 6 of every 31 suffixes. Only these are sorted, by refining ties: first through
their next 31 words, then by doubling along positions 31 words apart. Any two positions reach sampled positions together after at
most 30 steps, so a query compares these few words and then takes a range minimum over the neighbours' common prefixes.

Documents of one Arrow batch are joined with separators that occur once, so short texts share the vector operations.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobgrain.llm.common import chunked, require, rows_of

#: A perfect difference set (every difference modulo the order occurs once).
ORDER, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Smallest exponent and length of a run.
EXPONENT, SHORTEST = 4, 6
#: Words of the documents that are joined, and grid points that are asked at a time.
WORDS, POINTS = 1 << 18, 1 << 20


def _steps() -> np.ndarray:
    """Steps from residues (a, b) to sampled positions of both."""
    out = np.full((ORDER, ORDER), ORDER, dtype=np.int64)
    for k in range(ORDER):
        for a in COVER:
            for b in COVER:
                i, j = (a - k) % ORDER, (b - k) % ORDER
                out[i, j] = min(out[i, j], k)
    return out


STEPS = _steps()


class Extensions:
    """How far the text agrees with itself from two positions on."""

    def __init__(self, words: np.ndarray) -> None:
        """Words are numbers from 0; the text ends in a word that occurs nowhere else, so no two suffixes are equal."""
        n = len(words)
        self.words = np.concatenate([words.astype(np.int64), np.full(ORDER, -1, dtype=np.int64)])
        classes = [np.arange(r, n, ORDER) for r in COVER]
        at = np.concatenate(classes)
        m = len(at)
        self.first = np.zeros(ORDER, dtype=np.int64)
        self.first[list(COVER)] = np.cumsum([0, *map(len, classes)])[:-1]
        follow = np.arange(1, m + 1)  # the sample 31 words on; m: none
        follow[np.cumsum([len(x) for x in classes])[[len(x) > 0 for x in classes]] - 1] = m
        rank, tied = np.zeros(m, dtype=np.int64), np.arange(m)
        for k in range(ORDER):
            rank, tied = self._refined(rank, tied, self.words[at + k])
        levels = [rank]
        while len(tied):
            rank, tied = self._refined(rank, tied, np.append(rank, -1)[follow])
            levels.append(rank)
            follow = np.append(follow, m)[follow]
        self.rank = rank
        self.table = self._minima(at, levels)

    @staticmethod
    def _refined(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by (rank, key), and the samples that still share one. A rank is the number of samples before it, so only ties move."""
        if not len(tied):
            return rank, tied
        order = tied[np.lexsort((key[tied], rank[tied]))]
        r, k = rank[order], key[order]
        here = np.arange(len(order))
        group = np.concatenate([[True], r[1:] != r[:-1]])
        fresh = group | np.concatenate([[True], k[1:] != k[:-1]])
        out = rank.copy()
        out[order] = r + np.maximum.accumulate(np.where(fresh, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
        alone = fresh & np.append(fresh[1:], True)
        return out, order[~alone]

    def _minima(self, at: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Sparse table over the common prefixes of neighbours in sorted order."""
        order = np.argsort(self.rank)
        i, j = at[order[:-1]], at[order[1:]]
        prefix = np.zeros(len(i), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            r = levels[level]
            a, b = self._sample(i + prefix), self._sample(j + prefix)
            both = np.flatnonzero((a < len(r)) & (b < len(r)))
            both = both[r[a[both]] == r[b[both]]]
            prefix[both] += ORDER << level
        prefix += self._compare(i + prefix, j + prefix, np.full(len(i), ORDER))
        table, width = [prefix], 1
        while 2 * width <= len(prefix):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _sample(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the samples at positions of the cover; a large one beyond the text."""
        return np.where(at < len(self.words) - ORDER, self.first[at % ORDER] + at // ORDER, len(self.words))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, looking at ``most`` of them."""
        out = np.zeros(len(i), dtype=np.int64)
        live, step = np.flatnonzero(most > 0), 0
        while len(live):
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            step += 1
            out[live] = step
            live = live[most[live] > step]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions of i and j, i <> j."""
        steps = STEPS[i % ORDER, j % ORDER]
        out = self._compare(i, j, steps)
        deep = np.flatnonzero(out == steps)
        a, b = self._sample(i[deep] + steps[deep]), self._sample(j[deep] + steps[deep])
        inside = (a < len(self.rank)) & (b < len(self.rank))
        deep, a, b = deep[inside], self.rank[a[inside]], self.rank[b[inside]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for x in np.unique(level).tolist():
            at = np.flatnonzero(level == x)
            out[deep[at]] += np.minimum(self.table[x][low[at]], self.table[x][high[at] - (1 << x)])
        return out


def find_runs(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs of joined documents, by document, start and period.

    ``words`` holds the documents' word numbers, each followed by a number that occurs once.
    """
    none = np.zeros(0, dtype=np.int64)
    periods = np.where(size >= SHORTEST, np.maximum(size // EXPONENT, 1), 0)
    if not periods.any():
        return none, none, none, none
    doc = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stretch = EXPONENT - 1
    points = (size[doc] - q - 1) // (stretch * q) + 1
    ends = np.cumsum(points)
    found, after, before, lo = [], None, None, 0
    n = len(words)
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POINTS, side="right")))
        each = points[lo:hi]
        of = np.repeat(np.arange(lo, hi), each)
        i = begin[doc[of]] + (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * stretch * q[of]
        hit = np.flatnonzero(words[i] == words[i + q[of]])
        lo = hi
        if not len(hit):
            continue
        if after is None:
            after, before = Extensions(words), Extensions(np.append(words[-2::-1], words[-1]))  # of the text read backwards
        d, i, p = doc[of[hit]], i[hit], q[of[hit]]
        back, forward = before(n - 1 - i - p, n - 1 - i), after(i, i + p)
        keep = np.flatnonzero(back + forward + p >= np.maximum(SHORTEST, EXPONENT * p))
        found.append(np.unique(np.stack([d, i - back, back + forward + p, p], axis=1)[keep], axis=0))
    if not found:
        return none, none, none, none
    rows = np.unique(np.concatenate(found), axis=0)
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)  # multiples of a run's period give the same stretch
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1] - begin[rows[:, 0]], rows[:, 2], rows[:, 3]


def planted(words: list, h: int | None) -> list:
    """Every tenth document repeats from one of its words on: word i becomes word a + (i - a) % p."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


EMPTY = _hex(b"")
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)
FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")


def _described(texts: list[list[bytes]], full: bool) -> Iterator[tuple]:
    """A row's values after doc_id for each document's words."""
    number = defaultdict(count().__next__)
    size = np.array([len(w) for w in texts], dtype=np.int64)
    parts = []
    for w in texts:
        parts += [np.fromiter(map(number.__getitem__, w), np.int64, len(w)), np.zeros(1, dtype=np.int64)]
    words = np.concatenate(parts)
    begin = np.cumsum(size + 1) - size - 1
    words[begin + size] = len(number) + np.arange(len(size))
    doc, start, length, period = find_runs(words, begin, size)
    cuts = np.searchsorted(doc, np.arange(len(size) + 1))
    for k, w in enumerate(texts):
        lo, hi = cuts[k], cuts[k + 1]
        if lo == hi:
            joined = b" ".join(w)
            yield 0, None, None, None, None, EMPTY, _hex(joined), [], joined.decode() if full else None
            continue
        s, n, p = start[lo:hi], length[lo:hi], period[lo:hi]
        best = np.lexsort((p, s, -n))[0]
        marks = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(marks, s + p, 1)
        np.add.at(marks, s + n, -1)
        joined = b" ".join(compress(w, (np.cumsum(marks[:-1]) == 0).tolist()))
        rows = list(zip(s.tolist(), n.tolist(), p.tolist(), strict=True))
        digest = _hex("".join(f"{a},{b},{c}\n" for a, b, c in rows).encode())
        a, b, c = rows[best]
        yield hi - lo, a, b, c, 1000 * b // c, digest, _hex(joined), [dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] if full else [], joined.decode() if full else None


def _runs(plant: bool, full: bool):
    def flush(ids: list, texts: list) -> pa.RecordBatch:
        rows = [(d, *r) for d, r in zip(ids, _described(texts, full), strict=True)]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches, 2048):
            ids, texts, n = [], [], 0
            for d, text in zip(rows_of(b, "doc_id").to_pylist(), rows_of(b, "text").cast(pa.binary()), strict=True):
                w = (text.as_py() or b"").split()
                if plant:
                    w = planted(w, None if d is None else zlib.crc32(str(d).encode()))
                if ids and n + len(w) > WORDS:
                    yield flush(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(d)
                texts.append(w)
                n += len(w) + 1
            if ids:
                yield flush(ids, texts)

    return run


def periodic_runs(docs: DataFrame, plant: bool = False, full: bool = True) -> DataFrame:
    """documents -> one row per row: doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests, and with
    ``full`` all runs and the text without repeats (``runs``, ``collapsed``; else an empty list and null).

    A run is a stretch of words with smallest period q, length >= max(6, 4q), that no neighbouring word extends. A word goes
    from the collapsed text if it stands in a run after its first q words. Of runs of equal length the one with the smallest
    start, then period, is the longest. Null, empty and blank texts have no words and no runs; the four values are null then.
    ``plant`` first makes every tenth document (by crc32 of its doc_id; none with a null id) repeat, as the query asks.
    Repeated rows stay repeated, an empty table gives an empty result, further columns are ignored. Nothing is shuffled. A task
    holds one group of texts of 262 144 words, or one longer text at some 250 bytes a word (17 MB of text: 0.75 GB).
    """
    return require(docs, "doc_id", "text").mapInArrow(_runs(plant, full), SCHEMA)
