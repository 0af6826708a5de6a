"""Periodic runs and spelling variants against brute force, and their defined results in odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jobgrain.llm import periodic_runs, queries, spelling_variants

EXTRA = "text_mark_a string, n long, word string, form string, root string, runs string, start string, scan string, key string, size string, side string, of string, near_of string, best string"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, blank and long texts, repeated rows, and further columns with names that the operators use."""
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, "one"), (5, "one"), (None, "aa " * 40), (None, None), (6, "İstanbul ß \u0000 \x1c end"), (7, "x" * 50_000), (8, " ".join(["y" * 20_000] * 9))]
    return spark.createDataFrame([(*r, *([None] * 14)) for r in rows], f"doc_id long, text string, {EXTRA}")


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and all(any(w[x] != w[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_scan_of_all_periods():
    rng = random.Random(4)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 7)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.choice([0, 1, 5, 6, 9, 40, 130, 300]))]
            w = periodic_runs.planted(w, 10 * rng.randrange(10**6)) if rng.random() < 0.5 else w
            texts.append(list(texts[-1]) if texts and rng.random() < 0.3 else w)
        got = [[(r["start"], r["length"], r["period"]) for r in x[7]] for x in periodic_runs._described(texts, True)]
        assert got == [brute_runs(w) for w in texts]


@pytest.mark.parametrize("points", [7, 1 << 20])
def test_grid_points_asked_in_parts_give_the_same_runs(monkeypatch, points):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    w = [b"a", b"b", b"c"] * 30 + [b"d"] * 50 + [b"%d" % i for i in range(40)] + [b"e", b"f"] * 33
    assert [(r["start"], r["length"], r["period"]) for r in next(periodic_runs._described([w], True))[7]] == brute_runs(w)


def test_extensions_equal_direct_comparison():
    rng = np.random.default_rng(5)
    for k, n in ((1, 200), (2, 500), (3, 2000), (2, 31), (2, 4)):
        words = np.append(np.tile(rng.integers(0, k, max(n // 3, 1)), 3), 99)
        at = rng.integers(0, len(words), (300, 2))
        at = at[at[:, 0] != at[:, 1]]
        got = periodic_runs.Extensions(words)(at[:, 0], at[:, 1])
        for (i, j), g in zip(at.tolist(), got.tolist(), strict=True):
            t = 0
            while max(i, j) + t < len(words) and words[i + t] == words[j + t]:
                t += 1
            assert g == t


def test_op11_query_equals_brute_force(spark, small, local):
    want = []
    for d, text in local:
        w = (text or "").encode().split()
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w) if len(w) <= 3000 else None
        if runs is None:
            continue
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    frame = queries.op11_periodic_runs(spark, small)
    assert frame.columns == names
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(local)
    assert any(r[1] for r in want)
    assert sorted(set(want) - set(got)) == []


def test_odd_texts_have_defined_runs(spark, odd):
    rows = periodic_runs.periodic_runs(odd, plant=True).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    empty = hashlib.sha256(b"").hexdigest()
    for d in (1, 2, 3):
        assert (by[d].n_runs, by[d].start, by[d].exponent_milli, by[d].runs_sha256, by[d].collapsed_sha256) == (0, None, None, empty, empty)
    assert (by[4].n_runs, by[4].period, by[4].collapsed) == (1, 6, "lorem ipsum dolor sit amet consectetur")
    nameless = [r for r in rows if r.doc_id is None and r.n_runs]
    assert [(r.start, r.length, r.period, r.collapsed) for r in nameless] == [(0, 40, 1, "aa")]
    assert by[8].n_runs == 1 and by[5].collapsed == "one" and sum(r.doc_id == 5 for r in rows) == 2
    assert periodic_runs.periodic_runs(odd.where("false")).collect() == []


def brute_variants(counts, factor=5):
    letters = sorted({c for w in counts for c in w})
    near = {}
    for w in counts:
        out = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = [x for x in out if x in counts and x != w]
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def test_op13_query_equals_brute_force(spark, small, local):
    counts = Counter()
    for d, text in local:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = brute_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    frame = queries.op13_spelling_variants(spark, small)
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and any(r[1] for r in rows)


def test_blocks_of_a_list_lose_and_double_no_pair(spark):
    rng = random.Random(6)
    counts = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 7, 8, 9]))): rng.randrange(5, 300) for _ in range(1500)}
    counts["abcdefgh" * 50], counts["abcdefgh" * 50 + "x"] = 10, 100
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {(w, near) for w, _, _, _, near, _ in brute_variants(counts) if near}
    for block in (40, 8192):
        got = spelling_variants.neighbours(words, block=block).collect()
        assert {(r.word, r.n_near) for r in got} == want and len(got) == len(want)


def test_chains_of_forms_lead_to_the_last(spark):
    text = " ".join(["abcdef"] * 5 + ["abcdeff"] * 25 + ["abcdefff"] * 125 + ["abcdeffff"] * 625)
    got = {r.word: (r.form, r.root) for r in spelling_variants.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {"abcdef": ("abcdeff", "abcdeffff"), "abcdeff": ("abcdefff", "abcdeffff"), "abcdefff": ("abcdeffff", "abcdeffff"), "abcdeffff": (None, "abcdeffff")}


def test_odd_texts_have_defined_variants(spark, odd):
    got = {r.word: r.n for r in spelling_variants.spelling_variants(odd, garble=spelling_variants.GARBLE).collect()}
    assert got["consectetur"] + got.get("consecttur", 0) <= 3000 and got["y" * 20_000] == 9 and "x" * 50_000 not in got
    assert spelling_variants.spelling_variants(odd.where("false")).collect() == []
