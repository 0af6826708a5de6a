import numpy as np
import pyarrow as pa

from jobgrain.llm import line_dedup
from jobgrain.llm.common import CLEANUP, materialize


def packed(portions):
    """Packed entries of one destination, of portions of (band, key) lines."""
    rows = []
    for lines in portions:
        band, low, at, key = line_dedup._bucketed(*(np.array(c, dtype=t) for c, t in zip(zip(*lines, strict=True), (np.uint64, np.int64), strict=True)))
        entries, members = np.empty(len(band), dtype=line_dedup.ENTRY), np.empty(len(at), dtype=line_dedup.MEMBER)
        entries["band"], entries["key"] = band, low
        members["band"], members["key"], members["low"] = band[at], key, low[at]
        rows.append((3, entries.tobytes(), members.tobytes()))
    return pa.table(dict(zip(("dest", "entries", "members"), map(list, zip(*rows, strict=True)), strict=True)))


def test_buckets_keep_no_row_of_repeats_and_one_of_a_pair():
    repeats = [(1, 50), (2, 50)]  # one line in every portion
    pair = [(4, 60), (5, 60), (4, 61), (5, 61)]  # two lines that share two bands
    portions = [repeats + pair, repeats + pair[2:], repeats + [(9, 71), (9, 70)], repeats + [(9, 72), (9, 71)]]
    got = line_dedup._buckets(packed(portions)).to_pylist()
    band = 3 << 32 | 9
    many = {(band, 70, 70), (band, 71, 70), (band, 71, 71), (band, 72, 71)}
    assert {(r["band"], r["key"], r["low"]) for r in got} - many == {(None, 61, 60)}
    met = {(r["key"], r["low"]) for r in got if r["band"]}
    assert {k for k, _ in met} == {70, 71, 72} and (71, 70) in met and (72, 71) in met
    assert len(got) == len({tuple(r.values()) for r in got})
    assert line_dedup._buckets(packed([repeats, repeats])).num_rows == 0


def test_line_roots_tells_texts_of_one_key_apart(spark):
    words = [f"word{i}" for i in range(80)]
    a, b, c = " ".join(words), " ".join(["other", *words[10:]]), " ".join([*words[:-10], "last"])
    lines = [(1, 10, a), (1, 11, b), (2, 20, c), (1, 12, "nothing of the kind at all"), (3, 30, "something else entirely here")]
    assert not line_dedup.jaccard_at_least(*line_dedup._split([b, c]), 0.8) and line_dedup.jaccard_at_least(*line_dedup._split([a, b]), 0.8)
    got = line_dedup.line_roots(spark.createDataFrame(lines, "key long, sum long, form string")).collect()
    assert {r["sum"] for r in got} == {10, 11, 20} and len({r["root"] for r in got}) == 1


def test_normal_form_is_lower_case_words_joined_by_one_blank():
    for code in (*range(0x3100), 0xFEFF, 0x10400):
        for text in (f"A{chr(code)}b", f"{chr(code)}A", f"A {chr(code)}", chr(code)):
            assert line_dedup.normal(text) == " ".join(text.lower().split())


def test_materialize_frees_its_shuffle_and_restores_the_setting(spark):
    before = spark.conf.get(CLEANUP, None)
    rows = spark.range(1000).selectExpr("id % 10 as k").groupBy("k").count()
    assert materialize(rows, free=True).join(materialize(rows, free=True), "k").count() == rows.count() == 10
    assert spark.conf.get(CLEANUP, None) == before
