"""The corpus pipeline: every stage against a plain computation on what the stage before it kept."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import plain_fingerprint, union_find

import corpus_pipeline
from jobgrain.llm import line_dedup, toxicity
from jobgrain.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, small):
    """What goes into each stage, and what the last one gives."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs))
        docs = materialize(stage(spark, docs, small))
    return dict(out) | {"result": docs}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(stages[n].columns == stages["toxicity"].columns for n in names)


def test_toxic_documents_go(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = {r.doc_id: r.score for r in toxicity.score_documents(stages["toxicity"], labels).collect()}
    assert texts(stages["line_dedup"]) == {d: t for d, t in texts(stages["toxicity"]).items() if scored[d] < 0.5}


def test_repeated_lines_go(stages):
    kept = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(stages["line_dedup"]).where("kept").collect()}
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in kept or not x.split()) for d, t in texts(stages["line_dedup"]).items()}
    assert texts(stages["near_dedup"]) == want
    exact: dict[str, int] = {}
    for t in want.values():
        for line in (t or "").split("\n"):
            if form := line_dedup.normal(line):
                exact[form] = exact.get(form, 0) + 1
    assert max(exact.values()) == 1
    assert {r.doc_id: r.n_chars for r in stages["near_dedup"].collect() if r.text is not None and r.text != texts(stages["line_dedup"])[r.doc_id]} == {
        d: len(t) for d, t in want.items() if t is not None and t != texts(stages["line_dedup"])[d]
    }


def test_one_document_of_a_group_stays(stages):
    docs = texts(stages["near_dedup"])
    ids = list(docs)
    fp = np.array([plain_fingerprint(docs[d]) for d in ids], dtype=np.uint64)
    roots = union_find(len(ids), zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3), strict=True))
    least: dict[int, int] = {}
    for d, r in zip(ids, roots, strict=True):
        least[r] = min(d, least.get(r, d))
    assert set(texts(stages["decontamination"])) == set(least.values())


def test_documents_that_hold_items_go(spark, small, stages):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] if w for i in range(max(1, len(w) - 4))}
    items = [g for _, t in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").toPandas().itertuples(index=False) if (g := grams(t))]
    docs = texts(stages["decontamination"])
    assert set(texts(stages["packing"])) == {d for d, t in docs.items() if not any(len(grams(t) & q) >= 0.8 * len(q) for q in items)}


def test_all_that_is_left_is_packed(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = stages["result"].toPandas()
    for d, t in texts(stages["packing"]).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    full = got.groupby("sequence_id").length.sum()
    assert (full[:-1] == 4096).all()


def test_run_is_the_stages_in_order(spark, small, stages):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["result"].collect()))
