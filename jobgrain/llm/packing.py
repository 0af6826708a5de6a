"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed length.

Every source is a queue of tokens. Each queue earns credit in proportion to its target share, and the next token
is taken from the queue that is furthest behind: token j (from 0) of a queue with weight w falls due at
(j + 0.5) / w, and tokens are dealt in the order of (due time, queue). A queue's deficit after any number of windows
is thus below one token while it lasts; the share of an empty queue passes to the others. As the order is a closed
form of the queue lengths, the cut of every queue at every window edge can be computed anywhere: deficits carry
across windows and across Spark's partitions, no state is passed from task to task, and each window but the last is
full.

Two passes: tokenise once into a table in the shared folder, with each document's place in its queue counted within
its task; then add the queue lengths of the tasks before it and cut the documents at the window edges.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.llm.common import Memo, chunked, materialize, require, rows_of

#: Words and pieces of words that a Python worker remembers with their ids, twice over at most (some 150 MB together).
CACHE_WORDS = 3 << 17


#: Fixed value: the tokenizer's own split pattern, on lower-cased ASCII and the accented letters of Latin-1.
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Words that this pattern splits as the tokenizer does, without its normaliser (their letters are composed already).
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes beyond ASCII in the tokenizer's vocabulary, by the rule of byte-level BPE: printable ones for themselves, the others
    numbered from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordIds(Memo):
    """Word (bytes between ASCII white space) -> its token ids as little-endian uint32 bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in a row; and a
    word's ids are those of its pieces (runs of letters, digits, runs of other signs), which are remembered as words of their own.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__(CACHE_WORDS)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.wide = tokenizer.get_vocab_size() > 1 << 16
        self.letters = byte_letters()
        self.written = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        known = self.old.get(word)
        return self.keep(word, self.ids(word) if known is None else known)

    def ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one piece
            low = word.lower()
            return self.piece(low.decode()) if low == word else self[low]
        text = word.decode("utf-8")
        if not LATIN.fullmatch(text):
            normal = self.tokenizer.normalizer.normalize_str(text)
            return b"".join([self.piece(x) for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)])
        parts = LATIN_PIECES.findall(text.lower())
        if len(parts) > 1:  # a piece by itself is split no further
            return b"".join([self[x.encode()] for x in parts])
        return self.piece(parts[0] if word.isascii() else parts[0].encode().decode("latin-1").translate(self.letters))

    def piece(self, part: str) -> bytes:
        return b"".join([self.written[t.id] for t in self.model.tokenize(part)])


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache a Python worker, kept from task to task."""
    if path not in _WORDS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        _WORDS[path] = WordIds(tokenizer)
    return _WORDS[path]


_LOADED: dict[str, object] = {}


def as_loaded(path: str):
    """The tokenizer with its added tokens in force, for the few texts that hold one."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.array([end_id], dtype="<u4").tobytes()
        added = [t.content.lower() for t in words.tokenizer.get_added_tokens_decoder().values()]
        task, seen = TaskContext.get().partitionId(), {}
        for b in chunked(batches):
            ids, start = [], []
            queue = rows_of(b, "source").to_pylist()
            for q, text in zip(queue, rows_of(b, "text").to_pylist(), strict=True):
                low = (text or "").lower()
                if any(t in low for t in added):
                    doc = np.array(as_loaded(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + end
                else:
                    doc = b"".join(map(words.__getitem__, (text or "").encode("utf-8").split())) + end
                ids.append(np.frombuffer(doc, dtype="<u4").astype("<u4" if words.wide else "<u2").tobytes())
                start.append(seen.get(q, 0))
                seen[q] = start[-1] + len(doc) // 4
            n = pa.array([len(x) // (4 if words.wide else 2) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows_of(b, "doc_id"), rows_of(b, "source"), pa.array([task] * b.num_rows, pa.int32()), pa.array(start, pa.int64()), n, pa.array(ids, pa.binary())],
                ["doc_id", "source", "task", "start_in_task", "doc_tokens", "ids"],
            )

    return run


class Mixture:
    """Where the queues are cut after any number of dealt tokens."""

    def __init__(self, lengths: list[int], weights: list[float]) -> None:
        self.n, self.w = np.array(lengths, dtype=np.int64), np.array(weights, dtype=np.float64)
        self.total = int(self.n.sum())
        self.order = np.argsort(self.n / self.w, kind="stable")

    def due(self, j: np.ndarray) -> np.ndarray:
        return (j + 0.5) / self.w

    def cut(self, dealt: int) -> np.ndarray:
        """Tokens taken from each queue by the first ``dealt`` of them: the smallest by (due time, queue)."""
        if dealt >= self.total:
            return self.n.copy()
        left, weight, v = dealt, self.w.sum(), 0.0
        for s in self.order:  # until which time do the queues last?
            step = self.n[s] / self.w[s] - v
            if step * weight > left:
                v += left / weight
                break
            left, v, weight = left - step * weight, v + step, weight - self.w[s]
            if weight <= 0:
                break
        c = np.clip(np.floor(v * self.w + 0.5).astype(np.int64), 0, self.n)
        while (gap := dealt - int(c.sum())) != 0:
            self._step(c, 1 if gap > 0 else -1)
        while True:  # rounding may have left a later token in and an earlier one out
            low, high = self._edge(c, 1), self._edge(c, -1)
            if low is None or high is None or (self.due(c)[low], low) > (self.due(c - 1)[high], high):
                return c
            c[low] += 1
            c[high] -= 1

    def _edge(self, c: np.ndarray, way: int) -> int | None:
        """The queue of the next token to take (way 1), or of the last one taken (way -1)."""
        if way > 0:
            at = np.where(c < self.n, self.due(c), np.inf)
            return int(at.argmin()) if np.isfinite(at).any() else None
        at = np.where(c > 0, self.due(c - 1), -np.inf)
        return int(len(at) - 1 - at[::-1].argmax()) if np.isfinite(at).any() else None

    def _step(self, c: np.ndarray, way: int) -> None:
        c[self._edge(c, way)] += way

    def window_of(self, queue: int, j: int, window: int) -> int:
        """The window that token ``j`` of ``queue`` falls into."""
        v = (j + 0.5) / self.w[queue]
        k = int(np.minimum(self.n, v * self.w).sum()) // window
        while self.edge(k, window)[queue] > j:
            k -= 1
        while self.edge(k + 1, window)[queue] <= j:
            k += 1
        return k

    def edge(self, k: int, window: int) -> np.ndarray:
        known = self.__dict__.setdefault("_edges", {})
        if k not in known:
            if len(known) > 20_000:
                known.clear()
            known[k] = self.cut(k * window)
        return known[k]


def _cut_up(mixture_of, window: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, dtype = Mixture(*mixture_of), "<u4" if wide else "<u2"
        for b in chunked(batches, 256):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, q, at, n, raw in zip(*[rows_of(b, c).to_pylist() for c in ("doc_id", "queue", "start", "doc_tokens", "ids")], strict=True):
                ids, done, k = np.frombuffer(raw, dtype=dtype), 0, mix.window_of(q, at, window)
                while done < n:
                    here, after = mix.edge(k, window), mix.edge(k + 1, window)
                    end = min(n, int(after[q]) - at)
                    if end > done:
                        piece = ids[done:end].astype("<u4").tobytes()
                        offset = int((after[:q] - here[:q]).sum()) + at + done - int(here[q])
                        for c, v in zip(out, (doc, done, end - done, zlib.crc32(piece), n, k, offset, piece), strict=True):
                            out[c].append(v)
                        done = end
                    k += 1
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, targets: dict[str | None, float] | None = None, power: float = 1.0
) -> DataFrame:
    """documents -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    ``targets`` gives a positive weight for each source (others: 1); without it a source weighs as many tokens as it has,
    raised to ``power``: 1 lets all queues last to the end, less gives small sources a larger part of each window while they last.
    A null source is a queue of its own; null and empty texts are the end id alone; repeated rows are packed each; an empty
    table gives no pieces; further columns are ignored. Sequences are to be padded to ``window``; only the last can need it.
    One number per source, its length, reaches the driver and the tasks: the round-robin is over the queues, whose names
    are those of a mixture.
    """
    docs = require(docs, "doc_id", "text", "source")
    tokens = materialize(
        docs.mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, source string, task int, start_in_task long, doc_tokens long, ids binary")
    )
    by_task = materialize(tokens.groupBy("source", "task").agg(F.sum("doc_tokens").alias("n")))
    lengths = {r["source"]: r["n"] for r in by_task.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row per source
    used = sorted(lengths, key=lambda x: (x is not None, x))
    weights = [float(lengths[q]) ** power if targets is None else float(targets.get(q, 1.0)) for q in used]
    mixture = ([lengths[q] for q in used] or [1], weights or [1.0])
    numbers = docs.sparkSession.createDataFrame([(q, i) for i, q in enumerate(used)], "name string, queue int")
    before = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = by_task.select("source", F.col("task").alias("of_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = materialize(base.join(numbers, F.col("source").eqNullSafe(F.col("name"))).select("name", "of_task", "queue", "base"))
    placed = tokens.join(base, F.col("source").eqNullSafe(F.col("name")) & (F.col("task") == F.col("of_task"))).select(
        "doc_id", "queue", (F.col("start_in_task") + F.col("base")).alias("start"), "doc_tokens", "ids"
    )
    return placed.mapInArrow(
        _cut_up(mixture, window, word_ids(tokenizer_path).wide),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def expected_counts(mixture: Mixture, window: int) -> list[np.ndarray]:
    """Tokens of each queue in each window (for reports and tests)."""
    edges = [mixture.cut(k * window) for k in range(-(-mixture.total // window) + 1)]
    return [b - a for a, b in pairwise(edges)]
