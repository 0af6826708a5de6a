"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with all of it, but not with the passage where it stands.
So the items are partitioned by size, and for each partition a document is cut into windows somewhat longer than the
partition's items, which overlap so far that any passage of an item's length lies inside one. An item that a window contains to
``threshold`` then has a Jaccard similarity with it above a bound that the partition's sizes give; MinHash
signatures of items and windows are banded to that bound, and item and window meet in a Spark join on (partition, band, key).
Candidates are verified by the exact containment of the item's shingles in the whole document.

Only windows that can qualify are signed: one that holds fewer benchmark shingles than the threshold asks of the smallest
item of its partition is passed over. Benchmark shingles are told by a bit table, built by Spark from the
benchmark and sized by it; what it lets through by mistake costs time and never a match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import MARKS, chunked, materialize, mix64, require, rows_of, text_marks, without_rows

SHINGLE = 5
#: Sizes of neighbouring partitions stand in this ratio.
RATIO = 1.25
#: A window is so much longer than the partition's largest item, and the next one starts so much later.
LONGER, STEP = 1.5, 0.25
#: Hash functions of a signature, and the chance of missing an item at the threshold that sets the rows of a band.
MINIMA, MISS = 48, 1e-3
#: Bits of the table of benchmark shingles: 16 for each shingle, within these powers of two (32 MB at most).
LEAST_BITS, MOST_BITS = 22, 28
SEEDS = mix64(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as the longest text so far has bytes."""

    BASE = 0x9E3779B97F4A7C15
    LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, n.bit_length())
            each = np.array([[self.BASE], [pow(self.BASE, -1, 1 << 64)]], dtype=np.uint64).repeat(size, axis=1)
            each[:, 0] = 1
            self.up, self.down = each.cumprod(axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Words:
    """The lower-case words of a text, ready to be hashed in runs: every run's hash comes from two sums over the text's bytes."""

    def __init__(self, text: str | None) -> None:
        line = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
        self.count = 0
        if line:
            flat = np.frombuffer(line, dtype=np.uint8)
            up, self.down = POWERS.of(len(flat) + 1)
            self.sums = np.zeros(len(flat) + 1, dtype=np.uint64)
            np.cumsum(Powers.LETTERS[flat] * up[:-1], out=self.sums[1:])
            spaces = np.flatnonzero(flat == 32)
            self.starts, self.ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(flat)]])
            self.count = len(self.starts)

    def shingles(self, width: int) -> np.ndarray:
        """Hashes of the runs of ``width`` words, in the order of the text, repeats included; none for a shorter text."""
        n = self.count - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        a, b = self.starts[:n], self.ends[width - 1 :]
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def partition_of(shingles: int) -> int:
    """Number of the size partition of an item with so many shingles, repeats included."""
    return math.ceil(math.log(shingles) / math.log(RATIO) - 1e-9)


@dataclass(frozen=True)
class Partition:
    """Windows of one size partition. ``width`` is below ``SHINGLE`` for items of so few words, which are one shingle."""

    width: int
    number: int
    fewest: int  # distinct shingles of the partition's smallest item

    @property
    def largest(self) -> int:
        return math.floor(RATIO**self.number + 1e-9)

    @property
    def window(self) -> int:
        return max(math.ceil(LONGER * self.largest), self.largest + self.step)

    @property
    def step(self) -> int:
        return max(1, math.floor(STEP * self.largest))

    def band_rows(self, threshold: float) -> int:
        """The most rows of a band that still miss an item at the threshold by ``MISS`` at most; one at least."""
        shared = threshold * self.fewest
        similar = shared / (self.window + self.fewest - shared)
        fits = [r for r in range(1, 9) if (1 - similar**r) ** (MINIMA // r) <= MISS]
        return max(fits, default=1)


def signature_keys(h: np.ndarray, rows: int) -> np.ndarray:
    """Band keys of a set of shingle hashes; the band's number is part of the key."""
    minima = mix64(h[None, :] ^ SEEDS[:, None]).min(axis=1)[: MINIMA // rows * rows].reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, len(minima) + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, r])
    return key.view(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunked(batches):
        width, number, shingles = [], [], []
        for text in rows_of(b, "text").to_pylist():
            words = Words(text)
            w = min(SHINGLE, words.count)
            h = words.shingles(w) if w else np.zeros(0, dtype=np.uint64)
            width.append(w)
            number.append(partition_of(len(h)) if w else 0)
            shingles.append(np.unique(h).view(np.int64))
        arrays = [rows_of(b, "item_id"), pa.array(width, pa.int32()), pa.array(number, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["item_id", "width", "number", "shingles"])


def _item_keys(rows: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches):
            shingles = rows_of(b, "shingles")
            keys = [signature_keys(s.values.to_numpy().view(np.uint64), rows[p]) for s, p in zip(shingles, zip(rows_of(b, "width").to_pylist(), rows_of(b, "number").to_pylist(), strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(rows_of(b, c) for c in ("item_id", "width", "number")), pa.array(keys, pa.list_(pa.int64()))], ["item_id", "width", "number", "keys"]
            )

    return run


def _document_windows(table: bytes, bits: int, partitions: list[Partition], threshold: float):
    """Per document: its benchmark shingles, and the (partition, key) of the bands of every window that can qualify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(table, dtype=np.uint8)
        plans = {w: [(p.number, p.window, p.step, p.band_rows(threshold), math.ceil(threshold * p.fewest - 1e-9)) for p in partitions if p.width == w] for w in sorted({p.width for p in partitions})}

        def known(h: np.ndarray) -> np.ndarray:
            slot = h >> np.uint64(64 - bits)
            return packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1

        for b in chunked(batches):
            out = {k: [] for k in ("at", "hits", "width", "number", "keys")}
            for at, text in enumerate(rows_of(b, "text").to_pylist()):
                words, hits, found = Words(text), [], []
                for w, plan in plans.items():
                    h = words.shingles(w)
                    place = np.flatnonzero(known(h)) if len(h) else np.zeros(0, dtype=np.int64)
                    if not len(place):
                        continue
                    hits.append(h[place])
                    for number, window, step, rows, need in plan:
                        if len(place) < need:
                            continue
                        back = -(-window // step)
                        starts = np.unique(place // step - np.arange(back)[:, None])
                        starts = starts[starts >= 0] * step
                        held = np.searchsorted(place, starts + window) - np.searchsorted(place, starts)
                        found += [(w, number, signature_keys(h[s : s + window], rows)) for s in starts[held >= need].tolist()]
                if found:
                    out["at"].append(at)
                    out["hits"].append(np.unique(np.concatenate(hits)).view(np.int64))
                    out["width"].append([f[0] for f in found for _ in f[2]])
                    out["number"].append([f[1] for f in found for _ in f[2]])
                    out["keys"].append(np.concatenate([f[2] for f in found]))
            take, ints, longs = pa.array(out["at"], pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(rows_of(b, c).take(take) for c in ("doc_id", *MARKS)), pa.array(out["hits"], longs), pa.array(out["width"], ints), pa.array(out["number"], ints), pa.array(out["keys"], longs)],
                ["doc_id", *MARKS, "hits", "width", "number", "keys"],
            )

    return run


def _bit_table(items: DataFrame) -> tuple[bytes, int]:
    """Bits of the leading bits of all benchmark shingles, put together by Spark in blocks of 4 KB."""
    shingles = items.select(F.explode("shingles").alias("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * shingles.count()).bit_length()))
    slot = (F.shiftrightunsigned("h", 64 - bits) + 1).cast("long")
    blocks = shingles.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    table = bytearray(1 << (bits - 3))
    for r in blocks.collect():  # 2^MOST_BITS bits at most
        table[(r["block"] - 1) * 4096 : r["block"] * 4096] = bytes(r["bits"])
    return bytes(table), bits


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """doc_id, marks, item_id, n_item, n_shared, containment of each row of ``docs`` and each item that it holds."""
    items = require(benchmark, "item_id", "text").where("item_id is not null").mapInArrow(_items, "item_id long, width int, number int, shingles array<long>")
    items = materialize(items.where("width > 0").distinct())
    parts = items.groupBy("width", "number").agg(F.min(F.size("shingles")).alias("fewest")).collect()  # partitions: the logarithm of the largest item
    partitions = [Partition(r["width"], r["number"], r["fewest"]) for r in parts]
    rows = {(p.width, p.number): p.band_rows(threshold) for p in partitions}
    table, bits = _bit_table(items)
    marked = text_marks(require(docs, "doc_id", "text"))
    marks = ", ".join(f"{c} long" for c in MARKS)
    hits = marked.mapInArrow(
        _document_windows(table, bits, partitions, threshold), f"doc_id long, {marks}, hits array<long>, width array<int>, number array<int>, keys array<long>"
    )
    hits = materialize(hits.withColumn("row", F.monotonically_increasing_id()))
    bands = ["width", "number", "key"]
    windows = hits.select("row", F.explode(F.arrays_zip("width", "number", F.col("keys").alias("key"))).alias("x")).select("row", "x.width", "x.number", F.col("x.key").alias("key"))
    signed = items.mapInArrow(_item_keys(rows), "item_id long, width int, number int, keys array<long>").select("item_id", "width", "number", F.explode("keys").alias("key"))
    met = windows.join(signed, bands).select("row", "item_id").distinct()
    shared = F.size(F.array_intersect("hits", "shingles"))
    exact = met.join(hits.drop("width", "number", "keys"), "row").join(items.select("item_id", "shingles"), "item_id")
    exact = exact.select("doc_id", *MARKS, "item_id", F.size("shingles").alias("n_item"), shared.alias("n_shared"))
    return exact.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold - 1e-12)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """documents, benchmark (item_id, text) -> doc_id, item_id, n_item, n_shared, containment of at least ``threshold``.

    Shingles are distinct runs of five words; an item of fewer words is a single shorter shingle and is found wherever its words
    stand in a row. Null and empty texts hold nothing and are held by nothing. Repeated doc_ids give one row for their best
    copy, and an item_id with several texts one row for its best text; rows with a null id are left out; empty tables give
    an empty result; further columns are ignored.
    """
    found = _found(docs, benchmark, threshold).where("doc_id is not null")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows that hold no benchmark item; rows that share a doc_id, or have none, are judged each by its text."""
    return without_rows(docs, _found(docs, benchmark, threshold))
