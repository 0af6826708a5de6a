"""Embedding near-duplicates by sorted projection passes.

Each pass orders all vectors lexicographically by a word of random hyperplane signs and compares every vector
with its neighbours inside a window of the sorted order. Two vectors at the angle t agree in a sign with
probability 1 - t/pi, so a pass surely finds a pair if both agree in the leading k signs and the run of rows that share
them is no larger than the window. Every pass reports the k of each row (none where the run touches the edge of its
range partition), so dense regions count as what they are: rows for which the passes so far leave a pair just at the
threshold a chance above ``miss`` go into a further round among themselves, and where more passes would cost more than
comparing those rows with each other, they are compared exactly. Passes run a few at a time, so that their shuffles need
not all be kept. Verified pairs of all passes are united (as forests, never as all pairs of a group).

Vectors are not shuffled with the passes: a row carries its sort key and a code, the unit vector in 16-bit integers, with a
bound on its error. Two codes decide a pair unless their cosine is within both bounds of the threshold; those few pairs are
sent on by their numbers and verified on the vectors themselves, in double precision, by a join.

Then the direct links of every vector are counted exactly inside its component, block against block:
whatever a window was too narrow for is found there, so large groups of copies lose no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import Forest, block_pairs, connected_components, materialize, require, rows_of

#: Neighbours on either side that a vector is compared with in a pass.
WINDOW = 1024
#: Vectors of one block when links are counted inside a component.
BLOCK = 2048
#: Vectors of one block when rows of dense regions are compared exactly.
DENSE_BLOCK = 4096
#: Passes of one round at most.
ROUND = 8
#: What single-precision products of unit vectors add to the error of the codes.
ROUNDING = 2e-5
SIGNS = 62


def passes_for(rows: int, threshold: float, window: int, miss: float) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    found = agree ** (max(0.0, math.log2(max(rows, 1) / window)) + 1)
    return max(4, math.ceil(math.log(miss) / math.log(1 - min(found, 1 - 1e-9))))


def _unit(col: pa.Array) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _gains(keys: np.ndarray, threshold: float, window: int) -> np.ndarray:
    """Of the sorted keys of one pass in one partition: -log of the chance that the pass misses a pair at the threshold.

    Each row counts with the fewest leading signs whose run is no larger than the window, and with 0 if that run
    touches an edge of the partition, as it may go on in the next one.
    """
    n, low, high = len(keys), np.zeros(len(keys), dtype=np.int64), np.full(len(keys), SIGNS + 1, dtype=np.int64)

    def run(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = (keys >> (SIGNS - k)) << (SIGNS - k)
        return np.searchsorted(keys, start), np.searchsorted(keys, start + (np.int64(1) << (SIGNS - k)))

    while (low < high).any():
        k = np.minimum((low + high) // 2, SIGNS)
        first, end = run(k)
        fits = (end - first <= window + 1) & (first > 0) & (end < n)
        low, high = np.where((low < high) & ~fits, k + 1, low), np.where((low < high) & fits, k, high)
    agree = 1 - math.acos(threshold) / math.pi
    return np.where(low <= SIGNS, -np.log1p(-np.minimum(agree ** low.astype(float), 1 - 1e-9)), 0.0)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit integers, the scale of each, and the length of what was lost (rounded up)."""
    scale = np.abs(x).max(axis=1) / 32767
    code = np.rint(x / scale[:, None]).astype("<i2")
    lost = np.linalg.norm(x - code * scale[:, None], axis=1)
    return code, scale, np.nextafter(lost.astype(np.float32), np.float32(1)).astype(np.float64)


def _signs(passes: int, seed: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = rows_of(b, "dims").to_numpy()
            key, code = np.zeros((b.num_rows, passes), dtype=np.int64), [b""] * b.num_rows
            scale, lost = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for d in np.unique(dims):  # vectors of another length are a world of their own
                at = np.flatnonzero(dims == d)
                x = _unit(rows_of(b, "vec").take(pa.array(at)))
                planes = np.random.default_rng([seed, int(d), turn]).standard_normal((int(d), passes * SIGNS))
                bits = (x @ planes > 0).reshape(len(at), passes, SIGNS)
                key[at] = bits @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                short, scale[at], lost[at] = encode(x)
                for i, c in zip(at.tolist(), short, strict=True):
                    code[i] = c.tobytes()
            arrays = [rows_of(b, "vid"), rows_of(b, "dims"), pa.array(code, pa.binary()), pa.array(scale), pa.array(lost), pa.array(list(key), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["vid", "dims", "code", "scale", "lost", "keys"])

    return run


def _windows(window: int, threshold: float):
    """Rows arrive sorted by (dims, pass, key) within the partition; a run may go on in the next batch.

    Rows out: links (sure), pairs to be verified (not sure), and the gain of each row.
    """

    def links(ids: np.ndarray, x: np.ndarray, lost: np.ndarray, new: int) -> tuple[list, list, list]:
        """Forest of the sure links between the last ``new`` rows and the ``window`` rows before each, and the unsure pairs."""
        forest, a, b, sure = Forest(len(ids)), [], [], []
        for at in range(len(ids) - new, len(ids), 256):
            lo, hi = max(0, at - window), min(at + 256, len(ids))
            cosine = x[at:hi] @ x[lo:hi].T
            slack = ROUNDING + (lost[at:hi, None] + lost[None, lo:hi]) * 1.01
            near = np.argwhere(cosine >= threshold - slack)
            gap = near[:, 0] + at - near[:, 1] - lo
            near = near[(gap > 0) & (gap <= window)]
            certain = cosine[near[:, 0], near[:, 1]] >= threshold + slack[near[:, 0], near[:, 1]]
            for known in (True, False):
                for i, j in near[certain == known].tolist():
                    if forest.find(at + i) != forest.find(lo + j):
                        if known:
                            forest.join(at + i, lo + j)
                        a.append(int(ids[at + i]))
                        b.append(int(ids[lo + j]))
                        sure.append(known)
        return a, b, sure

    def out(a: list, b: list, sure: list, vid: np.ndarray, gain: np.ndarray) -> pa.RecordBatch:
        pairs, rows = len(a), len(vid)
        with_nulls = lambda first, second, kind: pa.concat_arrays([pa.array(first, kind), pa.array(second, kind)])
        return pa.RecordBatch.from_arrays(
            [with_nulls(a, [None] * rows, pa.int64()), with_nulls(b, [None] * rows, pa.int64()), with_nulls(sure, [None] * rows, pa.bool_()),
             with_nulls([None] * pairs, vid, pa.int64()), with_nulls([None] * pairs, gain, pa.float64())],
            ["a", "b", "sure", "vid", "gain"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None
        seen: list[tuple] = []  # ids and keys of the world that is being read

        def gains() -> tuple[np.ndarray, np.ndarray]:
            ids, keys = (np.concatenate(c) for c in zip(*seen, strict=True))
            seen.clear()
            return ids, _gains(keys, threshold, window)

        for b in batches:
            ids, dims, turn, keys, scale, lost = (rows_of(b, c).to_numpy() for c in ("vid", "dims", "pass", "key", "scale", "lost"))
            edges = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (turn[1:] != turn[:-1])) + 1), len(ids)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                code = np.frombuffer(b"".join(rows_of(b, "code").slice(lo, hi - lo).to_pylist()), dtype="<i2").reshape(hi - lo, -1)
                x, own, loss, world = (code * scale[lo:hi, None]).astype(np.float32), ids[lo:hi], lost[lo:hi], (dims[lo], turn[lo])
                if tail and tail[0] == world:
                    own, x, loss = (np.concatenate(c) for c in zip(tail[1:], (own, x, loss), strict=True))
                elif seen:
                    yield out([], [], [], *gains())
                seen.append((ids[lo:hi], keys[lo:hi]))
                yield out(*links(own, x, loss, hi - lo), np.empty(0, np.int64), np.empty(0))
                tail = (world, own[-window:], x[-window:], loss[-window:])
        if seen:
            yield out([], [], [], *gains())

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = rows_of(b, "vec_a"), rows_of(b, "vec_b")
            dims, good = np.diff(left.offsets.to_numpy()), np.zeros(b.num_rows, dtype=bool)
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                good[at.to_numpy()] = (_unit(left.take(at)) * _unit(right.take(at))).sum(axis=1) >= threshold
            yield pa.RecordBatch.from_arrays([rows_of(b, c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    return run


def _dense_links(threshold: float):
    """Forest of the links between rows of different roots, block against block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = rows_of(b, "items")
            ends, flat = items.offsets.to_numpy(), items.flatten()
            same = rows_of(b, "bi").to_numpy() == rows_of(b, "bj").to_numpy()
            ids, side, roots = (flat.field(c).to_numpy() for c in ("id", "side", "root"))
            vec, at0 = flat.field("vec"), ends[0]
            a, c = [], []
            for k in range(b.num_rows):
                lo, hi = int(ends[k] - at0), int(ends[k + 1] - at0)
                x, s, r, own, forest = _unit(vec.slice(lo, hi - lo)), side[lo:hi], roots[lo:hi], ids[lo:hi], Forest(hi - lo)
                left, right = (np.arange(hi - lo),) * 2 if same[k] else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
                for at in range(0, len(left), 256):
                    near = left[at : at + 256]
                    for i, j in zip(*np.nonzero((x[near] @ x[right].T >= threshold) & (r[near][:, None] != r[right])), strict=True):
                        if forest.join(int(near[i]), int(right[j])):
                            a.append(int(own[near[i]]))
                            c.append(int(own[right[j]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _count_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = rows_of(b, "items")
            ends, flat = items.offsets.to_numpy(), items.flatten()
            same = rows_of(b, "bi").to_numpy() == rows_of(b, "bj").to_numpy()
            ids, side, copies = (flat.field(c).to_numpy() for c in ("id", "side", "copies"))
            vec, at0 = flat.field("vec"), ends[0]
            id_out, n_out = [], []
            for k in range(b.num_rows):
                lo, hi = int(ends[k] - at0), int(ends[k + 1] - at0)
                x, s, m = _unit(vec.slice(lo, hi - lo)), side[lo:hi], copies[lo:hi]
                left, right = (np.arange(hi - lo),) * 2 if same[k] else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
                other = np.zeros(len(right), dtype=np.int64)
                for at in range(0, len(left), 512):
                    rows = left[at : at + 512]
                    near = x[rows] @ x[right].T >= threshold
                    if same[k]:
                        near[np.arange(len(rows)), rows] = False
                    else:
                        other += near.T @ m[rows]
                    id_out += ids[lo:hi][rows].tolist()
                    n_out += (near @ m[right]).tolist()
                if not same[k]:
                    id_out += ids[lo:hi][right].tolist()
                    n_out += other.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(id_out, pa.int64()), pa.array(n_out, pa.int64())], ["vid", "n"])

    return run


def _passes(distinct: DataFrame, n: int, threshold: float, window: int, miss: float, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Links that the sorted passes find, and the rows (vid, dims, vec) to be compared with each other exactly, if any.

    A pair is settled if one of its rows is, so later rounds see the open rows only.
    """
    links, rows, done, turn = None, distinct.select("vid", "dims", "vec", F.lit(0.0).alias("had")), 0, 0
    passes = min(passes_for(n, threshold, window, miss), ROUND)
    vectors = lambda side: distinct.select(F.col("vid").alias(side), F.col("vec").alias(f"vec_{side}"))
    while True:
        signed = rows.select("vid", "dims", "vec").mapInArrow(
            _signs(passes, seed, turn), "vid long, dims int, code binary, scale double, lost double, keys array<long>"
        )
        dealt = signed.select("vid", "dims", "code", "scale", "lost", F.posexplode("keys").alias("pass", "key"))
        parts = max(1, min(-(-n * passes // (16 * window)), 100_000))
        dealt = dealt.repartitionByRange(parts, "dims", "pass", "key", "vid").sortWithinPartitions("dims", "pass", "key", "vid")
        found = materialize(dealt.mapInArrow(_windows(window, threshold), "a long, b long, sure boolean, vid long, gain double"))
        unsure = found.where("not sure").select("a", "b").distinct().join(vectors("b"), "b").join(vectors("a"), "a")
        verified = unsure.select("a", "b", "vec_a", "vec_b").mapInArrow(_verify(threshold), "a long, b long")
        forest = materialize(found.where("sure").select("a", "b").union(verified))
        links = forest if links is None else links.union(forest)
        done, turn = done + passes, turn + 1
        gained = found.where("vid is not null").groupBy("vid").agg(F.sum("gain").alias("gain"))
        rows = rows.join(gained, "vid").withColumn("had", F.col("had") + F.col("gain")).drop("gain").where(F.col("had") < -math.log(miss))
        rows = materialize(rows)
        needs = F.when(F.col("had") > 0, (F.lit(-math.log(miss)) - F.col("had")) * done / F.col("had")).otherwise(F.lit(1e15))
        n, more = rows.agg(F.count("*"), F.percentile_approx(needs, 0.9)).first()
        if n == 0:
            return links, None
        if n <= 2 * window * more:
            return links, rows.select("vid", "dims", "vec")
        passes = max(1, min(math.ceil(more), ROUND))


def embedding_components(
    vectors: DataFrame, threshold: float = 0.9, window: int = WINDOW, miss: float = 1e-4, seed: int = 7, block: int = BLOCK
) -> DataFrame:
    """(vec_id, embedding) -> one row per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Links join vectors of one length whose cosine, in double precision, is ``threshold`` or more. Null, empty or
    zero vectors and those with null or non-finite components link with nothing. Equal vectors are one node with
    a count, and are each other's links. Repeated vec_ids stay repeated; rows with a null vec_id are kept as they are
    (kept is then null); an empty table gives an empty result; further columns are ignored.
    """
    rows = require(vectors, "vec_id", "embedding").withColumnRenamed("embedding", "vec")
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = rows.withColumn("vec", F.when(sound, F.transform("vec", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))))
    rows = rows.withColumns({"ha": F.when(sound, F.xxhash64("vec")), "hb": F.when(sound, F.xxhash64(F.lit("vector"), F.col("vec")))})  # equal vectors have equal names
    distinct = rows.where("vec is not null and vec_id is not null").groupBy("ha", "hb").agg(
        F.min("vec_id").alias("owner"), F.count("*").alias("copies"), F.first("vec").alias("vec")
    )
    distinct = materialize(distinct.select("ha", "hb", "owner", "copies", F.size("vec").alias("dims"), "vec", F.monotonically_increasing_id().alias("vid")))
    n = distinct.count()
    links, dense = _passes(distinct, n, threshold, window, miss, seed)
    roots = materialize(connected_components(links))
    if dense is not None:
        near = dense.join(roots.withColumnRenamed("node", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
        more = materialize(block_pairs(near, ["dims"], "vid", ["root", "vec"], DENSE_BLOCK).select("bi", "bj", "items").mapInArrow(_dense_links(threshold), "a long, b long"))
        if not more.isEmpty():
            roots = materialize(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    inside = roots.withColumnRenamed("node", "vid").join(distinct, "vid").select("root", "vid", "vec", "copies")
    counted = block_pairs(inside, ["root"], "vid", ["vec", "copies"], block).select("bi", "bj", "items").mapInArrow(_count_links(threshold), "vid long, n long")
    counted = counted.groupBy("vid").agg(F.sum("n").alias("n"))
    named = distinct.drop("vec").join(roots.withColumnRenamed("node", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    least = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = named.join(least, "root").join(counted, "vid", "left").select("ha", "hb", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = rows.select("vec_id", "ha", "hb").join(named, ["ha", "hb"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
