"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits (the last padded with zeros to 23). The
perfect binary Golay code puts every 23-bit word within 3 bits of exactly one codeword, and the codewords
within 4 bits of a word are one (if the word is at most 2 bits from its codeword) or six. If two words differ
in at most one bit, then the nearest codeword of either is within 4 bits of the other.

Of at most 3 differing bits over three segments (pigeonhole), either some segment has none, and then another has one
at most, or each has exactly one. For the first case a fingerprint gives the keys (whole segment i, each codeword
near segment j), for the second (nearest of the first, near ones of the others) and (near ones of the first, nearest
of the others): one's nearest codeword is near the other's word, so linked fingerprints always share a key. Recall is
complete; keys have 30 to 36 bits, so unlinked fingerprints rarely meet, and a fingerprint has 77 of them at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import MARKS, Forest, block_pairs, chunked, connected_components, destinations, materialize, mix64, packed, require, rows_of, shared_keys, text_marks, unpacked, without_rows

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY_GENERATOR = 0b101011100011
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Distinct fingerprints of one block when a key is shared by many.
BLOCK = 2048


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the systematic code (a codeword's index is its upper 12 bits): remainder by index, error by syndrome, and by
    syndrome the index differences from the nearest codeword to the other five within 4 bits (-1: there are none)."""
    rest = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY_GENERATOR << (bit - 11), 0)
    masks = [0]
    for k in range(23):
        masks += [m | 1 << k for m in masks if m.bit_count() < 3]
    heavy = [w for i in range(4096) if (w := i << 11 | int(rest[i])).bit_count() == 7]
    error = np.zeros(2048, dtype=np.int64)
    others = np.full((2048, 5), -1, dtype=np.int64)
    for m in masks:
        s = int(rest[m >> 11]) ^ m & 2047
        error[s] = m
        if m.bit_count() == 3:  # the codewords of weight 7 over these 3 bits lie 4 bits away
            others[s] = [w >> 11 for w in heavy if w & m == m]
    return rest, error, others


def golay_near(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word: the index of its nearest codeword, then those of the others within 4 bits or -1."""
    rest, error, others = golay_tables()
    s = rest[words >> 11] ^ words & 2047
    nearest = (words ^ error[s]) >> 11
    more = others[s]
    return np.concatenate([nearest[:, None], np.where(more < 0, -1, nearest[:, None] ^ more)], axis=1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority of the XXH64 bits (seed 42) of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= width:
        spans = [(0, len(line))]
    else:
        starts = [0, *ends[: len(words) - width].tolist()]
        spans = list(zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), 1 << 16):
        h = np.array([digest(line[a:b], 42) for a, b in spans[i : i + (1 << 16)]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(spans))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunked(batches):
        f = np.array([fingerprint(t) for t in rows_of(b, "text").to_pylist()], dtype=np.uint64).view(np.int64)
        carried = ["doc_id", *MARKS]
        yield pa.RecordBatch.from_arrays([*(rows_of(b, c) for c in carried), pa.array(f)], [*carried, "fp"])


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint, without repeats within a row."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    near = [golay_near(x) for x in seg]
    keys = []
    for i, j in permutations(range(3), 2):
        keys.append(np.where(near[j] < 0, -1, (3 * i + j) << 36 | seg[i][:, None] << 12 | near[j]))
    second, third = np.repeat(near[1], 6, axis=1), np.tile(near[2], 6)
    for parts in ((near[0][:, :1], second, third), (near[0][:, 1:], near[1][:, :1], near[2][:, :1])):
        missing = (parts[0] < 0) | (parts[1] < 0) | (parts[2] < 0)
        keys.append(np.where(missing, -1, 9 << 36 | parts[0] << 24 | parts[1] << 12 | parts[2]))
    keys = np.concatenate(keys, axis=1)
    row = np.repeat(np.arange(len(fps)), keys.shape[1])
    keep = keys.ravel() >= 0
    return row[keep], keys.ravel()[keep]


#: Keys of a fingerprint, about.
KEYS = 64


def _keys(dests: int):
    """(key, fingerprint) entries, packed by destination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches, 4096):
            fps = rows_of(b, "fp").to_numpy(zero_copy_only=False)
            row, key = golay_keys(fps)
            out = packed(np.stack([key, fps[row]], axis=1), mix64(key.view(np.uint64)) % np.uint64(dests))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["dest", "entries"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(key, fp) of the keys that several fingerprints of one destination have."""
    rows, _ = shared_keys(unpacked(table, "entries", 2))
    return pa.table({"key": rows[:, 0], "fp": rows[:, 1]})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the true links of each block pair."""
    for b in batches:
        a_out, b_out = [], []
        items = rows_of(b, "items")
        ends = items.offsets.to_numpy()
        flat = items.flatten()
        side, fp = flat.field("side").to_numpy(), flat.field("id").to_numpy().view(np.uint64)
        same = rows_of(b, "bi").to_numpy() == rows_of(b, "bj").to_numpy()
        lo = ends[0]
        for k in range(b.num_rows):
            s, f = side[ends[k] - lo : ends[k + 1] - lo], fp[ends[k] - lo : ends[k + 1] - lo]
            left = np.arange(len(f)) if same[k] else np.flatnonzero(s == 0)
            right = left if same[k] else np.flatnonzero(s == 1)
            forest = Forest(len(f))
            for at in range(0, len(left), 256):
                d = np.bitwise_count(f[left[at : at + 256], None] ^ f[None, right])
                for i, j in zip(*np.nonzero(d <= 3), strict=True):
                    if forest.join(x := int(left[at + i]), y := int(right[j])):
                        a_out.append(f[x])
                        b_out.append(f[y])
        arrays = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a_out, b_out)]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def simhash_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``fp`` (long) -> forest of links (a, b) between those at most 3 bits apart."""
    n = fps.count()
    spread = fps.repartition(max(1, -(-n // 16_384)), "fp")  # a row becomes some sixty entries
    entries = spread.mapInArrow(_keys(destinations(n * KEYS)), "dest long, entries binary")
    keys = materialize(entries.groupBy("dest").applyInArrow(_shared, "key long, fp long"))
    return block_pairs(keys, ["key"], "fp", [], block).select("bi", "bj", "items").mapInArrow(_verify, "a long, b long")


def _components(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, the marks of its text, fp, component_id."""
    marks = ", ".join(f"{c} long" for c in MARKS)
    prints = materialize(text_marks(require(docs, "doc_id", "text")).mapInArrow(_fingerprints, f"doc_id long, {marks}, fp long"))
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(simhash_links(first.select("fp")))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """documents -> one row per row: doc_id, fp (long), component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node, so a
    group of copies costs one key set. Rows with a null doc_id stay, and count as larger than any other id.
    Repeated rows stay repeated; an empty table gives an empty result; further columns are ignored.
    """
    return _components(docs).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the rows with the smallest doc_id.

    Rows go by doc_id and text, so of rows that share a doc_id each is judged by its own component; rows with a null id
    stay.
    """
    return without_rows(docs, _components(docs).where("doc_id is not null and doc_id <> component_id"))
