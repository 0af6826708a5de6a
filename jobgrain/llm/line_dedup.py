"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact Jaccard, distributed union-find.

1. Each line (lower case, white space collapsed) is named by the 128-bit hash of its normal form; exact repeats are one node.
2. 48 minima over its shingles of 7 characters in 12 bands of 4: two lines of Jaccard 0.8 share a band with
   probability 0.998, of Jaccard 0.85 with 0.9998. Short lines take one minimum per hash function; long ones split a single
   hash into 48 ranges (one-permutation hashing, empty ranges borrowing from the next); between 89 and 140 shingles both.
3. In each band's bucket the members are compared with the smallest one (as many pairs as members). A task first compares the
   lines of a portion among themselves: of those that share a band only the smallest goes on to the band's bucket, so a bucket
   gets one entry for each portion at most, however many lines share it. Entries travel packed, many to a row. A line that meets
   only its repeats leaves the buckets, a bucket of two leaves one pair.
4. Buckets of three or more lines that still hold several components after union-find are compared in full, in bounded blocks
   inside tasks, so that no link inside a bucket is lost and no group's pairs are ever written out.

Bucket entries carry 64 bits of a name; as soon as texts are fetched, every distinct text (told apart by all 128 bits) is a node
with a number of its own, so lines whose 64 bits collide are compared, linked and named apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import MARKS, Forest, block_pairs, chunked, connected_components, cut, destinations, free_name, materialize, mix64, require, rows_of, text_marks

SHINGLE, BANDS, ROWS = 7, 12, 4
MINIMA = BANDS * ROWS
HASH_BITS = 44
#: Bands of both kinds of signature, as a power of two.
PLACES = 32
#: Shingle counts: signatures by many hashes below the second, by one permutation from the first on, both within.
LONG_FROM, SHORT_UNDER, SHORT_PARTNER = 89, 112, 140
#: Pairs of a block that are compared one by one.
FEW = 24
#: Of the polynomial that hashes a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lines of one block.
BLOCK = 512
#: Lines of one portion, within which repeats of a line are stored and banded once.
PORTION = 1 << 15


def normal(line: str) -> str:
    line = line.lower()
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":  # of all white space only the blank is printable
        return line
    return " ".join(line.split())


def line_keys(texts: list[str]) -> np.ndarray:
    """128-bit hashes as rows of two signed integers: the name of a line, and a check on it."""
    digests = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
    return np.frombuffer(digests, dtype="<i8").reshape(-1, 2)


def _mixed(x: np.ndarray, spare: np.ndarray) -> None:
    """``mix64`` in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=spare)
        x ^= spare
        if factor > 1:
            x *= np.uint64(factor)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): 44-bit hashes of the character shingles of all texts, distinct and sorted within each text.

    A text shorter than a shingle is one shingle. At most 2^20 texts at a time.
    """
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    short = n < SHINGLE
    if short.any():  # filled up with a sign that no text holds, and their length
        texts = [t if len(t) >= SHINGLE else t + "\uffff" * (SHINGLE - len(t)) for t in texts]
        n = np.maximum(n, SHINGLE)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    with np.errstate(over="ignore"):  # a polynomial over the 4 + 3 characters of a shingle
        two = flat[:-1] * BASE
        two += flat[1:]
        key = two[:-5] * (BASE * BASE)
        key += two[2:-3]
        key *= BASE * BASE * BASE
        three = two[4:-1]
        three *= BASE
        three += flat[6:]
        key += three
        _mixed(key, three)
    key >>= np.uint64(64 - HASH_BITS)
    line = np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(HASH_BITS)
    key |= np.repeat(line[:-1], n)[: len(key)]
    ends = np.cumsum(n)[:-1]
    first = key[ends - n[:-1]]
    for k in range(1, SHINGLE):
        key[ends - k] = first  # shingles that would reach into the next text repeat the first of theirs
    key.sort()
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]
    ends = np.searchsorted(key, line[1:])
    key &= np.uint64((1 << HASH_BITS) - 1)
    return key, ends


def _bands(minima: np.ndarray, kind: int) -> np.ndarray:
    """A key per band from (lines, MINIMA) minima; its lowest bits are the band's place."""
    m = minima.reshape(-1, BANDS, ROWS)
    place = np.broadcast_to((2 * np.arange(BANDS) + kind).astype(np.uint64), m.shape[:2])
    with np.errstate(over="ignore"):
        key = place + np.uint64(1)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key & ~np.uint64(PLACES - 1) | place


def _many_hashes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], ends[:-1]])
    seeds = mix64(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    out = np.empty((len(ends), MINIMA), dtype=np.uint64)
    h = (h >> np.uint64(HASH_BITS - 32)).astype(np.uint32)
    for k in range(0, MINIMA, ROWS):
        x = h ^ (seeds[k : k + ROWS, None] >> np.uint64(32)).astype(np.uint32)
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        out[:, k : k + ROWS] = np.minimum.reduceat(x, starts, axis=1).T
    return out


def _one_permutation(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], ends[:-1]])
    line = np.repeat(np.arange(len(ends)), ends - starts)
    bin_ = ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(MINIMA)) >> np.uint64(32)
    cell = line * MINIMA + bin_.astype(np.int64)
    # shingles are sorted by hash within a line, so cells are in order and a cell's first hash is its least
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(ends) * MINIMA, none, dtype=np.uint64)
    out[cell[first]] = h[first]
    out = out.reshape(-1, MINIMA)
    filled = out.copy()
    row, place = np.nonzero(out == none)
    for step in range(1, MINIMA):
        if not len(row):
            break
        borrowed = out[row, (place + step) % MINIMA]
        usable = borrowed != none
        with np.errstate(over="ignore"):
            filled[row[usable], place[usable]] = mix64(borrowed[usable] + np.uint64(step))
        row, place = row[~usable], place[~usable]
    return filled


def band_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, key) of all bands."""
    h, ends = shingles(texts)
    starts = np.concatenate([[0], ends[:-1]])
    n, rows, keys = ends - starts, [], []
    for kind, (make, own, lent) in enumerate(((_many_hashes, n < SHORT_UNDER, n <= SHORT_PARTNER), (_one_permutation, n >= SHORT_UNDER, n >= LONG_FROM))):
        at = np.flatnonzero(own | lent)
        if len(at):
            k = _bands(make(h[np.repeat(own | lent, n)], np.cumsum(n[at])), kind)
            rows.append(np.repeat(at, BANDS))
            keys.append(k.ravel())
    return np.concatenate(rows), np.concatenate(keys)


def _lines(batch: pa.RecordBatch):
    """(row, line number, normal form) of the lines that hold anything but white space."""
    for row, text in enumerate(rows_of(batch, "text").to_pylist()):
        for no, line in enumerate((text or "").split("\n")):
            if form := normal(line):
                yield row, no, form


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line; the text only at its first occurrence in a portion."""
    seen: set[tuple[int, int]] = set()
    for b in chunked(batches):
        carried = [c for c in b.schema.names if c != "text"]
        found = list(_lines(b))
        row, no, form = zip(*found, strict=True) if found else ((), (), ())
        key, take = line_keys(form), pa.array(row, pa.int64())
        texts: list[str | None] = list(form)
        for i, name in enumerate(map(tuple, key.tolist())):
            if name in seen:
                texts[i] = None
            else:
                seen.add(name)
        if len(seen) >= PORTION:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [*(rows_of(b, c).take(take) for c in carried), pa.array(no, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(texts, pa.string())],
            [*carried, "line_no", "key", "sum", "form"],
        )


#: A bucket's entry: the lower half of the band (the upper is the destination's), and the line's name.
ENTRY = np.dtype([("band", "<u4"), ("key", "<i8")])
MEMBER = np.dtype([("band", "<u4"), ("key", "<i8"), ("low", "<i8")])


def _bucketed(band: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(band, smallest key) of each band, sorted, and (place in that list, key) of the lines of bands that have several."""
    order = np.argsort(band)
    band, key = band[order], key[order]
    starts = cut(band)
    low = np.minimum.reduceat(key, starts)
    sizes = np.diff(starts, append=len(band))
    shared = np.repeat(sizes > 1, sizes)
    return band[starts], low, np.repeat(np.arange(len(starts)), sizes)[shared], key[shared]


def _entries(bits: int):
    """The bands of a portion's lines, packed by destination (the band's upper bits): (band, smallest key), and (band, key, smallest)
    of all lines of the bands that several of the portion's lines share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, forms, size, held, held_keys = [], [], 0, [], []

        def bands() -> None:
            row, band = band_keys(forms)
            held.append(band)
            held_keys.append(np.array(keys, dtype=np.int64)[row])

        def out() -> pa.RecordBatch:
            band, low, at, key = _bucketed(np.concatenate(held), np.concatenate(held_keys))
            dest = (band >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)  # no bits: one destination
            entries = np.empty(len(band), dtype=ENTRY)
            entries["band"], entries["key"] = band & np.uint64(0xFFFFFFFF), low
            members = np.empty(len(at), dtype=MEMBER)
            members["band"], members["key"], members["low"] = entries["band"][at], key, low[at]
            starts, ends = cut(dest), np.append(cut(dest)[1:], len(dest))
            first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
            return pa.RecordBatch.from_arrays(
                [pa.array(dest[starts]), pa.array([entries[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([members[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())],
                ["dest", "entries", "members"],
            )

        for b in batches:
            for key, form in zip(rows_of(b, "key").to_pylist(), rows_of(b, "form").to_pylist(), strict=True):
                keys.append(key)
                forms.append(form)
                size += len(form)
                if size > 100_000:
                    bands()
                    keys, forms, size = [], [], 0
                    if sum(map(len, held)) >= PORTION * BANDS:
                        yield out()
                        held.clear()
                        held_keys.clear()
        if keys:
            bands()
        if held:
            yield out()

    return run


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows, sorted."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns]


def _buckets(table: pa.Table) -> pa.Table:
    """Packed entries of one destination -> (band, key, low) of the lines of bands that hold three or more, each row once; of a
    band of two only their pair, without the band, once for all the bands they share here. A line that meets only itself has no row."""
    join = lambda c, kind: np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), dtype=kind)
    dest = np.int64(table.column("dest")[0].as_py() << 32)
    entries, members = join("entries", ENTRY), join("members", MEMBER)
    band, low, at, key = _bucketed(entries["band"], entries["key"])
    band, key, low = np.concatenate([band[at], members["band"]]), np.concatenate([key, members["key"]]), np.concatenate([low[at], members["low"]])
    band, key, low = _distinct(band, key, low)
    starts = cut(band)
    other = np.ones(len(band), dtype=bool)
    other[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
    lines = np.repeat(np.add.reduceat(other, starts, dtype=np.int64), np.diff(starts, append=len(band))) if len(band) else starts
    many, two = lines > 2, (lines == 2) & (key != low)
    ends, hubs = _distinct(key[two], low[two])
    bands = pa.array(band[many].astype(np.int64) | dest, pa.int64())
    return pa.table({"band": pa.concat_arrays([bands, pa.nulls(len(ends), pa.int64())]), "key": np.concatenate([key[many], ends]), "low": np.concatenate([low[many], hubs])})


def jaccard_at_least(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Of two sorted arrays of distinct hashes."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort()
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _split(texts: list[str]) -> list[np.ndarray]:
    h, ends = shingles(texts)
    return np.split(h, ends[:-1])


def _verify_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches, 1024):  # pairs of one text are no pairs
            b = b.filter(pc.not_equal(rows_of(b, "a"), rows_of(b, "b")))
            if not b.num_rows:
                continue
            left, right = (_split(rows_of(b, c).to_pylist()) for c in ("form_a", "form_b"))
            good = pa.array([jaccard_at_least(x, y, threshold) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows_of(b, "a").filter(good), rows_of(b, "b").filter(good)], ["a", "b"])

    return run


def _shared(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, as matrix products over the hashes that several sets hold."""
    names, column, counts = np.unique(h, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    common = counts[column] > 1
    row, column = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[common], place[column[common]]
    out = np.zeros((len(ends), len(ends)), dtype=np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 8192):
        here = (column >= at) & (column < at + 8192)
        holds = np.zeros((len(ends), 8192), dtype=np.float32)
        holds[row[here], column[here] - at] = 1
        out += holds @ holds.T
    return out


def _verify_blocks(threshold: float):
    """Links between the components that meet in a block pair.

    Lines of one component are not compared, and two lines that share several buckets are compared in that of the lowest place only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches, 16):
            a_out, b_out = [], []
            whole = rows_of(b, "bi").to_numpy() == rows_of(b, "bj").to_numpy()
            ends = np.cumsum(pc.list_value_length(rows_of(b, "items")).to_numpy())
            items = rows_of(b, "items").flatten()
            roots, sides, forms, lists = (pc.struct_field(items, c) for c in ("root", "side", "form", "bands"))
            roots, sides, held = roots.to_numpy(), sides.to_numpy(), lists.flatten().to_numpy()
            bands = np.zeros((len(items), PLACES), dtype=np.int64)
            bands[np.repeat(np.arange(len(items)), pc.list_value_length(lists).to_numpy()), held & (PLACES - 1)] = held
            for same, band, start, end in zip(whole, rows_of(b, "band").to_pylist(), [0, *ends[:-1]], ends, strict=True):
                keys, root = np.unique(roots[start:end], return_inverse=True)
                side = sides[start:end]
                i, j = np.nonzero(np.triu(root[:, None] != root[None, :]) if same else (root[:, None] != root[None, :]) & (side[:, None] < side[None, :]))
                for place in range(band & (PLACES - 1)):
                    x = bands[start:end, place]
                    if len(i) and x.any():
                        open_ = (x[i] != x[j]) | (x[i] == 0)
                        i, j = i[open_], j[open_]
                if not len(i):
                    continue
                at = np.unique(np.concatenate([i, j]))
                h, stops = shingles(forms.take(pa.array(start + at)).to_pylist())
                n, i, j = np.diff(stops, prepend=0), np.searchsorted(at, i), np.searchsorted(at, j)
                close = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-6
                i, j = i[close], j[close]
                if len(i) <= FEW:
                    sets = np.split(h, stops[:-1])
                    near = np.array([jaccard_at_least(sets[x], sets[y], threshold) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
                else:
                    both = _shared(h, stops)[i, j]
                    near = both >= threshold * (n[i] + n[j] - both) - 1e-6
                forest = Forest(len(keys))
                for x, y in zip(root[at[i[near]]].tolist(), root[at[j[near]]].tolist(), strict=True):
                    if forest.join(x, y):
                        a_out.append(int(keys[x]))
                        b_out.append(int(keys[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def line_roots(lines: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(key, sum, form) rows, repeats included -> (key, sum, root) of the lines that are similar to another one.

    ``root`` is a number that the lines of one component share.
    """
    texts = lines.where("form is not null").select("key", "sum", "form")
    bits = (destinations(lines.count() * BANDS) - 1).bit_length()  # a count of rows reads no column
    entries = texts.select("key", "form").mapInArrow(_entries(bits), "dest long, entries binary, members binary")
    met = entries.groupBy("dest").applyInArrow(_buckets, "band long, key long, low long")
    met = materialize(met, free=True)
    keys = met.select(F.explode(F.array("key", "low")).alias("key")).distinct()
    forms = texts.join(keys, "key", "left_semi").dropDuplicates(["key", "sum"])
    forms = materialize(forms.withColumn("node", F.monotonically_increasing_id()), free=True)
    side = lambda key, name: forms.select(F.col("key").alias(key), F.col("node").alias(name), F.col("form").alias(f"form_{name}"))
    twins = forms.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # distinct texts of one key
    pairs = met.where("key <> low").select("low", "key").distinct().union(twins.select("key", "key")).join(side("key", "b"), "key").join(side("low", "a"), "low")
    near = pairs.select("a", "b", "form_a", "form_b").mapInArrow(_verify_pairs(threshold), "a long, b long")
    roots = materialize(connected_components(near), free=True)
    named = met.where("band is not null").select("band", "key").distinct().join(forms.select("key", "node"), "key").join(roots, "node", "left")
    named = materialize(named.select("band", "node", F.coalesce("root", "node").alias("root")), free=True)
    mixed = named.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    rest = materialize(named.join(mixed.select("band"), "band"), free=True)
    members = rest.groupBy("node").agg(F.collect_list("band").alias("bands")).join(forms.select("node", "form"), "node")
    found = block_pairs(rest.join(members, "node"), ["band"], "node", ["root", "form", "bands"], block).select("band", "bi", "bj", "items")
    joined = connected_components(found.mapInArrow(_verify_blocks(threshold), "a long, b long"))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = joined.join(roots.select("node"), joined["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), "top")  # lines without an earlier link
    every = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(alone)
    return every.join(forms.select("key", "sum", "node"), "node").select("key", "sum", "root")


def _classes(docs: DataFrame, threshold: float, marks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One row per non-blank line: doc_id, the marks of its text (if asked for), line_no, key and sum; and (key, sum, p) with the
    first place of the class, of the lines that occur again or resemble another one. Any other line is a class of its own."""
    docs = text_marks(require(docs, "doc_id", "text")).select("doc_id", *marks, "text")
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in marks], "line_no int, key long, sum long, form string"])
    seen = materialize(docs.mapInArrow(_occurrences, schema))
    roots = line_roots(seen.select("key", "sum", "form"), threshold)
    seen = seen.drop("form")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    firsts = seen.groupBy("key", "sum").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(roots, ["key", "sum"], "left")
    firsts = materialize(firsts.where("n > 1 or root is not null"), free=True)
    linked = firsts.where("root is not null")
    least = linked.groupBy("root").agg(F.min("first").alias("p"))
    return seen, linked.join(least, "root").select("key", "sum", "p").union(firsts.where("root is null").select("key", "sum", "first"))


def line_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """documents -> one row per non-blank line: doc_id, line_no, class_doc_id, class_line_no, kept.

    A class is a component of lines linked by equality of their normal forms or by a Jaccard similarity of ``threshold``
    or more; its name, and its one kept line, is the smallest (doc_id, line_no). Blank lines, null and empty texts have no
    row. Rows that repeat a doc_id are ties: each line keeps a row, and lines that tie for the first place are all kept.
    A null doc_id counts as larger than any other. An empty table gives an empty result; further columns are ignored.
    """
    seen, named = _classes(docs, threshold)
    own = F.col("p").isNull()
    doc, line = (F.when(own, F.col(c)).otherwise(F.col(f"p.{c}")).alias(f"class_{c}") for c in ("doc_id", "line_no"))
    out = seen.join(named, ["key", "sum"], "left").select("doc_id", "line_no", doc, line)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no")))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents with only the kept and the blank lines; columns, and texts that lose no line, stay as they are.

    Lines go from the row (doc_id and text) that they stand in, so rows that share a doc_id keep their own lines, and
    rows that are equal in both lose the same ones; rows with a null doc_id take part like others.
    """
    gone = free_name(docs, "lost_lines")
    kept = F.col("doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("line_no") == F.col("p.line_no"))
    seen, named = _classes(docs, threshold, MARKS)
    lost = seen.join(named, ["key", "sum"]).where(~kept).groupBy("doc_id", *MARKS).agg(F.collect_set("line_no").alias(gone))
    names = {c: free_name(docs, c) for c in MARKS}
    text = F.col("text").cast("string")
    left = docs.withColumns({names[MARKS[0]]: F.xxhash64(text), names[MARKS[1]]: F.xxhash64(F.lit("mark"), text)})
    same = left["doc_id"].cast("long").eqNullSafe(lost["doc_id"]) & (left[names[MARKS[0]]] == lost[MARKS[0]]) & (left[names[MARKS[1]]] == lost[MARKS[1]])
    lines = F.filter(F.split(left["text"], "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    short = F.when(F.col(gone).isNull(), left["text"]).otherwise(F.array_join(lines, "\n"))
    return left.join(lost, same, "left").select(*[short.alias(c) if c == "text" else left[c] for c in docs.columns])
