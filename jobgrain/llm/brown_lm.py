"""Brown class n-grams: exchange clustering, class transitions and word emissions, smoothed document scores.

Every training word belongs to one class, which the exchange algorithm gives it: in rounds, a word moves to the class under which
its neighbours and its own emission are likeliest, given class transitions measured before, as is usual when the algorithm is distributed. All
words take part in every round, half of them by turns so that mutual neighbours do not swap forever. Each round measures the likelihood of the
class bigrams; a round that loses is taken back, and the rounds end when they gain little.

No vocabulary reaches the driver or a broadcast. Tasks cut the corpus into chunks of half a million tokens, written once as numbers of the chunk's own
words in the order of their hashes. Buckets are ranges of hashes, so a chunk's words of a bucket stand in a row. In a round the buckets send each chunk the
classes of its words; the chunk counts the classes to the left and right of each word and sends these counts, packed by bucket; a bucket adds them up as they
come and moves its words. So rows that travel hold many words, and a task holds one chunk or the counts of one bucket's words, however large the corpus is.

log10 P(w | previous word) = log10 of  a * P(class(w) | class(previous)) * P(w | class(w)) + (1 - a) * P(w), where
P(w | class) = (c(w) + 0.5) / (N_class + 0.5 * (V_class + 1)), the last term standing for unseen words, transitions are
smoothed by their unigrams, and P(w) is the base model. An unseen word has the class that most training words with its
ending have. A document begins and ends at the end token.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import chunked, materialize, mix64, release, require, rows_of

ENDINGS, CLASSES = 1 << 11, 64
#: Rounds at most, and the share of the likelihood that a round must gain for another one to follow.
ROUNDS, STALL = 6, 1e-3
CLASS_SHARE, TRANSITION_PRIOR = 0.9, 8.0
#: The end token cannot be a word, as words hold no white space.
END = b" "
#: Tokens of a chunk, and pairs of a chunk and one of its words that a bucket holds, about.
CHUNK, SPREAD = 1 << 19, 1 << 17
#: The class of words that the training rows do not hold.
UNSEEN = 255


def tokens(text: bytes | str | None) -> list[bytes]:
    """ASCII-lower-cased words; the end token is implied."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()


def trains(doc_id: int | None) -> bool:
    """crc32 of the id as text, mod 5, is not 1 (a null id trains)."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def ending(word: bytes) -> int:
    """The group of a word by its last three letters, signs at the end left out."""
    return zlib.crc32(word.rstrip(b".,;:!?|\"')(")[-3:]) % ENDINGS


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


TABLE = "chunk long, tokens binary, words binary, counts binary, n_words long, doc_ids array<long>, sizes binary, train binary"


def by_hash(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words by (hash, word), and their hashes in it."""
    h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if len(same):  # a few words share a hash
        tied = np.unique(np.concatenate([same, same + 1]))
        order[tied] = sorted(order[tied].tolist(), key=lambda i: (h[i], words[i]))
    return order, h[order]


def _encode(chunk: int):
    """Chunks of documents: an end token, then each document's words and an end token, as numbers of the chunk's words (0: the end token; others by hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), count()

        def empty():
            number = defaultdict(count().__next__)
            number[END]
            return number, [np.zeros(1, dtype=np.int32)], [], [], []

        def out() -> pa.RecordBatch:
            words = list(number)[1:]
            order, _ = by_hash(words)
            place = np.zeros(len(number), dtype=np.int32)
            place[order + 1] = np.arange(1, len(number))
            flat = place[np.concatenate(parts)]
            mask = np.repeat(np.array(train, dtype=bool), np.array(sizes, dtype=np.int64) + 1)
            counts = np.bincount(flat[1:][mask], minlength=len(number)).astype(np.int32)
            row = [task << 32 | next(made), pack(flat), pack(b"\n".join([words[i] for i in order])), pack(counts), len(number), ids, pack(np.array(sizes, dtype=np.int32)), pack(np.array(train, dtype=bool))]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in TABLE.split(", ")])

        number, parts, ids, sizes, train = empty()
        held = 0
        for b in chunked(batches):
            for d, text in zip(rows_of(b, "doc_id").to_pylist(), rows_of(b, "text").cast(pa.binary()), strict=True):
                w = tokens(text.as_py())
                if ids and held + len(w) > chunk:
                    yield out()
                    number, parts, ids, sizes, train = empty()
                    held = 0
                parts += [np.fromiter(map(number.__getitem__, w), np.int32, len(w)), np.zeros(1, dtype=np.int32)]
                ids.append(d)
                sizes.append(len(w))
                train.append(trains(d))
                held += len(w) + 1
        if ids:
            yield out()

    return run


def words_of(packed: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(packed)
    return text.split(b"\n") if text else []


def _spread(buckets: int):
    """(bucket, chunk, words, counts): each chunk's words by buckets, which are ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, packed, counts in zip(*(rows_of(b, c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                words, c = words_of(packed), unpack(counts, "<i4")[1:]
                if not words:
                    continue
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)]
                spans = list(pairwise(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([chunk] * len(spans), pa.int64()), pa.array([pack(b"\n".join(words[x:y])) for x, y in spans], pa.binary()), pa.array([pack(c[x:y]) for x, y in spans], pa.binary()),
                ], ["bucket", "chunk", "words", "counts"])

    return run


NUMBERED = "bucket int, chunk long, a binary, b binary, c binary"


def _number(rows: pa.Table) -> pa.Table:
    """The words of a bucket (chunk null: endings, first classes, counts), and for each chunk the numbers here of the words that it has, in its order."""
    bucket, chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
    lists = [words_of(x) for x in rows.column("words").to_pylist()]
    seen: dict[bytes, int] = {}
    for words in lists:
        for w in words:
            seen.setdefault(w, len(seen))
    names = list(seen)
    order, _ = by_hash(names)
    number = np.empty(len(names), dtype=np.int32)
    number[order] = np.arange(len(names), dtype=np.int32)
    total, mine = np.zeros(len(names), dtype=np.int64), []
    for words, counts in zip(lists, rows.column("counts").to_pylist(), strict=True):
        at = number[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))]
        total[at] += unpack(counts, "<i4")
        mine.append(pack(np.diff(at, prepend=np.int32(0))))
    ends = np.array([ending(names[i]) for i in order], dtype=np.int16)
    first = np.where(total > 0, ends % (CLASSES - 1), UNSEEN).astype(np.uint8)
    n = len(chunks)
    return pa.table({
        "bucket": pa.array([bucket] * (n + 1), pa.int32()), "chunk": pa.array([None, *chunks], pa.int64()), "a": pa.array([ends.tobytes(), *mine], pa.binary()), "b": pa.array([first.tobytes()] + [None] * n, pa.binary()),
        "c": pa.array([total.tobytes()] + [None] * n, pa.binary()),
    })


STATE = "bucket int, classes binary, counts binary, endings binary"
ANSWER = "chunk long, bucket int, number binary, class binary, count binary"
MESSAGE = "bucket int, number binary, cells binary, cell binary, n binary, big binary"


def _answers(counts: bool):
    """To each chunk the classes (and counts) of its words in a bucket."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        classes = np.frombuffer(state.column("classes")[0].as_py(), dtype=np.uint8)
        total = np.frombuffer(state.column("counts")[0].as_py(), dtype=np.int64)
        numbers = [np.cumsum(unpack(x, "<i4")) for x in asked.column("a").to_pylist()]
        return pa.table({
            "chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "number": asked.column("a"),
            "class": pa.array([pack(classes[x]) for x in numbers], pa.binary()), "count": pa.array([pack(total[x]) if counts else None for x in numbers], pa.binary()),
        })

    return run


class Chunk:
    """The tokens of a chunk, and what the buckets say of its words: bucket by bucket they are all of them in order."""

    def __init__(self, row: pa.Table, answers: pa.Table) -> None:
        first = lambda c, kind: unpack(row.column(c)[0].as_py(), kind)
        self.flat, self.sizes, self.train = first("tokens", "<i4"), first("sizes", "<i4").astype(np.int64), first("train", bool)
        order = np.argsort(answers.column("bucket").to_numpy(), kind="stable") if answers.num_rows else np.zeros(0, dtype=np.int64)
        answers = answers.take(pa.array(order, pa.int64()))
        self.buckets, self.numbers = answers.column("bucket").to_pylist(), answers.column("number").to_pylist()
        classes = [unpack(x, np.uint8) for x in answers.column("class").to_pylist()]
        self.starts = np.cumsum([1, *map(len, classes)])
        self.classes = np.concatenate([np.array([CLASSES - 1], dtype=np.uint8), *classes])
        counts = [x for x in answers.column("count").to_pylist() if x is not None]
        self.counts = np.concatenate([np.zeros(1, dtype=np.int64), *(unpack(x, "<i8") for x in counts)])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours in training documents: (word, word before it)."""
        at = np.flatnonzero(np.repeat(self.train, self.sizes + 1)) + 1
        return self.flat[at], self.flat[at - 1]


def _meet(neighbours: bool):
    """A chunk's class bigrams (bucket -1), and for each bucket the classes beside its words: how many cells each word has, the cells, and their counts (large ones apart)."""

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        x = Chunk(row, answers)
        word, before = x.pairs()
        of = x.classes.astype(np.int32 if len(x.classes) < 1 << 24 else np.int64)
        matrix = np.bincount(of[before] * CLASSES + of[word], minlength=CLASSES * CLASSES).astype(np.int64)
        rows = [(-1, b"", b"", matrix.tobytes(), b"", b"")]
        if neighbours:
            keys = np.concatenate([(word * (2 * CLASSES) + of[before])[word > 0], (before * (2 * CLASSES) + CLASSES + of[word])[before > 0]])
            keys.sort()
            at = np.flatnonzero(np.diff(keys, prepend=-1))
            n = np.diff(at, append=len(keys))
            keys = keys[at]
            per_word = np.bincount(keys // (2 * CLASSES), minlength=len(of)).astype(np.uint8)
            ends = np.searchsorted(keys, x.starts * (2 * CLASSES))
            cell, low = (keys % (2 * CLASSES)).astype(np.uint8), np.minimum(n, 255).astype(np.uint8)
            for k, bucket in enumerate(x.buckets):
                a, b = ends[k], ends[k + 1]
                rows.append((bucket, x.numbers[k], pack(per_word[x.starts[k] : x.starts[k + 1]]), pack(cell[a:b]), pack(low[a:b]), n[a:b][low[a:b] == 255].astype(np.int64).tobytes()))
        names = [f.split()[0] for f in MESSAGE.split(", ")]
        return pa.table([pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return run


def worth(matrix: np.ndarray) -> np.ndarray:
    """What a neighbour of a class (before the word: the first rows, after it: the others) adds to each class that the word may take.

    Log transitions, and the emission, which favours small classes: the word's share of a class is its count over the class's tokens.
    """
    log_p = np.log((matrix + 0.1) / (matrix.sum(1, keepdims=True) + 0.1 * CLASSES))
    out = np.concatenate([log_p - np.log(matrix.sum(0) + 1.0), log_p.T])
    out[:, CLASSES - 1] = -np.inf  # the end token's own class
    return out


def best_classes(word: np.ndarray, cell: np.ndarray, n: np.ndarray, per_cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of (word, cell, count) entries, sorted by word, and the class under which each one's neighbours and its emission are likeliest.

    Words with many entries come first, so the k-th entries of those that have as many are added in one step.
    """
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    entries = np.diff(starts, append=len(word))
    order = np.argsort(-entries, kind="stable")
    best, per_cell = np.empty(len(starts), dtype=np.uint8), per_cell.astype(np.float32)
    for lo in range(0, len(starts), TOGETHER):
        some = order[lo : lo + TOGETHER]
        first, many = starts[some], entries[some]
        value = np.zeros((len(some), CLASSES), dtype=np.float32)
        for k in range(many[0]):
            have = int(np.searchsorted(-many, -k, side="left"))  # entries above k
            at = first[:have] + k
            value[:have] += per_cell[cell[at]] * n[at, None].astype(np.float32)
        best[some] = value.argmax(1)
    return word[starts], best


#: Words that are weighed together, and entries that a bucket holds before equal ones are added up.
TOGETHER, HELD = 1 << 13, 1 << 22


class Cells:
    """Counts of a bucket's (word, neighbour's class) cells, added up as they come: as many entries as there are cells at most, and some that wait."""

    def __init__(self) -> None:
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        if self.size > HELD:
            keys, n = self.summed()
            self.keys, self.n, self.size = [keys], [n], min(len(keys), HELD // 2)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[at], np.add.reduceat(n[order], at) if len(at) else n


def _move(matrix: np.ndarray | None, turn: int):
    """Rows sorted by bucket, its state first -> its next state. Bucket -1 gives the sum of class bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, cells, bigrams = None, None, Cells(), np.zeros(CLASSES * CLASSES, dtype=np.int64)
        per_cell = None if matrix is None else worth(matrix)

        def out() -> pa.RecordBatch:
            if now < 0:
                row = [now, bigrams.tobytes(), b"", b""]
            else:
                classes, (keys, n) = np.frombuffer(state[0], dtype=np.uint8).copy(), cells.summed()
                word, best = best_classes(keys // (2 * CLASSES), keys % (2 * CLASSES), n, per_cell)
                if turn:
                    mine = (mix64(word.astype(np.uint64) ^ np.uint64(now) << np.uint64(32)) & np.uint64(1)) == turn % 2
                    word, best = word[mine], best[mine]
                classes[word] = best
                row = [now, classes.tobytes(), *state[1:]]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["bucket", "classes", "counts", "endings"])

        for b in batches:
            for bucket, is_state, classes, counts, endings, number, per_word, cell, n, big in zip(*(rows_of(b, c).to_pylist() for c in ("bucket", "is_state", "classes", "counts", "endings", "number", "cells", "cell", "n", "big")), strict=True):
                if bucket != now:
                    if now is not None:
                        yield out()
                    now, state, cells = bucket, (classes, counts, endings), Cells()
                if is_state:
                    continue
                if bucket < 0:
                    bigrams += np.frombuffer(cell, dtype=np.int64)
                    continue
                n = unpack(n, np.uint8).astype(np.int64)
                n[n == 255] = np.frombuffer(big, dtype=np.int64)
                word = np.repeat(np.cumsum(unpack(number, "<i4"), dtype=np.int64), unpack(per_word, np.uint8))
                cells.add(word * (2 * CLASSES) + unpack(cell, np.uint8), n)
        if now is not None:
            yield out()

    return run


def likelihood(matrix: np.ndarray) -> float:
    """Of the training tokens under the class bigrams, but for a constant of the words' own counts."""
    part = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return part(matrix) - part(matrix.sum(1)) - part(matrix.sum(0))


@dataclass
class Corpus:
    """The written chunks, dealt by chunk, and which chunk has which words of which bucket."""

    chunks: DataFrame
    asked: DataFrame

    def answered(self, state: DataFrame, counts: bool = False) -> DataFrame:
        return self.asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(_answers(counts), ANSWER)

    def pass_over(self, state: DataFrame, matrix: np.ndarray | None, turn: int = 0) -> tuple[DataFrame, np.ndarray]:
        """The next state if there are transitions to move by (else the same), and the class bigrams of this one."""
        state.sparkSession.sparkContext._jvm.System.gc()  # else the shuffle files of past rounds stay until the driver happens to collect its garbage
        met = self.chunks.groupBy("chunk").cogroup(self.answered(state).groupBy("chunk")).applyInArrow(_meet(matrix is not None), MESSAGE)
        message, own = [f.split()[0] for f in MESSAGE.split(", ")], [f.split()[0] for f in STATE.split(", ")]
        none = lambda names: [F.lit(None).cast("binary").alias(c) for c in names]
        rows = met.select("bucket", F.lit(False).alias("is_state"), *none(own[1:]), *message[1:])
        if matrix is not None:
            rows = rows.union(state.select("bucket", F.lit(True), *own[1:], *none(message[1:])))
        ordered = rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("is_state"))
        moved = materialize(ordered.mapInArrow(_move(matrix, turn), STATE))
        sums = [np.frombuffer(r["classes"], dtype=np.int64) for r in moved.where("bucket < 0").collect()]  # one row
        total = sum(sums, np.zeros(CLASSES * CLASSES, dtype=np.int64)).reshape(CLASSES, CLASSES).astype(np.float64)
        if matrix is None:
            release(moved)
            return state, total
        next_ = moved.where("bucket >= 0")
        next_.table_path = moved.table_path
        return next_, total


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([rows_of(b, c) for c in ("bucket", "b", "c", "a")], ["bucket", "classes", "counts", "endings"])


def read_corpus(docs: DataFrame, chunk: int = CHUNK, spread: int = SPREAD) -> tuple[Corpus, DataFrame, DataFrame]:
    """The chunks of (doc_id, text), the first state of the buckets (words by their endings), and the table of chunks."""
    table = materialize(docs.mapInArrow(_encode(chunk), TABLE))
    pairs = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, -(-pairs // spread))
    each = table.select("chunk", "words", "counts").mapInArrow(_spread(buckets), "bucket int, chunk long, words binary, counts binary")
    numbered = materialize(each.groupBy("bucket").applyInArrow(_number, NUMBERED))
    state = materialize(numbered.where("chunk is null").mapInArrow(_first, STATE))
    # each round meets the chunks where they lie: dealt into as many partitions as the answers are
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = table.select("chunk", "tokens", "sizes", "train").repartition(n, "chunk").persist(StorageLevel.DISK_ONLY)
    return Corpus(chunks, numbered.where("chunk is not null").select("bucket", "chunk", "a")), state, table


def exchange(corpus: Corpus, state: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """The state after the rounds, its class bigrams, and the likelihood before the first round and after each that stays.

    A round moves words by the class bigrams of the state before, which the pass over the corpus measures on the way.
    """
    _, matrix = corpus.pass_over(state, None)
    kept, reached, by = (state, matrix), [likelihood(matrix)], matrix
    for r in range(rounds):
        moved, matrix = corpus.pass_over(state, by, r)  # the class bigrams are those of the state that the words move from
        if r:
            value = likelihood(matrix)
            if value < reached[-1]:
                return (*kept, reached)
            kept, by = (state, matrix), matrix
            reached.append(value)
            if r > 1 and value - reached[-3] < STALL * abs(value):  # both halves have had their turn
                return (*kept, reached)
        state = moved
    _, matrix = corpus.pass_over(state, None)
    if likelihood(matrix) >= reached[-1]:
        kept = (state, matrix)
        reached.append(likelihood(matrix))
    return (*kept, reached)


@dataclass(frozen=True)
class ClassModel:
    """What every task knows: classes of endings, log10 weight of each class pair, and the counts behind them."""

    endings: np.ndarray
    weight: np.ndarray
    n: int
    v: int
    end_count: int
    matrix: np.ndarray
    likelihoods: list[float] = field(default_factory=list)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and words of each class, and words of each ending by class, of some buckets."""
    size, by_ending = np.zeros((2, CLASSES), dtype=np.int64), np.zeros(ENDINGS * CLASSES, dtype=np.int64)
    for b in batches:
        for classes, counts, ends in zip(*(rows_of(b, c).to_pylist() for c in ("classes", "counts", "endings")), strict=True):
            k, c, e = np.frombuffer(classes, dtype=np.uint8).astype(np.int64), np.frombuffer(counts, dtype=np.int64), np.frombuffer(ends, dtype=np.int16).astype(np.int64)
            seen = c > 0
            size[0] += np.bincount(k[seen], weights=c[seen], minlength=CLASSES).astype(np.int64)
            size[1] += np.bincount(k[seen], minlength=CLASSES)
            by_ending += np.bincount(e[seen] * CLASSES + k[seen], minlength=len(by_ending))
    yield pa.RecordBatch.from_arrays([pa.array([size.tobytes()], pa.binary()), pa.array([by_ending.tobytes()], pa.binary())], ["size", "by_ending"])


def fit(docs: DataFrame, rounds: int = ROUNDS, chunk: int = CHUNK, spread: int = SPREAD) -> tuple[ClassModel, Corpus, DataFrame, DataFrame]:
    """The model, the corpus, the final state of the buckets, and the table of chunks."""
    corpus, first, table = read_corpus(docs, chunk, spread)
    state, matrix, reached = exchange(corpus, first, rounds)
    size, by_ending = np.zeros((2, CLASSES), dtype=np.int64), np.zeros((ENDINGS, CLASSES), dtype=np.int64)
    for r in state.coalesce(8).mapInArrow(_totals, "size binary, by_ending binary").collect():  # eight rows of a megabyte at most
        size += np.frombuffer(r["size"], dtype=np.int64).reshape(2, CLASSES)
        by_ending += np.frombuffer(r["by_ending"], dtype=np.int64).reshape(ENDINGS, CLASSES)
    end = int(matrix[:, CLASSES - 1].sum())  # only the end token has the last class
    size[:, CLASSES - 1] += end, int(end > 0)
    n, v = int(size[0].sum()), int(size[1].sum())
    unigram = (matrix.sum(0) + 1) / (matrix.sum() + CLASSES)
    transition = (matrix + TRANSITION_PRIOR * unigram) / (matrix.sum(1, keepdims=True) + TRANSITION_PRIOR)
    emission = 1 / (size[0] + 0.5 * (size[1] + 1))
    weight = np.log10(CLASS_SHARE * transition * emission + (1 - CLASS_SHARE) / (n + 0.5 * (v + 1)))
    return ClassModel(by_ending.argmax(1), weight, n, v, end, matrix, reached), corpus, state, table


SCORED = "doc_id long, held_out boolean, n long, known long, logs double, link double"


def _score(model: ClassModel):
    """Per document of a chunk: its tokens, those known, and the two parts of the score."""

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        x = Chunk(row, answers)
        x.counts[0] = model.end_count
        unseen = np.flatnonzero(x.classes == UNSEEN)
        if len(unseen):
            words = words_of(row.column("words")[0].as_py())
            x.classes[unseen] = [model.endings[ending(words[i - 1])] for i in unseen]
        word, before = x.flat[1:], x.flat[:-1]
        starts = np.cumsum(x.sizes + 1) - x.sizes - 1
        sums = lambda v: np.add.reduceat(v, starts)
        of = x.classes.astype(np.int64)
        return pa.table({
            "doc_id": row.column("doc_ids").combine_chunks().flatten(), "held_out": pa.array(~x.train), "n": pa.array(x.sizes + 1), "known": pa.array(sums((x.counts > 0).astype(np.int64)[word])),
            "logs": pa.array(sums(np.log10(x.counts + 0.5)[word])), "link": pa.array(sums(model.weight[of[before], of[word]])),
        })

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row.

    Null texts count as empty: the end token alone. Rows with a null id train and are scored; repeated rows count and are
    scored each; without training rows every token is unseen; an empty table gives an empty result; further columns
    are ignored. A task holds a chunk of half a million tokens, or one longer text at some 60 bytes a token.
    """
    model, corpus, state, table = fit(require(docs, "doc_id", "text"))
    chunks = table.select("chunk", "tokens", "words", "doc_ids", "sizes", "train")
    rows = materialize(chunks.groupBy("chunk").cogroup(corpus.answered(state, counts=True).groupBy("chunk")).applyInArrow(_score(model), SCORED))
    corpus.chunks.unpersist()
    logs, link = F.col("logs"), F.col("link")
    return rows.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (logs - F.col("n") * F.lit(math.log10(model.n + 0.5 * (model.v + 1)))).alias("base_score"), (logs + link).alias("score"), F.pow(F.lit(10.0), -(logs + link) / F.col("n")).alias("perplexity"),
    )
