"""Shared pieces of the training-data operators.

* ``materialize`` cuts lineage with a Parquet table in the shared checkpoint folder, so that a lost
  executor costs only the tasks after the cut.
* ``connected_components`` is distributed union-find by alternating large-star and small-star steps.
* ``block_pairs`` splits groups of any size into bounded blocks whose pairs are compared inside tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Narrow rows of one file.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where it is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which a query's shuffle files go as soon as it has ended, instead of when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, rows: int | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; narrow rows whose number is known go to few files.

    ``free``: the shuffle files of the write go with its end.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, rows // FILE_ROWS))
    before = df.sparkSession.conf.get(CLEANUP, None)
    if free:
        df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and before is None:
            df.sparkSession.conf.unset(CLEANUP)
        elif free:
            df.sparkSession.conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more (later tables do not need them to recover)."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_marks(df: DataFrame) -> DataFrame:
    """``df`` with two columns that name its text by 128 bits, so that rows which share a doc_id can be told apart."""
    return df.withColumns({MARKS[0]: F.xxhash64("text"), MARKS[1]: F.xxhash64(F.lit("mark"), F.col("text"))})


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) ``gone`` names by doc_id and marks; nulls equal nulls."""
    names = {c: free_name(docs, c) for c in MARKS}
    left = docs.withColumns({
        names[MARKS[0]]: F.xxhash64(F.col("text").cast("string")), names[MARKS[1]]: F.xxhash64(F.lit("mark"), F.col("text").cast("string"))
    })
    right = gone.select("doc_id", *MARKS).distinct()
    same = left["doc_id"].cast("long").eqNullSafe(right["doc_id"])
    for c in MARKS:
        same = same & (left[names[c]] == right[c])
    return left.join(right, same, "left_anti").select(docs.columns)


#: Types that the operators work with.
TYPES = {"doc_id": "long", "vec_id": "long", "item_id": "long", "text": "string", "source": "string", "toxic": "int"}
#: Columns of ``text_marks``.
MARKS = ("text_mark_a", "text_mark_b")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns in their types, so that further columns of the input can never clash with ours."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).cast(TYPES[c]).alias(c) if c in TYPES else F.col(c) for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of any orderable type -> (node, root): root is the smallest node reachable.

    Nodes without a link to another node do not appear. Each round is one large-star and one small-star step on edges
    (u, v), v < u. Only a node with a smaller neighbour moves its edges, so the root of a star, however large, is never
    grouped, and its edges stay as they are. Smallest neighbours are combined map-side and written before they are joined, so
    that Spark sees two plain shuffles and can split a hot node's rows. The rounds end when every node has one edge, to a node
    that has none, after a number of them that grows with the logarithm of the longest chain. Tables of a round are deleted with the next.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = materialize(e.distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

    while True:
        n = e.count()
        low = materialize(e.groupBy("u").agg(F.min("v").alias("m")), n)
        over = low.select(F.col("u").alias("v"), "m")
        large = materialize(e.join(over, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")), n)
        if low.count() == n and large.where("moved").isEmpty():
            release(low, large)
            break
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), n)
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = materialize(least.select("u", F.col("m").alias("v")).union(hung).distinct(), n)
        release(e, low, large, least)
        e = done
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v"), F.col("v")).distinct())


def block_pairs(rows: DataFrame, key: list[str], ident: str, payload: list[str], block: int) -> DataFrame:
    """Groups of two or more rows as blocks to compare: (key..., bi, bj, items).

    A group of n rows becomes ceil(n / block) blocks by a hash of ``ident``, and every pair of blocks is one
    row whose ``items`` array holds (side, ident, payload...) of both blocks, about 2 * block at most. So
    every pair of a group meets in exactly one row (rows of one block in the row bi = bj), no task holds a
    whole group, and no pair is written out.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    nb = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    dealt = rows.join(sizes, key).withColumn("_nb", nb)
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(ident), F.col("_nb")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    item = F.struct(
        F.when(F.col("_b") <= F.col("_o"), 0).otherwise(1).alias("side"), F.col(ident).alias("id"), *[F.col(c) for c in payload]
    )
    return (
        dealt.withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
        .groupBy(*key, "bi", "bj").agg(F.collect_list(item).alias("items")).where(F.size("items") > 1)
    )


#: Entries that are packed into one destination, on average.
ENTRIES = 1 << 20


def destinations(entries: int) -> int:
    return max(1, -(-entries // ENTRIES))


def packed(values: np.ndarray, dest: np.ndarray) -> dict[int, bytes]:
    """Rows of an array of 64-bit integers as bytes by destination."""
    order = np.argsort(dest, kind="stable")
    values, dest = values[order], dest[order]
    cuts = np.flatnonzero(np.diff(dest)) + 1
    return {int(d[0]): v.tobytes() for v, d in zip(np.split(values, cuts), np.split(dest, cuts), strict=True) if len(d)}


def unpacked(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype=np.int64).reshape(-1, width)


def cut(order_key: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.concatenate([[0], np.flatnonzero(order_key[1:] != order_key[:-1]) + 1]) if len(order_key) else np.zeros(0, dtype=np.int64)


def shared_keys(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, member) rows of keys with several members, and the smallest member of each row's key."""
    e = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    keep = np.ones(len(e), dtype=bool)
    keep[1:] = (e[1:] != e[:-1]).any(axis=1)
    e = e[keep]
    first = np.ones(len(e), dtype=bool)
    first[1:] = e[1:, 0] != e[:-1, 0]
    shared = ~first
    shared[:-1] |= shared[1:]
    low = e[first][np.cumsum(first) - 1, 1] if len(e) else e[:, 1]
    return e[shared], low[shared]


class Memo(dict):
    """What was computed for the keys seen of late: at most ``most`` new ones, and those of the time before."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Forest:
    """Union-find over the few items of one block pair."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def chunked(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that long texts do not pile up."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, on an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
