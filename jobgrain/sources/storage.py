"""Where jobs keep intermediate and versioned tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset and Spark runs locally."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Setting that deletes the shuffle files of a statement at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """A table in the shared folder: lineage is cut, and Spark knows its size where it is joined.

    ``free``: for large tables; they are packed closer, and the shuffle files of the write go with its end.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    if not free:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Version:
    """What one commit makes visible: of each table its schema and, by bucket, the folder that holds the bucket's rows (or the folders
    that this batch appended)."""

    batch: int
    schemas: dict[str, str] = field(default_factory=dict)
    buckets: dict[str, dict[str, str]] = field(default_factory=dict)
    appended: dict[str, list[str]] = field(default_factory=dict)


class VersionedTables:
    """Tables under one folder that change together, a batch at a time.

    A batch writes its files aside, in folders of its own that nobody reads yet, and then one small file, the commit, which names the
    folders of every table: its rename makes all of them visible at once. A batch that failed before that leaves folders that no commit
    names; run again it writes new ones. A batch whose commit is there is not applied twice. Tables with a key are dealt into buckets by its
    hash, and a commit takes over the folders of the buckets that its batch does not touch. Appended tables are the folders of all commits.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commit_path(self, batch: int) -> str:
        return f"{self.root}/_commits/{batch + 1:010d}.json"  # batch -1 is the start

    def batches(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) - 1 for n in names if n.endswith(".json"))

    def version(self, batch: int | None = None) -> Version:
        """The commit of a batch, or the newest."""
        batch = self.batches()[-1] if batch is None else batch
        stream = self._files.open(self._path(self._commit_path(batch)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def commit(self, version: Version) -> None:
        """Make a version visible; of two attempts at one batch the first wins."""
        aside = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._files.create(aside)
        out.write(bytearray(json.dumps(vars(version)).encode()))
        out.close()
        if not self._files.rename(aside, self._path(self._commit_path(version.batch))):
            self._files.delete(aside, False)

    def write_buckets(self, rows: DataFrame, table: str, key: str, into: Version, touched: list[int]) -> None:
        """The whole new content of the touched buckets; a bucket without rows disappears."""
        folder = f"{self.root}/{table}/batch={into.batch + 1:010d}-{uuid.uuid4().hex}"
        name = "_bucket"
        rows.withColumn(name, bucket_of(key, self.buckets)).repartition(name).write.partitionBy(name).parquet(folder)
        held = into.buckets.setdefault(table, {})
        for b in touched:
            held.pop(str(b), None)
        for status in self._files.listStatus(self._path(folder)):
            if (part := status.getPath().getName()).startswith(f"{name}="):
                held[part.removeprefix(f"{name}=")] = f"{folder}/{part}"
        into.schemas[table] = rows.schema.json()

    def append(self, rows: DataFrame, table: str, into: Version) -> None:
        folder = f"{self.root}/{table}/batch={into.batch + 1:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        into.appended[table] = [folder]
        into.schemas[table] = rows.schema.json()

    def _at(self, paths: list[str], schema: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, batch: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a batch (the newest), of some buckets or all."""
        v = self.version(batch)
        if table in v.buckets:
            return self._at([p for b, p in sorted(v.buckets[table].items()) if only is None or int(b) in only], v.schemas[table])
        found = [self.version(b) for b in self.batches() if b <= v.batch]
        return self._at([p for x in found for p in x.appended.get(table, [])], next(x.schemas[table] for x in reversed(found) if table in x.schemas))

    def next(self, batch: int) -> Version:
        """The version to build on: the newest commit, with nothing appended yet."""
        old = self.version()
        return Version(batch, dict(old.schemas), {t: dict(b) for t, b in old.buckets.items()})

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets that hold keys of ``rows``: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(bucket_of(key, self.buckets).alias("b")).distinct().collect())

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that neither the last ``keep`` commits nor appended tables name; returns how many. Not while a batch is being written."""
        versions = [self.version(b) for b in self.batches()]
        named = {p for v in versions[-keep:] for t in v.buckets.values() for p in t.values()} | {p for v in versions for t in v.appended.values() for p in t}
        gone = 0
        for table in {t for v in versions for t in v.schemas}:
            if not self._files.exists(self._path(f"{self.root}/{table}")):
                continue
            for s in self._files.listStatus(self._path(f"{self.root}/{table}")):
                at = f"{self.root}/{table}/{s.getPath().getName()}"
                if not any(p == at or p.startswith(f"{at}/") for p in named):
                    self._files.delete(s.getPath(), True)
                    gone += 1
        return gone
