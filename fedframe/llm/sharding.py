"""Immutable shards, size-tiered compaction and a versioned manifest (DataFrame functions only).

Arrivals are appended as they come, one small file a task. Shards of similar size
form a tier; tiers with enough of them are merged in one job, without a shuffle:
Spark packs whole files, ordered by size, into scan partitions of about the target
size, and each partition is written as one file. A version is a small file that
names the table's schema and its list of shards, a Parquet table, so neither plans
nor the driver grow with the number of shards. Each change writes a new list and
commits it by a rename that fails if another writer was first, which HDFS, local
disks and object stores with atomic renames promise; readers use the highest
version. A lost task is run again by Spark's own commit protocol, and a write that
dies leaves files that no version names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
#: Shards of one tier that are merged; sizes of a tier are within this factor.
FANOUT = 4
SMALLEST = 1 << 16
#: Shards that one round merges; a round follows until nothing is due.
FILES_PER_ROUND = 100_000
#: Shards in a file of a version's list.
SHARDS_PER_LIST = 500_000
SHARD = "shard string, bytes long, rows long"


class CommitConflict(RuntimeError):
    """Another writer committed the next version first."""


@dataclass(frozen=True)
class Version:
    """A committed state: its number, the table's schema as JSON, and where its list of so many shards is."""

    version: int = 0
    schema: str | None = None
    listed: str | None = None
    shards: int = 0


class ShardStore:
    """Shards of one table under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._fs = self._where("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _where(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list:
        where = self._where(name)
        return list(self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._list("manifest")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Version:
        """A version, by default the last; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Version()
        stream = self._fs.open(self._where(f"manifest/v{version:010d}.json"))
        try:
            return Version(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, old: Version, schema: str, shards: DataFrame) -> int:
        """Publish the version after old; the rename is the commit."""
        listed = f"lists/{uuid.uuid4().hex}"
        shards.coalesce(1 + old.shards // SHARDS_PER_LIST).write.parquet(f"{self.path}/{listed}")
        n = self.spark.read.schema(SHARD).parquet(f"{self.path}/{listed}").count()
        text = json.dumps(asdict(Version(old.version + 1, schema, listed, n)))
        draft, final = self._where(f"draft/{uuid.uuid4().hex}"), self._where(f"manifest/v{old.version + 1:010d}.json")
        self._fs.mkdirs(self._where("manifest"))
        stream = self._fs.create(draft, False)
        try:
            self._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {old.version + 1} exists")
        return old.version + 1

    def _write(self, df: DataFrame) -> DataFrame:
        """Write df's partitions as files: shard, bytes, rows of each that has rows."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        files = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").select("_metadata.file_name", "_metadata.file_size")
        return files.groupBy("file_name", "file_size").agg(F.count("*").alias("rows")).select(F.concat(F.lit(f"{name}/"), "file_name").alias("shard"), F.col("file_size").alias("bytes"), "rows")

    def append(self, arrivals: DataFrame) -> int:
        """Add rows as new small shards. All appends have the first one's schema; no rows add no shard."""
        last = self.manifest()
        own = T.StructType([T.StructField(f.name, f.dataType, True) for f in arrivals.schema])
        if last.schema is not None and T.StructType.fromJson(json.loads(last.schema)) != own:
            raise ValueError("the store has another schema")
        return self._commit(last, own.json(), self._shards(last).union(self._write(arrivals)))

    def _shards(self, version: Version) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(f"{self.path}/{version.listed}") if version.listed else self.spark.createDataFrame([], SHARD)

    def shards(self, version: int | None = None) -> DataFrame:
        """shard (path), bytes, rows, tier of a version; a row for each file."""
        return self._shards(self.manifest(version)).withColumn("tier", self._tier(0.0))

    def _tier(self, shift: float) -> Column:
        level = F.log(float(self.fanout), F.greatest(F.col("bytes") / F.lit(SMALLEST), F.lit(1.0)))
        return F.floor(level + F.lit(shift)).cast("int")

    def due(self, version: int | None = None) -> DataFrame:
        """The shards to merge: those below half the target, of tiers that have at least fanout of them.

        Tiers are cut twice, the second time half a tier further, so that similar
        shards on either side of a border are found too.
        """
        small = self.shards(version).where(F.col("bytes") < self.target / 2).withColumn("shifted", self._tier(0.5))
        found = []
        for tier in ("tier", "shifted"):
            full = small.groupBy(tier).count().where(F.col("count") >= self.fanout).select(tier)  # at most a row for each tier
            found.append(small.join(F.broadcast(full), tier, "left_semi").select("shard", "bytes", "rows", "tier"))
        return found[0].union(found[1]).dropDuplicates(["shard"])

    @contextmanager
    def _packed(self) -> Iterator[None]:
        """Scans that are planned inside take whole files up to the target into a partition."""
        wanted = {"spark.sql.files.maxPartitionBytes": str(self.target * 15 // 16), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def compact(self, max_rounds: int = 64) -> int:
        """Merge until no tier has enough similar shards; returns the version.

        A round is one job, a task for each file it writes. A round that would not
        leave fewer shards, as where a session fixes the scans' partitions, ends it.
        """
        for _ in range(max_rounds):
            last = self.manifest()
            gone = self.due(last.version).orderBy("tier", "bytes", "shard").limit(FILES_PER_ROUND).select("shard").collect()
            if len(gone) < 2:
                return last.version
            fields = T.StructType.fromJson(json.loads(last.schema))
            with self._packed():
                made = self._write(self.spark.read.schema(fields).parquet(*[f"{self.path}/{r.shard}" for r in gone]))
            if made.count() >= len(gone):
                return last.version
            left = self._shards(last).join(self.spark.createDataFrame(gone, "shard string"), "shard", "left_anti")
            self._commit(last, last.schema, left.union(made))
        return self.manifest().version

    def vacuum(self, keep: int = 1, grace_seconds: float = 86_400) -> int:
        """Remove data files that none of the last `keep` versions name, and older versions; returns how many files.

        Files that no version at all names may belong to a write that is yet to be
        committed: their folders stay until they are grace_seconds old.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        none = self.spark.createDataFrame([], SHARD)
        every = {}
        for name, numbers in (("old", old), ("kept", kept)):
            held = none
            for v in numbers:
                held = held.union(self._shards(self.manifest(v)))
            every[name] = held.select("shard").distinct()
        folder = F.regexp_extract("shard", "^data/([^/]+)/", 1).alias("folder")
        live = {r.folder for r in every["kept"].select(folder).distinct().collect()}  # a name for each write, not each shard
        past = {r.folder for r in every["old"].select(folder).distinct().collect()}
        removed = 0
        dead = every["old"].join(every["kept"], "shard", "left_anti")
        for r in dead.toLocalIterator():
            removed += bool(self._fs.delete(self._where(r.shard), False))
        before = (time.time() - grace_seconds) * 1000
        for x in self._list("data"):
            name = x.getPath().getName()
            if name not in live and (name in past or x.getModificationTime() <= before):
                removed += sum(f.getPath().getName().endswith(".parquet") for f in self._list(f"data/{name}"))
                self._fs.delete(x.getPath(), True)
        for v in old:
            self._fs.delete(self._where(self.manifest(v).listed), True)
            self._fs.delete(self._where(f"manifest/v{v:010d}.json"), False)
        return removed

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version (by default the last), with every column as it was appended, and if asked for the shard of each."""
        found = self.manifest(version)
        if found.schema is None:
            raise ValueError("the store is empty")
        fields = T.StructType.fromJson(json.loads(found.schema))
        paths = [f"{self.path}/{r.shard}" for r in self._shards(found).select("shard").toLocalIterator()]  # as many as Spark's own index of the scan holds
        if not paths:
            rows = self.spark.createDataFrame([], fields)
            return rows if shard_col is None else rows.withColumn(shard_col, F.lit(None).cast("string"))
        rows = self.spark.read.schema(fields).parquet(*paths)
        return rows if shard_col is None else rows.select("*", F.regexp_extract("_metadata.file_path", r"data/[^/]+/[^/]+$", 0).alias(shard_col))
