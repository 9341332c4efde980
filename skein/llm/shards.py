"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import shared_dir, unused

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Merges that run side by side.
JOBS = 8


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    size: int


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A table of immutable Parquet shards. What a reader sees is the newest manifest, a list of shards.

    A version appears by one rename that fails if the version exists. Of two writers one retries on what the other left:
    appends always fit, and a merge fits while the shards that it replaces are there. Files that no manifest names, as a lost
    job leaves them, are never read. Nothing but ``vacuum`` deletes files, so older versions stay readable until it runs.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _files(self, folder: str) -> list[Shard]:
        if not self.fs.exists(self._path(folder)):
            return []
        found, top = [], self.fs.getFileStatus(self._path("")).getPath().toString()
        walk = self.fs.listFiles(self._path(folder), True)
        while walk.hasNext():
            f = walk.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                found.append(Shard(name[len(top) + 1 :], f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def _versions(self) -> list[int]:
        if not self.fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self._versions(), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        if version not in self._versions():
            raise ValueError(f"version {version} isn't there (any more)")
        stream = self.fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, after: int, shards: list[Shard]) -> int:
        temp, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{after + 1:012d}.json")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": after + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, name, options)
        except Exception as e:
            self.fs.delete(temp, False)
            raise CommitConflict(f"version {after + 1} exists") from e
        return after + 1

    def _update(self, change) -> int | None:
        """Commits ``change(shards)`` on the newest version, again after each conflict; None if it gives None."""
        while True:
            after = self.version()
            new = change(self.shards(after))
            if new is None:
                return None
            try:
                return self._commit(after, new)
            except CommitConflict:
                if self.version() <= after:  # not a conflict: the store itself fails
                    raise

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as small shards, one for each task that writes, and returns the new version."""
        run = f"data/arrival-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{run}")
        mine = [s for s in self._files(run) if s.size]
        return self._update(lambda shards: shards + mine)

    def tier(self, size: int) -> int:
        """-1 for a full shard, 0 for sizes down to a ``fanout``-th of one, 1 down to a ``fanout``-th of that, and so on."""
        return max(0, math.ceil(math.log(max(1, self.target) / max(1, size), self.fanout)) - 1) if size < self.target else -1

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of shards of one tier to merge, each of up to the target size; a tier with fewer than ``fanout`` waits."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target * 3 // 4:
                tiers.setdefault(self.tier(s.size), []).append(s)
        groups: list[list[Shard]] = []
        for _, found in sorted(tiers.items()):
            if len(found) < self.fanout:
                continue
            groups.append([])
            for s in found:
                if groups[-1] and sum(x.size for x in groups[-1]) + s.size > self.target * 5 // 4:
                    groups.append([])
                groups[-1].append(s)
        return [g for g in groups if len(g) > 1]

    def compact(self, sole: bool = False) -> int:
        """Merges until no tier is due; every round is one commit. Returns the version.

        ``sole``: nothing else reads or writes the store, so what a round has replaced is deleted at once.
        """
        while True:
            groups = self.plan(self.shards())
            if not groups:
                return self.version()
            run = f"data/merge-{uuid.uuid4().hex}"

            def merge(item, run=run):
                i, group = item
                self.read_shards(group).coalesce(1).write.parquet(f"{self.root}/{run}/{i:06d}")

            with ThreadPoolExecutor(JOBS) as pool:
                list(pool.map(merge, enumerate(groups)))
            gone, made = {s.path for g in groups for s in g}, [s for s in self._files(run) if s.size]

            def swap(shards, gone=gone, made=made):
                left = [s for s in shards if s.path not in gone]
                return left + made if len(left) + len(gone) == len(shards) else None  # None: another merge took some of them

            self._update(swap)
            if sole:
                self.vacuum(versions=1, older=0.0)

    def vacuum(self, versions: int = 10, older: float = 7 * 86_400.0) -> None:
        """Deletes files that none of the newest ``versions`` manifests names and that are ``older`` seconds old, and the
        manifests before these. ``older`` must exceed the time from a writer's first file to its commit and that of a read;
        a version that is gone can't be read, the others can."""
        newest = self.version()
        first = max(1, newest - versions + 1)
        named = {s.path for v in range(first, newest + 1) for s in self.shards(v)}
        for v in self._versions():
            if v < first:
                self.fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        until = (time.time() - older) * 1000
        for s in self._files("data"):
            if s.path not in named and self.fs.getFileStatus(self._path(s.path)).getModificationTime() <= until:
                self.fs.delete(self._path(s.path), False)

    def read_shards(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest, with ``shard int``: the place of their file in its manifest."""
        shards = self.shards(version)
        rows = self.read_shards(shards)
        path = unused(rows, "_path")
        number = self.spark.createDataFrame([(s.path, i) for i, s in enumerate(shards)], f"{path} string, shard int")
        below = F.regexp_extract(F.col("_metadata.file_path"), r"(data/(?:arrival|merge)-.*)$", 1)
        return rows.withColumn(path, below).join(F.broadcast(number), path).drop(path)  # a row for each file


def shard_documents(docs: DataFrame, root: str, arrivals: int = 4) -> ShardStore:
    """A compacted store, at a new ``root``, of all columns of ``docs``, dealt to arrivals by a hash of doc_id and text.

    Null ids and texts and repeated rows are kept as they are. An empty table gives a store without shards. Columns named
    ``shard`` are replaced when read; others may have any name but Spark's own ``_metadata``.
    """
    store = ShardStore(docs.sparkSession, root)
    run, name = f"data/arrival-{uuid.uuid4().hex}", unused(docs, "_slot")
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    docs.drop("shard").withColumn(name, slot).write.partitionBy(name).parquet(f"{store.root}/{run}")  # one pass writes all
    files = store._files(run)
    for s in range(arrivals):
        own = [f for f in files if f"/{name}={s}/" in f.path]
        if own:
            store._update(lambda shards, own=own: shards + own)
    store.compact(sole=True)
    return store


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table through four arrivals and compaction, read back: a row per document with its shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard_documents(docs, f"{shared_dir(spark)}/skein-shards-{uuid.uuid4().hex}")
    if not store.shards():
        return docs.select("doc_id", F.lit(0).alias("shard"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    return store.read().select("doc_id", "shard", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
