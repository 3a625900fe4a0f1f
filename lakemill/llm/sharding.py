"""Shards of documents with size-tiered compaction and a versioned manifest.

Arrivals are written as small immutable Parquet files. Files fall into tiers by size, each tier a few times
larger than the one before; when a tier holds enough files they are merged, until files reach the target size
and stay as they are. A manifest, one JSON file a version, lists the files of that version; a version is
committed by renaming a finished file to a name that must not exist, so it is there whole or not at all, and of
two writers of one version one fails. Readers keep to the version they opened.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Merges of one job, each of which is a part of its plan.
MERGES = 64


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


class ShardStore:
    """A folder of shards.

    ``target``: bytes of a full file (half of it counts as full); ``fan_in``: files of one tier that are merged;
    ``tier``: size ratio from one tier to the next; ``least``: files below it are all of the lowest tier.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan_in: int = 4, tier: int = 4, least: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan_in, self.tier, self.least = target, fan_in, tier, least

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest by default; that of version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "shards": []}
        path = f"{self.root}/manifest/v{version:010d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: int, shards: list[Shard], what: str) -> int:
        """Make ``shards`` version ``base + 1``; CommitConflict if that version exists."""
        jvm = self.spark._jvm
        body = json.dumps({"version": base + 1, "parent": base, "what": what, "shards": [vars(s) for s in shards]})
        fs, draft = self._fs(f"{self.root}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(body.encode())
        finally:
            out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{base + 1:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), rename)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _write(self, df: DataFrame) -> list[Shard]:
        """New files with the rows of ``df``, one a task; files without rows are left out."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        found = written.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").count()
        return [Shard(r["path"], r["count"], r["bytes"]) for r in found.orderBy("path").collect()]  # a row for each new file

    def _publish(self, change: Callable[[list[Shard]], list[Shard] | None], what: str) -> int | None:
        """Commit ``change`` of the latest version's shards, again if another writer comes first; None, and nothing is
        committed, where it says so."""
        while True:
            base = self.manifest()
            shards = change([Shard(**s) for s in base["shards"]])
            if shards is None:
                return None
            try:
                return self.commit(base["version"], shards, what)
            except CommitConflict:
                continue

    def append(self, df: DataFrame) -> int:
        """Commit the rows of ``df`` as new shards. Rows and columns are kept as they are; no rows commit no file."""
        new = self._write(df)
        return self._publish(lambda shards: shards + new, "append")

    def tier_of(self, shard: Shard) -> int | None:
        """None for full files."""
        if 2 * shard.bytes >= self.target:
            return None
        return max(0, math.ceil(math.log(max(shard.bytes, 1) / self.least, self.tier)))

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """What to merge next, each list into one file: the files of a tier that has ``fan_in`` or more, in order of
        size, as many together as the target holds. What is left over after full ones is merged if it is ``fan_in`` files."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if (t := self.tier_of(s)) is not None:
                tiers.setdefault(t, []).append(s)
        out = []
        for _, group in sorted(tiers.items()):
            if len(group) < self.fan_in:
                continue
            bins: list[list[Shard]] = [[]]
            for s in sorted(group, key=lambda s: (s.bytes, s.path)):
                if bins[-1] and sum(x.bytes for x in bins[-1]) + s.bytes > self.target:
                    bins.append([])
                bins[-1].append(s)
            out += [x for i, x in enumerate(bins) if len(x) >= self.fan_in or len(x) > 1 and i < len(bins) - 1]
        return out

    def compact(self, schema) -> int:
        """Merge until nothing is due. Each round is a version: its inputs out, its outputs in, in one commit.

        Every merge is one task that reads its files and writes one, of the target's size at most as its inputs are
        counted, and so without a shuffle. Each leaves fewer files that aren't full, so this ends. Another writer's
        commit in between is kept; where it took one of the inputs, the outputs are thrown away.
        """
        while True:
            due = self.due(self.shards())
            if not due:
                return self.manifest()["version"]
            due = due[:MERGES]
            parts = [self.spark.read.schema(schema).parquet(*(s.path for s in group)).coalesce(1) for group in due]
            merged = self._write(reduce(DataFrame.union, parts))
            gone = {s.path for group in due for s in group}
            kept = self._publish(lambda shards, gone=gone, merged=merged: [s for s in shards if s.path not in gone] + merged if gone <= {s.path for s in shards} else None, "merge")
            if kept is None:
                for s in merged:
                    fs, p = self._fs(s.path)
                    fs.delete(p, False)

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Delete folders of data of which no manifest lists a file, and unfinished manifests, that are ``older_than``
        seconds old: what writers have left that never came to commit. How many."""
        listed = {s.path.split("/")[-2] for v in self.versions() for s in self.shards(v)}
        found = []
        for folder, keep in (("data", lambda name: name in listed), ("manifest", lambda name: "draft-" not in name)):
            fs, p = self._fs(f"{self.root}/{folder}")
            found += [s for s in (fs.listStatus(p) if fs.exists(p) else []) if not keep(s.getPath().getName())]
        old = [s for s in found if time.time() - s.getModificationTime() / 1000 > older_than]
        for s in old:
            self._fs(self.root)[0].delete(s.getPath(), True)
        return len(old)

    def expire(self, keep: int = 1) -> int:
        """Delete all manifests but the last ``keep``, then the files that only those listed; how many files went.

        Files go after their manifests, so a stop between leaves files that no manifest lists, never the reverse.
        """
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        listed = {s.path for v in kept for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - listed
        for path in [f"{self.root}/manifest/v{v:010d}.json" for v in old] + sorted(gone):
            fs, p = self._fs(path)
            fs.delete(p, False)
        return len(gone)

    def read(self, schema, version: int | None = None) -> DataFrame:
        paths = [s.path for s in self.shards(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
