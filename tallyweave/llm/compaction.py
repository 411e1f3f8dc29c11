"""Sharding by size-tiered compaction.

A store is a folder: ``data/<id>/`` holds immutable Parquet shards, ``manifest/`` one JSON file for each version, and
``intent/`` an empty file for each folder that is being written. Arrivals are appended as small shards. Compaction takes
shards of one size tier (powers of ``FANOUT``), packs runs of at least ``MIN_RUN`` of them, in order of arrival, into
files of about the target size, and goes on while a tier still has such a run. Shards of three quarters of the target
are left alone.

A version lists the shards that it adds and removes; behind every ``SNAPSHOT_EVERY``-th one a snapshot file lists all, so
a version costs what it changes and a reader opens few files. It appears by a rename that fails where the version exists
already, so readers see all of a change or nothing. Of two writers one finds its version taken and plans again on top
of it: an append as it is, a merge if all its shards are still listed, else with new bins. The store needs a file system
with such a rename (HDFS and local ones have it); object stores without one may let two writers make the same version.

``vacuum`` deletes shards that no kept version lists. It spares what a writer has announced by an intent: data is listed
before intents and these before versions, so a folder without an intent has been committed by then or is left over.

Merging reads whole shards and writes each bin in one task of about the target size; it does not shuffle.

Defined results
---------------
* The table read at a version has exactly the rows appended up to it, repeated rows and nulls included; an append of
  no rows is a version with the same shards. A store without versions cannot be read.
* All appends have the columns of the first, whatever their names.
* Arrivals of ``append_batches`` become versions in order of their values, numbers by size, a null last. An empty table
  is one arrival without shards.
* The order of rows is not kept. A failed append or merge leaves files that no manifest lists, and an intent that
  counts for ``INTENT_HOURS``. Texts are carried, however long; a shard is never split.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm import common

TARGET_BYTES = 128 << 20
FANOUT, MIN_RUN, BASE_BYTES = 4, 4, 1 << 20
#: Bins merged by one job.
BINS_PER_JOB = 200
#: Versions from one that lists all shards to the next.
SNAPSHOT_EVERY = 16
#: A writer that has announced itself longer ago is taken for dead.
INTENT_HOURS = 7 * 24


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


def tier(size: int) -> int:
    """0 below ``BASE_BYTES * FANOUT``, then one more for every factor of ``FANOUT``."""
    return max(0, int(math.log(max(size, 1) / BASE_BYTES, FANOUT)))


def plan_bins(shards: tuple[Shard, ...], target: int = TARGET_BYTES) -> list[list[Shard]]:
    """The merges of one round: bins of two or more shards of one tier, up to the target size."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < 0.75 * target:
            tiers.setdefault(tier(s.bytes), []).append(s)
    bins: list[list[Shard]] = []
    for _, own in sorted(tiers.items()):
        if len(own) < MIN_RUN:
            continue
        now: list[Shard] = []
        made: list[list[Shard]] = []
        for s in own:
            if now and sum(x.bytes for x in now) + s.bytes > target:
                made.append(now)
                now = []
            now.append(s)
        bins += [b for b in [*made, now] if len(b) > 1]
    return bins


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        fs, where = common.file_system(self.spark, f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(kind + r"(\d+)\.json", n)))

    def versions(self) -> list[int]:
        return self._numbers("v")

    def _raw(self, kind: str, version: int) -> dict:
        fs, where = common.file_system(self.spark, f"{self.path}/manifest/{kind}{version:012d}.json")
        read = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray
        stream = fs.open(where)
        try:
            return json.loads(bytes(read(stream)).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version, or the last one: the snapshot before it, and what the versions since add and remove."""
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"{self.path} has no version {version if version is not None else ''}")
        version = found[-1] if version is None else version
        start = max((n for n in self._numbers("s") if n <= version), default=0)
        step = self._raw("s", start) if start else {"add": {}}
        shards = dict(step["add"])
        for n in range(start + 1, version + 1):
            step = self._raw("v", n)
            for path in step["remove"]:
                del shards[path]
            shards.update(step["add"])
        return Manifest(version, step["schema"], tuple(Shard(p, n) for p, n in shards.items()))

    def _create(self, kind: str, version: int, content: dict) -> bool:
        """Write a manifest file; False where it exists already."""
        jvm = self.spark.sparkContext._jvm
        fs, draft = common.file_system(self.spark, f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        out.write(json.dumps(content).encode())
        out.close()
        _, final = common.file_system(self.spark, f"{self.path}/manifest/{kind}{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)  # refuses to overwrite
        except Exception:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise
        return True

    def _snapshot(self, of: Manifest) -> None:
        self._create("s", of.version, {"schema": of.schema, "add": {s.path: s.bytes for s in of.shards}})

    def _commit(self, last: Manifest | None, schema: str, add: list[Shard], remove: set[str]) -> Manifest:
        """The version behind ``last``; raises Conflict where another writer has made it."""
        before = last.shards if last else ()
        made = Manifest(last.version + 1 if last else 1, schema, tuple(s for s in before if s.path not in remove) + tuple(add))
        if not self._create("v", made.version, {"schema": schema, "add": {s.path: s.bytes for s in add}, "remove": sorted(remove)}):
            raise Conflict(f"version {made.version} exists")
        if made.version % SNAPSHOT_EVERY == 0:
            self._snapshot(made)
        return made

    @contextmanager
    def _writing(self) -> Iterator[str]:
        """A new data folder, announced by an intent until what is done with it is committed."""
        name = uuid.uuid4().hex
        fs, mark = common.file_system(self.spark, f"{self.path}/intent/{name}")
        fs.mkdirs(mark.getParent())
        fs.create(mark, False).close()
        yield f"data/{name}"
        fs.delete(mark, False)

    def _announced(self) -> set[str]:
        """Names of the data folders of writers that are taken to be alive."""
        fs, where = common.file_system(self.spark, f"{self.path}/intent")
        alive = time.time() - 3600 * INTENT_HOURS
        found = fs.listStatus(where) if fs.exists(where) else []
        return {f.getPath().getName() for f in found if f.getModificationTime() / 1000 >= alive}

    def _listed(self, folder: str) -> list[Shard]:
        """The Parquet files under a folder, in order of their names; paths relative to the store."""
        fs, where = common.file_system(self.spark, f"{self.path}/{folder}")
        found, files = [], fs.listFiles(where, True) if fs.exists(where) else None
        while files is not None and files.hasNext():
            f = files.next()
            full = f.getPath().toString()
            if full.endswith(".parquet"):
                found.append(Shard(folder + full.split(folder, 1)[1], f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def _added(self, schema: str, shards: list[Shard]) -> Manifest:
        """Commit an arrival on top of whatever is there."""
        while True:
            last = self.manifest() if self.versions() else None
            try:
                return self._commit(last, last.schema if last else schema, shards, set())
            except Conflict:
                continue

    def append(self, df: DataFrame) -> Manifest:
        """One arrival: its rows become shards as they are partitioned."""
        with self._writing() as folder:
            df.write.parquet(f"{self.path}/{folder}")
            return self._added(df.schema.json(), self._listed(folder))

    def append_batches(self, df: DataFrame, batch) -> Manifest:
        """Several arrivals in one job: the rows of each value of ``batch`` are an arrival and a version of their own."""
        name = "__batch"
        while name in map(str.lower, df.columns):
            name += "_"
        with self._writing() as folder:
            named = df.withColumn(name, batch)
            named.write.partitionBy(name).parquet(f"{self.path}/{folder}")
            number = isinstance(named.schema[name].dataType, T.NumericType)
            arrivals: dict[tuple, list[Shard]] = {}
            for s in self._listed(folder):
                value = s.path.rsplit("/", 2)[1].removeprefix(f"{name}=")
                last = value == "__HIVE_DEFAULT_PARTITION__"
                arrivals.setdefault((last, Decimal(value) if number and not last else value), []).append(s)
            made = None
            for _, own in sorted(arrivals.items()) or [("", [])]:
                made = self._added(df.schema.json(), own)
            return made

    def _frame(self, schema: str, shards: list[Shard] | tuple[Shard, ...]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        # files below a folder named after a batch value are read as they are, without a column for it
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        return self._frame(found.schema, found.shards)

    def compact(self, target: int = TARGET_BYTES) -> Manifest:
        """Merge until no tier holds a run; one version for each round."""
        while bins := plan_bins((last := self.manifest()).shards, target):
            gone = {s.path for b in bins for s in b}
            with self._writing() as folder:
                for at in range(0, len(bins), BINS_PER_JOB):
                    parts = [self._frame(last.schema, b).coalesce(1) for b in bins[at : at + BINS_PER_JOB]]
                    merged = reduce(DataFrame.union, parts)
                    merged.write.mode("append").parquet(f"{self.path}/{folder}")
                while gone <= {s.path for s in last.shards}:
                    try:
                        last = self._commit(last, last.schema, self._listed(folder), gone)
                        break
                    except Conflict:
                        last = self.manifest()
                else:  # another merge has taken some of these shards
                    common.drop(self.spark, f"{self.path}/{folder}")
        return last

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last versions and the shards that none of these lists; returns how many shards went."""
        data, alive = self._listed("data"), self._announced()
        found = self.versions()
        kept = found[-keep:]
        named = {s.path for v in kept for s in self.manifest(v).shards}
        old = [s for s in data if s.path not in named and s.path.split("/")[1] not in alive]
        if kept:
            self._snapshot(self.manifest(kept[0]))
            gone = [f"{k}{v:012d}" for k in "vs" for v in self._numbers(k) if v < kept[0]]
            common.drop(self.spark, *[f"{self.path}/manifest/{name}.json" for name in gone])
        common.drop(self.spark, *[f"{self.path}/{s.path}" for s in old])
        return len(old)


ORACLE_SQL = """
SELECT doc_id, CAST(coalesce(doc_id, 0) % 16 AS BIGINT) AS arrival, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars
FROM documents
"""


def arrivals_of(docs: DataFrame) -> DataFrame:
    return docs.withColumn("arrival", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(16)).cast("long"))
