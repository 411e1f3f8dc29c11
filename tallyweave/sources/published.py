"""Parent and child tables that are published together, or not at all.

A publication is a folder: ``runs/<attempt>/parents`` and ``.../children`` hold the rows of one run as Parquet, written by
ordinary Spark jobs; ``commits/<number>`` names run and attempt. A run counts
from the moment its commit exists, so readers see both tables of a run or neither, and a failed task leaves both as they
were. A commit is created by a call that refuses to overwrite; of two writers one takes the next number. A run whose id is
committed already is not written again.

Later runs replace the parents of the same key and all their children; children of no parent in the run, and keys that a
run repeats, are refused. Null keys are refused.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.lineage import create_once, file_at

PUBLISHED, SKIPPED = "PUBLISHED", "PUBLISH_SKIPPED"  # fixed values: what a publication answers


class Publication:
    """Parents and children by a key that both have."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def runs(self) -> list[dict]:
        """What was committed, in order: run and attempt."""
        fs, where = file_at(self.spark, f"{self.path}/commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
        return [json.loads(self._read(n)) for n in names if re.fullmatch(r"\d{12}\.json", n)]

    def _read(self, name: str) -> str:
        fs, where = file_at(self.spark, f"{self.path}/commits/{name}")
        stream = fs.open(where)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def _commit(self, run: str, attempt: str) -> bool:
        """Add a commit behind the last; False where the run has been committed meanwhile."""
        while True:
            done = self.runs()
            if any(r["run"] == run for r in done):
                return False
            if create_once(self.spark, f"{self.path}/commits/{len(done):012d}.json", json.dumps({"run": run, "attempt": attempt}).encode()):
                return True

    def publish(self, parents: DataFrame, children: DataFrame, run: str) -> tuple[str, str]:
        """Publish one run. Returns the answer and, where the run was skipped, why; nothing is visible then."""
        if any(r["run"] == run for r in self.runs()):
            return PUBLISHED, ""
        attempt = uuid.uuid4().hex
        fs, where = file_at(self.spark, f"{self.path}/runs/{attempt}")
        try:
            parents.write.parquet(f"{self.path}/runs/{attempt}/parents")
            children.write.parquet(f"{self.path}/runs/{attempt}/children")
            # what is judged is what was written
            own, below = (self.spark.read.schema(d.schema).parquet(f"{self.path}/runs/{attempt}/{t}") for d, t in ((parents, "parents"), (children, "children")))
            if not own.groupBy(self.key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(self.key).isNull()).isEmpty():
                raise ValueError(f"{self.key} repeats or is null")
            if not below.join(own.select(self.key), self.key, "left_anti").isEmpty():
                raise ValueError("children without a parent")
            if not self._commit(run, attempt):
                fs.delete(where, True)
            return PUBLISHED, ""
        except Exception as e:
            fs.delete(where, True)
            return SKIPPED, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"

    def _rows(self, table: str, done: list[dict]) -> DataFrame:
        """The rows of a table of all runs, with the number of their run in ``__run``."""
        read = self.spark.read.parquet(*[f"{self.path}/runs/{r['attempt']}/{table}" for r in done])
        attempt = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([0-9a-f]{32})/", 1)
        numbers = F.broadcast(self.spark.createDataFrame([(n, r["attempt"]) for n, r in enumerate(done)], "__run int, __attempt string"))  # one row a run
        return read.withColumn("__attempt", attempt).join(numbers, "__attempt").drop("__attempt")

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Parents and children as the last run left them."""
        done = self.runs()
        if not done:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        parents, children = self._rows("parents", done), self._rows("children", done)
        last = parents.groupBy(self.key).agg(F.max("__run").alias("__run"))
        return tuple(t.join(last, [self.key, "__run"], "left_semi").drop("__run") for t in (parents, children))
