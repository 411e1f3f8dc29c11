"""Structured Streaming: rolling counts of events, ledgers that grow by one entry for each micro-batch, chains verified as they arrive."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.functions import scalars as S
from tallyweave.operators import ledger as L
from tallyweave.operators.lineage import create_once, file_at


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and time window; rows later than the watermark allows are dropped by the engine."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def append_to_ledger(events: DataFrame, ledger_path: str, checkpoint: str, actor: str = "stream") -> StreamingQuery:
    """For each micro-batch one ledger entry over the batch's digest; a repeated batch adds nothing.

    The digest is an order-free combination of row hashes, so it does not depend on partitioning. The last entry is
    read back before each append, so the chain goes on over restarts. One writer at a time.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        digest = batch.select(F.xxhash64(*batch.columns).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).first()
        try:
            last = spark.read.parquet(ledger_path).orderBy(F.desc("seq")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last is not None and last["batch_id"] >= batch_id:
            return
        seq, previous = (0, L.GENESIS) if last is None else (last["seq"] + 1, last["entry_hash"])
        row = spark.range(1).select(
            F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(seq).cast("bigint").alias("seq"), F.lit("BatchAppended").alias("action"), F.lit(actor).alias("actor"),
            S.sha256(F.lit(f"{digest['n']}:{digest['x']}")).alias("payload_sha"), F.lit(previous).alias("prev_hash"),
        )
        row = row.withColumn("entry_hash", L.entry_hash(F.col("seq"), F.col("action"), F.col("actor"), F.col("payload_sha"), F.col("prev_hash")))
        row.coalesce(1).write.mode("append").parquet(ledger_path)

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HeadMoved(RuntimeError):
    """Another writer has appended since the head was read."""


class GuardedLedger:
    """One chain as a folder with a file for each entry; an entry's file is created once, so a place in the chain is taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def head(self) -> tuple[int, str, dict]:
        """The number of entries, the last hash, and the last entry."""
        fs, where = file_at(self.spark, self.path)
        names = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().endswith(".json")) if fs.exists(where) else []
        if not names:
            return 0, L.GENESIS, {}
        stream = fs.open(file_at(self.spark, f"{self.path}/{names[-1]}")[1])
        try:
            last = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()
        return len(names), last["entry_hash"], last

    def append(self, action: str, actor: str, payload_sha: str, expected: tuple[int, str], **more) -> dict:
        """Append behind the head that the caller has read; refused where that is no longer the head."""
        seq, previous = expected
        if self.head()[:2] != (seq, previous):
            raise HeadMoved(f"the head is no longer entry {seq - 1}")
        digest = hashlib.sha256("|".join((str(seq), action, actor, payload_sha, previous)).encode()).hexdigest()
        entry = {"seq": seq, "action": action, "actor": actor, "payload_sha": payload_sha, "prev_hash": previous, "entry_hash": digest, **more}
        if not create_once(self.spark, f"{self.path}/{seq:012d}.json", json.dumps(entry).encode()):
            raise HeadMoved(f"entry {seq} is there already")
        return entry

    def entries(self) -> DataFrame:
        schema = "seq long, action string, actor string, payload_sha string, prev_hash string, entry_hash string, batch_id long"
        return self.spark.read.schema(schema).json(f"{self.path}/*.json")


def append_to_guarded(events: DataFrame, ledger: GuardedLedger, checkpoint: str, actor: str = "stream") -> StreamingQuery:
    """As ``append_to_ledger``, into a ledger that refuses a second writer: the query fails with ``HeadMoved`` then.

    A batch that is run again after its entry was written adds nothing.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        seq, head, last = ledger.head()
        if last.get("batch_id") is not None and last["batch_id"] >= batch_id and last["actor"] == actor:
            return
        digest = batch.select(F.xxhash64(*batch.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("x")).first()
        sha = hashlib.sha256(f"{digest['n']}:{digest['x'] or 0}".encode()).hexdigest()
        ledger.append("BatchAppended", actor, sha, (seq, head), batch_id=batch_id)

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify_stream(entries: DataFrame, chain: str) -> DataFrame:
    """Rows (chain, n, valid, first_break, reason) of every chain that a micro-batch adds to: the chain as a whole so far.

    ``entries`` has (chain, seq, action, actor, payload_sha, prev_hash, entry_hash) and brings the entries of a chain in order
    of their batches; within a batch they are put in order. The state of a chain is its length, its last hash and its first
    break, so it stays as small as that. A repeated place (a second writer), a gap, a changed field and a cut link are
    breaks; after one the stored hashes are followed on, as ``verify_chain`` does.
    """
    kind = dict(entries.dtypes)[chain]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, head, broken, why = state.get if state.exists else (0, L.GENESIS, -1, "")
        rows = pd.concat(list(frames)).sort_values(["seq", "entry_hash"], kind="stable")
        for seq, action, actor, sha, previous, stored in zip(*(rows[c] for c in ("seq", "action", "actor", "payload_sha", "prev_hash", "entry_hash")), strict=True):
            again = hashlib.sha256("|".join((str(seq), action, actor, sha, previous)).encode()).hexdigest()
            reason = "sequence" if seq != n else "prevhash" if previous != head else "entryhash" if stored != again else ""
            if reason and broken < 0:
                broken, why = n, reason
            n, head = n + 1, stored
        state.update((n, head, broken, why))
        yield pd.DataFrame({chain: [key[0]], "n": [n], "valid": [broken < 0], "first_break": pd.array([broken if broken >= 0 else None], "Int64"), "reason": [why or None]})

    return entries.groupBy(chain).applyInPandasWithState(step, f"{chain} {kind}, n long, valid boolean, first_break long, reason string", "n long, head string, broken long, why string", "update", "NoTimeout")
