"""Hash-chained ledgers: building, verifying, and Merkle roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators.lineage import cut

GENESIS, ZERO_GENESIS = "GENESIS", "0" * 64
EMPTY_ROOT = ""


def entry_hash(seq: Column, action: Column, actor: Column, payload_sha: Column, previous: Column) -> Column:
    """Binds every field of an entry to the one before it."""
    return S.sha256(F.concat_ws("|", seq.cast("string"), action, actor, payload_sha, previous))


def link_hash(payload_sha: Column, previous: Column) -> Column:
    """The weaker variant, which binds only the payload."""
    return S.sha256(F.concat_ws("|", payload_sha, previous))


def _folded(rows: DataFrame, chain: str, order: str, action: str, actor: str, payload: str) -> DataFrame:
    """Rows (chain, seq, action, actor, payload_sha, prev_hash, entry_hash, prev_link, link): both variants of every chain.

    A chain is sequential, so its rows come in order to one task, which folds them as they stream by and keeps only the
    last hashes. What is shuffled and sorted are hashes of payloads, not payloads.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    narrow = rows.select(F.col(chain).alias("chain"), F.col(order).alias("o"), text(action).alias("action"), text(actor).alias("actor"), S.sha256(text(payload)).alias("payload_sha"))
    sorted_rows = narrow.repartition("chain").sortWithinPartitions("chain", "o", "action", "actor", "payload_sha").drop("o")
    digest = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, head, link = object(), 0, "", ""
        for batch in batches:
            made = []
            for key, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, seq, head, link = key, 0, GENESIS, ZERO_GENESIS
                entry, weak = digest(str(seq), *fields, head), digest(fields[2], link)
                made.append((seq, head, entry, link, weak))
                seq, head, link = seq + 1, entry, weak
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            seqs, *hashes = (pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), seqs, *batch.columns[1:], *hashes], ["chain", "seq", "action", "actor", "payload_sha", "prev_hash", "entry_hash", "prev_link", "link"])

    kind = dict(narrow.dtypes)["chain"]
    schema = f"chain {kind}, seq bigint, action string, actor string, payload_sha string, prev_hash string, entry_hash string, prev_link string, link string"
    return sorted_rows.mapInArrow(fold, schema).withColumnRenamed("chain", chain)


def append_chain(rows: DataFrame, chain: str, order: str, action: str, actor: str, payload: str, *, bind_all: bool = True) -> DataFrame:
    """Rows (chain, seq, action, actor, payload_sha, prev_hash, entry_hash) of every chain. Null fields count as empty."""
    made = _folded(rows, chain, order, action, actor, payload)
    hashes = ("prev_hash", "entry_hash") if bind_all else (F.col("prev_link").alias("prev_hash"), F.col("link").alias("entry_hash"))
    return made.select(chain, "seq", "action", "actor", "payload_sha", *hashes)


def heads(rows: DataFrame, chain: str, order: str, action: str, actor: str, payload: str) -> DataFrame:
    """Rows (chain, head, weak_head, n): the last hashes of both variants, from one fold."""
    return _folded(rows, chain, order, action, actor, payload).groupBy(chain).agg(F.max_by("entry_hash", "seq").alias("head"), F.max_by("link", "seq").alias("weak_head"), F.count("*").alias("n"))


def verify_chain(entries: DataFrame, chain: str, *, bind_all: bool = True) -> DataFrame:
    """Rows (chain, n, valid, first_break, reason). Parallel: stored hashes are compared with their neighbours."""
    w = Window.partitionBy(chain).orderBy("seq")
    out = entries.select(
        chain, "seq", "action", "actor", "payload_sha", "prev_hash", "entry_hash",
        (F.row_number().over(w) - 1).alias("at"), F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS if bind_all else ZERO_GENESIS)).alias("expected"),
    )
    again = entry_hash(F.col("seq"), F.col("action"), F.col("actor"), F.col("payload_sha"), F.col("prev_hash")) if bind_all else link_hash(F.col("payload_sha"), F.col("prev_hash"))
    reason = F.when(F.col("seq") != F.col("at"), "sequence").when(F.col("prev_hash") != F.col("expected"), "prevhash").when(F.col("entry_hash") != again, "entryhash")
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("at", "reason"))).alias("b")
    got = out.withColumn("reason", reason).groupBy(chain).agg(F.count("*").alias("n"), first)
    return got.select(chain, "n", F.col("b").isNull().alias("valid"), F.col("b.at").alias("first_break"), F.col("b.reason").alias("reason"))


def merkle_root(leaves: Column) -> Column:
    """Root of an ordered array of hex hashes: pairs are joined and hashed, an odd last one with itself."""

    def level(a: Column) -> Column:
        n = F.ceil(F.size(a) / 2).cast("int")
        pair = lambda i: S.sha256(F.concat(F.get(a, 2 * i), F.coalesce(F.get(a, 2 * i + 1), F.get(a, 2 * i))))
        return F.transform(F.sequence(F.lit(0), n - 1), pair)

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(leaves).cast("double"))).cast("int"), F.lit(1)))
    folded = F.aggregate(rounds, leaves, lambda a, _: F.when(F.size(a) > 1, level(a)).otherwise(a))
    return F.when(F.size(leaves) == 0, F.lit(EMPTY_ROOT)).otherwise(F.get(folded, F.lit(0)))


def merkle_root_of_rows(rows: DataFrame, order: str, leaf: str) -> str:
    """Root of one ledger of any length, in rounds that halve the rows; only the root reaches the driver.

    ``order`` is the position, from 0 without gaps.
    """
    now = cut(rows.select(F.col(order).cast("bigint").alias("i"), F.col(leaf).alias("h")))
    n = now.count()
    if n == 0:
        return EMPTY_ROOT
    while n > 1:
        pair = F.max(F.when(F.pmod("i", F.lit(2)) == 0, F.col("h"))), F.max(F.when(F.pmod("i", F.lit(2)) == 1, F.col("h")))
        now = now.groupBy(F.floor(F.col("i") / 2).alias("p")).agg(pair[0].alias("a"), pair[1].alias("b")).select(F.col("p").alias("i"), S.sha256(F.concat("a", F.coalesce("b", "a"))).alias("h"))
        n = (n + 1) // 2
    return now.first()["h"]
