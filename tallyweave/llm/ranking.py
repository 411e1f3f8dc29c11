"""Ranked lexical search by Fagin's threshold algorithm.

Documents are scored by a BM25 in whole numbers: a term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``, and its
occurrences ``tf`` in a document of ``n`` terms count ``10^9 tf div (1000 tf + 8 m)`` with ``m = 25 + 75 n N div L``, for N
documents with a term and L terms in all. The k best documents of every item are exact, ties by the smaller key.

Plan
----
1. *Forward index.* One scan of the texts counts, for every document, the terms that some item holds; it is written.
   Numbers of documents, of terms, and of documents for each term are partial aggregates over it.
2. *Shards.* Each task takes documents by blocks of some ``BLOCK_POSTINGS`` postings. A block has its impact-sorted lists
   and its rows of the forward index. For every item, its lists are read in turn, some entries of each in a round; a
   document met for the first time is scored whole by a lookup in the forward index. An item is done when the sum of the
   last impacts read, the threshold, is strictly below the k-th score so far; that score is carried from block to block
   of a task, so that later blocks stop sooner.
3. *Merge.* The tasks' k best of each item meet in groups dealt by a hash of the document, then by item.

A term's postings lie in the shards of their documents, so no list has to fit a task, however frequent the term. Items are
taken in blocks of a stated number of terms, which are what is sent to every task; each block is one pass over the texts.

Defined results
---------------
* A null or empty text has no terms: as a document it is not counted, as an item it has no rows. Null keys come last
  among equal scores.
* Every row is a document, or an item, of its own, also where rows repeat or share a key; the rows of an item that occurs
  twice occur twice.
* Fewer than k documents with a score above 0: these. An empty table on either side gives an empty table.
* Texts are read whole, by pieces, whatever their length. Only keys and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Distinct terms, counted for each item, of a block of items; one item may have more.
BLOCK_TERMS = 200_000
#: Postings of a block of documents, about.
BLOCK_POSTINGS = 1_000_000
#: Entries that the first round reads of each list; every round reads twice as many.
FIRST_READ = 16
#: Groups of an item's candidates before the last merge.
GROUPS = 256
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

# letters and digits stay, A-Z become small, other ASCII separates; bytes of longer code points stay
_TABLE = bytes((b"%c" % b).lower()[0] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of one piece each."""
    flat, at = (raw or b"").translate(_TABLE), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..., one after the other."""
    size = high - low
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + size, size)


class Best:
    """The k best documents so far of one item."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.key, self.keyed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, key: np.ndarray, keyed: np.ndarray) -> None:
        if len(self.score) == self.k:
            some = score >= self.score[-1]
            score, key, keyed = score[some], key[some], keyed[some]
        score, key, keyed = np.concatenate([self.score, score]), np.concatenate([self.key, key]), np.concatenate([self.keyed, keyed])
        first = np.lexsort((key, ~keyed, -score))[: self.k]
        first = first[score[first] > 0]
        self.score, self.key, self.keyed = score[first], key[first], keyed[first]

    def beats(self, threshold: int) -> bool:
        return len(self.score) == self.k and threshold < self.score[-1]


class Shard:
    """Impact-sorted lists and forward index of a block of documents."""

    def __init__(self, key: np.ndarray, keyed: np.ndarray, row: np.ndarray, terms: np.ndarray, rate: np.ndarray, n_terms: int):
        self.key, self.keyed, self.row, self.terms, self.rate = key, keyed, row, terms, rate
        order = np.argsort((terms.astype(np.int64) << 20) + ((1 << 20) - 1 - rate), kind="stable")
        self.listed = np.repeat(np.arange(len(key)), np.diff(row))[order]
        self.listed_rate = rate[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
        self.q = np.zeros(n_terms, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        low, high = self.row[docs], self.row[docs + 1]
        at = _ranges(low, high)
        return np.add.reduceat(self.q[self.terms[at]] * self.rate[at], np.cumsum(high - low) - (high - low))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Add the documents of this block to an item's best; returns how many were scored."""
        self.q[terms] = weights
        start, stop = self.at[terms], self.at[terms + 1]
        seen, depth, step = np.zeros(len(self.key), bool), 0, FIRST_READ
        while True:
            met = np.zeros(len(self.key), bool)
            met[self.listed[_ranges(np.minimum(start + depth, stop), np.minimum(start + depth + step, stop))]] = True
            docs = np.flatnonzero(met & ~seen)
            if len(docs):
                seen |= met
                best.add(self.scores(docs), self.key[docs], self.keyed[docs])
            depth, step = depth + step, step * 2
            left = start + depth < stop
            if not left.any() or best.beats(int((weights[left] * self.listed_rate[start[left] + depth - 1]).sum())):
                break
        self.q[terms] = 0
        return int(seen.sum())


def _forward(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows (key, n, terms, tfs) of the documents with a term; vocabulary is a broadcast map from terms to numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            at, sizes, ends, terms, tfs = [], [], [0], [], []
            for i, value in enumerate(batch.column(1)):
                found, n = Counter(), 0
                for piece in terms_of(value.as_py()):
                    n += len(piece)
                    found.update(map(number, piece))
                if n:
                    found.pop(None, None)
                    at.append(i)
                    sizes.append(n)
                    terms.extend(found)
                    tfs.extend(found.values())
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(sizes, pa.int64()), *lists], ["key", "n", "terms", "tfs"])

    return docs.mapInArrow(scan, "key long, n long, terms array<int>, tfs array<int>")


def _searched(forward: DataFrame, items, weights: list[int], n_docs: int, n_all: int, k: int) -> DataFrame:
    """Rows (row, key, score): every task's k best documents of each item; items is a broadcast list of (row, terms, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = np.array(weights, np.int64)
        asked = [(row, np.array(terms, np.int64), np.array(counts, np.int64) * weigh[terms], Best(k)) for row, terms, counts in items.value]

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            key, n, terms, tfs = (table.column(i).chunk(0) for i in range(4))
            m = 25 + 75 * np.asarray(n) * n_docs // n_all
            row = np.concatenate([[0], np.cumsum(np.asarray(terms.value_lengths()))])
            tf = np.asarray(tfs.flatten()).astype(np.int64)
            rate = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(row)))
            shard = Shard(np.asarray(key.fill_null(0)), np.asarray(key.is_valid()), row, np.asarray(terms.flatten()), rate, len(weigh))
            for _, numbers, own, best in asked:
                shard.search(numbers, own, best)

        held, postings = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                postings += len(batch.column(2).flatten())
            if postings >= BLOCK_POSTINGS:
                search(held)
                held, postings = [], 0
        if postings:
            search(held)
        for row, _, _, best in asked:
            if len(best.score):
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(best.score), pa.int64()), pa.array(best.key, mask=~best.keyed), pa.array(best.score)], ["row", "key", "score"])

    return forward.mapInArrow(scan, "row long, key long, score long")


def rank(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """Rows (item, rank, key, score): the k best documents of every row of ``items``. Keys of documents are integers."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sum((Counter(p) for p in terms_of(v.as_py())), Counter()) for v in batch.column(1)]
            columns = [pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["item", "terms", "counts"])

    given = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").cast("string").cast("binary").alias("text"))
    given = given.mapInArrow(counted, f"item {given.schema['item'].dataType.simpleString()}, terms array<binary>, counts array<bigint>").where(F.size("terms") > 0)
    asked, asked_path = common.written(given.withColumn("row", F.monotonically_increasing_id()), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    paths = [asked_path]
    found = spark.createDataFrame([], "row long, key long, score long")
    for b in range(blocks):  # a pass over the texts for each block of items
        held = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms", "counts").collect()
        vocabulary: dict[bytes, int] = {}
        listed = [(r["row"], [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]], r["counts"]) for r in held]
        forward, path = common.written(_forward(texts, spark.sparkContext.broadcast(vocabulary)), "forward")
        totals = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        dfs = {r["t"]: r["df"] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # of the block's terms
        weights = [weight(totals["docs"], dfs.get(t, 0)) for t in range(len(vocabulary))]
        best, best_path = common.written(_searched(forward, spark.sparkContext.broadcast(listed), weights, totals["docs"], totals["terms"], k), "best")
        common.drop(spark, path)
        found, paths = found.unionByName(best), [*paths, best_path]
    order = [F.desc("score"), F.asc_nulls_last("key")]
    found = found.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "group").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    out, _ = common.written(found.join(asked.select("row", "item"), "row").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score"), "ranked")
    common.drop(spark, *paths)
    return out


#: DuckDB SQL of the query over ``documents`` and ``benchmark``: every document that shares a term with an item is scored.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(u) AS term FROM i) GROUP BY ALL
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(len(u)) AS BIGINT) AS n_all FROM d WHERE len(u) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(u) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs
), rates AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(u) * n_docs) // n_all))) AS impact FROM tf JOIN d USING (r) JOIN weights USING (term), total
), scored AS (
  SELECT i, item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score FROM asked JOIN rates USING (term) GROUP BY i, item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
