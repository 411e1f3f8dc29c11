"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes (64 bits) of its distinct word shingles. Two documents link when
``100 * |A and B| >= percent * |A or B|``. The operator returns components of linked documents, so it needs every
link between different texts but not every pair within a group of copies.

Plan
----
1. *Rarity.* One pass counts shingles into cells, in number a small multiple of the texts up to a bound. The order
   "rarer cell first, then smaller hash" is the global order: frequent shingles come last.
2. *Prefixes.* A second pass writes, for each document, the size of its set, a 128-bit digest of it, and the first
   ``n - ceil(t n) + 1`` shingles in that order. Documents with equal sets become one class (partial aggregate on
   the digest); only classes go on. Shingles of the prefixes are then counted exactly; what is frequent although its
   cell is not goes to the end of the order, and prefixes that held such shingles are made again.
3. *Leaders.* Classes that share a prefix shingle are a group. Its members are compared with ``LEADERS`` of them, so
   candidates stay proportional to the prefixes, however large a group is. Verified links give preliminary components.
4. *Rest.* A pair left over is one of members that are no leaders and lie in different components. For every group
   with such members, those outside its largest component meet all, keyed by shingle and length band; groups of more
   than ``BLOCK`` members are cut into chunks, each pair of chunks being a key of its own. Pairs that pass all filters
   are verified too. So every link is found or implied by found links.
5. Candidates pass the length filter, the positional filter (what is left behind the shared shingle must suffice)
   and the suffix filter: fixed pivots split the hash space into parts, and each part in which one set has an even
   number of shingles and the other an odd one stands for a shingle that they do not share; for long sets the
   differences of the parts' sizes are added up. Only for what is left are whole sets made again from the texts, and
   each distinct pair is intersected once.

Defined results
---------------
* Null texts and texts without words have ``n_shingles`` 0 and link with nothing.
* Rows with the same id are one document; its component holds what any of its texts links with. A null id links with
  nothing and has a null component.
* Texts shorter than a shingle give one shingle, the whole word sequence. Very long texts have their whole sets
  compared; a set is one row where it is verified. An empty table gives an empty table. Other
  columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

#: The rarity table has two to four cells for each text, and 2 ** 22 bytes at most; counts travel in blocks.
CELL_BITS_PER_TEXT, MAX_CELL_BITS, BLOCK_CELLS = 1, 22, 1024
#: Hashes that wait for counting at a time.
MAX_WAITING = 1 << 18
#: Shingles in the prefixes of more classes than this are counted exactly and put behind all others; up to so many
#: (16 MB) of them, the most frequent ones, are told to all tasks.
HOT_CLASSES, MAX_HOT = 200, 1_000_000
#: Odd multipliers for the words of a shingle, and for the finaliser.
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Pivots split the hash space into this many equal parts for the suffix filter; one bit is kept of each.
SUFFIX_PARTS = 512
#: Sets of more than this many shingles are too large for one bit a part; of them so many counts are kept too.
LONG_SET, COUNTED_PARTS = 1024, 256
#: All members of a group are compared with so many leaders first.
LEADERS = 3
#: What leaders leave of a group meets in blocks of up to so many members on either side.
BLOCK = 2048
#: Up to so many ids (8 MB) of documents whose sets are needed are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def _finalise(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX_B
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8; ASCII letters are lower-cased, words end at ASCII space."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = _finalise(out * _MIX_A + h[i : len(h) - span + 1 + i])
    return np.unique(out.view(np.int64))


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes | None]:
    """The texts of a column as UTF-8, one at a time."""
    for value in batch.column(at).cast(pa.binary()):
        yield value.as_py()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is made from one stays small. Other operators' words go."""
    common.keep_only(__name__, lambda: None)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rarity(texts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The rarity of every cell: eight times the binary logarithm of its count of shingles, as a byte.

    The number of cells follows the number of texts up to ``MAX_CELL_BITS``. A task returns its counts in blocks of
    ``BLOCK_CELLS``, which are added up by block.
    """
    bits = min(max(rows, 1).bit_length() + CELL_BITS_PER_TEXT, MAX_CELL_BITS)
    cells = max(1 << bits, BLOCK_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in _slices(batches):
            waiting, size = [], 0
            for text in _texts(batch, 0):
                waiting.append(shingle_set(text, width) & np.int64(cells - 1))
                size += len(waiting[-1])
                if size > MAX_WAITING:
                    total += np.bincount(np.concatenate(waiting), minlength=cells).astype(np.uint32)
                    waiting, size = [], 0
            if size:
                total += np.bincount(np.concatenate(waiting), minlength=cells).astype(np.uint32)
        blocks = total.reshape(-1, BLOCK_CELLS)
        for at in range(0, len(blocks), 64):
            used = [i for i in range(at, min(at + 64, len(blocks))) if blocks[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(block, np.zeros(BLOCK_CELLS, np.int64))
                own += np.frombuffer(counts.as_py(), np.uint32)
        ranks = [np.minimum(np.round(8 * np.log2(1.0 + n)), 255).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(ranks, pa.binary())], ["block", "ranks"])

    counted = texts.mapInArrow(count, "block long, counts binary").repartition("block")
    table = np.zeros((cells // BLOCK_CELLS, BLOCK_CELLS), np.uint8)
    for row in counted.mapInArrow(add, "block long, ranks binary").collect():
        table[row["block"]] = np.frombuffer(row["ranks"], np.uint8)
    return table.ravel()


def _parities(h: np.ndarray) -> np.ndarray:
    """A bit for each part of the hash space: whether it holds an odd number of the shingles. As longs."""
    odd = np.bincount((h >> np.int64(55)) & np.int64(SUFFIX_PARTS - 1), minlength=SUFFIX_PARTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counts(h: np.ndarray) -> np.ndarray:
    """The sizes of the parts of a long set; nothing for others, and for sets so large that a size is no short."""
    if len(h) <= LONG_SET:
        return np.empty(0, np.int16)
    n = np.bincount((h >> np.int64(56)) & np.int64(COUNTED_PARTS - 1), minlength=COUNTED_PARTS)
    return n.astype(np.int16) if n.max() < 1 << 15 else np.empty(0, np.int16)


def _ceil_share(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _prefixes(docs: DataFrame, table: np.ndarray, hot: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """Rows (id, n, digest, parts, counts, prefix).

    ``hot`` holds shingles, sorted, and their numbers: they come behind all others, the more frequent the later.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, *hot))

    def order(h: np.ndarray, ranks: np.ndarray, late: np.ndarray, late_n: np.ndarray) -> np.ndarray:
        rank = ranks[h & np.int64(len(ranks) - 1)].astype(np.int64)
        if len(late):
            at = np.minimum(np.searchsorted(late, h), len(late) - 1)
            rank = np.where(late[at] == h, 256 + late_n[at], rank)
        return np.argsort(rank, kind="stable")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in _slices(batches):
            sizes, digests, parts, counted, firsts = [], [], [], [], []
            for text in _texts(batch, 1):
                h = shingle_set(text, width)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                parts.append(_parities(h))
                counted.append(_counts(h))
                keep = len(h) - _ceil_share(len(h), percent) + 1 if len(h) else 0
                firsts.append(h[order(h, *known)[:keep]])
            flat = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(parts, pa.list_(pa.int64())), pa.array(counted, pa.list_(pa.int16())), prefix]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "n", "digest", "parts", "counts", "prefix"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(scan, f"id {kind}, n long, digest binary, parts array<long>, counts array<smallint>, prefix array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (node, n, items): whole sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            every = [shingle_set(t, width) for t in _texts(batch, 1)]
            flat = np.concatenate(every) if every else np.empty(0, np.int64)
            items = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in every], pa.int64()), items], ["node", "n", "items"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(scan, f"node {kind}, n long, items array<long>")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of two linked sets of these sizes."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def _may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Length filter; index prefix of the smaller set; positional filter for the first shared shingle at i and j."""
    small = F.when(n <= m, F.struct(n.alias("n"), i.alias("i"))).otherwise(F.struct(m.alias("n"), j.alias("i")))
    index = small["n"] - F.ceil(2 * percent * small["n"] / F.lit(100 + percent)) + 1
    length = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    # where sizes are equal either one may be taken as the smaller
    prefix = F.when(n == m, F.least(i, j) < index).otherwise(small["i"] < index)
    return length & prefix & (1 + F.least(n - i - 1, m - j - 1) >= _needed(n, m, percent))


def _may_be_near(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Suffix filter: the parts with different parities are at most the shingles that only one set has."""
    apart = F.lit(0)
    for i in range(SUFFIX_PARTS // 64):
        apart = apart + F.bit_count(F.get(p, F.lit(i)).bitwiseXOR(F.get(q, F.lit(i))))
    return apart <= n + m - 2 * _needed(n, m, percent)


def _sides(pairs: DataFrame, what: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both nodes, named by side."""
    for x in ("a", "b"):
        pairs = pairs.join(what.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, str]:
    """Links (a, b) that connect what the given pairs connect, and where they are written.

    Pairs that pass the suffix filter are intersected in two steps, each of them once: first every node with that
    partner which has most partners, then the pairs whose ends the found links have not connected yet. Within a large
    group of near copies the first step connects most, so few sets are moved.
    """
    n, m = F.col("n_a"), F.col("n_b")
    near = _sides(pairs.distinct(), classes, "n", "parts", "counts").where(_may_be_near(n, F.col("parts_a"), m, F.col("parts_b"), percent))
    apart = F.aggregate(F.zip_with("counts_a", "counts_b", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, d: s + d)
    counted = (F.size("counts_a") > 0) & (F.size("counts_b") > 0)
    near = near.where(F.when(counted, apart <= n + m - 2 * _needed(n, m, percent)).otherwise(True))
    near, near_path = common.written(near.select("a", "b").distinct(), "near")
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = ends.groupBy("a").agg(F.count("*").alias("degree"))
    partners, partners_path = common.written(partners, "partners")
    wanted = partners.select(F.col("a").alias("id"))
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted
    sets, sets_path = common.written(_sets(docs.join(wanted, "id", "left_semi"), width), "sets")

    def intersected(chosen: DataFrame) -> tuple[DataFrame, str]:
        same = F.size(F.array_intersect("items_a", "items_b"))
        good = _sides(chosen, sets, "n", "items").where(100 * same >= percent * (n + m - same))
        return common.written(good.select("a", "b").distinct(), "links")

    best = ends.join(partners.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.max(F.struct("degree", "b"))["b"].alias("b"))
    first, first_path = common.written(best.select(*_ordered(F.col("a"), F.col("b"))).distinct(), "first")
    links, links_path = intersected(first)
    found, found_path = common.connected_components(links)
    at = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    left = near.join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    more, more_path = intersected(left.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"))
    every, path = common.written(links.unionByName(more), "links")
    common.drop(docs.sparkSession, near_path, partners_path, sets_path, first_path, links_path, found_path, more_path)
    return every, path


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _entries(wide: DataFrame) -> DataFrame:
    """Rows (sh, node, np): the prefixes. Size and position share a long: half of the rows' bytes are hash and node."""
    packed = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long"))
    return wide.select("node", "n", F.posexplode("prefix").alias("pos", "sh")).select("sh", "node", packed.alias("np"))


def _exact_entries(wide: DataFrame, docs: DataFrame, table: np.ndarray, width: int, percent: int) -> tuple[DataFrame, list[str]]:
    """The entries of prefixes in which shingles that turn out frequent come last, and what they are read from.

    Shingles of the prefixes are counted exactly, by a shuffle. Those of more than ``HOT_CLASSES`` classes move behind
    all others in the global order, which changes only prefixes that hold one; these are made again from their texts.
    """
    counted = _entries(wide).groupBy("sh").agg(F.count("*").alias("k")).where(F.col("k") > HOT_CLASSES)
    found = counted.orderBy(F.desc("k"), "sh").limit(MAX_HOT).toPandas().sort_values("sh")
    if not len(found):
        return _entries(wide), []
    hot = found["sh"].to_numpy(np.int64), found["k"].to_numpy(np.int64)
    named = F.broadcast(docs.sparkSession.createDataFrame(found[["sh"]], "sh long"))
    changed = wide.select("node", "digest", F.explode("prefix").alias("sh")).join(named, "sh", "left_semi").select("node", "digest").distinct()
    changed, path = common.written(changed, "changed")
    near = F.broadcast if changed.count() <= MAX_BROADCAST_IDS else lambda d: d
    texts = docs.join(near(changed.select(F.col("node").alias("id")).distinct()), "id", "left_semi")
    again = _prefixes(texts, table, hot, width, percent).withColumnRenamed("id", "node").join(near(changed), ["node", "digest"], "left_semi")
    again = again.groupBy("node", "digest").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    same = wide.join(near(changed), ["node", "digest"], "left_anti")
    return _entries(same.select("node", "n", "prefix").unionByName(again.select("node", "n", "prefix"))), [path]


def _leaders(groups: DataFrame) -> DataFrame:
    """Rows (sh, l): the leaders of each group.

    They are the members that share most of their prefix with others, each the first of a part of the group by hash:
    such a class has few shingles of its own and lies in the middle of its group.
    """
    shared = groups.groupBy("node").agg(F.count("*").alias("shared"))
    ranked = groups.join(shared, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(LEADERS)))
    heads = [F.max(F.when(F.col("part") == i, F.struct("shared", "node", "n", "pos"))).alias(f"l{i}") for i in range(LEADERS)]
    listed = F.array_compact(F.array(*[f"l{i}" for i in range(LEADERS)]))
    return ranked.groupBy("sh").agg(*heads).select("sh", F.transform(listed, lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"), x["pos"].alias("pos"))).alias("l"))


def shingle_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: the key, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest key reachable by links, the document's own included.
    """
    if not 0 < percent < 100 or width < 1:
        raise ValueError("percent lies between 1 and 99, width is 1 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    table = _rarity(docs.select("text").where("text is not null"), docs.count(), width)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    meta, meta_path = common.written(_prefixes(docs, table, none, width, percent), "prefixes")
    known = meta.where("id is not null and digest is not null")
    once = [F.first(c).alias(c) for c in ("n", "parts", "counts", "prefix")]
    wide, wide_path = common.written(known.groupBy("digest").agg(F.min("id").alias("node"), *once), "classes")
    meta, _ = common.written(meta.select("id", "n", "digest"), "sizes")
    known = meta.where("id is not null and digest is not null")
    common.drop(spark, meta_path)
    entries, changed_paths = _exact_entries(wide, docs, table, width, percent)
    size, position = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
    # aggregates by shingle are written before they are joined, so that a hot shingle's members are dealt to several tasks
    several, several_path = common.written(entries.groupBy("sh").agg(F.count("*").alias("k")).where("k > 1").select("sh"), "shared")
    groups = entries.join(several, "sh").withColumns({"n": size(F.col("np")), "pos": position(F.col("np"))}).drop("np")
    groups, groups_path = common.written(groups, "groups")
    classes, _ = common.written(wide.drop("prefix"), "classes")
    common.drop(spark, wide_path, several_path, *changed_paths)

    def possible(n: str, pos: str, m: str, other: str) -> Column:
        return _may_link(F.col(n), F.col(pos), F.col(m), F.col(other), percent)

    leaders, leaders_path = common.written(_leaders(groups), "leaders")
    led, led_path = common.written(groups.join(leaders, "sh"), "led")
    near = F.filter("l", lambda x: (x["node"] != F.col("node")) & _may_link(F.col("n"), F.col("pos"), x["n"], x["pos"], percent))
    pairs = led.select("node", F.explode(F.transform(near, lambda x: x["node"])).alias("leader"))
    links, links_path = _verify(pairs.select(*_ordered(F.col("node"), F.col("leader"))), classes, docs, width, percent)
    found, found_path = common.connected_components(links)

    # what has met the leaders and lies in another component than they meets in blocks
    headed = F.exists("l", lambda x: (x["node"] == F.col("node")) & (x["n"] == F.col("n")) & (x["pos"] == F.col("pos")))
    placed = led.where(~headed).select("sh", "node", "n", "pos").join(found, "node", "left")
    placed, placed_path = common.written(placed.withColumn("c", F.coalesce("component", "node")).drop("component"), "placed")
    common.drop(spark, led_path, leaders_path, groups_path)
    sizes = placed.groupBy("sh", "c").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("sh").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c")).alias("most"))
    chunks = lambda c: F.ceil(c / F.lit(float(BLOCK))).cast("int")
    mixed = sizes.where(F.col("most.k") < F.col("k"))
    mixed = mixed.select("sh", F.col("most.c").alias("main"), chunks(F.col("k")).alias("inner"), chunks(F.col("k") - F.col("most.k")).alias("outer"))
    mixed, mixed_path = common.written(mixed, "mixed")
    rest = placed.join(mixed, "sh")
    # a node that stands for several sets is left to the verification, which takes each set's own parts
    own = classes.groupBy("node").agg(F.first("parts").alias("parts"), (F.count("*") > 1).alias("several"))
    rest = rest.join(own, "node")
    # a little wider than the length filter, so that rounding never puts two sizes more than one band apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * float(np.log(100 / percent)))).cast("int")
    chunk = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rest.where("c <> main").withColumn("i", chunk("outer")).withColumn("j", every("inner"))
    left = left.withColumn("band", F.explode(F.array(*[band + d for d in (-1, 0, 1)])))
    right = rest.withColumns({"j": chunk("inner"), "band": band, "odd": F.col("c") != F.col("main")}).withColumn("i", every("outer"))
    keys = ("sh", "band", "i", "j")
    side = lambda d, x, *cs: d.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "c", "parts", "several", *cs)])
    alike = _may_be_near(F.col("n_a"), F.col("parts_a"), F.col("n_b"), F.col("parts_b"), percent)
    both = side(left, "a").join(side(right, "b", "odd"), list(keys)).where("c_a <> c_b and (not odd_b or node_a < node_b)")
    both = both.where(possible("n_a", "pos_a", "n_b", "pos_b")).where(F.col("several_a") | F.col("several_b") | alike)
    more, more_path = _verify(both.select(*_ordered(F.col("node_a"), F.col("node_b"))), classes, docs, width, percent)
    common.drop(spark, placed_path, mixed_path)
    # an id that stands in several rows ties the classes of its texts together
    several = known.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    ties = known.select("id", "digest").join(several, "id", "left_semi").join(classes.select("digest", "node"), "digest")
    ends = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    joined, _ = common.connected_components(ends.unionByName(ties.select(F.col("id").alias("a"), F.col("node").alias("b"))))
    common.drop(spark, links_path, more_path, found_path)

    member = classes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = meta.select("id", "n", "digest").join(member, "digest", "left")
    place = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), place.alias("component_id"))
