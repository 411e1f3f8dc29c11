"""Near-duplicate vectors by cross-polytope hashing.

Each of several tables hashes a vector by some fast rotations (three rounds of random signs and a Hadamard transform); a
rotation's code is the axis of the largest coordinate with its sign. The vector's home bucket joins the codes; further
buckets, its probes, take next-largest coordinates, in order of what they lose. Two vectors of one label and length are
candidates where the home of one is a home or probe of the other. Candidates are verified by their cosine in double
precision. ``PLANS`` has the rotations of a table: so many that a bucket holds ``LOAD`` vectors of the largest label on
average, and tables and probes that keep the recall.

Equal vectors (of one label) are one class with a multiplicity. Buckets are counted by narrow rows first; vectors go only
to buckets in which a pair can meet. Buckets of more than ``BLOCK`` members are cut into chunks, and every pair of chunks
is a block of its own, so the pairs of a hot bucket are spread over many tasks and never emitted: a block returns, per
vector, how many it links with and a vector that it reaches in the block. A pair counts only in the first bucket in
which it meets.

``exact_links`` counts the links of a set of query vectors by brute force, to measure the recall.

Defined results
---------------
* Vectors that are null, empty, all zero, or hold null, NaN or infinite components, and rows with a null label or id,
  have 0 links and their own id as component.
* Vectors of different lengths are not compared. Rows that repeat a vector count as other vectors: ``n_links`` counts
  rows. Rows that share an id share a component.
* An empty table gives an empty table. Columns besides id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Rotations of a table, tables, and buckets of a table that a vector is put into (home and probes). Simulated recall at
#: cosine 0.93 is 0.99 or more for each, at 64 and at 768 dimensions (0.987 for the first at 768).
PLANS = ((2, 6, 4), (3, 12, 8), (4, 20, 16))
#: Vectors of the largest label for each bucket of a table, at most (but for the last plan).
LOAD = 32
#: Alternatives of one rotation that enter the probing order.
CHOICES = 3
#: Members of a bucket that one block compares with each other, at most.
BLOCK = 4096
#: Codes are taken modulo this prime, so that they fit 31 bits; buckets that fall together compare a little more.
CODES = (1 << 31) - 1
SEED = 93


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def plan_for(vectors: int, width: int) -> tuple[int, int, int]:
    """The plan for so many vectors of one label."""
    buckets = 2 << max(1, (width - 1).bit_length())
    return next((p for p in PLANS if vectors <= LOAD * buckets ** p[0]), PLANS[-1])


def codes(x: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    """Bucket codes of unit rows, shape (rows, tables, probes); the first of each table is the home."""
    rotations, tables, probes = plan
    n, width = x.shape
    d = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :width] = x
    choices = min(CHOICES, d)
    out = np.empty((n, tables, probes), np.int32)
    for t in range(tables):
        bucket, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for k in range(rotations):
            signs = np.random.default_rng((SEED, d, t, k)).choice([-1.0, 1.0], (3, d))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :choices]
            value = np.take_along_axis(y, best, 1)
            code = 2 * best + (value < 0)
            lost = value[:, :1] ** 2 - value**2
            bucket = ((bucket[:, :, None] * (2 * d) + code[:, None, :]) % CODES).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(bucket, order, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = -1 - np.arange(probes - found.shape[1])
    return out


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(classes: DataFrame, plan: tuple[int, int, int]) -> DataFrame:
    """The classes with ``codes``: home and probes of every table, one after the other."""
    width = plan[1] * plan[2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("v"))
            sizes = np.asarray(vectors.value_lengths())
            out = np.empty((batch.num_rows, width), np.int32)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                flat = np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), int(d))
                out[at] = codes(_unit(flat), plan).reshape(len(at), -1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "codes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(scan, f"{fields}, codes array<int>")


class _Rows:
    """Members of some blocks as arrays: all vectors have one length, groups lie one after the other."""

    def __init__(self, table: pa.Table, group: np.ndarray, plan: tuple[int, int, int]):
        column = lambda c: np.asarray(table.column(c).combine_chunks())
        self.group, self.n = group, table.num_rows
        self.cid, self.node, self.mult, self.pos, self.chunk = (column(c) for c in ("cid", "node", "mult", "pos", "chunk"))
        self.i, self.j, self.bucket = (column(c) for c in ("i", "j", "bucket"))
        self.t, self.rank = self.pos // plan[2], self.pos % plan[2]
        self.x = _unit(np.asarray(table.column("v").combine_chunks().flatten()).reshape(self.n, -1))
        self.codes = np.asarray(table.column("codes").combine_chunks().flatten()).reshape(self.n, *plan[1:])
        self.links = np.zeros(self.n, np.int64)
        self.root = np.arange(self.n)

    def pairs(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of these pairs are compared here: one is at home, and the block is that of their chunks."""
        home = (self.rank[p] == 0) | (self.rank[q] == 0)
        low, high = np.minimum(self.chunk[p], self.chunk[q]), np.maximum(self.chunk[p], self.chunk[q])
        return home & (low == self.i[p]) & (high == self.j[p])

    def owned(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of these pairs meet here first: in the first table they share, in the smaller of two homes."""
        a, b = self.codes[p], self.codes[q]
        a_in_b = (b == a[:, :, :1]).any(2)
        b_in_a = (a == b[:, :, :1]).any(2)
        meets = a_in_b | b_in_a
        t = self.t[p]
        first = meets.argmax(1) == t
        at = np.arange(len(p))
        home_a, home_b = a[at, t, 0], b[at, t, 0]
        both = a_in_b[at, t] & b_in_a[at, t]
        return first & (~both | (self.bucket[p] == np.minimum(home_a, home_b)))

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        """Count these links, and give all rows that they connect one root."""
        np.add.at(self.links, p, self.mult[q])
        np.add.at(self.links, q, self.mult[p])
        pairs = np.unique(self.root[p] * self.n + self.root[q])
        a, b = pairs // self.n, pairs % self.n
        to = np.arange(self.n)
        while True:
            low = np.minimum(to[a], to[b])
            if (low == to[a]).all() and (low == to[b]).all():
                break
            np.minimum.at(to, to[a], low)
            np.minimum.at(to, to[b], low)
            to = to[to]
        self.root = to[self.root]

    def compare(self, least: float, small: int = 48, step: int = 100_000) -> None:
        start = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        size = np.diff(np.concatenate([start, [self.n]]))

        def check(p: np.ndarray, q: np.ndarray) -> None:
            for at in range(0, len(p), step):
                a, b = p[at : at + step], q[at : at + step]
                near = self.owned(a, b)
                self.link(a[near], b[near])

        few = (size > 1) & (size <= small)
        for s in np.unique(size[few]):  # all groups of one size at once
            own = start[few & (size == s)]
            up, uq = np.triu_indices(s, 1)
            for at in range(0, len(own), max(1, step // len(up))):
                base = own[at : at + max(1, step // len(up)), None]
                p, q = (base + up).ravel(), (base + uq).ravel()
                keep = self.pairs(p, q)
                p, q = p[keep], q[keep]
                near = np.einsum("ij,ij->i", self.x[p], self.x[q]) >= least
                check(p[near], q[near])
        for g in np.flatnonzero(size > small):
            lo, s = int(start[g]), int(size[g])
            for at in range(0, s, 256):
                dots = self.x[lo + at : lo + min(at + 256, s)] @ self.x[lo : lo + s].T
                p, q = np.nonzero(dots >= least)
                p += at
                keep = p < q
                p, q = p[keep] + lo, q[keep] + lo
                keep = self.pairs(p, q)
                check(p[keep], q[keep])


def _compared(blocks: DataFrame, least: float, plan: tuple[int, int, int]) -> DataFrame:
    """Rows (cid, node, links, root) of the vectors that link within a block; the root is a node that they reach there."""
    keys = ["label", "d", "k", "i", "j"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Runs of complete groups of one vector length, with a number for each row's group."""
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            number, lengths = numbered(rest)
            cut = int(np.searchsorted(number, number[-1]))  # the last group may go on
            if cut:
                yield from runs(rest.slice(0, cut), number[:cut], lengths[:cut])
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from runs(rest, *numbered(rest))

    def numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        columns = [np.asarray(table.column(c).combine_chunks()) for c in keys]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new), columns[1]

    def runs(table: pa.Table, number: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        edges = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield table.slice(a, b - a), number[a:b]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole(batches):
            rows = _Rows(table, number, plan)
            rows.compare(least)
            at = np.flatnonzero(rows.links)
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (rows.cid, rows.node, rows.links, rows.node[rows.root])], ["cid", "node", "links", "root"])

    return blocks.mapInArrow(scan, "cid long, node long, links long, root long")


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """One row for each row: the key, ``n_links`` and ``component_id``. Keys are integers."""
    read = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    read = read.withColumn("valid", valid).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit("second"), "v", "label")})
    most = read.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    classes = read.where("valid").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    # the key is numbered by hash so that labels of any type go the same way; the number of a written row stays
    classes = classes.withColumns({"label": F.xxhash64("label"), "d": F.size("v"), "cid": F.monotonically_increasing_id()})
    width = read.where("valid").select(F.size("v").alias("d")).limit(1).first()
    plan = plan_for(most, width["d"] if width else 1)
    hashed, hashed_path = common.written(_hashed(classes, plan), "hashed")

    # narrow rows first: buckets with a pair, one of which is at home
    at = F.posexplode("codes").alias("pos", "bucket")
    place = F.xxhash64("label", "d", (F.col("pos") / plan[2]).cast("int"), "bucket")
    entries = hashed.select("cid", "label", "d", at).select("cid", "pos", place.alias("k"))
    home = F.max((F.col("pos") % plan[2] == 0).cast("int"))
    sizes = entries.groupBy("k").agg(F.count("*").alias("n"), home.alias("home")).where("n > 1 and home = 1")
    sizes, sizes_path = common.written(sizes.select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("m")), "buckets")
    live = entries.join(sizes, "k")
    members = live.join(hashed.select("cid", "node", "mult", "label", "d", "v", "codes"), "cid")
    members = members.withColumn("bucket", F.element_at("codes", F.col("pos") + 1)).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    members = members.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("m", "other")
    keys = ["label", "d", "k", "i", "j"]
    blocks = members.repartition(*keys).sortWithinPartitions("d", *keys)
    found, found_path = common.written(_compared(blocks, least, plan), "links")

    component, _ = common.connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = hashed.select("cid", "h1", "h2", "node", "mult").join(links, "cid", "left").join(component, "node", "left")
    placed = placed.select("h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
    placed, _ = common.written(placed, "classes")
    common.drop(vectors.sparkSession, hashed_path, sizes_path, found_path)
    out = read.select("id", "valid", "h1", "h2").join(placed.withColumn("valid", F.lit(True)), ["h1", "h2", "valid"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "id").alias("component_id"))


def exact_links(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """Brute force: rows (key, n_links) of the query rows against all rows of their labels, for measuring recall.

    The queries are a stated set that fits a task; they are sent to every partition of the vectors.
    """
    held = [(r[0], list(r[1]), r[2]) for r in queries.select(key, vector, label).collect()]
    shared = vectors.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [q[0] for q in shared.value]
        total = np.zeros(len(ids), np.int64)
        unit = _unit(np.array([q[1] for q in shared.value]))
        labels = np.array([q[2] for q in shared.value])
        for batch in batches:
            x = _unit(np.array(batch.column(1).to_pylist(), dtype=np.float64))
            own = np.asarray(batch.column(2))[None, :] == labels[:, None]
            total += ((unit @ x.T >= least) & own).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], [key, "n"])

    counted = vectors.select(key, vector, label).mapInArrow(scan, f"{key} long, n long").groupBy(key).agg((F.sum("n") - 1).alias("n_links"))
    return counted
