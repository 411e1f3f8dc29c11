"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

Index
-----
1. Equal vectors are one node. A node's vector is sketched in 16-bit steps; sketches travel, vectors stay.
2. *First lists.* Several tables deal the nodes to buckets by the signs of random projections against medians; the medians
   come from a sample of at most about ``SAMPLE`` vectors, the dealing takes every node. Within a bucket, or a chunk of
   a large one, each node meets all others and keeps its ``DEGREE`` nearest.
3. *Rounds.* Every node is the centre of a group: the nodes that it lists and those that list it. All members of a group
   are compared with each other (neighbours of neighbours), and what beats a member's last neighbour is proposed to it.
   A centre that very many list has several groups, so no group grows; each has the centre's own list. Rounds end when
   less than ``CHANGED`` of the entries are new.

Search
------
A query starts at the nearest of ``SEEDS`` sampled nodes, and at the node of its own vector if there is one. In every hop it
expands the next ``EXPAND`` of the best ``BEAM`` nodes that it knows; their rows hold the sketches of their neighbours.
It is done when its beam is expanded. Beams are scored by the whole vectors in double precision, in order of the
components; nodes then give way to their rows.

Rows go through groups of bounded size only; joins are equi-joins, and state is written in each round and hop. Up to
``BUCKET`` vectors the first lists are exact. ``exact_nearest`` is the brute-force version, for measuring the recall.

Defined results
---------------
* Vectors that are null, empty, all zero, or hold null, NaN or infinite components, and rows with a null id, take no part,
  neither as query nor as candidate. Vectors of different lengths are no candidates of each other.
* Rows that repeat a vector are candidates each, in order of their ids. Rows that share the query's id are the query's own.
  A query row that occurs twice has its rows twice.
* Fewer than k candidates: all of them. An empty table gives an empty table. Columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Neighbours that a node lists.
DEGREE = 48
#: Tables of the first lists, nodes of a bucket on average, and vectors that the medians are taken from.
TABLES, BUCKET, SAMPLE = 16, 1024, 16_384
#: Share of new entries below which no further round is made.
CHANGED = 0.1
#: Nodes that every query looks at first, and how many of them it starts from.
SEEDS, STARTS = 1024, 8
#: Nodes that a query keeps, and how many it expands in a hop.
BEAM, EXPAND = 96, 32
#: Centres with several groups up to this number are told to all tasks; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Entries that a task gathers before it keeps the best of each node and sends them off.
HELD = 1_000_000
#: Nodes whose entries travel together, on average.
TOGETHER = 256
SEED = 12


def sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as 16-bit steps, and the size of a row's step."""
    step = np.abs(x).max(axis=1) / 32767
    return np.rint(x / step[:, None]).astype("<i2"), step.astype(np.float32)


def best_of(u: np.ndarray, v: np.ndarray, s: np.ndarray, flag: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k entries (v, s, flag) with the largest s of every u, in order; of entries with the same v that with the smaller flag."""
    order = np.lexsort((flag, v, u))
    u, v, s, flag = u[order], v[order], s[order], flag[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s, flag = u[first], v[first], s[first], flag[first]
    order = np.lexsort((v, -s, u))
    u, v, s, flag = u[order], v[order], s[order], flag[order]
    kept = _place(u) < k
    return u[kept], v[kept], s[kept], flag[kept]


def _starts(u: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)


def _place(u: np.ndarray) -> np.ndarray:
    """Place of every value within its run."""
    starts = _starts(u)
    return np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))


def _listed(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _packed(u: np.ndarray, v: np.ndarray, s: np.ndarray, flag: int, parts: int) -> pa.RecordBatch:
    """Entries as few rows (p, us, vs, ss, flag): those of the nodes of one part together."""
    p = ((u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(p, kind="stable")
    p = p[order].astype(np.int64)
    starts = _starts(p)
    columns = [pa.array(p[starts]), *(_listed(starts, c[order]) for c in (u, v, s)), pa.array(np.full(len(starts), flag, np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["p", "us", "vs", "ss", "flag"])


_PACKED = "p long, us array<long>, vs array<long>, ss array<float>, flag int"


class _Held:
    """Entries (u, v, s) of a task: what is gathered goes off as packed rows, the best of each node only."""

    def __init__(self, flag: int, parts: int):
        self.flag, self.parts, self.entries, self.count = flag, parts, [], 0

    def add(self, u: np.ndarray, v: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.entries.append((u, v, s))
        self.count += len(u)
        if self.count > HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            u, v, s = (np.concatenate(c) for c in zip(*self.entries, strict=True))
            u, v, s, _ = best_of(u, v, s, np.zeros(len(u), np.int32), DEGREE)
            yield _packed(u, v, s, self.flag, self.parts)
        self.entries, self.count = [], 0


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, which lie one after the other, and where groups start, the end included."""
    rest: pa.Table | None = None

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in keys:
            column = np.asarray(table.column(c).combine_chunks())
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        starts = starts_of(rest)
        if len(starts) > 1:  # the last group may go on
            yield rest.slice(0, starts[-1]), starts
            rest = rest.slice(starts[-1])
    if rest is not None:
        yield rest, np.append(starts_of(rest), rest.num_rows)


class _Rows:
    """Sketches of a table's rows; those of neighbouring rows of one length as a matrix."""

    def __init__(self, sketches: pa.ChunkedArray | pa.Array, steps: pa.ChunkedArray | pa.Array):
        flat = (sketches.combine_chunks() if isinstance(sketches, pa.ChunkedArray) else sketches).cast(pa.binary())
        _, ends, data = flat.buffers()
        self.ends = np.frombuffer(ends, np.int32)[flat.offset : flat.offset + len(flat) + 1] // 2
        self.data = np.frombuffer(data, "<i2") if data is not None else np.zeros(0, "<i2")
        self.steps = np.asarray(steps.combine_chunks() if isinstance(steps, pa.ChunkedArray) else steps)

    def matrix(self, a: int, b: int) -> np.ndarray:
        return self.data[self.ends[a] : self.ends[b]].reshape(b - a, -1).astype(np.float32) * self.steps[a:b, None]


def _array(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().flatten())


def _digests(vector: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(vector), "h2": F.xxhash64(F.lit("second"), vector)}


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v, h1, h2) that take part; negative zeros become zeros, so that equal vectors have equal digests."""
    kind = "float" if df.schema[vector].dataType.elementType.typeName() == "float" else "double"
    read = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x.cast(kind))).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    read = read.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return read.withColumns(_digests(F.col("v")))


def _sketched(rows: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, and d, sk, step of the column v: length, sketch and step."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(len(carried))
            sizes, made, steps = np.asarray(vectors.value_lengths()), [b""] * batch.num_rows, np.zeros(batch.num_rows, np.float32)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                sketches, steps[at] = sketch(np.asarray(vectors.take(pa.array(at)).flatten()).astype(np.float64).reshape(len(at), int(d)))
                for i, row in zip(at, sketches, strict=True):
                    made[i] = row.tobytes()
            columns = [*batch.columns[: len(carried)], pa.array(sizes.astype(np.int32)), pa.array(made, pa.binary()), pa.array(steps)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "d", "sk", "step"])

    return rows.select(*carried, "v").mapInArrow(scan, ", ".join([*(f"{c} long" for c in carried), "d int, sk binary, step float"]))


class Index:
    """The graph of some vectors: nodes with their sketches, lists of neighbours, and what searches start from."""

    def __init__(self, vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.paths = vectors.sparkSession, []
        self.rows = self._kept(_valid(vectors, key, vector), "rows")
        classes = self.rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.first("v").alias("v"))
        self.classes = self._kept(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.nodes = self._kept(_sketched(self.classes, "cid"), "nodes")
        sizes = self.nodes.groupBy("d").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        total = sizes.agg(F.sum("n")).first()[0] or 0
        self.parts = -(-total // TOGETHER) or 1
        # some vectors of every length, at most about SAMPLE in all
        some = self.nodes.where(F.pmod(F.xxhash64("cid"), F.lit(max(1, -(-total // SAMPLE)))) == 0).collect()
        by_length: dict[int, list] = {}
        for r in sorted(some, key=lambda r: r["cid"]):
            by_length.setdefault(r["d"], []).append((r["cid"], np.frombuffer(bytes(r["sk"]), "<i2").astype(np.float32) * r["step"]))
        self.seeds = {d: (np.array([c for c, _ in rows[:SEEDS]]), np.stack([x for _, x in rows[:SEEDS]])) for d, rows in by_length.items()}
        bits = max(0, (-(-most // BUCKET) - 1).bit_length())
        self.graph, path = common.written(self._first_lists(bits, {d: np.stack([x for _, x in rows]) for d, rows in by_length.items()}), "graph")
        self.changes = []
        while bits:
            graph, new = common.written(self._round(), "graph")
            common.drop(self.spark, path)
            self.graph, path = graph, new
            self.changes.append((graph.agg(F.sum("fresh")).first()[0] or 0) / max(1, most * min(DEGREE, most)))
            if self.changes[-1] < CHANGED:
                break
        edges = self.graph.select("u", F.explode("vs").alias("cid")).join(self.nodes.select("cid", "sk", "step"), "cid")
        # a node's list is bounded by DEGREE
        self.wide = self._kept(edges.groupBy("u").agg(F.collect_list(F.struct("cid", "sk", "step")).alias("near")), "wide")
        common.drop(self.spark, path)

    def _kept(self, df: DataFrame, kind: str) -> DataFrame:
        out, path = common.written(df, kind)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        common.drop(self.spark, *self.paths)

    def _merged(self, entries: DataFrame) -> DataFrame:
        """Rows (u, vs, ss, kth, fresh) of the best of all packed entries of a node; fresh counts entries of flag 1."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in _whole(batches, ["p"]):
                for a, b in zip(starts, starts[1:], strict=False):  # parts one by one
                    part = table.slice(a, b - a)
                    sizes = np.asarray(part.column("us").combine_chunks().value_lengths())
                    u, v, s, flag = best_of(_flat(part, "us"), _flat(part, "vs"), _flat(part, "ss"), np.repeat(_array(part, "flag"), sizes), DEGREE)
                    first = _starts(u)
                    ends = np.append(first[1:], len(u))
                    kth = np.where(ends - first == DEGREE, s[ends - 1], -np.inf).astype(np.float32)
                    columns = [pa.array(u[first]), _listed(first, v), _listed(first, s), pa.array(kth), pa.array(np.add.reduceat(flag, first).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["u", "vs", "ss", "kth", "fresh"])

        return entries.repartition("p").sortWithinPartitions("p").mapInArrow(scan, "u long, vs array<long>, ss array<float>, kth float, fresh long")

    def _first_lists(self, bits: int, sample: dict[int, np.ndarray]) -> DataFrame:
        tables = TABLES if bits else 1
        planes = {d: np.random.default_rng((SEED, d)).normal(size=(d, tables * bits)).astype(np.float32) for d in sample}
        middle = {d: np.median(x @ planes[d], axis=0) for d, x in sample.items()}
        shared = self.spark.sparkContext.broadcast((planes, middle))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes, middle = shared.value
            for batch in batches:
                rows, lengths = _Rows(batch.column(2), batch.column(3)), np.asarray(batch.column(1))
                out = np.zeros((batch.num_rows, tables), np.int64)
                for i in range(0, batch.num_rows if bits else 0):
                    d = int(lengths[i])
                    if d in planes:  # a length that no sampled vector has goes to one bucket, by chunks
                        out[i] = (rows.matrix(i, i + 1)[0] @ planes[d] > middle[d]).reshape(tables, bits) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays([*batch.columns, _listed(np.arange(0, out.size, tables), out.ravel())], [*batch.schema.names, "codes"])

        coded = self.nodes.select("cid", "d", "sk", "step").mapInArrow(code, "cid long, d int, sk binary, step float, codes array<long>")
        coded, path = common.written(coded, "codes")
        self.paths.append(path)
        keys = ["d", "t", "code"]
        places = coded.select("cid", "d", F.posexplode("codes").alias("t", "code"))
        sizes = self._kept(places.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / (2 * BUCKET)).alias("chunks")), "buckets")
        dealt = coded.select("cid", "d", "sk", "step", F.posexplode("codes").alias("t", "code")).join(sizes, keys)
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("cid", "t"), F.col("chunks"))).drop("chunks")
        keys = [*keys, "chunk"]

        parts = self.parts

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(0, parts)
            for table, starts in _whole(batches, keys):
                rows, cid = _Rows(table.column("sk"), table.column("step")), _array(table, "cid")
                for a, b in zip(starts, starts[1:], strict=False):
                    x, k = rows.matrix(a, b), min(DEGREE, b - a - 1)
                    if not k:
                        continue
                    for at in range(0, b - a, 512):
                        dots = x[at : at + 512] @ x.T
                        own = np.arange(len(dots))
                        dots[own, own + at] = -np.inf
                        near = np.argpartition(-dots, k - 1, axis=1)[:, :k]
                        yield from held.add(np.repeat(cid[a + at : a + at + len(dots)], k), cid[a:b][near].ravel(), np.take_along_axis(dots, near, 1).ravel())
            yield from held.send()

        return self._merged(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, _PACKED))

    def _round(self) -> DataFrame:
        """The graph after all groups of neighbours were compared."""
        edges = self.graph.select("u", F.explode("vs").alias("v"))
        several = edges.groupBy("v").agg(F.ceil(F.count("*") / (2 * DEGREE)).alias("groups")).where("groups > 1")
        several, path = common.written(several, "hubs")
        self.paths.append(path)
        near = F.broadcast(several) if several.count() <= MAX_BROADCAST_ROWS else several
        groups = F.coalesce("groups", F.lit(1))
        own = self.graph.join(near.withColumnRenamed("v", "u"), "u", "left").select(F.col("u").alias("centre"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), "vs")
        listing = edges.join(near, "v", "left").select(F.col("v").alias("centre"), F.pmod(F.xxhash64("u"), groups).alias("part"), F.col("u").alias("cid"))
        members = own.select("centre", "part", F.explode("vs").alias("cid")).unionByName(listing)
        known = self.nodes.select("cid", "sk", "step").join(self.graph.select(F.col("u").alias("cid"), "kth"), "cid")
        members = members.join(known, "cid").repartition("centre", "part").sortWithinPartitions("centre", "part")

        parts = self.parts

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(1, parts)
            for table, starts in _whole(batches, ["centre", "part"]):
                rows, cid, kth = _Rows(table.column("sk"), table.column("step")), _array(table, "cid"), _array(table, "kth")
                for a, b in zip(starts, starts[1:], strict=False):
                    ids, at = np.unique(cid[a:b], return_index=True)
                    x = rows.matrix(a, b)[at]
                    dots = x @ x.T
                    np.fill_diagonal(dots, -np.inf)
                    p, q = np.nonzero(dots > kth[a + at][:, None])
                    yield from held.add(ids[p], ids[q], dots[p, q])
            yield from held.send()

        def known_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = np.repeat(np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths()))
                yield _packed(u, np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten()), 0, parts)

        known = self.graph.select("u", "vs", "ss").mapInArrow(known_entries, _PACKED)
        return self._merged(known.unionByName(members.mapInArrow(compare, _PACKED)))

    def search(self, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """Rows (query_id, rank, vec_id, score): the k nearest found of every query row, without rows of its own id."""
        asked = _valid(queries, key, vector).withColumn("q", F.monotonically_increasing_id())
        asked, asked_path = common.written(asked, "queries")
        known = self.classes.select("h1", "h2", F.col("cid").alias("own"))
        seeds, beam = self.spark.sparkContext.broadcast(self.seeds), max(BEAM, 2 * k)
        sketched = _sketched(asked, "q").join(asked.join(known, ["h1", "h2"], "left").select("q", F.coalesce("own", F.lit(-1)).alias("own")), "q")
        sketched, sketched_path = common.written(sketched, "sketched")

        def state(q: np.ndarray, v: np.ndarray, s: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
            """Beams in order; ``todo`` has the nodes to expand next, which count as expanded from now on."""
            starts = _starts(q)
            nth = np.cumsum(open_)
            nth -= np.repeat(nth[starts] - open_[starts], np.diff(np.append(starts, len(q))))
            now = (open_ == 1) & (nth <= EXPAND)
            ends = np.append(starts[1:], len(q))
            floor = np.where(ends - starts == beam, s[ends - 1], -np.inf).astype(np.float32)
            todo = np.concatenate([[0], np.cumsum(now)])[starts]
            columns = [pa.array(q[starts]), _listed(starts, v), _listed(starts, s), _listed(starts, np.where(now, 0, open_).astype(np.int32)), _listed(todo, v[now]), pa.array(floor)]
            return pa.RecordBatch.from_arrays(columns, ["q", "vs", "ss", "open", "todo", "floor"])

        schema = "q long, vs array<long>, ss array<float>, open array<int>, todo array<long>, floor float"

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, lengths, own = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(4))
                rows, parts = _Rows(batch.column(2), batch.column(3)), []
                for i in range(batch.num_rows):
                    x = rows.matrix(i, i + 1)[0]
                    cids, others = seeds.value.get(int(lengths[i]), (np.zeros(0, np.int64), np.zeros((0, len(x)), np.float32)))
                    dots = others @ x
                    first = np.argsort(-dots, kind="stable")[:STARTS]
                    v, s = cids[first], dots[first]
                    if own[i] >= 0:
                        v, s = np.append(v, own[i]), np.append(s, x @ x)
                    parts.append((np.full(len(v), q[i]), v, s.astype(np.float32)))
                if parts:
                    q, v, s = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield state(*best_of(q, v, s, np.ones(len(q), np.int32), beam))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, floor, near = np.asarray(batch.column(0)), np.asarray(batch.column(3)), batch.column(4)
                own, flat = _Rows(batch.column(1), batch.column(2)), near.flatten()
                others, cid = _Rows(flat.field("sk"), flat.field("step")), np.asarray(flat.field("cid"))
                ends = np.concatenate([[0], np.cumsum(np.asarray(near.value_lengths()))])
                us, vs, ss = [], [], []
                for i in range(batch.num_rows):
                    dots = others.matrix(ends[i], ends[i + 1]) @ own.matrix(i, i + 1)[0]
                    better = dots > floor[i]
                    vs.append(cid[ends[i] : ends[i + 1]][better])
                    ss.append(dots[better])
                    us.append(len(vs[-1]))
                if us:
                    starts = np.concatenate([[0], np.cumsum(us)[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(q), _listed(starts, np.concatenate(vs)), _listed(starts, np.concatenate(ss)), _listed(starts, np.ones(sum(us), np.int32))], ["q", "vs", "ss", "open"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, _ in _whole(batches, ["q"]):
                sizes = np.asarray(table.column("vs").combine_chunks().value_lengths())
                yield state(*best_of(np.repeat(_array(table, "q"), sizes), _flat(table, "vs"), _flat(table, "ss"), _flat(table, "open"), beam))

        beams, path = common.written(sketched.mapInArrow(begin, schema), "beams")
        while beams.where(F.size("todo") > 0).limit(1).count():
            frontier = beams.select("q", "floor", F.explode("todo").alias("u")).join(sketched.select("q", "sk", "step"), "q")
            met = frontier.join(self.wide, "u").select("q", "sk", "step", "floor", "near")
            met = met.mapInArrow(score, "q long, vs array<long>, ss array<float>, open array<int>")
            lists = beams.select("q", "vs", "ss", "open").unionByName(met)
            new, new_path = common.written(lists.repartition("q").sortWithinPartitions("q").mapInArrow(merge, schema), "beams")
            common.drop(self.spark, path)
            beams, path = new, new_path

        product = F.aggregate(F.zip_with("v", "x", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
        ends = beams.select("q", F.explode("vs").alias("cid")).join(self.classes.select("cid", "least", "v"), "cid")
        ends = ends.join(asked.select("q", F.col("id").alias("query_id"), F.col("v").alias("x")), "q").where(F.size("v") == F.size("x"))
        ends = ends.select("q", "query_id", "cid", "least", product.alias("score"))
        # one of the first k + 1 nodes may be the query's own; each has its k + 1 smallest ids
        by_node = Window.partitionBy("q").orderBy(F.desc("score"), "least", "cid")
        ends = ends.withColumn("nth", F.row_number().over(by_node)).where(F.col("nth") <= k + 1)
        ids = self.rows.select("h1", "h2", "id").withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 1)
        ids = ids.join(self.classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("cid", F.col("id").alias("vec_id"))
        found = ends.drop("nth", "least").join(ids, "cid").where("vec_id <> query_id")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        out, _ = common.written(found.select("query_id", "rank", "vec_id", "score"), "nearest")
        common.drop(self.spark, path, asked_path, sketched_path)
        return out


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Index the vectors, search for the queries, drop the index."""
    index = Index(vectors, key=key, vector=vector)
    found = index.search(queries, k=k, key=key, vector=vector)
    index.drop()
    return found
