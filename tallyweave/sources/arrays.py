"""One JSON array of any size, read by many tasks.

A file is read in pieces that end at a closing brace, which Spark's line reader splits by byte ranges. Whether a byte stands
in a string, and how deep, depends on all before it; so a first pass folds each range from both possible starts (in a
string or not) into its end and its change of depth, a row a range, and the driver, which holds the list of ranges anyway,
chains these. The second pass knows where each range starts and cuts the elements out; what a range has of an element that
it does not finish is put together with the rest from the ranges behind.

Elements are objects. Text outside the array is passed over; an array that does not end gives the elements that do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARK = re.compile(r'[{}\[\]"\\]')


def fold(piece: str, quoted: bool, escaped: bool) -> tuple[bool, bool, int]:
    """Whether a piece ends in a string and behind a backslash of it, and how many braces and brackets it leaves open."""
    depth, at = 0, 0
    if escaped:
        at = 1
    while m := _MARK.search(piece, at):
        at, c = m.end(), m[0]
        if quoted:
            if c == '"':
                quoted = False
            elif c == "\\":
                if at >= len(piece):
                    return True, True, depth
                at += 1
        elif c == '"':
            quoted = True
        elif c != "\\":
            depth += 1 if c in "{[" else -1
    return quoted, False, depth


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, start, piece) in order within each range of a file."""
    read = spark.read.text(path, lineSep="}")
    meta = F.col("_metadata")
    return read.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.col("value").alias("piece"), meta["file_size"].alias("size"), meta["file_block_length"].alias("length"))


def _ended(pieces: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, bool]]:
    """(file, start, piece with its brace, whether it is the first of its range)."""
    last = None
    for batch in pieces:
        for file, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            yield file, start, piece + "}", (file, start) != last
            last = file, start


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, element): the texts of the objects of the JSON array in each file of a path."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every range its end and change of depth, from either start."""
        now: dict[tuple[str, int], list] = {}
        for file, start, piece, _ in _ended(batches):
            both = now.setdefault((file, start), [[False, False, 0], [True, False, 0]])
            for s in both:
                quoted, escaped, depth = fold(piece, s[0], s[1])
                s[:] = [quoted, escaped, s[2] + depth]
        rows = [(f, at, *a, *b) for (f, at), (a, b) in now.items()]
        if rows:
            kinds = (pa.string(), pa.int64(), *(pa.bool_(), pa.bool_(), pa.int64()) * 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "q0", "e0", "d0", "q1", "e1", "d1"])

    ranges = _ranges(spark, path).select("file", "start", "piece")
    folded = ranges.mapInArrow(states, "file string, start long, q0 boolean, e0 boolean, d0 long, q1 boolean, e1 boolean, d1 long")
    begins, at, state = {}, None, (False, False, 0)
    for r in sorted(folded.collect(), key=lambda r: (r["file"], r["start"])):  # a row for each range
        if r["file"] != at:
            at, state = r["file"], (False, False, 0)
        begins[r["file"], r["start"]] = state
        quoted, escaped, depth = (r["q1"], r["e1"], r["d1"]) if state[0] else (r["q0"], r["e0"], r["d0"])
        state = (quoted, escaped, state[2] + depth)
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (file, start, nr, text, opens, closes): whole elements, and parts of those that reach over a range's ends."""
        out: list[tuple] = []
        own: tuple | None = None

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["file", "start", "nr", "text", "opens", "closes"])
            out.clear()
            return batch

        held, nr, opened = [], 0, True
        for file, start, piece, new in _ended(batches):
            if new:
                if held:
                    out.append((*own, nr, "".join(held), opened, False))
                own, held, nr = (file, start), [], 0
                quoted, escaped, depth = shared.value[file, start]
                opened = depth < 2  # else the range begins within an element
            if depth < 2:  # between elements: up to the next one
                brace = piece.find("{")
                body = piece[brace:] if brace >= 0 else ""
                quoted, escaped, more = fold(piece, quoted, escaped)
                depth += more
                if not body or depth < 1 and not body:
                    continue
                held, opened = [body], True
            else:
                held.append(piece)
                quoted, escaped, more = fold(piece, quoted, escaped)
                depth += more
            if depth < 2 and held and not quoted:
                out.append((*own, nr, "".join(held), opened, True))
                held, nr = [], nr + 1
                if len(out) >= 1000:
                    yield send()
        if held:
            out.append((*own, nr, "".join(held), opened, False))
        if out:
            yield send()

    parts = ranges.mapInArrow(cut, "file string, start long, nr long, text string, opens boolean, closes boolean")
    whole = parts.where("opens and closes").select("file", F.col("text").alias("element"))
    order = Window.partitionBy("file").orderBy("start", "nr")  # two rows for each range at most
    torn = parts.where("not (opens and closes)").withColumn("begins", F.sum(F.col("opens").cast("int")).over(order))
    joined = torn.groupBy("file", "begins").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "nr", "text"))), lambda p: p["text"]), "").alias("element"), F.max("closes").alias("closes"))
    return whole.unionByName(joined.where("closes and begins > 0").select("file", "element"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON arrays as rows of a schema, as ``spark.read.json`` with ``multiLine`` reads them."""
    row: Column = F.from_json("element", schema)
    return elements(spark, path).select(row.alias("row")).select("row.*")
