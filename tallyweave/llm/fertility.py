"""Quality rules from tokeniser fertility.

Public vocabularies are run over every word of a text: a sentence-piece vocabulary with byte fallback, and a byte-level
one. They measure

* ``chars_per_token`` and ``bytes_chars_per_token``: code points in words by tokens of either vocabulary;
* ``tokens_per_word`` of the first;
* ``byte_share``: the part of its tokens that are byte fallbacks;
* ``token_entropy``: the collision entropy of its tokens in bits, ``-log2(sum c (c-1) / (m (m-1)))`` over counts c of
  the m tokens. It is unbiased in the sum, so short and long texts share one band.

A band lies around the median of a measure, as wide as a multiple of the distance between its quartiles (lower and upper
multiples are ``BANDS``), and is widened for short texts by ``sqrt(1 + 200 / n_words)``. A document outside a band is
rejected. Quartiles are those of all documents that pass the base rules, exact on a grid of ``STEP``. They are taken for
each language, each main script and the whole corpus, and pulled by their count n: ``PULL^2 / (n^2 + PULL^2)`` of a
language's quartiles are those of the document's script, drawn apart by ``APART`` since languages differ; likewise for a
script and the corpus, and for the corpus and ``PRIOR``. So rare languages, null ones and small tables have bands too, the
wider the fewer documents stand behind them, and one more document moves them little.

Base rules: fewer than 50 words, or more than half of the words within word triples that occur twice or more.

Defined results
---------------
* Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A null or empty text has no words and fails the base rules.
* ``n_dup_lines`` counts lines (split at \\n) that hold a word and equal an earlier line of the text.
* Repeated rows are measured one by one. An empty table gives an empty table. Only the key, text and language columns
  are read, whatever the others' names. Very long texts are measured whole; a text takes memory in proportion.
* Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common, scripts

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that weigh as much as what a group's quartiles are pulled to, and the grid of the quartiles.
PULL, STEP = 25, 0.001
#: How far the quartiles of a script, of the corpus and of the prior are drawn apart for what is pulled to them.
APART = {"lang": 3, "script": 8, "all": 1}
#: Bands are widened by the square root of 1 + this over the number of words.
SHORT_WORDS = 200
#: For each measure: quartile distances below and above the median, and the least half-width.
BANDS = {
    "chars_per_token": (4.0, 8.0, 0.05),
    "bytes_chars_per_token": (3.5, 8.0, 0.05),
    "tokens_per_word": (6.0, 6.0, 0.3),
    "token_entropy": (3.5, 10.0, 0.5),
    "byte_share": (8.0, 8.0, 0.05),
}
#: Quartiles of a corpus of no documents.
PRIOR = {
    "chars_per_token": (2.0, 3.0, 4.0),
    "bytes_chars_per_token": (2.0, 3.0, 4.0),
    "tokens_per_word": (1.5, 2.5, 4.0),
    "token_entropy": (5.0, 6.0, 8.0),
    "byte_share": (0.0, 0.0, 0.1),
}
#: Bands up to this number (pairs of language and script) are joined by broadcast.
MAX_BROADCAST_BANDS = 10_000
#: Words kept by a worker in each of two generations.
MEMO_WORDS = 160_000
#: Texts measured at a time.
SLICE_ROWS = 300
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_SCRIPTS = sorted({r[0] for r in scripts.RANGES} | {"other"})
_LATIN = _SCRIPTS.index("latin")


class _Vocabularies:
    """Both vocabularies and what they say of single words.

    A known word has its token ids (as int32), the byte fallbacks among them, its tokens in the byte vocabulary, and
    its script.
    """

    def __init__(self, piece_model: str, byte_ranks: str, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.fallback = {i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i)}
        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.new: dict = {}
        self.old: dict = {}

    def learn(self, words: set[bytes]) -> None:
        """Make sure that these words are known; what a worker has kept beyond its bound goes."""
        if len(self.new) > MEMO_WORDS:
            self.old, self.new = self.new, {}
        new, old, fallback, encode = self.new, self.old, self.fallback, self.bytes.encode_ordinary
        todo = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    todo.append(w)
        texts = [w.decode("utf-8", "replace") for w in todo]
        for w, t, ids in zip(todo, texts, self.pieces.encode(texts, num_threads=1) if todo else (), strict=True):
            fallbacks = 0 if fallback.isdisjoint(ids) else sum(i in fallback for i in ids)
            new[w] = (array("i", ids).tobytes(), fallbacks, len(encode(" " + t)), _script_at(t))


def _script_at(word: str) -> int:
    """The place of a word's script in ``_SCRIPTS``; -1 for a word with no letter."""
    if word[0].isascii() and word[0].isalpha():
        return _LATIN
    script = scripts.word_script(word)
    return -1 if script is None else _SCRIPTS.index(script)


_LOADED: dict[tuple, _Vocabularies] = {}


def _load(*paths: str) -> _Vocabularies:
    common.keep_only(__name__, _LOADED.clear)
    if paths not in _LOADED:
        _LOADED[paths] = _Vocabularies(*paths)
    return _LOADED[paths]


def _repeated(ids: np.ndarray) -> int:
    """Words inside word triples that occur twice or more."""
    if len(ids) < 4:
        return 0
    m = int(ids.max()) + 1
    pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= twice
    return int(inside.sum())


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n += line in seen
            seen.add(line)
    return n


_FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_tokens": "long",
    "chars_per_token": "double", "bytes_chars_per_token": "double", "tokens_per_word": "double", "byte_share": "double", "token_entropy": "double", "script": "string",
}


def measure_texts(texts: list[bytes | None], vocabularies: _Vocabularies) -> list[tuple]:
    """The values of ``_FIELDS`` for each text in UTF-8."""
    split = [(t or b"").split() for t in texts]
    vocabularies.learn(set().union(*split))
    return [_measured(t or b"", words, vocabularies) for t, words in zip(texts, split, strict=True)]


def _measured(raw: bytes, words: list[bytes], vocabularies: _Vocabularies) -> tuple:
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0, 0, None, None, None, None, None, None
    order: dict[bytes, int] = {}
    ids = np.array([order.setdefault(w, len(order)) for w in words], np.int64)
    each = np.bincount(ids)
    pieces, fallback, in_bytes, script = zip(*map(vocabularies.new.__getitem__, order), strict=True)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    tokens = int(lengths @ each)
    flat = np.frombuffer(b"".join(pieces), np.int32)
    counts = np.bincount(np.unique(flat, return_inverse=True)[1], weights=np.repeat(each, lengths))
    same = float((counts * (counts - 1)).sum())
    entropy = math.log2(tokens * (tokens - 1) / max(same, 1.0)) if tokens > 1 else 0.0
    chars = len(raw.decode("utf-8", "replace")) - (len(raw) - len(raw.translate(None, _SPACES)))
    by_script = np.bincount(np.array(script) + 1, weights=each, minlength=2)
    by_script[0] = 0
    main = _SCRIPTS[int(by_script.argmax()) - 1] if by_script.any() else None
    repeated = _repeated(ids)
    return (
        len(words), chars, symbols, _dup_lines(raw), repeated, tokens,
        chars / max(tokens, 1), chars / max(int(np.array(in_bytes) @ each), 1), tokens / len(words), int(np.array(fallback) @ each) / max(tokens, 1), entropy, main,
    )


def measure(docs: DataFrame, paths: tuple[str, str, str], *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (key, lang, the values of ``_FIELDS``), one for each row. ``paths``: piece model, byte ranks, byte pattern."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _load(*paths)
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = measure_texts(part.column(2).cast(pa.binary()).to_pylist(), vocabularies)
                arrays = [pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["key", "lang", *_FIELDS])

    read = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    kind = read.schema[0].dataType.simpleString()
    return read.mapInArrow(scan, ", ".join([f"key {kind}", "lang string", *[f"{k} {v}" for k, v in _FIELDS.items()]]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quartiles(measured: DataFrame) -> DataFrame:
    """Rows (kind, name, measure, n, q array of three quartiles) of languages, scripts and, without a name, the corpus."""
    good = measured.where(~base_failed())
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / STEP).cast("long").alias("bin")) for m in BANDS])
    counts = good.select("lang", "script", F.inline(bins)).groupBy("lang", "script", "measure", "bin").agg(F.count("*").alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("lang", F.col("lang")), ("script", F.col("script")), ("all", F.lit("")))])
    counts = counts.select("measure", "bin", "n", F.inline(kinds)).where("name is not null").groupBy("kind", "name", "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("kind", "name", "measure")
    counts = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
    three = F.array(*[F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin"))) * STEP for p in (0.25, 0.5, 0.75)])
    return counts.groupBy("kind", "name", "measure").agg(F.max("total").cast("double").alias("n"), three.alias("q"))


def bands(measured: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (of_lang, of_script, q_<measure>): the pulled quartiles for every pair of language and script that occurs."""
    prior = F.array(*[F.struct(F.lit(m).alias("measure"), F.array(*map(F.lit, q)).alias("q")) for m, q in PRIOR.items()])
    rows = measured.select(F.col("lang").alias("of_lang"), F.col("script").alias("of_script")).distinct().select("*", F.inline(prior))
    for kind, name in (("all", F.lit("")), ("script", F.col("of_script")), ("lang", F.col("of_lang"))):
        own = found.where(F.col("kind") == kind).select("name", F.col("measure").alias("m"), F.col("n"), F.col("q").alias("own"))
        rows = rows.join(own, (name == F.col("name")) & (F.col("measure") == F.col("m")), "left")
        # what a group without documents is pulled to holds alone
        weight = F.coalesce(F.lit(float(PULL**2)) / (F.col("n") * F.col("n") + PULL**2), F.lit(1.0))
        to = _apart(F.col("q"), APART[kind])
        pulled = F.zip_with(F.coalesce("own", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), to, lambda x, y: x + (y - x) * F.col("weight"))
        rows = rows.withColumn("weight", weight).select("of_lang", "of_script", "measure", pulled.alias("q"))
    return rows.groupBy("of_lang", "of_script").agg(*[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(f"q_{m}") for m in BANDS])


def _apart(q: Column, factor: float) -> Column:
    """Quartiles drawn apart around their median."""
    return F.transform(q, lambda x: q[1] + (x - q[1]) * factor)


def _outside(m: str) -> Column:
    """Whether the measure lies outside its band."""
    low, high, least = BANDS[m]
    q = F.col(f"q_{m}")
    spread = F.sqrt(1 + SHORT_WORDS / F.col("n_words"))
    width = lambda k: F.greatest((q[2] - q[0]) * k, F.lit(least)) * spread
    return (F.col(m) < q[1] - width(low)) | (F.col(m) > q[1] + width(high))


def judge(measured: DataFrame) -> DataFrame:
    """The measured rows with ``base_failed``, ``reasons`` (measures outside their bands) and ``kept``.

    ``measured`` is read twice, so it should be a written table.
    """
    found, path = common.written(quartiles(measured), "quartiles")
    table, _ = common.written(bands(measured, found), "bands")
    common.drop(measured.sparkSession, path)
    near = F.broadcast(table) if table.count() <= MAX_BROADCAST_BANDS else table
    out = measured.join(near, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("script").eqNullSafe(F.col("of_script"))).withColumn("base_failed", base_failed())
    reasons = F.array_compact(F.array(*[F.when(_outside(m), F.lit(m)) for m in BANDS]))
    out = out.withColumn("reasons", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(reasons))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).select("key", "lang", *_FIELDS, "base_failed", "reasons", "kept")


def quality(docs: DataFrame, paths: tuple[str, str, str], *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Measures and verdict of every row."""
    measured, _ = common.written(measure(docs, paths, key=key, text=text, lang=lang), "measured")
    return judge(measured).withColumnRenamed("key", key)
