"""Language identification of mixed-language texts.

Script ranges narrow the languages of a word to those that were seen in its script; each is scored by character
n-grams; a Viterbi pass over the words with a penalty for switching labels spans. The language of most letters is
the document's.

Training takes, for each language, a bounded sample of about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the key
(of the text where the key is null). Every language is learned and keeps its own most frequent n-grams, equally many
for all: ``LANG_GRAMS``, or as many as keep the table of n-grams by languages within ``MODEL_CELLS``, but at least
``LEAST_GRAMS``. So the model that goes to the workers takes 4 bytes a cell up to some 1,400 languages.

Defined results
---------------
* ``und`` with score 0 where the text is null or has no letter (number signs are none), or where no labelled row
  exists. A text whose letters all lie in scripts that no language was seen in gets the most frequent language, with its prior as the score.
* Ties go to the language that comes first in the order of code points. Repeated rows are labelled one by one, an
  empty table gives an empty table. Only key, text and (for training) language columns are read. Bytes that are no
  UTF-8 count as U+FFFD, which is no letter.
* Words are runs of up to ``WORD_LETTERS`` letters, number signs and combining marks of the whole lower-cased text that
  hold a letter; longer runs are cut. Very long texts are labelled whole: a text takes some 6 bytes for each word and language.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common, scripts

#: Labelled rows that a language is learned from, in expectation.
SAMPLE_ROWS = 2000
#: n-grams of a language at most and at least, cells (n-grams times languages) of the model, and lengths of n-grams.
LANG_GRAMS, LEAST_GRAMS, MODEL_CELLS, ORDERS = 50_000, 16, 1 << 25, (1, 2, 3, 4)
#: Evidence of one word is cut at this many nats, and a switch of language costs this many.
WORD_CAP, SWITCH_PENALTY = 4.0, 10.0
WORD_LETTERS = 32
SMOOTHING = 0.5
#: A language belongs to a script that this share of its words is in.
SCRIPT_SHARE = 0.02
#: Words kept by a worker, and words decoded at a time.
MEMO_WORDS, SLICE_WORDS = 200_000, 400_000
_RUN = re.compile(r"[^\W\d_]{1,%d}" % WORD_LETTERS)
# combining marks (vowel signs, accents) belong to the word; few texts have any, and the others are cut by the faster pattern
_MARKS = "".join(chr(c) for c in range(0x300, 0x12000) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
_MARK = re.compile(f"[{_MARKS}]")  # above Latin-1, all of them
_MARKED_RUN = re.compile(r"(?:[^\W\d_]|[%s]){1,%d}" % (_MARKS, WORD_LETTERS))
_UND = "und"


def _lettered(word: str) -> bool:
    """Whether a run holds a letter; roman numerals, fractions and raised digits are none."""
    return word.isalpha() or any(map(str.isalpha, word))


def runs_of(text: str) -> list[str]:
    """Runs of letters, number signs and combining marks of a text in lower case."""
    lower = text.lower()
    try:
        lower.encode("latin-1")  # no marks among these, which is told at the cost of a copy
        return _RUN.findall(lower)
    except UnicodeEncodeError:
        return (_MARKED_RUN if _MARK.search(lower) else _RUN).findall(lower)


def grams(word: str) -> list[str]:
    """The n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in ORDERS for i in range(len(marked) - n + 1)]


def _draw(key: Column) -> Column:
    """A hash of the key in [0, 1)."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))


class Model:
    """Languages in order, their log priors, log probabilities of n-grams, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, str, int]], words: list[tuple[str, str, int]], rows: dict[str, int]):
        self.langs = sorted(rows)
        at = {v: i for i, v in enumerate(self.langs)}
        total = sum(rows.values())
        self.prior = np.array([math.log(rows[v] / total) for v in self.langs])
        table: dict[str, np.ndarray] = {}
        for gram, lang, n in counts:
            table.setdefault(gram, np.zeros(len(self.langs)))[at[lang]] += n
        # additive smoothing over the n-grams of each length; only differences between languages matter
        names = list(table)
        n = np.array(list(table.values())).reshape(len(names), len(self.langs))
        size = np.array(list(map(len, names)), np.int64)
        for k in ORDERS:
            own = size == k
            if own.any():
                logs = np.log((n[own] + SMOOTHING) / (n[own].sum(0) + SMOOTHING * own.sum()))
                n[own] = logs - logs.max(1, keepdims=True)
        self.row = {g: i + 1 for i, g in enumerate(names)}  # row 0: unknown n-grams
        self.table = np.vstack([np.zeros((1, len(self.langs))), n]).astype(np.float32)
        seen: dict[str, np.ndarray] = {}
        for script, lang, k in words:
            seen.setdefault(script, np.zeros(len(self.langs)))[at[lang]] += k
        share = sum(seen.values()) if seen else np.zeros(len(self.langs))
        self.script_at = {s: i + 1 for i, s in enumerate(seen)}
        masks = [np.where(v >= SCRIPT_SHARE * np.maximum(share, 1), 0, -np.inf) for v in seen.values()]
        # row 0 holds for scripts of no language: such words say nothing
        self.masks = np.vstack([np.zeros((1, len(self.langs))), *[m if np.isfinite(m).any() else 0 * share for m in masks]]).astype(np.float32)
        self.mute = np.array([True, *[not np.isfinite(m).any() for m in masks]])

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, the best language's being 0; nothing below ``-WORD_CAP``."""
        get, flat, sizes, script = self.row.get, [], [], []
        for w in words:
            found = [get(g, 0) for g in grams(w)]
            flat += found
            sizes.append(len(found))
            script.append(self.script_at.get(scripts.word_script(w) or "", 0))
        starts = np.cumsum(sizes) - sizes
        score = np.add.reduceat(self.table[np.array(flat)], starts, axis=0) / np.float32(len(ORDERS))
        score = np.where(self.mute[script][:, None], np.float32(0), score + self.masks[script])
        return np.maximum(score - score.max(1, keepdims=True), np.float32(-WORD_CAP))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``docs`` that have a language and a text."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where("l is not null and t is not null")
    by = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not by:
        return Model([], [], {})
    share = F.create_map(*[F.lit(x) for v, n in by.items() for x in (v, sample_rows / n)])
    sample = rows.where(_draw(F.coalesce(F.col("k").cast("string"), F.concat(F.lit("text/"), "t"))) < F.try_element_at(share, F.col("l"))).select("l", "t")
    each = max(min(LANG_GRAMS, MODEL_CELLS // len(by) ** 2), LEAST_GRAMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for v, t in zip(common.decoded(batch.column(0)), common.decoded(batch.column(1)), strict=True):
                words.setdefault(v, Counter()).update(filter(_lettered, runs_of(t)))
        for v, own in words.items():
            found, by_script = Counter(), Counter()
            for w, n in own.items():
                by_script[scripts.word_script(w)] += n
                for g in grams(w):
                    found[g] += n
            names = [*found, *by_script]
            flags = [False] * len(found) + [True] * len(by_script)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(names)), pa.array(names), pa.array(flags), pa.array([*found.values(), *by_script.values()])], ["l", "g", "is_script", "n"])

    counted = sample.mapInArrow(count, "l string, g string, is_script boolean, n long")
    counted = counted.groupBy("l", "g", "is_script").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l", "is_script").orderBy(F.desc("n"), "g"))
    top = counted.withColumn("place", place).where(F.col("is_script") | (F.col("place") <= each)).orderBy("l", "is_script", "place").collect()
    return Model([(r["g"], r["l"], r["n"]) for r in top if not r["is_script"]], [(r["g"], r["l"], r["n"]) for r in top if r["is_script"]], by)


def viterbi(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of several sequences at once.

    ``scores`` holds the sequences' rows one after the other. Staying costs nothing, any switch the same penalty. Step
    t advances all sequences longer than t; they are taken by falling length, so these are the first ones.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    long_first = lengths[order]
    longest = int(long_first[0])
    active = n - np.searchsorted(long_first[::-1], np.arange(longest), side="right")
    offset = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    step = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = offset[step] + np.repeat(rank, lengths)
    packed = np.empty_like(scores)
    packed[place] = scores
    came = np.empty(scores.shape, np.bool_)  # whether the label was entered by a switch
    best_from = np.empty(len(scores), np.int16)
    value = np.tile(start.astype(np.float32), (n, 1))
    last = np.empty(n, np.int64)
    for t in range(longest):
        a, lo, hi = active[t], offset[t], offset[t + 1]
        if t and a < len(value):
            last[a : len(value)] = value[a:].argmax(1)
            value = value[:a]
        if t:
            arg = value.argmax(1)
            top = value[np.arange(a), arg][:, None] - np.float32(penalty)
            np.less(value, top, out=came[lo:hi])
            best_from[lo:hi] = arg
            value = np.maximum(value, top) + packed[lo:hi]
        else:
            value = value + packed[lo:hi]
    last[: len(value)] = value.argmax(1)
    label = np.empty(len(scores), np.int16)
    state = np.empty(0, np.int64)
    for t in range(longest - 1, -1, -1):
        a, lo, hi = active[t], offset[t], offset[t + 1]
        state = np.concatenate([state, last[len(state) : a]])
        label[lo:hi] = state
        if t:
            state = np.where(came[lo:hi][np.arange(a), state], best_from[lo:hi], state)
    return label[place]


class _Scorer:
    """A worker's model with the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.langs)), np.float32)

    def label(self, texts: list[str | None]) -> list[tuple]:
        """For each text: language, score, spans as (language, first word, last word)."""
        model = self.model
        if len(self.at) > MEMO_WORDS:
            self.clear()
        at, new, ids, sizes, letters = self.at, [], [], [], []
        for text in texts:
            runs = runs_of(text) if text and model.langs else []
            none = set()
            for w in set(runs):
                if w not in at:
                    if _lettered(w):
                        at[w] = len(at)
                        new.append(w)
                    else:
                        none.add(w)
            words = [w for w in runs if w not in none] if none else runs
            ids.append(np.fromiter(map(at.__getitem__, words), np.int64, len(words)))
            letters.append(np.fromiter(map(len, words), np.int64, len(words)))
            sizes.append(len(words))
        if new:
            self.table = np.vstack([self.table, model.words(new)])
        out: list[tuple] = [(_UND, 0.0, [])] * len(texts)
        full = [i for i, n in enumerate(sizes) if n]
        if not full:
            return out
        scores = self.table[np.concatenate([ids[i] for i in full])]
        weight = np.concatenate([letters[i] for i in full])
        lengths = np.array([sizes[i] for i in full])
        start = np.cumsum(lengths) - lengths
        label = viterbi(scores, lengths, model.prior, SWITCH_PENALTY)
        k = len(model.langs)
        owner = np.repeat(np.arange(len(full)), lengths)
        by_label = np.bincount(owner * k + label, weights=weight, minlength=len(full) * k).reshape(-1, k)
        main = by_label.argmax(1)
        share = by_label[np.arange(len(full)), main] / by_label.sum(1)
        # evidence of the words that carry the main label
        own = label == main[owner]
        sums = np.add.reduceat(np.where(own[:, None], scores, 0).astype(np.float64), start, axis=0) + model.prior
        likely = 1.0 / np.exp(np.minimum(sums - sums[np.arange(len(full)), main][:, None], 700.0)).sum(1)
        edge = np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(edge)
        ends = np.concatenate([first[1:], [len(label)]]) - 1
        spans: list[list] = [[] for _ in full]
        for f, e in zip(first.tolist(), ends.tolist(), strict=True):
            d = owner[f]
            spans[d].append({"lang": model.langs[label[f]], "first_word": int(f - start[d]), "last_word": int(e - start[d])})
        for j, i in enumerate(full):
            out[i] = (model.langs[main[j]], float(share[j] * likely[j]), spans[j])
        return out


_SCORERS: dict[str, _Scorer] = {}


def _scorer(name: str, shared) -> _Scorer:
    """A worker's scorer of a broadcast model; it outlives the task, so that words seen before are not scored again."""
    common.keep_only(__name__, _SCORERS.clear)
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = _Scorer(shared.value)
    return _SCORERS[name]


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score, spans), one for each row; ``spans`` are labelled runs of words, counted from 0."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared)
        for batch in batches:
            keys, texts, size, at = batch.column(0), [], 0, 0
            for i, t in enumerate(common.decoded(batch.column(1))):
                texts.append(t)
                size += len(texts[-1] or "")
                if size > 5 * SLICE_WORDS or i == batch.num_rows - 1:
                    made = scorer.label(texts)
                    columns = [pa.array([m[c] for m in made], t) for c, t in enumerate((pa.string(), pa.float64(), _SPANS))]
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), *columns], ["key", "lang_pred", "score", "spans"])
                    texts, size, at = [], 0, i + 1

    read = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = read.schema[0].dataType.simpleString()
    spans = "array<struct<lang: string, first_word: long, last_word: long>>"
    return read.mapInArrow(scan, f"key {kind}, lang_pred string, score double, spans {spans}").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: a third, by the CRC-32 of the key as text."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1
