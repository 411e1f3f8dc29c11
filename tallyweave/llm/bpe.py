"""Byte-level BPE encoding and decoding.

A text is cut at the special tokens' strings, the rest into pretokens by the tokenizer's pattern. A pretoken becomes a
doubly linked list of byte symbols; a priority queue holds (rank, position) of every adjacent pair that has a merge.
The least entry is popped; it is stale, and skipped, when its left symbol is gone or the pair there is no longer the
one that was queued; otherwise the right symbol is unlinked and the two new neighbours are queued. Decoding
concatenates the vocabulary's strings, as bytes, and reads them as UTF-8.

Merges never cross a pretoken, so a worker keeps the ids of pretokens it has seen, in two generations of bounded size;
that changes time only, never ids.

Defined results
---------------
* A null text counts as empty: no tokens, decoded to the empty string. Empty texts too.
* Bytes that are no UTF-8 become U+FFFD, so such a text is not restored. Ids that are null or of no token decode to
  nothing.
* Rows are independent: repeated rows give repeated results, an empty table an empty one. Any text length is handled
  whole; a pretoken of n bytes takes O(n log n). Columns besides key and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Pretokens kept in each of the two generations, and the longest that is kept.
MEMO_ENTRIES, MEMO_CHARS = 180_000, 48

# Code points that the regex library knows as letters or numbers and the tokenizer's Unicode version
# does not know yet; they count as neither.
_UNKNOWN_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: The pattern of byte-level pretokens, with the classes of letters, numbers and the rest left open.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{l}+| ?{n}+| ?{o}+|\s+(?!\S)|\s+"


def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """For texts below the first unknown letter, and for all texts."""
    new = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _UNKNOWN_LETTERS)
    plain = _PATTERN.format(l=r"\p{L}", n=r"\p{N}", o=r"[^\s\p{L}\p{N}]")
    whole = _PATTERN.format(l=rf"[^\P{{L}}{new}]", n=rf"[^\P{{N}}{new}]", o=rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])")
    return regex.compile(plain), regex.compile(whole)


#: A byte that occurs in UTF-8 only where a code point of U+0540 or more stands.
_HIGH = re.compile(rb"[\xd5-\xff]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings.

    Printable bytes of Latin-1 stand for themselves; the others take the code points from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class _Memo(dict):
    """Ids of pretokens, computed where absent."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """A tokenizer read from a ``tokenizers`` JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"], pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), spec["normalizer"]) == ("BPE", "ByteLevel", False, True, None)
        if not plain or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE is read")
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not read")
        self.strings = [b""] * (1 + max(*vocab.values(), *added.values()))
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s)
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.decimals = [str(i) for i in range(len(self.strings))]
        self.whole = list(range(len(self.strings)))  # one object for each id
        self.bytes = [vocab[c] for c in symbols]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.low, self.any = _patterns()
        self.memo = _Memo(lambda piece: tuple(self.merge(piece.encode())))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        sym = [self.bytes[b] for b in piece]
        n, ranks, whole = len(sym), self.merges, self.whole
        if n < 2:
            return [whole[s] for s in sym]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if m := ranks.get((sym[i], sym[i + 1])):
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            if sym[i] < 0 or (j := after[i]) >= n:
                continue
            now = ranks.get((sym[i], sym[j]))
            if now is None or now[0] != rank:
                continue
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := ranks.get((made, sym[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            if (p := before[i]) >= 0 and (m := ranks.get((sym[p], made))):
                heapq.heappush(queue, (m[0], p, m[1]))
        return [whole[s] for s in sym if s >= 0]

    def encode(self, raw: bytes | None) -> list[int]:
        """Ids of a text in UTF-8; special tokens' strings become their ids, nothing is added."""
        if not raw:
            return []
        text = raw.decode("utf-8", "replace")
        pattern = self.any if _HIGH.search(raw) else self.low
        parts = self.cut.split(text) if self.cut else [text]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.added[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.memo.__getitem__, pattern.findall(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The tokenizer of a path, kept for the life of the worker."""
    common.keep_only(__name__, _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


#: Rows that go back to the JVM in one batch.
_ROWS = 500


def _column(values: tuple) -> pa.Array:
    """An Arrow array; lists of ids go through one flat array."""
    if not isinstance(values[0], list):
        return pa.array(values)
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(values), np.int32, int(ends[-1]))))


def _scan(df: DataFrame, read: str, schema: str, row, carry: list[str]) -> DataFrame:
    """mapInArrow: ``row`` makes the values of ``schema`` from a value of the column ``read``; ``carry`` goes along."""
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                made = [row(v.as_py()) for v in part.column(part.num_columns - 1)]
                columns = [_column(c) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*carry, *names])

    kinds = dict(df.dtypes)
    given = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{read}`").alias("__read"))
    return given.mapInArrow(scan, ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], schema]))


def encode(df: DataFrame, path: str, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (carried columns, n_tokens, ids array<int>, restored), one for each input row.

    ``restored`` tells whether decoding gave the text back. All columns but the text are carried by default.
    """

    def row(raw: bytes | None) -> tuple:
        bpe = load(path)
        ids = bpe.encode(raw)
        return len(ids), ids, bpe.decode(ids).encode() == (raw or b"")

    carry = [c for c in df.columns if c != text] if carry is None else carry
    return _scan(df.withColumn(text, F.col(f"`{text}`").cast("binary")), text, "n_tokens long, ids array<int>, restored boolean", row, carry)


def decode(df: DataFrame, path: str, *, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Rows (carried columns, text): the decoded texts of an ids column; null ids, and those of no token, give no text."""

    def row(values: list[int] | None) -> tuple:
        bpe = load(path)
        return (bpe.decode([i for i in values or () if i is not None and 0 <= i < len(bpe.strings)]),)

    return _scan(df, ids, "text string", row, [c for c in df.columns if c not in (ids, "text")] if carry is None else carry)


def round_trip(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: rows (key, n_tokens, ids_sha256, decoded_sha256).

    The ids are digested as decimals joined by commas, the decoded text as UTF-8.
    """

    def row(raw: bytes | None) -> tuple:
        bpe = load(path)
        ids = bpe.encode(raw)
        listed = ",".join(map(bpe.decimals.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    read = df.withColumn(text, F.col(f"`{text}`").cast("binary"))
    return _scan(read, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [key])
