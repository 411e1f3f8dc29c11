"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at unit boundaries, and put together again.

A unit is a run of ASCII letters or one other code point. A text's bytes in UTF-8 become big integers with one bit for
each byte: ``bytes.translate`` builds the masks of letters and of code points' first bytes, shifts and boolean operations
mark where units start, ``bit_count`` gives their number, and a ranked bit is found by recursive halving. Every step is
linear in the text, and no list of units is made.

The cuts come from a digest of salt and key, so every rerun of a task gives the same. ``restored`` rebuilds the exact text
from output and form with built-in functions.

Defined results
---------------
* A null text is empty; an empty text, and one that holds a sentinel, stays plain. Plain rows have null lengths.
* A null key draws as the empty string. Rows that repeat a key have the same draws and are cut one by one.
* Texts of any length are cut whole. Bytes that are no UTF-8 become U+FFFD first.
* An empty table gives an empty table. Columns besides key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are cut, and percent of these whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20

_LETTERS = bytes(b"01"[chr(b).isascii() and chr(b).isalpha()] for b in range(256))
_LEADS = bytes(b"10"[0x80 <= b < 0xC0] for b in range(256))
#: Rows that go back to the JVM in one batch.
_ROWS = 200


def unit_starts(raw: bytes) -> tuple[int, int]:
    """Masks of a text in UTF-8, bit k for byte k: where units start, and where code points do."""
    if not raw:
        return 0, 0
    back = raw[::-1]  # the first byte is the lowest bit
    letters, leads = int(back.translate(_LETTERS), 2), int(back.translate(_LEADS), 2)
    return (leads ^ letters) | (letters ^ (letters & (letters << 1))), leads


def ranked_bit(mask: int, width: int, rank: int) -> int:
    """The place of the set bit with ``rank`` set bits below it, in a mask of ``width`` bits that has so many."""
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, place = mask >> half, width - half, rank - below, place + half
    return place


def cut(raw: bytes, draw: str, cut_percent: int, suffix_first_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text in UTF-8; ``draw`` is a hexadecimal digest."""
    starts, leads = unit_starts(raw)
    n = starts.bit_count()
    h = [int(draw[k : k + 8], 16) for k in (0, 8, 16, 24)]
    p, s, m = (x.encode() for x in SENTINELS)
    if not raw or h[2] % 100 >= cut_percent or p in raw or s in raw or m in raw:
        return n, "plain", None, None, raw
    a, b = (ranked_bit(starts, len(raw), k) if k < n else len(raw) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    before = (leads & ((1 << a) - 1)).bit_count()
    upto = (leads & ((1 << b) - 1)).bit_count()
    if h[3] % 100 < suffix_first_percent:
        return n, "spm", before, upto - before, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return n, "psm", before, upto - before, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", salt: str = "1", cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Rows (key, n, form, prefix_chars, middle_chars, output): units of the text, how it was put together, and the result."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    given = docs.select(F.col(f"`{key}`").alias("key"), drawn.alias("draw"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                made = [cut(t.encode(), d, cut_percent, suffix_first_percent) for t, d in zip(common.decoded(part.column(2)), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *names])

    found = given.mapInArrow(scan, f"key {given.schema['key'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.select(F.col("key").alias(key), *names)


def restored(output: Column, form: Column) -> Column:
    """The text that was put together as ``output``: no part holds a sentinel, and none arises where parts meet."""
    after = lambda s: F.substring_index(output, s, -1)
    head = F.substring_index(output, MIDDLE, 1)

    def rebuilt(first: str, second: str) -> tuple[Column, Column]:
        one = F.substring_index(head, second, 1)
        return F.substring(one, len(first) + 1, F.length(one)), F.substring_index(head, second, -1)

    prefix, suffix = rebuilt(PREFIX, SUFFIX)
    late_suffix, late_prefix = rebuilt(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, after(MIDDLE), suffix)).when(form == "spm", F.concat(late_prefix, after(MIDDLE), late_suffix)).otherwise(output)


#: DuckDB SQL of the query over ``documents``: all units as a list.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 :], '') AS s FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
