"""Scripts by code point ranges."""

from __future__ import annotations

from bisect import bisect_right

# First and last code points of the main blocks of each script.
RANGES = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0xAA), ("latin", 0xBA, 0xBA), ("latin", 0xC0, 0x24F),
    ("latin", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0x8A0, 0x8FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F),
    ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("latin", 0xFF21, 0xFF5A),
    ("kana", 0xFF66, 0xFF9F), ("han", 0x20000, 0x3134F),
)
_STARTS = [r[1] for r in RANGES]


def script_of(letter: str) -> str:
    """The script of a letter; ``other`` outside the table."""
    at = bisect_right(_STARTS, ord(letter)) - 1
    return RANGES[at][0] if at >= 0 and ord(letter) <= RANGES[at][2] else "other"


def word_script(word: str) -> str | None:
    """The script of a word's first letter, None for a word with no letter."""
    return next((script_of(c) for c in word if c.isalpha()), None)
