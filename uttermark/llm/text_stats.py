"""Counts of one text, given as UTF-8 bytes; blanks are the six ASCII ones."""

from __future__ import annotations

from collections import Counter

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def code_points(raw: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return len(raw) - len(raw.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))


def symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def word_chars(raw: bytes) -> int:
    """Code points that are no blanks."""
    return code_points(raw.translate(None, BLANKS))


def repeated_lines(lines: list[bytes]) -> int:
    """Lines equal to an earlier one."""
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*[words[i:] for i in range(size)]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered
