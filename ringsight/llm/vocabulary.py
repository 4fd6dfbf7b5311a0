"""Words of one text, taken in pieces so that work space follows its distinct words and not its length."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def word_pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``piece`` bytes; a word that is longer stays whole."""
    at, end = 0, len(text)
    while at < end:
        stop = min(at + piece, end)
        while stop < end and text[stop] not in _SPACES:
            stop += 1
        yield text[at:stop].split()
        at = stop


def word_counts(text: bytes) -> tuple[int, set[bytes]]:
    """The number of words and the distinct ones."""
    total, seen = 0, set()
    for words in word_pieces(text):
        total += len(words)
        seen.update(words)
    return total, seen
