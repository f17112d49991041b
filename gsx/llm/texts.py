"""Whole texts in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

PIECE = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def byte_pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Consecutive parts of about ``size`` bytes, cut at ASCII white space only."""
    at = 0
    while len(data) - at > size:
        cut = at + size
        while cut < len(data) and data[cut] not in _SPACE:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_lists(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words between ASCII white space, piece by piece; never an empty list."""
    for piece in byte_pieces(data, size):
        words = piece.split()
        if words:
            yield words


def char_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive parts of about ``size`` characters, cut at white space only."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def unused_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
