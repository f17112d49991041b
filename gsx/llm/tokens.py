"""Token ids of whole texts, word by word.

The tokenizer drops white space and never joins what white space separates, nor a letter or
digit with punctuation after it.  So a text is cut at white space and before such punctuation,
and its ids are those of the parts one after another.  Parts repeat, so their ids are
remembered.  A text with combining marks, whose case and composition depend on one another, is
encoded without folding case first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from gsx.llm.texts import byte_pieces, word_lists

#: Parts remembered per Python worker, in two halves: parts in use move to the recent one, the older one is dropped.
CACHE = 400_000
#: Parts that are encoded in one call.
CALL = 128
#: Bytes of text that are cut at once.
GROUP = 1 << 18

_OTHER, _LETTER, _MARK, _FAR = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = _LETTER
_CLASS[list(b".,!?;:|%*&$#")] = _MARK
# letters of Latin scripts begin with C3, C4 or C5; other scripts are not cut
_CLASS[0x80:0xC0] = _LETTER
_CLASS[[0xC2, *range(0xC6, 0xFF)]] = _FAR
# characters of that range that are no letters in lower case: signs, and the capital I with a dot
_SIGNS = tuple(chr(c).encode() for c in range(0xC0, 0x180) if not chr(c).lower().isalpha())


def spaced(data: bytes) -> bytes:
    """A space before every plain punctuation mark that follows a letter or digit."""
    raw = np.frombuffer(data, np.uint8)
    kinds = _CLASS[raw]
    letter = kinds[:-1] == _LETTER
    if (kinds == _FAR).any() or any(s in data for s in _SIGNS):
        letter &= raw[:-1] < 0x80
    at = np.flatnonzero(letter & (kinds[1:] == _MARK)) + 1
    return np.insert(raw, at, 32).tobytes() if len(at) else data


class WordTokens:
    """Ids as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word; many words go through one call."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        out: dict[bytes, bytes] = {}
        # a word of letters is one unit to the tokenizer, so such words may share a text
        plain, mixed = [], []
        for k, t in enumerate(texts):
            # lower case may hold marks that the word as written does not
            (plain if t.isalpha() and t.lower().isalpha() else mixed).append(k)
        for at, joined in ((plain, True), (mixed, False)):
            for low in range(0, len(at), CALL):
                part = [texts[k] for k in at[low : low + CALL]]
                found = self.tokenizer.encode(
                    " ".join(part) if joined else part, is_pretokenized=not joined, add_special_tokens=False
                )
                data = np.array(found.ids, "<u4").tobytes()
                of = np.array(found.word_ids, np.int64)
                cuts = (4 * np.searchsorted(of, np.arange(len(part) + 1))).tolist()
                for k, a, b in zip(at[low : low + CALL], cuts[:-1], cuts[1:]):
                    out[words[k]] = data[a:b]
        return out

    def _found(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts that are lists of parts; what is new is encoded together."""
        wanted = set().union(*texts)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHE // 2:
            self.older, self.known = self.known, {}
            new = wanted
        if new:
            kept = {w: self.older[w] for w in new if w in self.older}
            self.known.update(kept)
            self.known.update(self._encode(list(new.difference(kept))))
        known = self.known.__getitem__
        return [b"".join(map(known, parts)) for parts in texts]

    def ids(self, data: bytes) -> Iterator[bytes]:
        """Ids of a UTF-8 text, piece by piece."""
        if b"\xcc" in data or b"\xcd" in data:
            for words in word_lists(data):
                ids = self._encode(words)
                yield b"".join([ids[w] for w in words])
            return
        for piece in byte_pieces(data):
            yield from self._found([spaced(piece.lower()).split()])

    def each(self, texts: Iterable[bytes]) -> Iterator[Iterable[bytes]]:
        """Ids of every text in order, in pieces; short texts are encoded in groups."""
        group: list[bytes] = []
        size = 0

        def flush() -> Iterator[Iterable[bytes]]:
            # a byte that UTF-8 never holds keeps the texts apart
            parts = spaced(b"\xff".join(group).lower()).split(b"\xff")
            for ids in self._found([p.split() for p in parts]):
                yield (ids,)

        for data in texts:
            alone = len(data) > GROUP or b"\xcc" in data or b"\xcd" in data
            if group and (alone or size + len(data) > GROUP):
                yield from flush()
                group, size = [], 0
            if alone:
                yield self.ids(data)
            else:
                group.append(data)
                size += len(data)
        if group:
            yield from flush()


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this Python worker; what it remembers serves the tasks that follow."""
    return WordTokens(path)


def forget() -> None:
    """Drop the tokenizer and its memory; for tasks that need none after ones that did, in one Python worker."""
    word_tokens.cache_clear()
