"""Secrets in texts: fixed patterns, and strings that dictionary-primed compression finds novel.

A candidate in a sensitive context, before or after it or its neighbours, is compressed after its surroundings by zstandard
primed with identifiers.  What it adds to the compressed size, per character, tells a
random secret from words, paths and repeated strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.session import ship

# fixed values of the base scan
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

#: A candidate of the novelty scan, and the words that make its context sensitive.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What may stand between two candidates of one run: no word.
BETWEEN = re.compile(r"\W{1,32}")
SENSITIVE = re.compile(
    r"password|passwd|passphrase|secret|token|api_?key|credential|private|bearer|auth|signature|salt",
    re.IGNORECASE | re.ASCII,
)
#: Characters before and after a run of candidates that are its context, and those that prime the compressor.
CONTEXT, AROUND = 48, 512
#: Least compressed bytes that a candidate adds per character.
NOVELTY = 0.5

IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key credential private_key "
    "public_key bearer authorization signature client_id client_secret session cookie username "
    "user_id account config settings environment variable default example placeholder changeme "
    "import from return function class const static public private protected void string integer "
    "boolean float double null none true false self this new delete print console require module "
    "export package http https localhost example.com github index header content_type application "
    "json xml html utf-8 base64 encode decode encrypt decrypt hash digest sha256 md5 uuid "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)

_HEX_CLASS = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_MORE = (b"passphrase", b"credential", b"private", b"bearer", b"auth", b"signature", b"salt")


def candidate_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidates; those with no word between them (lines of a key, parts of a token) form one run."""
    run: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if run and not BETWEEN.fullmatch(text, run[-1][1], m.start()):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def _rests(start: int, end: int, covered: list[list[int]], at: int) -> Iterator[tuple[int, int]]:
    """Parts of a candidate outside ``covered[at:]`` that are long enough to be candidates."""
    while start < end:
        stop = min(covered[at][0], end) if at < len(covered) else end
        if stop - start >= LEAST:
            yield start, stop
        start = max(start, covered[at][1]) if stop < end else end
        at += 1


class Scanner:
    """Spans of one text; holds a primed compressor."""

    def __init__(self) -> None:
        import zstandard

        words = zstandard.ZstdCompressionDict(
            IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self.packer = zstandard.ZstdCompressor(
            level=19, dict_data=words, write_content_size=False, write_checksum=False
        )

    def novelty(self, around: str, candidate: str) -> float:
        """Compressed bytes that ``candidate`` adds after ``around``, per character."""
        before = around.encode("utf-8", "surrogatepass")
        alone = len(self.packer.compress(before))
        return (len(self.packer.compress(before + candidate.encode())) - alone) / len(candidate)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns; a cheap test of the bytes goes first."""
        raw = text.encode("utf-8", "surrogatepass")
        found = []
        low = raw.lower()
        if any(w in low for w in _WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if b"AKIA" in raw:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        if b"x" * 16 in raw.translate(_HEX_CLASS):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates in sensitive context, without what base spans cover, that are novel."""
        low = text.encode("utf-8", "surrogatepass").lower()
        if not any(w in low for w in _WORDS + _MORE):
            return []
        covered: list[list[int]] = []
        for start, _, end in base:
            if covered and start <= covered[-1][1]:
                covered[-1][1] = max(end, covered[-1][1])
            else:
                covered.append([start, end])
        found, at = [], 0
        for run in candidate_runs(text):
            first, last = run[0][0], run[-1][1]
            if not (
                SENSITIVE.search(text, max(0, first - CONTEXT), first)
                or SENSITIVE.search(text, last, last + CONTEXT)
            ):
                continue
            for start, end in run:
                while at < len(covered) and covered[at][1] <= start:
                    at += 1
                for a, b in _rests(start, end, covered, at):
                    around = text[max(0, a - AROUND) : a] + "\n" + text[b : b + AROUND] + "\n"
                    if self.novelty(around, text[a:b]) >= NOVELTY:
                        found.append((a, 3, b))
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = self.base(text)
        return sorted(base + self.novel(text, base))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [
            [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t.as_py() or "")]
            for t in batch.column(1)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"]
        )


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) per row; spans are (kind, start, end) in code points by start, then kind.

    Kinds are ``assign``, ``access`` and ``hex`` (fixed patterns) and ``novel``.  NULL text is
    empty and has no spans; repeated rows are scanned each; a NULL id is kept; other columns
    are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan, f"doc_id {kind}, spans array<struct<kind string, start bigint, end bigint>>"
    )


def digest(base: list[tuple[int, int, int]]) -> str:
    """sha256 of the joined spans, as the query states it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
