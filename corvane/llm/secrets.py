"""Secret scans: keyword prefilter, anchored expressions near hits, checksums.

One Aho-Corasick automaton per worker finds all keywords in a text in a single
pass.  The expressions are only tried where a keyword starts, in order, and a
hit inside the last match of its kind is passed over; that gives the leftmost
non-overlapping matches of a search through the whole text.  Runs of
hexadecimal digits have no keyword: the text is mapped to two classes, and
the keyword is 32 symbols of the class in a row.  Tokens that carry a
checksum (base62 of a CRC-32 in their last six characters) are only reported
if it holds.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords and expressions of the base kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 16
HEX_CHARS = 32
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
#: Prefixes of tokens of 30 characters and a checksum of six.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE_KINDS, "checked")

_HEX_CLASS = bytes.maketrans(b"0123456789abcdef", b"0" * 16)


def base62_crc32(text: str) -> str:
    """The checksum of a token's random part: six base62 digits."""
    value, digits = zlib.crc32(text.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


@lru_cache(maxsize=1)
def _automaton():
    """Keywords in every mixture of cases, as (kind, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for letters in product(*({c.lower(), c.upper()} for c in word)):
            found.add_word("".join(letters), ("assign", len(word)))
    found.add_word("AKIA", ("access", 4))
    for prefix in CHECKED_PREFIXES:
        found.add_word(prefix, ("checked", len(prefix)))
    found.make_automaton()
    return found


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least ``HEX_CHARS`` hexadecimal digits."""
    if b"0" * HEX_CHARS not in text.encode().translate(_HEX_CLASS):
        return []
    return [m.span() for m in HEX_RUN.finditer(text)]


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then by kind as listed."""
    if not text:
        return []
    spans = [("hex", a, b) for a, b in _hex_runs(text)]
    hits = sorted((end - length + 1, kind) for end, (kind, length) in _automaton().iter(text))
    free = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            if match := ASSIGN.match(text, start):
                free[kind] = match.end()
                if len(match[2]) >= ASSIGN_CHARS:
                    spans.append((kind, start, match.end()))
        elif kind == "access":
            if match := ACCESS.match(text, start):
                free[kind] = match.end()
                if match.end() - start >= ACCESS_CHARS:
                    spans.append((kind, start, match.end()))
        elif match := CHECKED.match(text, start):
            if base62_crc32(match[1]) == match[2]:
                free[kind] = match.end()
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row: an array of (kind, start, end).

    A null text is empty and has no span; repeated rows are scanned one by
    one; an empty table gives no rows; other columns are not read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
