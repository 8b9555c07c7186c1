"""Secret scan: keyword automaton, anchored expressions near its hits only, then checksum validation.

One Aho-Corasick pass over the case-folded bytes finds the keywords; an expression is tried only where one of its
keywords starts.  Kinds whose values carry a checksum (tokens that end in a base-62 CRC-32) or a decodable header are
kept only if it holds.  The ``hex`` kind has no keyword: its runs are found by one scan of a character class.

Matches of a kind are leftmost and do not overlap.  Positions are code points, ends exclusive.  Null counts as empty; an
empty text has no spans.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.textops import tidy
from quire.session import ship

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "package", "chat", "cloud", "payment", "signed", "private")
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: bytes) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS62[d] + out
    return out.rjust(6, "0")


def crc_holds(m: re.Match) -> bool:
    return checksum62(m[1][:-6]) == m[1][-6:].decode()


def header_holds(m: re.Match) -> bool:
    """The first part of a signed token is base64url JSON that names an algorithm."""
    try:
        part = m[0].split(b".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):
        return False


#: Kind, lower-case keywords, anchored expression, test of the match.
RULES: tuple[tuple[str, tuple[str, ...], bytes, Callable[[re.Match], bool]], ...] = (
    (
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m[1]) >= 6,
    ),
    ("access", ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])", crc_holds),
    ("package", ("npm_",), rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])", crc_holds),
    ("chat", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rb"xox[baprs]-[0-9A-Za-z-]{10,}", lambda m: True),
    ("cloud", ("aiza",), rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", lambda m: True),
    ("payment", ("sk_live_", "rk_live_"), rb"[sr]k_live_[0-9A-Za-z]{16,}", lambda m: True),
    ("signed", ("eyj",), rb"eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]*", header_holds),
    ("private", ("-----begin",), rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
)
HEX = re.compile(rb"[0-9a-f]{24,}")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BUILT: list = []


def automaton():
    """The keyword automaton; built once for each worker."""
    if not _BUILT:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, (_, keywords, _, _) in enumerate(RULES):
            for k in keywords:
                a.add_word(k, (i, len(k)))
        a.make_automaton()
        _BUILT[:] = [a, [re.compile(r[2]) for r in RULES]]
    return _BUILT


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every secret of a whole text, in order."""
    raw = text.encode("utf-8", "surrogatepass")
    found, free = [], [0] * len(RULES)
    keywords, expressions = automaton()
    for end, (rule, length) in keywords.iter(raw.translate(_LOWER).decode("latin-1")):
        start = end + 1 - length
        if start >= free[rule] and (m := expressions[rule].match(raw, start)):
            free[rule] = m.end()
            if RULES[rule][3](m):
                found.append((start, KINDS.index(RULES[rule][0]), m.end()))
    hexadecimal = KINDS.index("hex")
    found += [(m.start(), hexadecimal, m.end()) for m in HEX.finditer(raw)]
    found.sort()
    if found and len(raw) != len(text):
        at, points, place = 0, 0, {}
        for p in sorted({q for s, _, e in found for q in (s, e)}):
            points += len(raw[at:p].decode("utf-8", "surrogatepass"))
            at, place[p] = p, points
        found = [(place[s], k, place[e]) for s, k, e in found]
    return found


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end>> of every document, one row for each input row.

    Spans are ordered by start, then by the order of ``KINDS``.  Other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.secretscan import KINDS, scan

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,`end`:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span of their text replaced by ``mark``; overlapping spans become one mark."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.secretscan import scan

        for batch in batches:
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                out, done = [], 0
                for s, _, e in scan(text or ""):
                    if s >= done:
                        out += [text[done:s], mark]
                    done = max(done, e)
                texts.append(text if not out else "".join(out) + text[done:])
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
