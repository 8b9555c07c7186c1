"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For each pre-token an automaton over the whole vocabulary reports every token that ends at each byte.  A prefix has one
valid encoding, hence one last token: the token ``t`` for which the prefix before it has a last token compatible with
``t``.  Following the stored tokens back from the end gives the exact ids.

Two tokens are compatible if encoding their concatenation gives the two again.  Merging runs in rank order, so inner
nodes of the left token's right edge and of the right token's left edge live from the rank that makes them to the rank of
their parent; the pair is broken by a merge of two such nodes that comes before both parents (of equal ranks, the
leftmost merge is the first).

Nulls count as empty texts; an empty text has no ids.  The strings of special tokens in a text become their ids, as the
public library does by default.  Texts without white space are one long pre-token: time stays linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.textops import tidy
from quire.session import ship

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's memory of pre-tokens, and their longest length; longer ones are encoded each time.
MEMORY, LONGEST = 300_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies: visible Latin-1 bytes are themselves, the rest follow 0x100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _class(kind: str, top: int) -> str:
    """Character ranges of a Unicode major category up to a code point, for the standard regular expressions."""
    out, start = [], None
    for cp in range(top + 2):
        inside = cp <= top and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append((start, cp - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def splitter(top: int) -> re.Pattern:
    """The byte-level pre-tokeniser's pattern with Unicode classes written out, for texts of code points up to ``top``.

    Classes that stay within 0xFF or 0xFFFF are bitmaps; a class beyond is searched range by range.
    """
    space = "\\t-\\r " + "".join(c for c in ("\\x85\\xa0", "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")[: (top > 0x7F) + (top > 0xFF)])
    letter, number = _class("L", top), _class("N", top)
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Bpe:
    """A vocabulary file, its automaton and its tables; one per worker and file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.bytes: dict[int, bytes] = {}
        latin: dict[str, int] = {}
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(alphabet[c] for c in token)
            self.bytes[i] = raw
            latin[raw.decode("latin-1")] = i
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        vocab = spec["model"]["vocab"]
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[a], vocab[b]
            self.rank[pair] = r
            self.parts.setdefault(vocab[a + b], (*pair, r))
        self._automaton(latin)
        self.patterns: dict[int, re.Pattern] = {}
        self.good: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def _automaton(self, latin: dict[str, int]) -> None:
        """States are vocabulary prefixes; ``tokens[state]`` has the tokens that end there, longest first.  Steps are filled in as texts need them."""
        self.child: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        for s, i in latin.items():
            at = 0
            for c in s.encode("latin-1"):
                key = at << 8 | c
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(own)
                    own.append(None)
                at = to
            own[at] = (i, len(s))
        self.fail = [0] * len(own)
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        self.step: dict[int, int] = {}
        level = [(key & 0xFF, 0, to) for key, to in self.child.items() if key < 256]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.child.items():
            below.setdefault(key >> 8, []).append((key & 0xFF, to))
        while level:
            following = []
            for c, parent, at in level:
                self.fail[at] = self.go(self.fail[parent], c) if parent else 0
                self.tokens[at] = ((own[at],) if own[at] else ()) + self.tokens[self.fail[at]]
                following += [(d, at, to) for d, to in below.get(at, ())]
            level = following

    def go(self, state: int, c: int) -> int:
        """The state after one more byte."""
        key = state << 8 | c
        if (to := self.step.get(key)) is None:
            at = state
            while (to := self.child.get(at << 8 | c)) is None and at:
                at = self.fail[at]
            to = self.step[key] = to or 0
        return to

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Nodes of a token's right or left edge, each with the rank at which its parent takes it."""
        key = token, right
        if key not in self.edges:
            out, at, until = [], token, float("inf")
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                left, rgt, until = self.parts[at]
                at = rgt if right else left
            self.edges[key] = out
        return self.edges[key]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the concatenation of two tokens encodes to the two."""
        if len(self.good) > 400_000:
            self.good.clear()
        rank, got = self.rank, True
        right = self.edge(b, False)
        for x, x_until in self.edge(a, True):
            for y, y_until in right:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    got = False
        self.good[a << 17 | b] = got
        return got

    def word(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        step, tokens, good = self.step.get, self.tokens, self.good.get
        last, state, before_state, end = [-1], 0, 0, 0
        for c in raw:
            end += 1
            state = step(state << 8 | c)
            state = self.go(before_state, c) if state is None else state
            before_state = state
            for token, length in tokens[state]:
                if length == end:
                    break
                before = last[end - length]
                ok = good(before << 17 | token)
                if self.compatible(before, token) if ok is None else ok:
                    break
            last.append(token)
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return out[::-1]

    def lookup(self, piece: str) -> tuple[tuple[int, ...], str]:
        """Encode a pre-token and keep the result, unless it is long."""
        ids = tuple(self.word(piece))
        got = ids, ",".join(map(str, ids))
        if len(piece) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = got
        return got

    def pattern(self, text: str) -> re.Pattern:
        top = 0x7F if text.isascii() else 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
        if top not in self.patterns:
            self.patterns[top] = splitter(top)
        return self.patterns[top]

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same as decimals joined by commas."""
        ids: list[int] = []
        said: list[str] = []
        known, lookup = self.known, self.lookup
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                ids.append(self.special[part])
                said.append(str(self.special[part]))
                continue
            for piece in self.pattern(part).findall(part):
                got = known.get(piece) or lookup(piece)
                ids += got[0]
                said.append(got[1])
        return ids, ",".join(said)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load(path: str) -> Bpe:
    """The tables of a vocabulary file, kept for the life of a worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decode: bool = True) -> DataFrame:
    """Ids, token count and decoded text of every document: id, token_ids, n_tokens, ids_text, decoded.

    ``path`` names a vocabulary file on every machine (default: the public byte-level one).  ``decoded`` is null if
    ``decode`` is false.  One output row for each input row, repeated ids included; other columns are not read.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.bpe import load

        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, said, back = [], [], []
                for text in part.column(1).to_pylist():
                    got, line = bpe.encode(text or "")
                    ids.append(got)
                    said.append(line)
                    back.append(bpe.decode(got) if decode else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())],
                    names=[id_col, "token_ids", "n_tokens", "ids_text", "decoded"],
                )

    schema = f"`{id_col}` {kind}, token_ids array<int>, n_tokens bigint, ids_text string, decoded string"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: ``encode``'s rows, reduced where they are made.

    The ids and the decoded text stay in the worker, so only a row of fixed size for each document leaves it.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.bpe import load

        bpe, sha = load(path), hashlib.sha256
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids, said = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                first.append(sha(said.encode()).hexdigest())
                second.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
