"""Licence scan: one Aho-Corasick pass for notice phrases and identifier tags, and an expression parser for the tags.

Texts become their words (ASCII letters folded; a word is a run of letters, digits and non-ASCII characters), joined by
single spaces, and phrases are found as consecutive words.  Where an identifier tag occurs, the expression after it is
read by a shunting-yard parser with ``with`` above ``and`` above ``or``.  Every licence has a freedom grade from 0 (all
rights reserved) to 1 (permissive); ``or`` takes the freer side, ``and`` the stricter one, ``with`` an exception that
moves a licence halfway to the next freer grade.  A document's score is the strictest grade found, 1 if none.

Null counts as empty; an empty text has no words, no places and empty label lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.textops import tidy
from quire.session import ship

#: Phrases of the base contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases that the method adds.
NOTICES = {
    "apache license": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: Freedom grades of labels; an unknown label has UNKNOWN.
GRADES = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "bsd": 0.95, "isc": 0.95, "apache-2.0": 0.9, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.05, "reserved": 0.0,
}
UNKNOWN = 0.5
#: How identifiers of tags begin, with their labels; the longest beginning counts.
IDENTIFIERS = {
    "agpl": "agpl", "apache": "apache-2.0", "bsd": "bsd", "0bsd": "bsd", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa",
    "cc0": "cc0", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense", "licenseref": "proprietary",
}
_BINDS = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def label(identifier: str) -> str:
    """The label of an identifier; one that is not known is its own label."""
    i = identifier.lower()
    best = max((p for p in IDENTIFIERS if i.startswith(p)), key=len, default=None)
    return IDENTIFIERS[best] if best else i


def grade(name: str) -> float:
    return GRADES.get(name, UNKNOWN)


def postfix(text: str) -> list[str]:
    """Shunting-yard: an expression in postfix order.  Reading stops before the first token that can't follow; an open parenthesis is closed at the end."""
    out: list[str] = []
    waiting: list[str] = []
    want = True  # an operand
    for token in _TOKEN.findall(text):
        low = token.lower()
        if token == "(":
            if not want:
                break
            waiting.append(token)
        elif token == ")":
            if want or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif low in _BINDS:
            if want:
                break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            want = True
        else:
            if not want:
                break
            out.append(token)
            want = False
    while want and waiting:  # an operator or parenthesis without what should follow
        waiting.pop()
        if not waiting or waiting[-1] != "(":
            break
    return out + [x for x in reversed(waiting) if x != "("]


def evaluate(text: str) -> tuple[float, list[str]] | None:
    """Freedom grade and labels of an expression; null if it has no identifier."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix(text):
        if token in _BINDS and len(stack) >= 2:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if token == "with":
                freer = min((g for g in GRADES.values() if g > a), default=a)
                stack.append(((a + freer) / 2, left))
            else:
                stack.append(((max if token == "or" else min)(a, b), left + right))
        elif token not in _BINDS:
            stack.append((grade(label(token)), [label(token)]))
    return stack[-1] if stack else None


_BUILT: list = []


def automaton():
    """The phrase automaton; built once for each worker.  Values: is it of the base, label (null: the tag), length."""
    if not _BUILT:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in {**BASE, **NOTICES, TAG: None}:
            a.add_word(f" {p} ", (p in BASE, BASE.get(p) or NOTICES.get(p), len(p) + 2))
        a.make_automaton()
        _BUILT.append(a)
    return _BUILT[0]


def scan(text: str) -> tuple[int, list[tuple[int, str, bool]], list[tuple[float, list[str]]]]:
    """Number of words, places (first word, label, base?) in order, and the evaluated expressions of a whole text."""
    split = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    line = (b" " + b" ".join(split) + b" ").decode("latin-1")
    places, at, index, tagged = [], 0, -1, False
    hits = sorted((end + 1 - length, base, name) for end, (base, name, length) in automaton().iter(line)) if split else []
    for start, base, name in hits:
        index += line.count(" ", at, start + 1)
        at = start + 1
        if name is None:
            tagged = True
        else:
            places.append((index, name, base))
    expressions = [e for m in _EXPRESSION.finditer(text) if (e := evaluate(m[1]))] if tagged else []
    return len(split), places, expressions


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places array<struct<word, label, base>>, labels array<string>, score: one row for each input row.

    ``places`` has every occurrence of a phrase, ``labels`` (distinct, sorted) those of places and of expressions.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.licences import grade, scan

        kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            counts, spots, names, scores = [], [], [], []
            for t in batch.column(1):
                n, places, expressions = scan(t.as_py() or "")
                counts.append(n)
                spots.append([{"word": w, "label": x, "base": b} for w, x, b in places])
                names.append(sorted({x for _, x, _ in places} | {x for _, xs in expressions for x in xs}))
                scores.append(min([grade(x) for _, x, _ in places] + [g for g, _ in expressions], default=1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spots, kind), pa.array(names, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                names=[id_col, "n_words", "places", "labels", "score"],
            )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, places array<struct<word:bigint,label:string,base:boolean>>, labels array<string>, score double"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
