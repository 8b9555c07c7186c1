"""Hashed text features, sparse linear models over them, and the bounded training sample.

A document's features are the distinct hashes of its words, of its words' first 4, 5 and 6 bytes (which catch inflected
forms), and of the bins of a few shape statistics.  Hashes have 32 bits and models keep only the features with a weight,
so a feature that was never learnt collides with one that was in about one of a million documents.

Models are fitted on the driver from sketches (distinct feature hashes) of a sample of labelled rows.  ``SAMPLE`` bounds
the expected number of rows, whatever the size of the corpus; rows are chosen by a hash of their id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.textops import tidy
from quire.session import ship

#: Expected number of labelled rows that a model is fitted on, at most.
SAMPLE = 10_000
#: Documents of the sample that must hold a feature.
LEAST_DOCUMENTS = 4
PREFIXES = (4, 5, 6)
#: Entries of a matrix that are multiplied at a time.
PART = 1 << 20
_U = np.uint64
#: Edges of the shape bins (statistics in the order of ``shape``).
EDGES = (
    np.array([1, 2, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 5120]),  # words
    np.array([0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.6]),  # bytes that are neither of words nor white space, by bytes
    np.array([0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4]),  # digits, by bytes
    np.array([0.001, 0.01, 0.02, 0.05, 0.1, 0.3, 0.6]),  # capitals, by bytes
    np.array([0.001, 0.005, 0.02, 0.1]),  # exclamation and question marks, by bytes
    np.array([2, 3, 4, 5, 6, 8, 12, 20]),  # bytes of words, by words
    np.array([1, 4, 8, 16, 32, 64, 128]),  # words, by lines
    np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),  # distinct words, by words
)


def shape(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shape statistics of each text, a column each; 0 for an empty text."""
    from quire.llm.textops import SPACE, WORD

    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    count = lambda mask: np.bincount(at[mask], minlength=n)
    words = np.bincount(rows, minlength=n)
    most = np.maximum(words, 1)
    distinct = np.unique((rows.astype(_U) << _U(40)) | (hashes >> _U(24)))
    return np.stack(
        [
            words,
            count(~WORD[data] & ~SPACE[data]) / size,
            count((data >= 0x30) & (data <= 0x39)) / size,
            count((data >= 0x41) & (data <= 0x5A)) / size,
            count((data == 0x21) | (data == 0x3F)) / size,
            np.bincount(rows, ends - starts, minlength=n) / most,
            words / (count(data == 0x0A) + 1),
            np.bincount((distinct >> _U(40)).astype(np.int64), minlength=n) / most,
        ],
        axis=1,
    )


def features(data: np.ndarray, offsets: np.ndarray, shapes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 32-bit feature hashes) of all words, word beginnings and shape bins of a slice; not yet distinct."""
    from quire.llm.textops import WORD, Hasher, mix, runs

    starts, ends, rows = runs(WORD[data], offsets)
    hasher = Hasher(data)
    hashes, length = hasher(starts, ends), ends - starts
    at, out = [rows], [hashes >> _U(32)]
    for p in PREFIXES:
        use = length > p
        at.append(rows[use])
        out.append(mix(hasher(starts[use], starts[use] + p) ^ _U(0x632BE59BD9B4E019 + p)) >> _U(32))
    if shapes:
        stats = shape(data, offsets, starts, ends, rows, hashes)
        for j, edges in enumerate(EDGES):
            bins = np.searchsorted(edges, stats[:, j], "right")
            at.append(np.arange(len(stats)))
            out.append(mix(bins.astype(_U) + _U(0x589965CC75374CC3 + 1000 * j)) >> _U(32))
    return np.concatenate(at), np.concatenate(out).astype(np.uint32)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % 4 == 2


def _sketch(mark: Callable[[list[str]], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.hashlinear import features
        from quire.llm.textops import slices, strings

        for batch in batches:
            out = []
            for a, b, data, offsets in slices(batch.column(1)):
                rows, got = features(data, offsets)
                both = np.unique((rows.astype(_U) << _U(32)) | got)
                ends = np.searchsorted(both >> _U(32), np.arange(b - a + 1))
                low = (both & _U(0xFFFFFFFF)).astype(np.uint32)
                out += [low[ends[r] : ends[r + 1]].tobytes() for r in range(b - a)]
            marks = mark(strings(batch.column(1))) if mark else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(marks, pa.int64())], names=["y", "sketch", "marks"])

    return run


def sample(labelled: DataFrame, most: int = SAMPLE, mark: Callable[[list[str]], np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Labels, sketches and marks (``mark`` of the texts) of at most about ``most`` rows of (doc_id, text, y), chosen by a hash of the id."""
    ship(labelled.sparkSession)
    known = labelled.filter("y is not null")
    n = known.count()
    share = int(2**31 * min(1.0, most / max(n, 1)))
    chosen = known.filter((F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit(2**31 - 1))) < share).select(F.col("y").cast("double"), "text")
    got = chosen.mapInArrow(tidy(_sketch(mark)), "y double, sketch binary, marks bigint").toArrow()
    keys = [x.as_buffer() for x in got.column("sketch").combine_chunks()] if got.num_rows else []
    y, marks = (got.column(c).to_numpy() if keys else np.zeros(0, t) for c, t in (("y", float), ("marks", np.int64)))
    order = sorted(range(len(keys)), key=lambda r: (zlib.crc32(keys[r]), len(keys[r]), y[r], marks[r]))  # reruns agree; equal texts come together
    return y[order] if order else y, [np.frombuffer(keys[r], np.uint32) for r in order], marks[order] if order else marks


class Matrix:
    """Sketches as a sparse 0/1 matrix over the features that enough rows hold."""

    def __init__(self, sketches: list[np.ndarray], least: int = LEAST_DOCUMENTS):
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.uint32)
        flat.sort()
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.n = len(sketches)
        self.ids = flat[first][np.diff(np.append(first, len(flat))) >= min(least, max(1, self.n))]
        del flat, first
        size = np.array([len(x) for x in sketches], np.int64)
        rows, cols = [], []
        for a in range(0, self.n, 500):  # a part of the rows at a time, to spare the driver's memory
            part = np.concatenate(sketches[a : a + 500])
            at = np.minimum(np.searchsorted(self.ids, part), max(len(self.ids) - 1, 0))
            use = self.ids[at] == part if len(self.ids) else np.zeros(len(part), bool)
            cols.append(at[use].astype(np.int32))
            rows.append(np.repeat(np.arange(a, min(a + 500, self.n), dtype=np.int32), size[a : a + 500])[use])
        self.rows, self.cols = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, cols))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a in range(0, len(self.rows), PART):
            out += np.bincount(self.rows[a : a + PART], w[self.cols[a : a + PART]], minlength=self.n)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids))
        for a in range(0, len(self.rows), PART):
            out += np.bincount(self.cols[a : a + PART], r[self.rows[a : a + PART]], minlength=len(self.ids))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights by feature hash, and cut points: P(grade >= k) = sigmoid(margin - cuts[k - 1])."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        rows, got = features(data, offsets)
        if not len(self.ids):
            return np.zeros(n)
        flags = np.zeros(1 << 20, bool)
        flags[self.ids >> 12] = True
        use = flags[got >> np.uint32(12)]
        both = np.unique((rows[use].astype(_U) << _U(32)) | got[use])
        rows, got = (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.ids, got), len(self.ids) - 1)
        hit = self.ids[at] == got
        return np.bincount(rows[hit], self.weights[at[hit]], minlength=n)


def _descend(x: Matrix, slope, l1: float, rounds: int, extra: np.ndarray, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Proximal AdaGrad: weights with an L1 penalty and free extra parameters.  slope(margins, extra) gives both gradients."""
    w, g2, e2 = np.zeros(len(x.ids)), np.full(len(x.ids), 1e-8), np.full(len(extra), 1e-8)
    for _ in range(rounds):
        r, de = slope(x.times(w), extra)
        g = x.back(r) / x.n
        g2 += g * g
        step = rate / np.sqrt(g2)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        de = de / x.n
        e2 += de * de
        extra = extra - rate / np.sqrt(e2) * de
    return w, extra


def fit_logistic(x: Matrix, target: np.ndarray, l1: float = 2e-4, rounds: int = 120) -> Model:
    """Logistic regression on soft labels in [0, 1].  Without rows: margin 0 and an even score."""
    if not x.n:
        return Model()
    prior = np.clip(target.mean(), 1e-3, 1 - 1e-3)

    def slope(m, e):
        r = sigmoid(m - e[0]) - target
        return r, np.array([-r.sum()])

    w, e = _descend(x, slope, l1, rounds, np.array([-np.log(prior / (1 - prior))]))
    use = w != 0
    return Model(x.ids[use], w[use], e)


def fit_ordinal(x: Matrix, grade: np.ndarray, grades: int, l1: float = 2e-4, rounds: int = 120) -> Model:
    """Cumulative-link regression: one weight vector, ``grades - 1`` ordered cut points (gaps are positive by construction)."""
    if not x.n:
        return Model(cuts=np.linspace(-1, 1, grades - 1))
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades)) / x.n, 1e-3, 1 - 1e-3)[:-1]
    start = np.log(share / (1 - share))
    extra = np.concatenate([start[:1], np.log(np.expm1(np.maximum(np.diff(start), 0.05)))])
    one = np.arange(len(grade))

    def cut(e):
        return np.concatenate([e[:1], e[0] + np.cumsum(np.logaddexp(0.0, e[1:]))])

    def slope(m, e):
        f = np.concatenate([np.zeros((len(m), 1)), sigmoid(cut(e)[None, :] - m[:, None]), np.ones((len(m), 1))], axis=1)
        a, b = f[one, grade], f[one, grade + 1]
        p = np.maximum(b - a, 1e-12)
        dc = np.zeros((len(m), grades + 1))
        dc[one, grade + 1] -= b * (1 - b) / p
        dc[one, grade] += a * (1 - a) / p
        dc = dc[:, 1:-1].sum(axis=0)  # by cut point; a gap moves all later ones
        tail = np.cumsum(dc[::-1])[::-1]
        return 1.0 - a - b, np.concatenate([tail[:1], tail[1:] * sigmoid(e[1:])])

    w, e = _descend(x, slope, l1, rounds, extra)
    use = w != 0
    return Model(x.ids[use], w[use], cut(e))


def tails(docs: DataFrame, model: Model, id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """id, p (P(grade >= 1), P(grade >= 2), ...) of every document, from its whole text; null counts as empty."""
    ship(docs.sparkSession)
    columns = docs.columns if keep_text else [id_col]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    text = (docs.columns if keep_text else [id_col, "text"]).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.textops import slices

        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for a, b, data, offsets in slices(batch.column(text)):
                margins[a:b] = model.margins(data, offsets)
            p = sigmoid(margins[:, None] - model.cuts[None, :])
            k = p.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.columns if keep_text else batch.columns[:1]), lists], names=[*columns, "q_tails"])

    return docs.select(*(columns if keep_text else [id_col, "text"])).mapInArrow(tidy(run), f"{fields}, q_tails array<double>")
