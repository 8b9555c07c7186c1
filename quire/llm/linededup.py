"""Line dedup by pairwise alignment of documents that share runs of lines.

Texts are cut into units that end with a line feed or, within a line, with the blank after a sentence's ``.``, ``!`` or
``?``: passages are often pasted into the middle of a line.  Every unit (blanks at its ends ignored) is hashed; "line"
below means such a unit.  The shortest run of lines with ``MIN_WORDS`` words from every line with words on, and that up
to every such line, is a key, however short its lines are: together these runs cover every block of as many words.  A run that several documents hold points each of them to the earliest one that holds it;
so a run that very many documents share makes one pair for each of them instead of a pair for any two, and nothing needs
a cap.  Rarity decides within a pair: patience diff anchors on the lines that occur once in both documents, takes the
longest increasing chain of them, extends it over equal neighbours, and looks between anchors again.  Aligned lines that
follow one another in both documents make a block.  One chain misses passages that either document repeats or that stand
in another order, so what it leaves is searched for runs that the earlier document holds anywhere.  Blocks of at least
``MIN_WORDS`` words are deleted from the later document.  Shorter blocks (licence notices, signatures) stay.

Earlier means smaller id; null ids are last; of equal ids the text's hash decides.  Rows equal in id and text are one
document and change alike.  Null and empty texts stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.textops import tidy
from quire.session import cut, release, ship, small_batches

#: Words of the least block that is deleted, and of the runs that pair documents.
MIN_WORDS = 20
#: Documents, and pairs of them, in an Arrow batch.
BATCH = 1_000
#: An odd base of the runs' polynomial hashes modulo 2^64, and its inverse.
_BASE = 0x9E3779B97F4A7C1B
_BACK = pow(_BASE, -1, 1 << 64)
_LAST_ID = (1 << 63) - 1


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in ascending order of their first items, that ascends in the second."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            ends.append(n)
        else:
            tails[k], ends[k] = b, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def positions(lines: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for n, x in enumerate(lines):
        out.setdefault(x, []).append(n)
    return out


def patience(later: list[int], earlier: list[int], where: dict[int, list[int]] | None = None) -> list[tuple[int, int]]:
    """Aligned positions (later, earlier) of two sequences, ascending in both."""
    where = positions(earlier) if where is None else where
    mine = positions(later)
    out, todo = [], [(0, len(later), 0, len(earlier))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and later[a] == earlier[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and later[b - 1] == earlier[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = []
        for n in range(a, b):
            x = later[n]
            if (there := where.get(x)) is None:
                continue
            lo = bisect_left(there, c)
            if lo >= len(there) or there[lo] >= d or (lo + 1 < len(there) and there[lo + 1] < d):
                continue
            here = mine[x]
            k = bisect_left(here, a)
            if k + 1 < len(here) and here[k + 1] < b:
                continue
            once.append((n, there[lo]))
        anchors = _chain(once)
        if not anchors:
            continue
        for (m, n), (p, q) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if p < b:
                out.append((p, q))
            todo.append((m + 1, p, n + 1, q))
    return sorted(set(out))


def blocks(aligned: list[tuple[int, int]], words: list[int], least: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of the runs that follow one another in both documents and have ``least`` words."""
    out, start = [], 0
    for n in range(1, len(aligned) + 1):
        if n == len(aligned) or aligned[n] != (aligned[n - 1][0] + 1, aligned[n - 1][1] + 1):
            a, b = aligned[start][0], aligned[n - 1][0] + 1
            if sum(words[a:b]) >= least:
                out.append((a, b))
            start = n
    return out


def runs(lines: list[int], words: list[int], least: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(first line, line after the last, lines) of the shortest runs of ``least`` words from and up to every line with words."""
    total = [0, *accumulate(words)]
    for n, w in enumerate(words):
        if not w:
            continue
        b = bisect_left(total, total[n] + least)
        if b < len(total):
            yield n, b, tuple(lines[n:b])
        a = bisect_right(total, total[n + 1] - least) - 1
        if a >= 0 and total[n] - total[a] >= least:  # else it is the run from a
            yield a, n + 1, tuple(lines[a : n + 1])


def shared(later: list[int], words: list[int], earlier: list[int], theirs: set[tuple[int, ...]], least: int, where: dict[int, list[int]] | None = None) -> list[tuple[int, int]]:
    """Blocks of the later sequence that cover each of its runs of ``least`` words in ``theirs``, the earlier one's runs."""
    found = blocks(patience(later, earlier, where), words, least)
    done = bytearray(len(later))
    for a, b in found:
        done[a:b] = b"\1" * (b - a)
    return found + [(a, b) for a, b, run in runs(later, words, least) if 0 in done[a:b] and run in theirs]


def spans(words: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of ``runs`` over many documents at once.

    ``words`` has the lines of several documents, one after the other; ``starts`` has where each begins, and the end.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = np.flatnonzero(words > 0)
    doc = np.searchsorted(starts, n, side="right")
    b = np.searchsorted(total, total[n] + least)
    a = np.searchsorted(total, total[n + 1] - least, side="right") - 1
    on, back = b <= starts[doc], (a >= starts[doc - 1]) & (total[n] - total[a] >= least)
    return np.concatenate([n[on], a[back]]), np.concatenate([b[on], n[back] + 1])


def keys(lines: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each run of lines, the same wherever the run stands."""
    def powers(x: int) -> np.ndarray:
        out = np.full(len(lines) + 1, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    total = np.zeros(len(lines) + 1, np.uint64)
    np.cumsum(lines.view(np.uint64) * powers(_BASE)[:-1], dtype=np.uint64, out=total[1:])
    return ((total[b] - total[a]) * powers(_BACK)[a]).view(np.int64)


def _held(least: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.linededup import keys, spans

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, lines, words = batch.columns
            starts = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))])
            a, b = spans(words.flatten().to_numpy(zero_copy_only=False), starts, least)
            row = np.searchsorted(starts, a, side="right") - 1
            run = keys(lines.flatten().to_numpy(zero_copy_only=False), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(numbers.to_numpy(zero_copy_only=False)[row])], names=["q_run", "q_no"])

    return each


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.linededup import positions, runs, shared

        held, where, lines, known = None, {}, [], set()
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            numbers, found = [], []
            for i, mine, words, first, theirs, their_words in zip(*(c.to_pylist() if n in (0, 3) else c for n, c in enumerate(batch.columns)), strict=True):
                if held != first:
                    lines = theirs.as_py()
                    held, where, known = first, positions(lines), {x for _, _, x in runs(lines, their_words.as_py(), least)}
                if got := shared(mine.as_py(), words.as_py(), lines, known, least, where):
                    numbers.append(i)
                    found.append([{"a": a, "b": b} for a, b in got])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, kind)], names=["q_no", "q_cuts"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters that stay, as runs (from 1, length), from the blocks cut with every partner."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))
    for batch in batches:
        keep, gone = [], []
        for lengths, cuts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            ends = [0]
            for n in lengths:
                ends.append(ends[-1] + n)
            at, rest, lines = 0, [], 0
            for a, b in [*sorted((x["a"], x["b"]) for part in cuts for x in part), (len(lengths), len(lengths))]:
                if a > at:
                    rest.append({"a": ends[at] + 1, "n": ends[a] - ends[at]})
                lines += max(0, b - max(a, at))
                at = max(at, b)
            keep.append(rest)
            gone.append(lines)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, kind), pa.array(gone, pa.int64())], names=["p_id", "p_twin", "p_keep", "p_gone"])


def _lines():
    return F.split("text", r"(?<=\n|[.!?] )", -1)


def deleted(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """p_id, p_twin, p_keep (runs of characters that stay), p_gone (lines deleted) of the documents that lose lines."""
    spark = ship(docs.sparkSession)
    row = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("q_id"), F.xxhash64("text").alias("q_twin"))
    line = F.transform(_lines(), lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(" \t\r\n\f\x0b"))).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w"), F.length(x).alias("n")))
    sheet = docs.filter("text <> ''").select(*row, line.alias("q"))
    sheet = sheet.select("q_id", "q_twin", F.col("q.h").alias("q_lines"), F.col("q.w").alias("q_words"), F.col("q.n").alias("q_chars"))
    sheet = sheet.dropDuplicates(["q_id", "q_twin"]).orderBy("q_id", "q_twin")
    sheet = cut(sheet.withColumn("q_no", F.monotonically_increasing_id()))
    release(spark)
    held = sheet.select("q_no", "q_lines", "q_words").mapInArrow(tidy(_held(least)), "q_run bigint, q_no bigint")
    first = held.groupBy("q_run").agg(F.min("q_no").alias("f_no"), F.max("q_no").alias("l")).filter("f_no < l")
    with small_batches(spark, BATCH):
        first = cut(first.select(F.col("q_run").alias("f_run"), "f_no"))
    release(spark)
    pairs = held.join(first, F.col("q_run") == F.col("f_run")).filter("q_no <> f_no").select("q_no", "f_no").distinct()
    pairs = pairs.join(sheet.select("q_no", "q_lines", "q_words"), "q_no")
    theirs = sheet.select(F.col("q_no").alias("f_no"), F.col("q_lines").alias("f_lines"), F.col("q_words").alias("f_words"))
    pairs = pairs.join(theirs, "f_no").select("q_no", "q_lines", "q_words", "f_no", "f_lines", "f_words")
    cuts = pairs.mapInArrow(tidy(_align(least)), "q_no bigint, q_cuts array<struct<a:int,b:int>>")
    cuts = cuts.groupBy("q_no").agg(F.collect_list("q_cuts").alias("q_cuts"))
    cuts = cuts.join(sheet, "q_no").select("q_id", "q_twin", "q_chars", "q_cuts")
    with small_batches(spark, BATCH):
        gone = cut(cuts.mapInArrow(tidy(_merge), "p_id bigint, p_twin bigint, p_keep array<struct<a:int,n:int>>, p_gone bigint"))
    release(spark)
    return gone


def dedup(docs: DataFrame, least: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """The documents without the lines that repeat aligned blocks of earlier ones.

    Same rows and columns; with ``counts`` also n_lines (a trailing empty one included) and n_deleted.  A document that loses all lines has an empty text.
    """
    gone = deleted(docs, least)
    row = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)) == F.col("p_id")) & (F.xxhash64("text") == F.col("p_twin"))
    rest = F.array_join(F.transform("p_keep", lambda r: F.substr(F.col("text"), r["a"], r["n"])), "")
    text = F.when(F.col("p_keep").isNull(), F.col("text")).otherwise(rest)
    more = [F.coalesce(F.size(_lines()), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce("p_gone", F.lit(0)).cast("bigint").alias("n_deleted")] if counts else []
    return docs.join(gone, row, "left").select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), *more)
