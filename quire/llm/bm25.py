"""Exact top-k search by BM25 with block-max dynamic pruning, run per shard and merged with global statistics.

Document counts, document frequencies and the mean length are taken over all documents first, so scores of all shards are
comparable and their merge is exact.  Documents are dealt, in chunks, into shards of about ``SHARD`` documents and at most
about ``SHARD_WORDS`` words.  A shard's documents are put in an order that brings like ones together, and are cut into
blocks of ``BLOCK``; lists that a share of at least 1 / ``DENSE`` of the shard is in are long and have their largest impact in each block.

Queries meet a shard in batches, each with its terms once.  Block-max pruning goes by document-aligned blocks instead of a
cursor for each list: a block's bound for a query is the block maxima of its long lists, weighed and summed, and the
block's best sum of its short lists.  Where there are several shards, one in ``FLOOR`` documents is searched first: no
document below a query's k-th best score there (its floor) can be a result.  A block is the pivot of its query only if its
bound reaches the floor; the long lists of all other blocks are passed over.  Like queries are taken together, so what
they have as pivots are runs of blocks, scored in one matrix product in single precision; documents that reach the floor
within its error are scored in full.  Bounds are never below true scores, so the result is that of scoring every document.

Terms are words as in ``textops`` (by 64-bit hash); a query is the set of a text's terms.  Terms that no other document
holds are left out of queries: they can't add to another document.  A document without a common term is no result.
Results of equal score (rounded to nine decimals) are ordered by id.  Rows with a null id take no part; a query's results
leave out rows of its own id; equal rows are all results, and queries equal in id and text are one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.textops import tidy
from quire.session import cut, ship, small_batches

K, EVERY = 10, 50
K1, B = 1.2, 0.75
SHARD, SHARD_WORDS, CHUNK, QUERIES, TILE, BLOCK, DENSE = 16_000, 16_000_000, 250, 2048, 128, 64, 20
#: Documents that others are put in order by, their cosine from which on they are alike, and the longest lists that this goes by.
CENTRES, ALIKE, CENTRAL = 48, 0.5, 384
#: Scores are rounded to nine decimals, so what misses a floor by less is kept until it is rounded.
SLACK = 1e-6
#: Floors of the scores come from one in FLOOR documents, from FLOOR / 4 shards on.
FLOOR = 16
#: Packed rows (chunks of documents, blocks of queries) in an Arrow batch: about a megabyte each.
BATCH = 16
#: Documents of a query that are scored in full at once, for the memory.
PIECE = 512
_U = np.uint64


def bag(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms by row: (row, term, times), sorted by row, and the length of every row in words."""
    from quire.llm.textops import words

    hashes, rows = words(data, offsets)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return r[first], h[first], np.diff(np.append(first, len(h))), np.bincount(rows, minlength=len(offsets) - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of each batch, and its words and documents under a null term."""
    from quire.llm.bm25 import bag
    from quire.llm.textops import slices

    for batch in batches:
        found, words, n = [np.zeros(0, _U)], 0, 0
        for _, _, data, offsets in slices(batch.column(0)):
            _, terms, _, length = bag(data, offsets)
            found.append(terms)
            words, n = words + int(length.sum()), n + len(length)
        terms, times = np.unique(np.concatenate(found), return_counts=True)
        none = np.arange(len(terms) + 1) == 0
        yield pa.RecordBatch.from_arrays([pa.array(np.append(_U(0), terms).view(np.int64), mask=none), pa.array(np.append(n, times)), pa.array(np.where(none, words, 0))], names=["term", "n", "words"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quire.llm.bm25 import bag
    from quire.llm.textops import slices

    for batch in batches:
        for a, b, data, offsets in slices(batch.column(2)):
            rows, terms, _, _ = bag(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)), pa.array(terms.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["id", "twin", "terms"])


#: Packed arrays of documents and of queries; documents have no floors.
CELLS = ["ids", "counts", "lengths", "terms", "values", "places", "floors"]
_CHUNKS, _PACKED = (", ".join(f"{c} binary" for c in cells) for cells in (CELLS[:-1], CELLS))


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _steps(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places that ascend in each row, as steps."""
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = places[first]
    return _small(steps)


def _small_of(cell: bytes, total: int) -> np.ndarray:
    return np.frombuffer(cell, f"u{len(cell) // total}") if total else np.zeros(0, np.uint8)


def _places(steps: bytes, counts: np.ndarray) -> np.ndarray:
    """The places that ``_steps`` made steps of."""
    counts = counts[counts > 0]
    steps = _small_of(steps, int(counts.sum())).astype(np.int64)
    at, first = np.cumsum(steps), np.cumsum(counts) - counts
    return at - np.repeat(at[first] - steps[first], counts)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as rows of packed arrays, of at most CHUNK documents each: their terms once, and the places of each one's among them."""
    from quire.llm.bm25 import CELLS, _small, _steps, bag
    from quire.llm.textops import mix, slices

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in slices(batch.column(1)):
            rows, terms, times, length = bag(data, offsets)
            ends = np.searchsorted(rows, np.arange(b - a + 1))
            for c in range(0, b - a, CHUNK):
                d = min(b - a, c + CHUNK)
                use = slice(ends[c], ends[d])
                counts = np.diff(ends[c : d + 1])
                held, of = np.unique(terms[use], return_inverse=True)
                key = int(mix(np.array([ids[a + c]], np.int64).view(_U) + _U(len(terms)))[0] >> _U(1))
                packed = (ids[a + c : a + d].astype(np.int64), counts.astype(np.int32), length[c:d].astype(np.int32), held, _small(times[use]), _steps(of, counts))
                yield pa.RecordBatch.from_arrays([pa.array([key]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["key", *CELLS[:-1]])


def _pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of queries as packed arrays: ids, numbers of terms, text hashes, the block's terms (as steps) and their document
    frequencies once each, for each query the places of its terms among them, and its floor; every shard gets them, so deflated."""
    pdf = pdf.sort_values(["id", "twin"], kind="stable")
    counts = np.array([len(x) for x in pdf["terms"]], np.int32)
    terms, at, of = np.unique(np.concatenate([np.asarray(x, np.int64) for x in pdf["terms"]]).view(_U), return_index=True, return_inverse=True)
    held = np.minimum(np.concatenate([np.asarray(x, np.int64) for x in pdf["dfs"]])[at], 2**31 - 1).astype(np.int32)
    of = of[np.lexsort((of, np.repeat(np.arange(len(counts)), counts)))]
    terms[1:] -= terms[:-1].copy()
    cells = pdf["id"].to_numpy(np.int64), counts, pdf["twin"].to_numpy(np.int64), terms, held, _steps(of, counts), pdf["floor"].to_numpy(np.float64)
    return pd.DataFrame({"block": [key[0]], **{n: [_deflated(x)] for n, x in zip(CELLS, cells, strict=True)}})


def _spots(starts: np.ndarray, lists: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all of some lists, and for each its list's weight."""
    first = starts[lists]
    sizes = starts[lists + 1] - first
    spot = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    spot += np.arange(len(spot))
    return spot, np.repeat(weights, sizes)


def _deflated(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: the high ones are mostly nought."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _inflated(cell: bytes, kind: type | None, total: int = 0) -> np.ndarray:
    """The numbers of ``_deflated``; without a kind, whole ones of the width that their total gives."""
    held = np.frombuffer(zlib.decompress(cell), np.uint8)
    kind = np.dtype(kind or f"u{len(held) // total}")
    return np.ascontiguousarray(held.reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def _postings(chunks: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts of their lists, documents, times): each chunk's postings go straight to their places, so nothing else is
    as long as all of them."""
    terms, more, size = np.zeros(0, _U), [], 0
    for n, c in enumerate(chunks, 1):
        more.append(np.frombuffer(c[3], _U))
        size += len(more[-1])
        if n == len(chunks) or size > max(len(terms), 1 << 18):  # chunks may be small
            terms, more, size = np.concatenate([terms, *more]), [], 0
            terms.sort()
            terms = terms[np.append(True, terms[1:] != terms[:-1])[: len(terms)]]
    sizes, kinds, parts = np.zeros(len(terms), np.int64), [np.dtype(np.uint8)], []
    for c in chunks:
        counts = np.frombuffer(c[1], np.int32)
        at = np.searchsorted(terms, np.frombuffer(c[3], _U)).astype(np.int32)
        sizes[at] += np.bincount(_places(c[5], counts), minlength=len(at))  # a chunk has a term once
        kinds.append(_small_of(c[4], int(counts.sum())).dtype)
        parts.append(at)
    starts = np.append(0, np.cumsum(sizes))
    docs, times = np.empty(starts[-1], np.int32), np.empty(starts[-1], max(kinds, key=lambda x: x.itemsize))
    free, first = starts[:-1].copy(), 0
    for c, at in zip(chunks, parts, strict=True):
        counts = np.frombuffer(c[1], np.int32)
        places = _places(c[5], counts)
        held = np.bincount(places, minlength=len(at))
        order = np.argsort(places.astype(np.min_scalar_type(len(at))), kind="stable")
        spot = np.repeat(free[at] - (np.cumsum(held) - held), held) + np.arange(len(places))
        docs[spot] = np.repeat(np.arange(first, first + len(counts), dtype=np.int32), counts)[order]
        times[spot] = _small_of(c[4], len(places))[order]
        free[at] += held
        first += len(counts)
    return terms, starts, docs, times


class Shard:
    """The inverted index of one shard."""

    def __init__(self, chunks: list[list], mean: float, spend: bool = False):
        """``spend`` empties the list of chunks as soon as they are read."""
        read = lambda n, kind: np.concatenate([np.frombuffer(c[n], kind) for c in chunks])
        self.ids = read(0, np.int64)
        self.n = n = len(self.ids)
        self.sorted = np.sort(self.ids)
        self.terms, self.starts, docs, times = _postings(chunks)
        self.norm = K1 * (1 - B + B * read(2, np.int32) / mean)
        if spend:
            chunks.clear()
        self.blocks = -(-n // BLOCK)
        sizes = np.diff(self.starts)
        long_ = np.flatnonzero(sizes * DENSE >= max(n, DENSE * BLOCK))
        self.long_of = np.full(len(self.terms), -1, np.int32)
        self.long_of[long_] = np.arange(len(long_))
        self.dense = np.zeros((len(long_), self.blocks * BLOCK), np.float32)
        self.times = np.zeros((len(long_), n), np.min_scalar_type(int(times.max(initial=0))))
        for j, t in enumerate(long_):
            use = slice(self.starts[t], self.starts[t + 1])
            self.dense[j, docs[use]], self.times[j, docs[use]] = self._impacts(times[use], docs[use]), times[use]
        if len(long_):
            order = self._order(np.argsort(-sizes[long_], kind="stable")[:CENTRAL])
            place = np.empty(n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            self.ids, self.norm = self.ids[order], self.norm[order]
            for a in range(0, len(docs), 1 << 18):  # piece by piece and row by row, for the memory
                docs[a : a + (1 << 18)] = place[docs[a : a + (1 << 18)]]
            for j in range(len(long_)):
                self.dense[j, :n], self.times[j] = self.dense[j, order], self.times[j, order]
        self.docs, self.once = docs, self._impacts(1, slice(None))
        more = np.flatnonzero(times > 1)  # what these add to the impact of a single occurrence
        self.more_docs, self.more_starts = docs[more], np.searchsorted(more, self.starts)
        self.more = self._impacts(times[more], self.more_docs) - self.once[self.more_docs]
        self.most = self.dense.reshape(len(long_), self.blocks, BLOCK).max(axis=2).astype(np.float64)
        self.error = (len(long_) + 16) * 2.0**-23

    def _impacts(self, times: np.ndarray | int, docs: np.ndarray | slice) -> np.ndarray:
        return times * (K1 + 1) / (times + self.norm[docs])

    def _order(self, lists: np.ndarray) -> np.ndarray:
        """The documents by the nearest of a few of them, and by nearness to it; those few stand together if they are alike."""
        x = self.dense[lists, : self.n]
        x /= np.sqrt(np.einsum("ij,ij->j", x, x)) + 1e-9  # without the squares as an array
        centres = x[:, np.linspace(0, self.n - 1, CENTRES).astype(int)]
        near = x.T @ centres
        home = near.argmax(axis=1)
        alike, label = centres.T @ centres >= ALIKE, np.arange(CENTRES)
        while True:
            least = np.where(alike, label[None, :], label[:, None]).min(axis=1)
            if (least >= label).all():
                break
            label = np.minimum(label, least)
        return np.lexsort((-near[np.arange(self.n), home], home, label[home]))

    def search(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray, counts: np.ndarray, floors: np.ndarray, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of the k best of each query that reach its floor, ties by id; in no order.

        ``terms`` and ``weights`` are the batch's; ``places``, those of each query's terms among them; ``counts``, of each query.
        """
        m = len(counts)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at[self.terms[at] != terms] = -1
        row, at, w = np.repeat(np.arange(m), counts), at[places], weights[places]
        have = at >= 0
        row, at, w = row[have], at[have], w[have]
        long_ = self.long_of[at]
        some = long_ >= 0
        heavy = np.zeros((m, len(self.most)))
        heavy[row[some], long_[some]] = w[some]
        row, at, w = row[~some], at[~some], w[~some]
        ends = np.searchsorted(row, np.arange(m + 1))
        bound = heavy @ self.most
        out: list = [None] * m
        order = np.argsort(bound.argmax(axis=1), kind="stable")  # like queries have like pivots
        for n in range(0, m, TILE):
            tile = order[n : n + TILE]
            short = [(at[a:b], w[a:b]) for a, b in zip(ends[tile], ends[tile + 1], strict=True)]
            for q, hits in zip(tile, self._tile(heavy[tile], short, bound[tile], floors[tile], k[tile]), strict=True):
                out[q] = hits
        return out

    def _tile(self, heavy: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray, floors: np.ndarray, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``search``, of a few queries: weights of their long lists, their short lists and weights, bounds of the long lists' sums."""
        m, n, width = len(short), self.n, self.blocks * BLOCK
        partial = np.zeros((m, width))
        for q, (lists, w) in enumerate(short):
            if len(lists):
                spot, value = _spots(self.starts, lists, w)
                sums = np.bincount(self.docs.take(spot, mode="clip"), value, minlength=width)
                np.multiply(sums[:n], self.once, out=partial[q, :n])
                spot, value = _spots(self.more_starts, lists, w)
                if len(spot):
                    value *= self.more.take(spot, mode="clip")
                    partial[q] += np.bincount(self.more_docs.take(spot, mode="clip"), value, minlength=width)
        scores = partial
        if heavy.any():
            light = heavy.astype(np.float32)
            pivot = bound * (1 + self.error) + partial.reshape(m, self.blocks, BLOCK).max(axis=2) >= floors[:, None] - SLACK
            scores = np.full((m, width), -1.0, np.float32)
            edge = np.flatnonzero(np.diff(pivot.any(axis=0), prepend=False, append=False))
            for first, last in zip(edge[::2], edge[1::2], strict=True):
                use, span = np.flatnonzero(pivot[:, first:last].any(axis=1)), slice(first * BLOCK, last * BLOCK)
                if 4 * len(use) >= 3 * m:
                    np.matmul(light, self.dense[:, span], out=scores[:, span])
                    scores[:, span] += partial[:, span]
                else:
                    scores[use, span] = light[use] @ self.dense[:, span]
                    for q in use:
                        scores[q, span] += partial[q, span]
        out = []
        for q in range(m):
            mine, floor = scores[q, :n], floors[q]
            if floor <= 0 and n > k[q]:
                floor = np.partition(mine, n - k[q])[n - k[q]] * (1 - self.error)
            docs = np.flatnonzero(mine >= max(floor * (1 - self.error) - SLACK, 1e-12))
            best, lists = partial[q, docs], np.flatnonzero(heavy[q])
            if len(docs) and len(lists):  # the sums in single precision have found them; their scores are exact
                for a in range(0, len(docs), PIECE):
                    some = docs[a : a + PIECE]
                    best[a : a + PIECE] += heavy[q, lists] @ self._impacts(self.times[np.ix_(lists, some)].astype(np.float64), some)
            best = np.round(best, 9)
            reach = best >= max(floors[q], 1e-12)
            docs, best = docs[reach], best[reach]
            if len(docs) > k[q]:
                least = -np.partition(-best, k[q] - 1)[k[q] - 1]
                docs, best = docs[best >= least], best[best >= least]
                first = np.lexsort((self.ids[docs], -best))[: k[q]]
                docs, best = docs[first], best[first]
            out.append((docs, best))
        return out


def _search(n: int, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.bm25 import Shard, _inflated, _places
        from quire.llm.textops import trim

        at, chunks, shard = None, [], None
        for batch in batches:
            out = [[], [], [], []]
            for r, (number, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                cells = [c[r].as_buffer() for c in batch.columns[2:]]
                if number != at:
                    at, chunks, shard = number, [], None
                if part < 0:  # the shard's documents sort before its queries
                    chunks.append(cells)
                    continue
                if shard is None:
                    shard = Shard(chunks, mean, spend=True) if chunks else False
                    trim()
                if not shard:
                    continue
                ids, counts, twins, terms, held, floors = (_inflated(cells[c], t) for c, t in ((0, np.int64), (1, np.int32), (2, np.int64), (3, _U), (4, np.int32), (6, np.float64)))
                terms, steps = np.cumsum(terms), _inflated(cells[5], None, int(counts.sum())).tobytes()
                weights = np.log1p((n - held + 0.5) / (held + 0.5))
                most = k + np.searchsorted(shard.sorted, ids, "right") - np.searchsorted(shard.sorted, ids, "left")
                for i, twin, (docs, scores) in zip(ids, twins, shard.search(terms, weights, _places(steps, counts), counts, floors, most), strict=True):
                    other = shard.ids[docs] != i
                    out[0].append(np.full(int(other.sum()), i))
                    out[1].append(np.full(int(other.sum()), twin))
                    out[2].append(shard.ids[docs[other]])
                    out[3].append(scores[other])
            columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int64, np.float64), strict=True)], names=["query_id", "twin", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: Column | None = None, k: int = K, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), doc_id, score of the k best documents for every document that ``queries`` holds of (default: ids divisible by EVERY)."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    counts = cut(rows.select("text").mapInArrow(tidy(_frequencies), "term bigint, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words")))
    stats = counts.filter("term is null").first()
    n, mean = (stats["df"], max(stats["words"] / max(stats["df"], 1), 1e-9)) if stats else (0, 1.0)
    asked = rows.filter(F.col("id") % EVERY == 0 if queries is None else queries).withColumn("twin", F.xxhash64("text")).dropDuplicates(["id", "twin"])
    asked = asked.select("id", "twin", "text").mapInArrow(tidy(_terms), "id bigint, twin bigint, terms array<bigint>")
    weighed = asked.select("id", "twin", F.explode("terms").alias("term")).join(counts.filter("df > 1").select("term", "df"), "term")
    one = F.array_sort(F.collect_list(F.struct("term", "df")))
    asked = weighed.groupBy("id", "twin").agg(one.alias("q")).select("id", "twin", F.col("q.term").alias("terms"), F.col("q.df").alias("dfs"))
    asked = cut(asked).withColumn("floor", F.lit(0.0))
    blocks = max(1, -(-asked.count() // QUERIES))
    shards = max(1, -(-n // shard), math.ceil(n * mean / SHARD_WORDS))

    def best(rows: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
        packed = asked.withColumn("block", F.pmod(F.xxhash64("id", "twin"), F.lit(blocks))).groupBy("block").applyInPandas(_pack, f"block bigint, {_PACKED}")
        packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).select("shard", F.col("block").alias("part"), *CELLS)
        held = rows.mapInArrow(tidy(_chunks), f"key bigint, {_CHUNKS}").select(F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")).alias("shard"), F.lit(-1).cast("long").alias("part"), *CELLS[:-1], F.lit(None).cast("binary").alias("floors"))
        met = held.unionByName(packed).repartition("shard").sortWithinPartitions("shard", "part")
        with small_batches(spark, BATCH):
            found = cut(met.mapInArrow(tidy(_search(n, mean, k)), "query_id bigint, twin bigint, doc_id bigint, score double"))
        rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "doc_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    if 4 * shards >= FLOOR:
        some = best(rows.filter(F.pmod(F.xxhash64("id"), F.lit(FLOOR)) == 0), asked, max(6, -(-shards // FLOOR)))
        floors = some.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "twin", (F.col("score") - SLACK).alias("least"))
        asked = asked.join(floors, ["id", "twin"], "left").withColumn("floor", F.coalesce("least", "floor")).drop("least")
    return best(rows, asked, shards).select("query_id", "rank", "doc_id", "score")
