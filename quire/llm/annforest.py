"""Approximate nearest neighbours by largest inner product: a hash-prefix forest over shards of the vectors.

Rows are dealt into shards of about ``SHARD`` by a hash of their id.  Each shard has ``TREES`` sorted arrays of hash
strings (signs of random projections, ``BITS`` long).  Vectors are lifted to the unit sphere first (scaled by the shard's
largest norm, with one more component), so that the angle orders them by inner product with a query.

A query descends in every tree along its longest matching prefixes to where they hold a few candidates, then all trees
ascend together to shorter prefixes and so to more candidates, each scored on its original vector.  The ascent ends when
a neighbour as near as the k-th found so far would have been missed by all trees with a chance of at most ``MISS``: two
vectors at angle a share a prefix of x signs with chance (1 - a / pi)^x, which also says how far to ascend next, and how
many of the trees have to take the last level.  So easy queries stop early and hard ones go on; there is no candidate
limit.  The k-th place is taken of what a shard holds of the k nearest, with three standard
deviations to spare.

The stated queries (every row whose id is divisible by ``EVERY``) meet all shards, in blocks of at most ``QUERIES``;
every shard returns k rows for a query, and a query's rows from all shards are merged by score.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id take no part; vectors
of different dimension are never compared.  Rows equal in id and vector are one row.  Equal vectors of a shard are
indexed once, with all their ids.  An id with several vectors is one query and one neighbour: the score of two ids is that
of their nearest vectors, so no neighbour is named twice.  A query is not its own neighbour: rows of its id are left out.
Ids that are no numbers raise (they are cast to bigint).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.textops import tidy
from quire.session import cut, ship

K, EVERY = 20, 20
SHARD, QUERIES = 16_384, 256
TREES, BITS, MISS = 40, 24, 0.08
#: Dimensions of vectors up to which the plan of shards is broadcast (a row for each).
DIMENSIONS = 10_000


class Forest:
    """The forest of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        rows = vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        _, first, at = np.unique(rows, return_index=True, return_inverse=True)
        self.repeats = int(np.unique(ids, return_counts=True)[1].max())  # vectors of one id
        by = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at))
        self.ids = [ids[by[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]  # of equal vectors, ascending
        self.exact = vectors[first].astype(np.float64)
        norms = np.linalg.norm(self.exact, axis=1)
        self.norm = float(norms.max())
        self.quick = self.exact.astype(np.float32)
        lifted = np.concatenate([self.exact / self.norm, np.sqrt(np.maximum(0.0, 1.0 - (norms / self.norm) ** 2))[:, None]], axis=1)
        self.planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((lifted.shape[1], trees * bits))
        self.trees, self.bits = trees, bits
        keys = self.strings(lifted)
        self.order = np.argsort(keys, axis=0, kind="stable").astype(np.int32).T.copy()
        self.keys = np.take_along_axis(keys, self.order.T, axis=0).T.copy()

    def strings(self, lifted: np.ndarray) -> np.ndarray:
        """Hash strings as integers, a column for each tree."""
        signs = (lifted @ self.planes > 0).reshape(len(lifted), self.trees, self.bits)
        return (signs * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).sum(axis=2)

    def ranges(self, queries: np.ndarray) -> np.ndarray:
        """[prefix length, tree, query, 0 or 1]: the range of each tree's array that shares the prefix."""
        keys = self.strings(np.concatenate([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))], axis=1))
        out = np.empty((self.bits + 1, self.trees, len(queries), 2), np.int32)
        for x in range(self.bits + 1):
            rest = (1 << (self.bits - x)) - 1
            for t in range(self.trees):
                out[x, t, :, 0] = np.searchsorted(self.keys[t], keys[:, t] & ~rest, "left")
                out[x, t, :, 1] = np.searchsorted(self.keys[t], keys[:, t] | rest, "right")
        return out

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, shards: int, miss: float = MISS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's id, ids, scores) of the k best found for each query, best first, ties by id."""
        share = k / shards
        place = max(1, min(k, math.ceil(share + 3 * math.sqrt(share) if shards > 1 else share)))
        goal = math.log(miss)
        ranges = self.ranges(queries)
        held = (ranges[..., 1] - ranges[..., 0]).sum(axis=1)  # by prefix length and query
        for n, (me, q) in enumerate(zip(own, queries, strict=True)):
            quick = q.astype(np.float32)
            reach = float(np.linalg.norm(q)) * self.norm
            mark, seen = np.zeros(len(self.exact), bool), np.zeros(len(self.exact), bool)
            found, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
            enough = np.flatnonzero(held[:, n] >= max(4 * place, 64))
            level, ahead = (int(enough[-1]) if len(enough) else 0), self.trees  # so many trees are at this level, the rest a level deeper
            while True:
                for t in range(self.trees):
                    a, b = ranges[level + (t >= ahead), t, n]
                    mark[self.order[t, a:b]] = True
                new = np.flatnonzero(mark & ~seen)
                seen[new] = True
                found, scores = np.concatenate([found, new]), np.concatenate([scores, self.quick[new] @ quick])
                if level == 0 and ahead == self.trees:
                    break
                p = 0.0
                if len(found) > place:
                    worth = float(np.partition(scores, len(scores) - place - 1)[len(scores) - place - 1])
                    p = 1.0 - math.acos(max(-1.0, min(1.0, worth / reach))) / math.pi
                chance = [math.log1p(-min(p**x, 1 - 1e-12)) if p else 0.0 for x in range(level + 2)]  # of a tree's miss
                if ahead * chance[level] + (self.trees - ahead) * chance[level + 1] <= goal:
                    break
                to = next((x for x in range(level, -1, -1) if self.trees * chance[x] <= goal), 0)
                if to < level - 2 and 16 * len(found) < len(seen):  # the k-th place may still rise a lot
                    to = level - 2
                    ahead = self.trees
                else:
                    less = chance[to] - chance[to + 1]
                    some = math.ceil((goal - self.trees * chance[to + 1]) / less) if less < 0 else self.trees
                    ahead = max(1, min(self.trees, max(some, ahead if to == level else 1)))
                level = to
            best = min(len(found), (k + 1) * self.repeats)
            if best:  # all that single precision can't tell from the best
                least = np.partition(scores, len(scores) - best)[len(scores) - best]
                top = found[scores >= least - len(q) * 2.0**-21 * reach]
            else:
                top = found
            ids = [self.ids[c][: k + 1] for c in top]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            exact = np.repeat((self.exact[top] * q[None, :]).sum(axis=1), [len(x) for x in ids]) if ids else np.zeros(0)
            other = flat != me
            flat, exact = flat[other], exact[other]
            order = np.lexsort((flat, -exact))
            if self.repeats > 1:
                order = order[np.sort(np.unique(flat[order], return_index=True)[1])]
            yield int(me), flat[order[:k]], exact[order[:k]]


def _pack(part: str):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        vectors = np.array(pdf["v"].to_list(), np.float64)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "shards": [pdf["shards"].iloc[0]], "part": [part], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [vectors.tobytes()]})

    return run


_PACKED = "dim int, shard bigint, shards bigint, part string, ids binary, data binary"


def _search(k: int, trees: int, bits: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.annforest import Forest

        at, forest = None, None
        for batch in batches:
            out = [[], [], []]
            for dim, shard, shards, part, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, vectors = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
                if part == "":  # the shard's rows sort before its query blocks
                    at, forest = (dim, shard), Forest(own, vectors, trees, bits)
                elif at == (dim, shard):
                    for me, found, scores in forest.search(own, vectors, k, shards, miss):
                        out[0].append(np.full(len(found), me))
                        out[1].append(found)
                        out[2].append(scores)
            columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, trees: int = TREES, bits: int = BITS, miss: float = MISS, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every row whose vec_id is divisible by ``every``."""
    ship(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(fine).dropDuplicates(["id", "v"])
    rows = cut(rows.withColumn("dim", F.size("v")))
    plan = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"), F.ceil(F.count_if(F.col("id") % every == 0) / F.lit(QUERIES)).alias("blocks"))
    plan = cut(plan)
    rows = rows.join(F.broadcast(plan) if plan.count() <= DIMENSIONS else plan, "dim")
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.col("shards"))).groupBy("dim", "shard").applyInPandas(_pack(""), _PACKED)
    blocks = rows.filter(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks"))).groupBy("dim", "block").applyInPandas(_pack("q"), _PACKED)
    blocks = blocks.withColumnRenamed("shard", "block").withColumn("part", F.concat("part", F.col("block").cast("string")))
    asked = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select("dim", "shard", "shards", "part", "ids", "data")
    met = shards.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "part")
    found = met.mapInArrow(tidy(_search(k, trees, bits, miss)), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
