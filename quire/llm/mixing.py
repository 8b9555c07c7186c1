"""Mixing sources to target weights by balanced sampling with the cube method.

The unit of decision is a distinct (source, id, text): rows that are equal in these three share one decision, so reruns
and any partitioning agree.  A source's target over its size is split into whole copies, which every unit gets, and a
fraction, the inclusion probability of one more copy.

The flight moves three undecided units at a time along the null vector of their (words, rows) columns until one of them
is decided; so both totals of a block stay exactly at their expected values.  A block of at most ``BLOCK`` units leaves
two undecided units at most, besides ``RESERVE`` units of evenly spaced size ranks that did not fly.  These go, level by
level, into fewer blocks of the same source, until one block for each source is left.  There all fly; the last two units
land by dropping first the balance of rows, then that of words.  What a large unit's landing then lacks or exceeds in
words is made good by turning round decisions of the landing problem's units, from the largest size that fits down.

Sizes are runs of characters other than ASCII white space; null and empty texts have size 0.  A null source is a source
of its own, the last in order.  If all sizes are 0, targets are 0 and nothing is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.textops import tidy
from quire.session import cut, ship

BLOCK, RESERVE = 4096, 512
#: No unit is taken more often than this, and no target is above this times its source's size.
MOST = 3


def sized(docs: DataFrame) -> DataFrame:
    """q_source, q_id, q_twin (hash of the text), q_size of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.textops import SPACE, runs, slices

        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in slices(batch.column(3)):
                sizes[a:b] = np.bincount(runs(~SPACE[data], offsets)[2], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes)], names=["q_source", "q_id", "q_twin", "q_size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("source").cast("string"), "doc_id", F.xxhash64("text"), "text")
    return rows.mapInArrow(tidy(run), f"q_source string, q_id {kind}, q_twin bigint, q_size bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources in code-point order, null last, with their rank from 0: a range-partitioned sort and an offset for each partition."""
    ordered = cut(sources.orderBy(F.col("q_source").asc_nulls_last()).select("*", F.spark_partition_id().alias("q_part"), F.monotonically_increasing_id().alias("q_at")))
    starts, n = {}, 0
    for r in sorted(ordered.groupBy("q_part").agg(F.min("q_at").alias("low"), F.count("*").alias("n")).collect()):  # a row for each partition
        starts[r["q_part"]] = n - r["low"]
        n += r["n"]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("q_part")) if starts else F.lit(0)
    return ordered.select("q_source", "q_source_size", (F.col("q_at") + offset).alias("q_rank"))


def targets(sources: DataFrame, weight: Column | None = None) -> DataFrame:
    """q_target of every source: its share by weight of all sizes, at most MOST times its size, the excess reshared by weight.

    ``weight`` is a column over q_source and q_rank; by default weights are 1, 2, 3, repeating in order.  The level that
    the shares rise to is found by a few passes over the sources, each an aggregate of one row.
    """
    s = cut(ranked(sources).withColumn("q_weight", (F.col("q_rank") % 3 + 1 if weight is None else weight).cast("double")))
    top = F.lit(MOST) * F.col("q_source_size")
    total = s.agg(F.sum("q_source_size").alias("t")).first()["t"] or 0
    level, before = 0.0, -1
    while True:
        full = top <= F.col("q_weight") * F.lit(level)
        got = s.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0)).alias("taken"), F.sum(F.when(~full, F.col("q_weight"))).alias("free"), F.count_if(full).alias("n")).first()
        if not got["free"] or got["n"] == before:
            break
        level, before = (total - got["taken"]) / got["free"], got["n"]
    return s.withColumn("q_target", F.least(top.cast("double"), F.col("q_weight") * F.lit(level)))


def _fly(size: np.ndarray, rows: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """The cube method's flight over units in order; two units at most stay undecided, none with ``land``."""
    p = p.copy()
    s, c = size.tolist(), rows.tolist()
    q = p.tolist()
    waiting = [k for k in range(len(q)) if 0.0 < q[k] < 1.0]
    draws = iter(rng.random(len(waiting) + 4).tolist())
    active, at = [], 0
    while True:
        while len(active) < 3 and at < len(waiting):
            active.append(waiting[at])
            at += 1
        if len(active) == 3:
            i, j, k = active
            u = [s[j] * c[k] - s[k] * c[j], s[k] * c[i] - s[i] * c[k], s[i] * c[j] - s[j] * c[i]]
            if not any(u):  # the columns are collinear: two of the units suffice
                u = [c[j], -c[i], 0]
        elif land and len(active) == 2:
            i, j = active
            u = [s[j], -s[i]] if s[i] and s[j] else [c[j], -c[i]]
        elif land and len(active) == 1:
            u = [1]
        else:
            break
        up = down = float("inf")
        for x, unit in zip(u, active, strict=True):
            if x > 0:
                up, down = min(up, (1 - q[unit]) / x), min(down, q[unit] / x)
            elif x < 0:
                up, down = min(up, -q[unit] / x), min(down, -(1 - q[unit]) / x)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for x, unit in zip(u, active, strict=True):
            v = q[unit] + step * x
            v = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            q[unit] = v
            if 0.0 < v < 1.0:
                left.append(unit)
        active = left
    return np.array(q)


def _repair(size: np.ndarray, expected: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Turn round decisions, largest size first, in three passes, where each brings the words nearer to their expected total."""
    chosen = chosen.copy()
    off = float((size * (chosen - expected)).sum())
    for k in np.tile(np.argsort(-size, kind="stable"), 3):
        change = size[k] if chosen[k] < 0.5 else -size[k]
        if abs(off + change) < abs(off):
            off += change
            chosen[k] = 1.0 - chosen[k]
    return chosen


def _flight(land: bool):
    def run(key, pdf):
        pdf = pdf.sort_values(["q_size", "q_twin", "q_id"], ascending=[False, True, True], kind="stable", na_position="last")
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(repr((key[0], int(key[1]), len(pdf), land)).encode())))
        rows = pdf["q_n"].to_numpy(np.float64)
        size, p = pdf["q_size"].to_numpy(np.float64) * rows, pdf["q_p"].to_numpy(np.float64).copy()
        if land:
            pdf["q_p"] = _repair(size, p, _fly(size, rows, p, rng, True))
        else:
            flies = np.ones(len(p), bool)
            flies[np.unique(np.linspace(0, len(p) - 1, RESERVE).astype(int))] = False
            p[flies] = _fly(size[flies], rows[flies], p[flies], rng, False)
            pdf["q_p"] = p
        return pdf

    return run


def plan(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mix, a row for each unit: q_source, q_id, q_twin, q_size, q_n (rows), q_source_size, q_target, q_copies (of each row)."""
    units = cut(sized(docs).groupBy("q_source", "q_id", "q_twin", "q_size").agg(F.count("*").alias("q_n")))
    sources = units.groupBy("q_source").agg(F.sum(F.col("q_size") * F.col("q_n")).alias("q_source_size"))
    goal = cut(targets(sources, weight).select(F.col("q_source").alias("g_source"), "q_source_size", "q_target", F.when(F.col("q_source_size") > 0, F.col("q_target") / F.col("q_source_size")).otherwise(F.lit(0.0)).alias("g_ratio")))
    same = F.col("q_source").eqNullSafe(F.col("g_source"))
    units = units.join(goal, same).select("q_source", "q_id", "q_twin", "q_size", "q_n", "q_source_size", "q_target", F.floor("g_ratio").alias("q_whole"), (F.col("g_ratio") - F.floor("g_ratio")).alias("q_p"))
    open_ = (F.col("q_p") > 0) & (F.col("q_p") < 1)
    units = cut(units)
    decided, pending = units.filter(~open_), units.filter(open_)
    while True:
        sizes = pending.groupBy("q_source").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("g_blocks")).withColumnRenamed("q_source", "g_source")
        dealt = pending.join(sizes, same).withColumn("q_block", F.pmod(F.xxhash64("q_id", "q_twin", F.lit(7)), F.col("g_blocks")).cast("long")).drop("g_source")
        flown = cut(dealt.drop("g_blocks").groupBy("q_source", "q_block").applyInPandas(_flight(False), dealt.drop("g_blocks").schema))
        decided = decided.unionByName(flown.filter(~open_).drop("q_block"))
        pending = flown.filter(open_).drop("q_block")
        most = pending.groupBy("q_source").count().agg(F.max("count")).first()[0]
        if not most or most <= BLOCK:
            last = pending.withColumn("q_block", F.lit(-1).cast("long"))
            landed = last.groupBy("q_source", "q_block").applyInPandas(_flight(True), last.schema)
            decided = decided.unionByName(landed.drop("q_block"))
            break
    return decided.withColumn("q_copies", (F.col("q_whole") + F.round("q_p")).cast("long")).drop("q_p", "q_whole")


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with its own columns."""
    chosen = plan(docs, weight).filter("q_copies > 0").select(F.col("q_source").alias("g_source"), F.col("q_id").alias("g_id"), F.col("q_twin").alias("g_twin"), "q_copies")
    mine = docs.withColumn("g_row", F.xxhash64("text"))
    on = F.col("source").cast("string").eqNullSafe(F.col("g_source")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("g_row") == F.col("g_twin"))
    return mine.join(chosen, on).withColumn("g_copy", F.explode(F.sequence(F.lit(1), F.col("q_copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
