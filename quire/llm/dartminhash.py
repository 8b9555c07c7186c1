"""Near-duplicate classes from DartMinHash signatures of word shingles.

A text is its set of hashed word shingles (five words; fewer if the text has fewer; a text without words is one shingle of
all its bytes), or with ``weighted`` their multiset: an element weighs one, or as much as it occurs.  Every element owns a region: its weight by the rank axis.  Darts are thrown at regions in order of rank,
by a hash of the element alone, so that equal elements get equal darts in all texts; a dart names a coordinate, and each of
the ``COORDINATES`` coordinates keeps its earliest dart.  A text of total weight W reads the rank axis as far as
``t / W`` with t = k ln k + 2k, which fills all coordinates but rarely; where one stays empty the text reads on, twice as
far.  So a signature costs as much as the text has elements, plus t, and two texts agree in a coordinate with their
weighted Jaccard similarity as probability.

Signatures are joined by bands of ``ROWS`` coordinates.  Texts with equal shingle multisets are one node.  In each band
bucket all nodes are compared with one leader, the node of the largest buckets; pairs are verified on whole shingle sets.
Where a bucket's nodes are then in more than one component, all nodes that such buckets connect form a family, and
families are compared exactly: in pairs of blocks of bounded size, each by products of 0/1 matrices of the shingles that
occur twice in the two blocks.  Only links between components leave a task, one for two components.  So no pair of a
bucket is given up: it is verified, or its two nodes are known to be connected; and no list of a family's pairs is made.

Components are found by star rounds; the few nodes that a large share of all edges meet are joined by broadcast (their
number is bounded by that share), all others by shuffle, so no node's edges come together in one task.  A round is some
twenty stages, however few the edges, so up to ``FEW`` edges, at the start or after a round, are joined in one task.

Null and empty texts have no class partner.  Ids that are no numbers raise (they are cast to bigint).  A class is named by its smallest id; if all its ids are null, by a negative
number from its key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.textops import tidy, trim
from quire.session import cut, release, ship, small_batches

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Nodes, and shingles, of a block of a family; columns of a matrix.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1500, 800_000, 1024
#: Documents, and pairs of them, in an Arrow batch.
BATCH = 1_000
#: A node is hot from so many edges on, and from one of so many parts of all edges on: at most twice as many nodes are.
HOT = 1000
#: So many edges (32 bytes each) are joined in one task instead of in rounds.
FEW = 1 << 18
_U = np.uint64


def cells(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted regions as cells of weight one, the last of them cut: (cell hash, row, width)."""
    from quire.llm.textops import mix

    n = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return mix(elements[at] + number.astype(_U) * _U(0xA24BAED4963EE407)), rows[at], np.minimum(weights[at] - number, 1.0)


def _thrown(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gap before dart ``m`` of cells, and the dart's own hash."""
    from quire.llm.textops import mix, unit

    d = mix(h + m * _U(0x9FB21C651E98DF25))
    return -np.log(unit(d)), mix(d ^ _U(0xD1342543DE82EF95))


def signatures(elements: np.ndarray, rows: np.ndarray, n: int, widths: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """``n`` signatures of ``k`` 64-bit values from cells; a row without cells has zeros.  ``widths``: cells' parts of weight one."""
    from quire.llm.textops import unit

    total = np.bincount(rows, widths, minlength=n)
    out, todo = np.zeros((n, k), _U), total > 0
    reach = np.where(todo, (k * math.log(k) + 2 * k) / np.where(todo, total, 1.0), 0.0)
    while todo.any():
        use = todo[rows]
        h, at = elements[use], rows[use]
        width = None if widths is None else widths[use]
        rank, got, m = np.zeros(len(h)), [], 0
        while len(h):
            step = 1 if m < 6 else 32
            number = np.arange(m, m + step, dtype=_U)
            gap, dart = _thrown(h[:, None], number[None, :])
            when = rank[:, None] + np.cumsum(gap, axis=1)
            hit = when <= reach[at][:, None]
            if width is not None:
                hit &= unit(dart * _U(0x8CB92BA72F3D8DD7)) <= width[:, None]
            i, j = np.nonzero(hit)
            got.append((at[i], when[i, j], dart[i, j]))
            on = when[:, -1] <= reach[at]
            h, at, rank, m = h[on], at[on], when[on, -1], m + step
            width = None if width is None else width[on]
        who, when, dart = (np.concatenate(x) for x in zip(*got, strict=True))
        place = who * k + ((dart >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
        order = np.argsort(-when, kind="stable")
        best = np.full(n * k, -1, np.int64)
        best[place[order]] = order  # the last to be written is the earliest dart
        best = best.reshape(n, k)
        full = todo & (best >= 0).all(axis=1)
        out[full] = dart[best[full]]
        todo = todo & ~full
        reach = np.where(todo, reach * 2, reach)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    from quire.llm.textops import mix

    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    keys = np.arange(k // rows, dtype=_U)[None, :] * _U(0xE7037ED1A0B428DB)
    for j in range(rows):
        keys = mix(keys + parts[:, :, j])
    return keys


def elements(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and rows of a slice; a text that has bytes but no words is one element."""
    from quire.llm.textops import Hasher, shingles

    h, rows = shingles(data, offsets, size)
    have = np.bincount(rows, minlength=len(offsets) - 1)
    bare = np.flatnonzero((have == 0) & (np.diff(offsets) > 0))
    if len(bare):
        h = np.concatenate([h, Hasher(data)(offsets[:-1][bare], offsets[1:][bare]) ^ _U(0x6C62272E07BB0142)])
        rows = np.concatenate([rows, bare])
    return h, rows


def regions(data: np.ndarray, offsets: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct elements of each text of a slice with their weights, by row and element: (element, row, weight)."""
    h, rows = elements(data, offsets)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(h))).astype(float) if weighted else np.ones(len(first))
    return h[first], rows[first], weights


def _sign(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.dartminhash import BANDS, bands, cells, regions, signatures
        from quire.llm.textops import mix, slices

        for batch in batches:
            nodes, keys, counts = [], [], []
            for _, _, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                h, rows, weights = regions(data, offsets, weighted)
                count = np.bincount(rows, minlength=n)
                first = np.cumsum(count) - count
                digest = np.zeros((n, 2), _U)
                full = count > 0
                if full.any():
                    weighed = h + weights.astype(_U) * _U(0xDB4F0B9175AE2165)
                    digest[full, 0] = np.add.reduceat(mix(weighed), first[full])
                    digest[full, 1] = np.add.reduceat(mix(weighed ^ _U(0x2545F4914F6CDD1D)), first[full])
                raw = digest.tobytes()
                nodes += [raw[16 * r : 16 * r + 16] if count[r] else None for r in range(n)]
                h, rows, widths = cells(h, rows, weights)
                key = bands(signatures(h, rows, n, widths if (widths < 1.0).any() else None)).astype(np.int64)
                keys += [key[r] if count[r] else None for r in range(n)]
                counts.append(count)
            flat = pa.array(np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)]))
            have = np.array([k is not None for k in keys], bool)
            ends = np.concatenate([[0], np.cumsum(have * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.binary()), lists, pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64())], names=["id", "twin", "node", "bands", "n"])

    return run


def _sets(weighted: bool):
    """The sorted cells of each text, as bytes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.dartminhash import cells, regions
        from quire.llm.textops import slices

        for batch in batches:
            out, counts = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                h, rows, _ = cells(*regions(data, offsets, weighted))
                order = np.lexsort((h, rows))
                h, ends = h[order], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    out.append(h[a:b].tobytes())
                    counts.append(b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.binary())], names=["node", "m", "shingles"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if min(len(a), len(b)) >= least * max(len(a), len(b)):
                    both = np.sort(np.concatenate([a, b]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    good[r] = common >= least * (len(a) + len(b) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    return run


def _family(least: float):
    """Links between components of a block, or across two blocks, of a family."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "node"], kind="stable")
        sets = [np.frombuffer(x, _U) for x in pdf["shingles"]]
        size = np.array([len(x) for x in sets])
        rows = np.repeat(np.arange(len(sets)), size)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        use = count[token] > 1
        rows, token = rows[use], (np.cumsum(count > 1) - 1)[token[use]]
        order = np.argsort(token, kind="stable")
        rows, token = rows[order], token[order]
        n = len(sets)
        split = int((pdf["block"].to_numpy() == key[1]).sum()) if key[1] != key[2] else n
        other = slice(split, n) if key[1] != key[2] else slice(0, n)
        common = np.zeros((split, n - split if key[1] != key[2] else n), np.float32)
        top = int(token[-1]) + 1 if len(token) else 0
        m = None
        for a in range(0, top, COLUMNS):
            part = slice(*np.searchsorted(token, [a, a + COLUMNS]))
            m = np.zeros((n, COLUMNS), np.float32)
            m[rows[part], token[part] - a] = 1.0
            common += m[:split] @ m[other].T
        names, home = np.unique(pdf["home"].to_numpy(object), return_inverse=True)
        found = [np.zeros(0, np.int64)]
        for a in range(0, split, 128):
            part = slice(a, min(a + 128, split))
            union = size[part, None] + size[other][None, :] - common[part]
            i, j = np.nonzero((common[part] >= least * union - 1e-6) & (home[part, None] != home[other][None, :]))
            x, y = home[part][i], home[other][j]
            found.append(np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y)))
        pairs = np.unique(np.concatenate(found))
        del sets, token, rows, common, m
        trim()
        return pd.DataFrame({"u": names[pairs // len(names)], "v": names[pairs % len(names)]}, columns=["u", "v"])

    return run


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes below ``n`` is connected to by the edges (u, v)."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((up := root[root]) != root).any():
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return root


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of a partition's edges."""
    import pyarrow.compute as pc
    from quire.llm.dartminhash import roots

    got = list(batches)
    both = pa.chunked_array([b.column(k) for k in (0, 1) for b in got]).combine_chunks() if got else []
    if len(both):
        names = pc.unique(both)
        names = names.take(pc.array_sort_indices(names))
        at = pc.index_in(both, names).to_numpy()
        root = roots(at[: len(at) // 2], at[len(at) // 2 :], len(names))
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of the edges (u, v): alternating large-star and small-star rounds until nothing changes.

    Each round joins the edges with the smallest neighbour of each node; no neighbour list is ever gathered.  Once there are
    at most ``few`` edges, one task joins them; the result is the same.  A node of at least ``most`` edges is hot; as an edge has two nodes, at most ``2 * edges / most`` are, and these are broadcast.
    """

    def joined(e: DataFrame, least: DataFrame, most: int) -> DataFrame:
        hot = e.join(F.broadcast(least.filter(F.col("c") >= most)), F.col("u") == F.col("w"), "left")
        return hot.filter("m is not null").select("u", "v", "m").unionByName(hot.filter("m is null").select("u", "v").join(least.filter(F.col("c") < most), F.col("u") == F.col("w")).select("u", "v", "m"))

    def star(e: DataFrame, large: bool, most: int) -> DataFrame:
        if large:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"), F.count("*").alias("c"))
            out = joined(both, least, most).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # from each node to its smaller neighbours
            least = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("c"))
            out = joined(e, least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(e)
    while True:
        if seen[0] <= few:
            kind = e.schema["u"].dataType.simpleString()
            return cut(e.repartition(1).mapInArrow(tidy(_joined), f"node {kind}, root {kind}"))
        most = max(HOT, int(seen[0]) // HOT)
        e = cut(star(star(e, True, most), False, most))
        now = mark(e)
        release(e.sparkSession)
        if now == seen:
            break
        seen = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut(members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def facing(loose: DataFrame) -> DataFrame:
    """The nodes of families (root, node, home, m, shingles), once for each two blocks i <= j of their family to be compared."""
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("m") / F.lit(BLOCK_SHINGLES))).alias("blocks")
    large = F.broadcast(loose.groupBy("root").agg(blocks).filter("blocks > 1"))  # a row for each BLOCK nodes or BLOCK_SHINGLES shingles at most
    loose = loose.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    loose = loose.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = loose.select("root", F.least("block", "facing").alias("i"), F.greatest("block", "facing").alias("j"), "block", "node", "home", "shingles")
    return dealt.repartition("root", "i", "j")  # else all blocks of a family may stay in the task of its root


def classes(docs: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """q_id, q_twin (hash of the text), class_id, q_first (is it its class's row to keep?) of every document."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("twin"), "text")
    with small_batches(spark, BATCH):
        signed = cut(rows.mapInArrow(tidy(_sign(weighted)), "id bigint, twin bigint, node binary, bands array<bigint>, n bigint"))
    last = F.coalesce("id", F.lit((1 << 63) - 1))
    nodes = cut(signed.filter("node is not null").groupBy("node").agg(F.min(F.struct(last.alias("rank"), "twin")).alias("rep"), F.min("id").alias("least_id"), F.first("bands").alias("bands"), F.first("n").alias("n")))

    posts = nodes.select("node", F.explode("bands").alias("key"))
    crowd = posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    posts = cut(posts.join(crowd, "key"))
    central = posts.groupBy("node").agg(F.sum("c").alias("s"))
    leaders = posts.join(central, "node").groupBy("key").agg(F.max(F.struct("s", "node"))["node"].alias("leader"))
    pairs = posts.join(leaders, "key").filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = cut(pairs)

    wanted = posts.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", "rep.rank", F.col("rep.twin").alias("twin_"))
    held = rows.withColumn("rank", last).join(wanted, ["rank"]).filter("twin = twin_").dropDuplicates(["node"]).select("node", "text")
    with small_batches(spark, BATCH):
        sets = cut(held.mapInArrow(tidy(_sets(weighted)), "node binary, m bigint, shingles binary"))
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "uv")

    def verified(p: DataFrame) -> DataFrame:
        with small_batches(spark, BATCH):
            return cut(p.join(left, "u").join(right, "v").select("u", "v", "u_set", "v_set").mapInArrow(tidy(_verify(least)), "u binary, v binary"))

    links = verified(pairs)
    release(spark)
    found = components(links)
    home = F.coalesce("root", "node").alias("home")
    spread = cut(posts.select("key", "node").join(found, "node", "left").select("key", "node", home))
    mixed = spread.groupBy("key").agg(F.min("home").alias("a"), F.max("home").alias("b")).filter("a <> b").select("key")
    open_ = spread.join(mixed, "key")
    if not open_.isEmpty():
        bucket = F.unhex(F.lpad(F.hex("key"), 16, "0"))
        family = components(open_.select(F.col("node").alias("u"), bucket.alias("v")))
        loose = cut(open_.select("node", "home").distinct().join(family, "node").join(sets, "node"))
        more = cut(facing(loose).groupBy("root", "i", "j").applyInPandas(_family(least), "u binary, v binary"))
        release(spark)
        if not more.isEmpty():  # links between roots: their components rename the roots
            renamed = components(more).select(F.col("node").alias("old"), F.col("root").alias("new"))
            found = cut(found.unionByName(renamed.filter("old <> new").select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct().join(renamed, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))
    of = nodes.select("node", "least_id", "rep").join(found, "node", "left").select("node", "least_id", "rep", home)
    negative = -F.pmod(F.xxhash64("home"), F.lit((1 << 62) - 1)) - 1
    named = of.groupBy("home").agg(F.min("least_id").alias("class_id"), F.min("rep").alias("keep")).withColumn("class_id", F.coalesce("class_id", negative))
    named = of.select("node", "home").join(named, "home").select("node", "class_id", "keep")
    out = signed.join(named, "node", "left").withColumn("alone", F.col("class_id").isNull() & F.col("node").isNull())
    own = (F.coalesce("id", F.lit((1 << 63) - 1)) == F.col("keep.rank")) & (F.col("twin") == F.col("keep.twin"))
    return out.select(F.col("id").alias("q_id"), F.col("twin").alias("q_twin"), F.when(F.col("alone"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("alone"), True).otherwise(own).alias("q_first"), F.col("alone").alias("q_alone"))


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one of the smallest id (of equal ids, the smallest text hash); documents without text all stay."""
    kept = classes(docs, least).filter("q_first").select(F.coalesce("q_id", F.lit((1 << 63) - 1)).alias("p_id"), F.col("q_twin").alias("p_twin"), F.col("q_alone").alias("p_alone"))
    kept = kept.dropDuplicates(["p_id", "p_twin"])
    mine = docs.withColumn("p_mine", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("p_hash", F.xxhash64("text"))
    got = mine.join(kept, (F.col("p_mine") == F.col("p_id")) & (F.col("p_hash") == F.col("p_twin")))
    bare = got.filter("p_alone")
    once = got.filter("not p_alone").dropDuplicates(["p_id", "p_twin"])
    return once.unionByName(bare).select(*(F.col(f"`{c}`") for c in docs.columns))
