"""Table detection: ruled grids from vector paths and borderless grids from aligned text.

Rulings, density gates, crossings, coverage, cell assignment, gutters and regions are relational operators of their own.
The end-to-end detectors gate pages relationally, so only candidate pages reach the per-page functions, in Arrow batches;
these do what depends on order: components, separators, merged cells, owners of spans.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import itemgetter
from statistics import median
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.pages import KEY
from quire.session import ship, spread

#: Tolerances and thresholds, in points and shares.
SNAP, JOIN, LEAST_RULING, LIMIT = 1.5, 2.0, 8.0, 512
OUTER, INNER, PRESENT = 0.9, 0.45, 0.5
BUCKET, GUTTER, EDGE_SPREAD, GAP_FLOOR, GAP_SHARE = 3.0, 0.7, 4.5, 3.0, 1.5
FILL, NEAR, REGULAR, TABULAR, LINE_OVERLAP = 0.4, 0.15, 0.6, 0.6, 0.35
#: About so many texts and rulings (whole pages) are unpacked at once in Python.
PIECE = 65536
TABLE = "doc_id {key}, page int, kind string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int, cells array<struct<row:int,col:int,row_span:int,col_span:int,content:string>>, consumed array<string>, warning string"


class Limits(NamedTuple):
    """Most rulings or free texts of a page, separators of a grid and buckets of a region that a detector looks at."""

    items: float = np.inf
    separators: float = np.inf
    buckets: float = np.inf


#: Detection has no limits, but Markdown prints no table beyond these, and warnings instead: they are the format's.
WHOLE, MARKDOWN = Limits(), Limits(LIMIT, 64, 4096)


def rulings(paths: DataFrame) -> DataFrame:
    """(axis h/v, position, low, high) of thin painted paths, and the four inset edges of stroked rectangles."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    stroke = F.abs(F.coalesce("stroke_width", F.lit(1.0)))
    thin = F.when(F.col("stroked"), G.clamp(stroke * 2.0, 1.5, 6.0)).otherwise(3.0)
    inset = F.least(stroke, w / 2.0, h / 2.0)
    line = lambda axis, at, a, b: F.struct(F.lit(axis).alias("axis"), at.alias("position"), a.alias("low"), b.alias("high"))
    x0, y0, x1, y1 = map(F.col, G.BOX)
    a, b, c, d = x0 + inset, y0 + inset, x1 - inset, y1 - inset
    got = (
        F.when((w >= LEAST_RULING) & (h <= thin), F.array(line("h", (y0 + y1) / 2.0, x0, x1)))
        .when((h >= LEAST_RULING) & (w <= thin), F.array(line("v", (x0 + x1) / 2.0, y0, y1)))
        .when(F.col("stroked") & (w >= LEAST_RULING) & (h >= LEAST_RULING), F.array(line("h", b, a, c), line("h", d, a, c), line("v", a, b, d), line("v", c, b, d)))
    )
    painted = (F.col("stroked") | F.col("filled")) & ~(F.col("stroked") & (stroke > 3.0)) & G.ordered_box()
    return paths.filter(painted).select(*KEY, "element", F.explode(got).alias("r")).select(*KEY, "element", "r.*")


def dense_pages(lines: DataFrame) -> DataFrame:
    """Pages with at least three rulings of each axis; ``dense`` where they are more than LIMIT."""
    got = lines.groupBy(*KEY).agg(F.count_if(F.col("axis") == "h").alias("h"), F.count_if(F.col("axis") == "v").alias("v"))
    return got.filter("h >= 3 and v >= 3").select(*KEY, "h", "v", (F.col("h") + F.col("v") > LIMIT).alias("dense"))


def crossings(lines: DataFrame) -> DataFrame:
    """Pairs of horizontal and vertical rulings of a page that meet within SNAP: a range join on the page key."""
    h = lines.filter("axis = 'h'").select(*KEY, F.col("position").alias("h_at"), F.col("low").alias("h_low"), F.col("high").alias("h_high"))
    v = lines.filter("axis = 'v'").select(*KEY, F.col("position").alias("v_at"), F.col("low").alias("v_low"), F.col("high").alias("v_high"))
    return h.join(v, KEY).filter(F.col("v_at").between(F.col("h_low") - SNAP, F.col("h_high") + SNAP) & F.col("h_at").between(F.col("v_low") - SNAP, F.col("v_high") + SNAP))


def interval_coverage(spans: DataFrame, by: list[str], low: str, high: str, start: str, end: str, join: float = JOIN) -> DataFrame:
    """Share of [start, end] that the union of spans covers; gaps of up to ``join`` are bridged.  Islands by a running maximum."""
    cut = spans.withColumn("a", F.greatest(low, start)).withColumn("b", F.least(high, end)).filter("b > a")
    order = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("a") > reach + F.lit(join), F.lit(True)).cast("int")
    island = cut.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    sums = island.groupBy(*by, start, end, "island").agg((F.max("b") - F.min("a")).alias("length"))
    return sums.groupBy(*by, start, end).agg(F.least(F.sum("length") / (F.col(end) - F.col(start)), F.lit(1.0)).alias("coverage"))


def assign_cells(texts: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """The first grid interval on either axis (edges within SNAP) that holds each text's centre: xs and ys have (i, low, high) by page.

    A page's intervals come to its texts as arrays, so no text is multiplied by them; they are never broadcast, because
    Spark's estimate knows nothing of how many there are.
    """
    held = lambda axis, name: axis.groupBy(*KEY).agg(F.collect_list(F.struct("i", "low", "high")).alias(name)).hint("merge")
    first = lambda name, at: F.array_min(F.transform(F.filter(name, lambda e: at.between(e["low"] - SNAP, e["high"] + SNAP)), lambda e: e["i"]))
    near = texts.join(held(xs, "xs"), KEY).join(held(ys, "ys"), KEY)
    near = near.select(*KEY, "element", first("xs", (F.col("x0") + F.col("x1")) / 2.0).alias("col"), first("ys", (F.col("y0") + F.col("y1")) / 2.0).alias("row"))
    return near.filter("col is not null and row is not null").groupBy(*KEY, "element", "col").agg(F.min("row").alias("row"))


def gutter_histogram(items: DataFrame, by: list[str]) -> DataFrame:
    """Lines that cover each bucket of BUCKET points from the region's left edge, gaps included as rows that are missing.

    A line's spans are merged first; then the lines that begin less those that end, summed along the buckets, give the
    count, so a span costs two rows however wide it is, and only constant stretches are written out as buckets.
    """
    left = items.withColumn("left", F.min("x0").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("x0") - F.col("left")) / BUCKET), F.floor((F.col("x1") - F.col("left")) / BUCKET)
    spans = left.select(*by, "line", F.greatest(low, F.lit(0)).alias("low"), high.alias("high")).filter("high >= low")
    order = Window.partitionBy(*by, "line").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("low") > reach + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    merged = spans.groupBy(*by, "line", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("step")), F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("step"))))
    steps = merged.select(*by, ends.alias("e")).groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy(*by).orderBy("at")
    runs = steps.withColumn("lines", F.sum("step").over(along)).withColumn("next", F.lead("at").over(along)).filter("lines > 0")
    return runs.select(*by, F.explode(F.sequence("at", F.col("next") - 1)).alias("bucket"), "lines")


def visual_regions(lines: DataFrame) -> DataFrame:
    """Lines with a region number: a gap of more than max(GAP_FLOOR, GAP_SHARE median height) starts one."""
    tall = lines.withColumn("height", F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)))
    limit = tall.groupBy(*KEY).agg(F.greatest(F.lit(GAP_FLOOR), F.median("height") * GAP_SHARE).alias("limit"))
    order = Window.partitionBy(*KEY).orderBy("line")
    fresh = (F.col("y0") - F.lag("y1").over(order) > F.col("limit")).cast("int")
    return tall.join(limit, KEY).withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("region", F.sum("fresh").over(order)).drop("fresh", "height", "limit")


def outside(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Texts whose centre is in none of the page's boxes (within SNAP): an anti join on a range."""
    b = boxes.select(*(F.col(c).alias(f"b_{c}") for c in (*KEY, *G.BOX)))
    inside = ((F.col("x0") + F.col("x1")) / 2.0).between(F.col("b_x0") - SNAP, F.col("b_x1") + SNAP) & ((F.col("y0") + F.col("y1")) / 2.0).between(F.col("b_y0") - SNAP, F.col("b_y1") + SNAP)
    return texts.join(b, (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page") == F.col("b_page")) & inside, "left_anti")


def clusters(values: list[float]) -> list[float]:
    """Medians of groups of values within SNAP of each group's first."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][0] <= SNAP:
            out[-1].append(v)
        else:
            out.append([v])
    return [median(g) for g in out]


def covered(spans: list[tuple[float, float]], start: float, end: float) -> float:
    """Share of an interval under the union of spans, gaps of up to JOIN bridged."""
    if end <= start:
        return 0.0
    total, first, reach = 0.0, None, 0.0
    for a, b in sorted((max(a, start), min(b, end)) for a, b in spans if min(b, end) > max(a, start)):
        if first is None:
            first, reach = a, b
        elif a > reach + JOIN:
            total += reach - first
            first, reach = a, b
        else:
            reach = max(reach, b)
    return 0.0 if first is None else min(max((total + reach - first) / (end - start), 0.0), 1.0)


#: Columns by name, of one page's texts or rulings.
Rows = dict[str, np.ndarray]


def _take(rows: Rows, at) -> Rows:
    return {c: x[at] for c, x in rows.items()}


#: (position, low, high) of a ruling; (x0, x1, element, y0, y1, content) of a text.
Ruling = tuple[float, float, float]
Text = tuple[float, float, str, float, float, str]


def component_labels(h: list[Ruling], v: list[Ruling]) -> tuple[list[int], list[int]]:
    """Components of the crossing graph: labels (least member's place) of the horizontal and of the vertical rulings.

    Each ruling of the smaller axis finds those it meets among the others by their order, so no pairs are held.
    """
    n_h, n_v = len(h), len(v)
    few, many, names, others = (h, v, np.arange(n_h), n_h + np.arange(n_v)) if n_h < n_v else (v, h, n_h + np.arange(n_v), np.arange(n_h))
    at, low, high = np.array(many, float).reshape(-1, 3).T
    order = np.argsort(at, kind="stable")
    at, low, high = at[order], low[order] - SNAP, high[order] + SNAP
    place, begin, end = np.array(few, float).reshape(-1, 3).T
    begin, end = np.searchsorted(at, begin - SNAP, "left"), np.searchsorted(at, end + SNAP, "right")
    up, owner = list(range(len(names))), np.full(len(at), -1)

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for j, (p, a, b) in enumerate(zip(place.tolist(), begin.tolist(), end.tolist(), strict=True)):
        met = a + np.flatnonzero((low[a:b] <= p) & (p <= high[a:b]))
        for k in set(owner[met].tolist()) - {-1}:
            up[root(k)] = j
        owner[met] = j
    roots = np.array([root(k) for k in range(len(up))], int)
    held, least = owner >= 0, np.full(len(names), n_h + n_v)
    np.minimum.at(least, roots, names)
    np.minimum.at(least, roots[owner[held]], others[order][held])
    out = others.copy()
    out[order[held]] = least[roots[owner[held]]]
    mine, theirs = least[roots].tolist(), out.tolist()
    return (mine, theirs) if few is h else (theirs, mine)


def _along(lines: list[Ruling], edges: list[float]) -> list[list[tuple[float, float]]]:
    """Extents of the rulings within SNAP of each edge."""
    out: list[list[tuple[float, float]]] = [[] for _ in edges]
    for p, low, high in lines:
        n = bisect_left(edges, p - 2.0 * SNAP)
        while n < len(edges) and edges[n] <= p + 2.0 * SNAP:
            if abs(p - edges[n]) <= SNAP:
                out[n].append((low, high))
            n += 1
    return out


def _bands(spans: list[tuple[float, float]], edges: list[float]) -> list[float]:
    """``covered`` of each interval between edges; of the spans, those within others are left out, as they add nothing."""
    kept: list[tuple[float, float]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or b > kept[-1][1]:
            kept.append((a, b))
    starts, ends = [a for a, _ in kept], [b for _, b in kept]
    return [covered(kept[bisect_right(ends, a) : bisect_left(starts, b)], a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _centres(texts: Rows) -> Rows:
    """Places and centres of texts, from top to bottom."""
    x, y = (texts["x0"] + texts["x1"]) / 2.0, (texts["y0"] + texts["y1"]) / 2.0
    order = np.argsort(y, kind="stable")
    return {"n": order, "x": x[order], "y": y[order]}


def _within(centres: Rows, x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, float, float]]:
    """Places and centres of texts in a box (within SNAP), in the order of the texts."""
    near = _take(centres, slice(np.searchsorted(centres["y"], y0 - SNAP, "left"), np.searchsorted(centres["y"], y1 + SNAP, "right")))
    near = _take(near, (near["x"] >= x0 - SNAP) & (near["x"] <= x1 + SNAP))
    return sorted(zip(*(near[c].tolist() for c in ("n", "x", "y")), strict=True))


def _clean(s: str) -> str:
    return " ".join(s.split())


def grid_table(h: list[Ruling], v: list[Ruling], texts: list[Text], centres: Rows, limits: Limits) -> tuple[dict | None, str | None]:
    """The table of one component of rulings, or why there is none."""
    xs, ys = (clusters([r[0] for r in x]) for x in (v, h))
    if len(xs) < 3 or len(ys) < 3:
        return None, None
    if max(len(xs), len(ys)) > limits.separators:
        return None, "too many row or column separators"

    at_y, at_x = _along(h, ys), _along(v, xs)
    across = [covered(spans, xs[0], xs[-1]) for spans in at_y]
    down = [covered(spans, ys[0], ys[-1]) for spans in at_x]
    if min(across[0], across[-1], down[0], down[-1]) < OUTER or min(across + down) < INNER:
        return None, "rulings do not form a closed grid"
    rows, cols = len(ys) - 1, len(xs) - 1
    held: dict[tuple[int, int], list[int]] = {}
    bottoms, rights = [y + SNAP for y in ys[1:]], [x + SNAP for x in xs[1:]]
    for n, x, y in _within(centres, xs[0], ys[0], xs[-1], ys[-1]):
        held.setdefault((bisect_left(bottoms, y), bisect_left(rights, x)), []).append(n)
    if len(held) < max(4, -(-rows * cols // 3)) or len({r for r, _ in held}) < 2 or len({c for _, c in held}) < 2:
        return None, "grid has too little cell text"
    walls = [[share >= PRESENT for share in _bands(spans, ys)] for spans in at_x]
    floors = [[share >= PRESENT for share in _bands(spans, xs)] for spans in at_y]
    taken, cells, used = [bytearray(cols) for _ in range(rows)], [], []
    for r in range(rows):
        for c in range(cols):
            if taken[r][c]:
                continue
            right = next((k for k in range(c + 1, cols) if walls[k][r]), cols)
            below = next((k for k in range(r + 1, rows) if any(floors[k][c:right])), rows)
            for rr in range(r, below):
                taken[rr][c:right] = b"\1" * (right - c)
            got = sorted((texts[n] for rr in range(r, below) for cc in range(c, right) for n in held.pop((rr, cc), ())), key=itemgetter(3, 0, 4, 2))
            used += [x[2] for x in got]
            cells.append({"row": r, "col": c, "row_span": below - r, "col_span": right - c, "content": "\n".join(x for x in (_clean(x[5]) for x in got) if x)})
    return {"x0": xs[0], "y0": ys[0], "x1": xs[-1], "y1": ys[-1], "n_rows": rows, "n_cols": cols, "cells": cells, "consumed": sorted(set(used))}, None


def _ruled(lines: Rows, texts: list[Text], centres: Rows, limits: Limits) -> list[dict]:
    """The ruled tables of a page, and why others are none."""
    every = sorted(zip(*(lines[c].tolist() for c in ("axis", "position", "low", "high")), strict=True))
    h, v = ([r[1:] for r in every if r[0] == axis] for axis in "hv")
    parts: dict[int, tuple[list[Ruling], list[Ruling]]] = {}
    for side, (rulings_of, labels) in enumerate(zip((h, v), component_labels(h, v), strict=True)):
        for ruling, label in zip(rulings_of, labels, strict=True):
            parts.setdefault(label, ([], []))[side].append(ruling)
    out = []
    for _, (across, down) in sorted(parts.items(), key=itemgetter(0)):
        table, why = grid_table(across, down, texts, centres, limits)
        if table or why:
            out.append({"kind": "ruled"} | (table or {}) | {"warning": why})
    return out


def visual_lines(texts: list[Text]) -> list[list[Text]]:
    """Texts in (y0, x0, id) order, dealt into lines: one joins the last line if it overlaps its running extent enough."""
    lines: list[list[Text]] = []
    low = high = 0.0
    for text in texts:
        y0, y1 = text[3], text[4]
        shared = max(0.0, min(high, y1) - max(low, y0))
        if lines and shared > LINE_OVERLAP * max(1.0, min(high - low, y1 - y0)):
            lines[-1].append(text)
            low, high = min(low, y0), max(high, y1)
        else:
            lines.append([text])
            low, high = y0, y1
    return [sorted(x, key=itemgetter(0, 1, 2)) for x in lines]


def _box(lines: list[list[Text]]) -> dict[str, float]:
    return {c: end(x[n] for line in lines for x in line) for c, n, end in (("x0", 0, min), ("y0", 3, min), ("x1", 1, max), ("y1", 4, max))}


def gutter_columns(lines: list[list[Text]], left: float, right: float, limits: Limits) -> list[tuple[float, float]]:
    """Column intervals between the gutters of a region: as in ``gutter_histogram``, only the ends of a line's runs of buckets count."""
    if not 0.0 < right - left < np.inf:
        return []
    n = int(np.ceil((right - left) / BUCKET)) + 1
    if n > limits.buckets:
        return []
    steps: dict[int, int] = {}
    for line in lines:
        reach = 0
        for x0, x1, *_ in line:
            low, high = max(reach, int((x0 - left) // BUCKET)), min(n - 1, int((x1 - left) // BUCKET)) + 1
            if high > low:
                steps[low], steps[high] = steps.get(low, 0) + 1, steps.get(high, 0) - 1
                reach = high
    out, hits, begin, most = [], 0, None, int(np.floor((1.0 - GUTTER) * len(lines)))
    for at, step in sorted(steps.items()):
        hits += step
        inside = hits > most
        if inside and begin is None:
            begin = at
        elif begin is not None and not inside:
            out.append((left + begin * BUCKET, left + at * BUCKET))
            begin = None
    return out


def aligned_table(lines: list[list[Text]], limits: Limits) -> tuple[dict | None, str | None]:
    """The borderless table of one region of visual lines, or why there is none."""
    box = _box(lines)
    columns = gutter_columns(lines, box["x0"], box["x1"], limits)
    rows, cols = len(lines), len(columns)
    if not 2 <= cols <= limits.separators:
        return None, None
    low, high = [a - SNAP for a, _ in columns], [b + SNAP for _, b in columns]
    spans = [[(bisect_right(high, x[0]), bisect_left(low, x[1]) - 1) for x in line] for line in lines]
    alone: dict[int, list[tuple[float, float]]] = {}
    for line, at in zip(lines, spans, strict=True):
        for x, (a, b) in zip(line, at, strict=True):
            if a == b:
                alone.setdefault(a, []).append(x[:2])
    for edges in alone.values():  # within EDGE_SPREAD, edges can't deviate by it
        if min(max(x) - min(x) for x in zip(*edges, strict=True)) > EDGE_SPREAD and (np.array(edges).std(axis=0) > EDGE_SPREAD).all():
            return None, None
    filled, cells, used, regular = 0, [], [], 0
    for r, (line, at) in enumerate(zip(lines, spans, strict=True)):
        owner, held, full = list(range(cols)), {}, bytearray(cols)
        for x, (a, b) in zip(line, at, strict=True):
            if a > b:
                continue
            anchor = owner[a]
            cell = held.setdefault(anchor, [1, []])
            cell[0] = max(cell[0], b - anchor + 1)
            cell[1].append(x)
            owner[anchor : b + 1] = [anchor] * (b + 1 - anchor)
        regular += len(held) >= 2
        for c, (width, items) in sorted(held.items()):
            full[c : c + width] = b"\1" * width
            got = sorted(items, key=itemgetter(0, 2))
            used += [x[2] for x in got]
            cells.append({"row": r, "col": c, "row_span": 1, "col_span": width, "content": " ".join(x for x in (_clean(x[5]) for x in got) if x)})
        filled += sum(full)
    if regular < REGULAR * rows:
        return None, None
    if filled / (rows * cols) < FILL:
        return None, "too few cells were filled to trust the borderless grid" if filled / (rows * cols) >= FILL - NEAR else None
    said = [x for x in cells if x["content"]]
    if not said or sum(len(x["content"].split()) <= 3 and len(x["content"]) <= 24 for x in said) < TABULAR * len(said):
        return None, None
    first = [x for x in said if x["col"] == 0]
    if cols == 2 and first and 2 * sum(x["content"].endswith(":") for x in first) >= len(first):
        return None, None
    return box | {"n_rows": rows, "n_cols": cols, "cells": cells, "consumed": sorted(set(used))}, None


def _aligned(texts: list[Text], ruled: list[dict], limits: Limits) -> list[dict]:
    """The borderless tables of a page's free texts that meet no ruled one, and why others are none."""
    out = []
    x0, y0, x1, y1 = np.array([[r[c] for c in G.BOX] for r in ruled], float).reshape(-1, 4).T
    lines = visual_lines(sorted(texts, key=itemgetter(3, 0, 2)))
    if len(lines) >= 3:
        low, high = [min(x[3] for x in line) for line in lines], [max(x[4] for x in line) for line in lines]
        limit = max(GAP_FLOOR, GAP_SHARE * median(max(b - a, 1.0) for a, b in zip(low, high, strict=True)))
        breaks = [0, *(n for n in range(1, len(lines)) if low[n] - high[n - 1] > limit), len(lines)]
        for a, b in zip(breaks, breaks[1:], strict=False):
            if b - a >= 3:
                table, why = aligned_table(lines[a:b], limits)
                if table and ((table["x1"] > x0) & (table["x0"] < x1) & (table["y1"] > y0) & (table["y0"] < y1)).any():
                    continue
                if table or why:
                    out.append({"kind": "aligned"} | (table or {}) | {"warning": why})
    return out


def page_tables(texts: Rows, lines: Rows, dense: bool = False, limits: Limits = WHOLE) -> list[dict]:
    """All of one page: ruled tables, then borderless ones of the texts outside them; none is ruled on a ``dense`` page, which only limits make so."""
    every = list(zip(*(texts[c].tolist() for c in ("x0", "x1", "element", "y0", "y1", "content")), strict=True))
    centres = _centres(texts)
    ruled = [{"kind": "ruled", "warning": "path density exceeded the detector limit"}] if dense else _ruled(lines, every, centres, limits) if len(lines["axis"]) else []
    found = [r for r in ruled if r["warning"] is None]
    used = {e for r in found for e in r["consumed"]}
    inside = {n for r in found for n, _, _ in _within(centres, *(r[c] for c in G.BOX))}
    free = [x for n, x in enumerate(every) if n not in inside and x[2] not in used]
    return ruled + (_aligned(free, found, limits) if 6 <= len(free) <= limits.items else [])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut between pages, at about PIECE texts and rulings."""
    items = sum(batch.column(c).value_lengths().fill_null(0).to_numpy().astype(np.int64) for c in ("texts", "lines"))
    starts = np.flatnonzero(np.diff(np.cumsum(items) // PIECE, prepend=-1)).tolist() if len(items) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=False):
        yield batch.slice(a, b - a)


def _unpacked(items: pa.ListArray) -> Iterator[Rows]:
    """The structs of each list, as columns."""
    flat = items.flatten()
    columns = {f.name: flat.field(n).to_numpy(zero_copy_only=False) for n, f in enumerate(flat.type)}
    sizes = items.value_lengths().fill_null(0).to_numpy()
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        yield _take(columns, slice(a, b))


def detect(texts: DataFrame, paths: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Ruled tables, then borderless ones of the texts outside them; rows with only a warning where a candidate was not trusted.

    ``texts``: doc_id, page, element, content, x0..y1; ``paths``: doc_id, page, element, x0..y1, stroked, filled, stroke_width.
    Texts and rulings come to their page as arrays, each read once; pages that can't have a table stay outside Python.
    """
    ship(texts.sparkSession)
    schema = TABLE.format(key=texts.schema["doc_id"].dataType.simpleString())
    names = ["element", "content", *G.BOX]
    text = texts.filter((T.clean_text("content") != "") & G.ordered_box()).groupBy(*KEY).agg(F.collect_list(F.struct(*names)).alias("texts"))
    of = rulings(paths).groupBy(*KEY).agg(F.count_if(F.col("axis") == "h").alias("h"), F.count_if(F.col("axis") == "v").alias("v"), F.collect_list(F.struct("axis", "position", "low", "high")).alias("lines"))
    dense = F.col("h") + F.col("v") > F.lit(limits.items)
    ruled = of.filter("h >= 3 and v >= 3").select(*KEY, dense.alias("dense"), F.when(~dense, F.col("lines")).alias("lines"))
    pages = text.join(ruled, KEY, "full").withColumn("dense", F.coalesce("dense", F.lit(False)))
    pages = pages.filter(F.col("dense") | F.col("lines").isNotNull() | F.size("texts").between(F.lit(6), F.lit(limits.items))).select(*KEY, "dense", "texts", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.operators.tables import _pieces, _unpacked, page_tables

        cell = pa.struct([(c, pa.int32()) for c in ("row", "col", "row_span", "col_span")] + [("content", pa.string())])
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            kinds = [("doc_id", batch.schema.field("doc_id").type), ("page", pa.int32()), ("kind", pa.string()), *((c, pa.float64()) for c in G.BOX), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("cells", pa.list_(cell)), ("consumed", pa.list_(pa.string())), ("warning", pa.string())]
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEY, "dense")), _unpacked(batch.column("texts")), _unpacked(batch.column("lines")), strict=True)
            out = [{"doc_id": d, "page": p} | x for d, p, thick, t, r in keys for x in page_tables(t, r, thick, limits)]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return spread(pages).mapInArrow(run, schema)
