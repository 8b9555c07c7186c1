"""Markdown of whole paged documents from normalised tables: tables, roles, links, columns, rows, headings, paragraphs.

Body size, columns, links and table detection are relational (``layout``, ``tables``).  What remains per page depends on
order within the page: rows that grow as blocks join them, styled segments, and paragraph breaks between what is printed.

Records hold their documents whole, so ``of_records`` prints them where they are, without a join or a shuffle; its steps
have the names of the relational ones that they equal.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import layout, pages, tables
from quire.operators.pages import KEY
from quire.session import cut, ship, spread
from quire.sources import records

_WS = re.compile("[" + T.WS[1:-1] + "]+")
_MARKER = re.compile(rf"[{T.WS[1:-1]}]*([^{T.WS[1:-1]}]+)([{T.WS[1:-1]}]+)(?=[{T.WS[1:-1]}]*[^{T.WS[1:-1]}])")
_ITEM = re.compile(r"\(?([A-Za-z]|[0-9]{1,3})[.)]")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_BREAKS = re.compile(f"{T.WS}*{T.BREAK}{T.WS}*")
_ROLE = re.compile(r"h\+?0*([1-9])(?:\r\n|[\n\r\x85\u2028\u2029])?")
_SPACE = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _middle(values: list[float]) -> float:
    """The median."""
    values, n = sorted(values), len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2.0


def size_clusters(sizes: list[float], body: float) -> list[float]:
    """As ``layout.size_clusters``, of one page: medians of clusters of distinct sizes, largest first."""
    out: list[list[float]] = []
    for s in sorted(set(sizes), reverse=True):
        if out and abs(s - _middle(out[-1])) <= max(0.4, body * 0.04):
            out[-1].append(s)
        else:
            out.append([s])
    return [_middle(c) for c in out]


def _gap(space: str) -> int:
    """0 no white space, 1 white space, 2 with a line break."""
    return 2 if re.search(T.BREAK, space) else 1 if space else 0


def escape(text: str) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return _CONTROL.sub(" ", re.sub(r"([\\*_\[\]`|#!])", r"\\\1", text))


def link_allowed(href: str) -> bool:
    m = re.match(r"([^:/?#]*):", _CONTROL.sub("", _WS.sub("", href)))
    return not m or m[1].lower() in T.SCHEMES


def link_target(href: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\\()<>]", lambda m: f"%{ord(m[0]):02X}", href)


def inline(segments: list[dict], plain: bool = False) -> str:
    """Segments (text, bold, italic, href) as Markdown; white space moves out of the marks; ``plain`` leaves out bold."""
    out, pending = "", 0
    for s in segments:
        body = s["text"].strip(_SPACE)
        at = s["text"].find(body) if body else len(s["text"])
        pending = max(pending, _gap(s["text"][:at]))
        if body:
            out += ("", " ", "<br>\n")[pending] if out else ""
            text = escape(_WS.sub(lambda m: "\x00" if _gap(m[0]) == 2 else " ", body).replace("\x00", "")).replace("", "<br>\n")
            mark = ("**" if s["bold"] and not plain else "") + ("*" if s["italic"] else "")
            text = mark + text + mark
            if s["href"] is not None and link_allowed(s["href"]):
                text = f"[{text}]({link_target(s['href'])})"
            out += text
            pending = _gap(s["text"][at + len(body) :])
    return out


def list_item(text: str) -> tuple[str, int] | None:
    """The printed marker and where the item's text starts."""
    if not (m := _MARKER.match(text)):
        return None
    marker = m[1]
    if len(marker) == 1 and marker in T.BULLETS:
        return "-", m.end()
    if not (core := _ITEM.fullmatch(marker)):
        return None
    return (f"{int(core[1])}." if core[1].isdigit() else f"- {marker}"), m.end()


def segments_of(content: str, bold: bool, italic: bool, runs: list | None) -> list[dict]:
    """A text's styled segments: its runs where they occur in turn, the text between them in its own style."""
    own = lambda text: {"text": text, "bold": bool(bold), "italic": bool(italic), "href": None}
    if runs is None or not len(runs):
        return [own(content)]
    out, at = [], 0
    for r in runs:
        if (start := content.find(r["content"], at)) >= 0:
            out += [own(content[at:start])] if start > at else []
            at = start + len(r["content"])
        out.append({"text": r["content"], "bold": bool(r["bold"]), "italic": bool(r["italic"]), "href": r["href"]})
    return out + ([own(content[at:])] if at < len(content) else [])


def _after(segments: list[dict], skip: int) -> list[dict]:
    out = []
    for s in segments:
        if skip >= len(s["text"]):
            skip -= len(s["text"])
        else:
            out.append(s | {"text": s["text"][skip:]})
            skip = 0
    return out


def _rows(blocks: list[dict]) -> list[dict]:
    """Blocks of a column merged into visual rows."""
    blocks = sorted(blocks, key=lambda b: (b["column"], b["y0"], b["x0"], b["element"]))
    rows: list[list[dict]] = []
    for b in blocks:
        best = None
        for n, row in enumerate(rows):
            if b["rendered"] is None and row[0]["rendered"] is None and row[0]["column"] == b["column"]:
                shared = max(max(0.0, min(r["y1"], b["y1"]) - max(r["y0"], b["y0"])) for r in row)
                if shared > layout.ROW_SHARE * min(max(r["y1"] - r["y0"] for r in row), b["y1"] - b["y0"]):
                    away = abs(_middle([r["y0"] for r in row]) - b["y0"])
                    best = (away, n) if best is None or away < best[0] else best
        if best:
            rows[best[1]].append(b)
        else:
            rows.append([b])
    return [_merged(row) for row in rows]


def _merged(row: list[dict]) -> dict:
    if len(row) == 1:
        return row[0]
    row = sorted(row, key=lambda b: (b["x0"], b["x1"], b["element"]))
    content, segments = "", []
    for n, b in enumerate(row):
        if n and b["x0"] - row[n - 1]["x1"] > max(1.0, b["size"] * 0.12):
            content += " "
            segments.append({"text": " ", "bold": False, "italic": False, "href": None})
        content += b["content"]
        segments += b["segments"]
    levels = [b["level"] for b in row if b["level"]]
    return row[0] | {
        "element": min(b["element"] for b in row), "content": content, "segments": segments, "size": max(b["size"] for b in row), "bold": all(b["bold"] for b in row), "level": min(levels, default=None),
        "x0": min(b["x0"] for b in row), "y0": min(b["y0"] for b in row), "x1": max(b["x1"] for b in row), "y1": max(b["y1"] for b in row),
    }


def _heading(b: dict, body: float) -> bool:
    words = b["content"].split()
    large = b["size"] >= max(body + 1.0, body * 1.12)
    return b["rendered"] is None and (large or (b["bold"] and b["size"] >= body * 0.98 and 0 < len(words) <= 12 and len(" ".join(words)) <= 100))


def render(blocks: list[dict], body: float) -> str:
    """Markdown of one page's blocks, which have their columns."""
    blocks = _rows(blocks)
    free = [b for b in blocks if not b["level"] and _heading(b, body)]
    ranks = size_clusters([b["size"] for b in free], body)
    for b in free:
        level = min(min(range(len(ranks)), key=lambda n: abs(ranks[n] - b["size"])) + 1, 4)
        b["level"] = level - 1 if b["bold"] and level > 1 else level
    out, last = [], None
    for b in sorted(blocks, key=lambda b: (b["column"], b["y0"], b["x0"], b["y1"], b["element"])):
        item = None if b["rendered"] is not None else list_item(b["content"])
        if b["rendered"] is not None:
            line = b["rendered"]
        elif item:
            line = f"{item[0]} {inline(_after(b['segments'], item[1]))}"
        elif b["level"]:
            line = f"{'#' * min(b['level'], 6)} {inline(b['segments'], True)}"
        else:
            line = inline(b["segments"])
        if not line:
            continue
        alone = b["rendered"] is not None or b["level"] or item
        near = last is not None and not alone and not last[1] and b["y0"] - last[0]["y1"] <= max(4.0, body * 0.65) and abs(b["x0"] - last[0]["x0"]) <= max(18.0, body * 1.8)
        if near:
            out[-1] += " " + line
        else:
            out.append(line)
        last = b, alone
    return "\n\n".join(out)


def _page(blocks: list[dict], body: float) -> str:
    """Markdown of one page's blocks, which have their columns, runs and links."""
    for b in blocks:
        b["segments"] = [] if b["rendered"] is not None else segments_of(b["content"], b["own_bold"], b["italic"], b["runs"])
        for s in b["segments"]:
            if s["href"] is None and b["link"] is not None and s["text"].split():
                s["href"] = b["link"]
    return render(blocks, body)


#: What detectors say of candidates that they don't trust.
SKIPPED = {"ruled": "ruled-table candidate skipped", "aligned": "borderless-table candidate skipped"}
TOO_DENSE = "ruled-table candidate skipped because path density exceeded the Markdown detector limit"


def detector_warnings(found: DataFrame) -> DataFrame:
    """(doc_id, page, ord, message) of the detector's warning rows: ruled before borderless, those of one page by reason."""
    said = F.when(F.col("kind") == "ruled", SKIPPED["ruled"]).otherwise(SKIPPED["aligned"])
    why = F.when(F.col("warning").startswith("path density"), TOO_DENSE).otherwise(F.concat(said, F.lit(": "), F.col("warning")))
    message = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), why)
    order = layout.Window.partitionBy("doc_id").orderBy("page", F.col("kind") != "ruled", "warning")
    return found.filter("warning is not null").select("doc_id", "page", F.row_number().over(order).alias("ord"), message.alias("message"))


def with_context(printed: DataFrame, context: DataFrame) -> DataFrame:
    """Documents of Markdown (each with its final line feed) with the context after the pages; a document may have either alone."""
    both = printed.join(context, "doc_id", "full")
    return both.select("doc_id", F.concat(F.concat_ws("\n\n", F.regexp_replace("markdown", r"\n\z", ""), "context"), F.lit("\n")).alias("markdown"))


def classes(t: dict[str, DataFrame]) -> DataFrame:
    """Page classes of documents in the tables of ``records.tables``."""
    return pages.classify(pages.signals(t["pages"], t["boxes"], t["glyphs"]), records.garbled_warnings(t["warnings"]))


def markdown(t: dict[str, DataFrame], tag: str | None = None) -> DataFrame:
    """(doc_id, markdown) of documents in the tables of ``records.tables``.

    Detected tables of PDF pages take the place of their texts: HTML with merged cells, else pipes.  With
    ``tag``, the record's warnings, the detectors' and then hidden items, as comments that begin with it, follow the pages.
    """
    ship(t["texts"].sparkSession)
    pdf = t["pages"].filter("format = 'pdf'").select(*KEY)
    texts = t["texts"].filter(T.clean_text("content") != "")
    found = tables.detect(texts.join(pdf, KEY, "left_semi"), t["paths"].join(pdf, KEY, "left_semi"), tables.MARKDOWN)
    order = F.row_number().over(layout.Window.partitionBy(*KEY, F.col("warning").isNull()).orderBy("y0", "x0", "y1", "x1")) - 1
    found = found.withColumn("element", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-table-"), order.cast("string")))
    every = cut(found)  # read five times below
    found = every.filter("warning is null")
    cells = found.select(*KEY, "element", F.explode("cells").alias("c")).select(*KEY, "element", "c.*")
    by = [*KEY, "element"]
    merged = cells.groupBy(*by).agg((F.max(F.greatest("row_span", "col_span")) > 1).alias("spans"))
    drawn = merged.join(layout.html_table(cells, by).withColumnRenamed("table", "html"), by).join(layout.gfm_table(cells, by).withColumnRenamed("table", "pipes"), by).select(*by, F.when(F.col("spans"), F.col("html")).otherwise(F.col("pipes")).alias("rendered"))
    boxes = found.select(*by, *G.BOX).join(drawn, by)
    used = found.select(*KEY, F.explode("consumed").alias("element"))
    runs = t["runs"].groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "content", "bold", "italic", "href"))), lambda r: r.dropFields("run")).alias("runs"))
    role = t["hidden"].filter("kind = 'role'").select(*KEY, "element", F.coalesce(F.when(F.col("content").isin("title", "ctrTitle"), 1).when(F.col("content") == "subTitle", 2), T.heading_role("content")).alias("level")).filter("level is not null").groupBy(*by).agg(F.min("level").alias("level"))
    text = texts.join(used, by, "left_anti").join(runs, by, "left").join(role, by, "left")
    visible = F.filter("runs", lambda r: T.clean_text(r["content"]) != "")
    bold = F.when(F.size(visible) > 0, F.forall(visible, lambda r: r["bold"])).otherwise(F.col("bold"))
    block = text.select(*by, "content", *G.BOX, F.coalesce("size", F.lit(0.0)).alias("size"), bold.alias("bold"), F.col("bold").alias("own_bold"), F.coalesce("italic", F.lit(False)).alias("italic"), "runs", "level", F.lit(None).cast("string").alias("rendered"))
    block = cut(block)
    grid = boxes.select(*by, F.lit("").alias("content"), *G.BOX, F.lit(0.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("own_bold"), F.lit(False).alias("italic"), F.lit(None).cast(block.schema["runs"].dataType).alias("runs"), F.lit(None).cast("int").alias("level"), "rendered")
    links = layout.nearest_block(t["annotations"].filter("uri is not null"), block.unionByName(grid))
    hrefs = links.join(t["annotations"].select(*KEY, F.col("element").alias("annotation"), "uri", "place"), [*KEY, "annotation"]).groupBy(*by).agg(F.min_by("uri", "place").alias("link"))
    body = layout.body_size(block)
    columns = layout.columns(block, t["pages"])
    placed = layout.assign_columns(block.unionByName(grid), columns).join(hrefs, by, "left").join(body, "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(layout.BODY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            printed = [_page(blocks, body) for blocks, body in zip(batch.column("blocks").to_pylist(), batch.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array(printed, pa.string())], names=[*KEY, "markdown"])

    kind = t["pages"].schema["doc_id"].dataType.simpleString()
    rest = [c for c in placed.columns if c not in (*KEY, "body")]
    whole = placed.groupBy(*KEY).agg(F.first("body").alias("body"), F.collect_list(F.struct(*rest)).alias("blocks"))
    printed = layout.document_markdown(spread(whole).mapInArrow(run, f"doc_id {kind}, page int, markdown string"))
    if tag is None:
        return printed
    late = detector_warnings(every).select("doc_id", F.struct(F.lit(1).alias("late"), "ord").alias("ord"), "message")
    said = t["warnings"].select("doc_id", F.struct(F.lit(0).alias("late"), F.col("ord").cast("int").alias("ord")).alias("ord"), "message")
    return with_context(printed, layout.trailing_context(said.unionByName(late), t["hidden"], tag))


def _clean(s: str) -> str:
    return _WS.sub(" ", s).strip(_SPACE)


def _inner(s: str) -> str:
    """As ``text.inner_whitespace``, line breaks as private characters."""
    return _WS.sub(" ", _BREAKS.sub("\x00", s.strip(_SPACE))).replace("\x00", "\ue000")


def _gfm_table(cells: list[dict]) -> str:
    rows, cols = max(c["row"] for c in cells) + 1, max(c["col"] for c in cells) + 1
    said = {(c["row"], c["col"]): escape(_inner(c["content"])).replace("\ue000", "<br>") for c in cells}
    lines = ["| " + " | ".join(said.get((r, c), "") for c in range(cols)) + " |" for r in range(rows)]
    return "\n".join([lines[0] + "\n|" + " --- |" * cols, *lines[1:]])


def _html_table(cells: list[dict]) -> str:
    rows, cols = max(c["row"] for c in cells) + 1, max(c["col"] for c in cells) + 1
    under = {(r, k) for c in cells for r in range(c["row"], c["row"] + max(c["row_span"], 1)) for k in range(c["col"], c["col"] + max(c["col_span"], 1)) if (r, k) != (c["row"], c["col"])}
    held = {(c["row"], c["col"]): c for c in cells}
    lines = []
    for r in range(rows):
        line, tag = "<tr>\n", "td" if r else "th"
        for k in range(cols):
            if (r, k) in under:
                continue
            c = held.get((r, k))
            across, down = (min(c["col_span"], cols - k), min(c["row_span"], rows - r)) if c else (1, 1)
            body = _inner(c["content"]).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if c else ""
            spans = (f' colspan="{across}"' if across > 1 else "") + (f' rowspan="{down}"' if down > 1 else "")
            line += f"<{tag}{spans}>{_CONTROL.sub(' ', body)}</{tag}>\n".replace("\ue000", "<br>")
        lines.append(line + "</tr>\n")
    rest = "<tbody>\n" + "".join(lines[1:]) + "</tbody>\n" if rows > 1 else ""
    return f"<table>\n<thead>\n{lines[0]}</thead>\n{rest}</table>"


def _rulings(paths: list[dict]) -> list[tuple[str, float, float, float]]:
    """As ``tables.rulings``, of one page."""
    out = []
    for e in paths:
        x0, y0, x1, y1 = (e[c] for c in G.BOX)
        stroke, stroked = abs(1.0 if e["stroke_width"] is None else e["stroke_width"]), e["stroked"]
        if not (stroked or e["filled"]) or (stroked and stroke > 3.0) or not _ordered(e):
            continue
        w, h = x1 - x0, y1 - y0
        thin = min(max(stroke * 2.0, 1.5), 6.0) if stroked else 3.0
        if w >= tables.LEAST_RULING and h <= thin:
            out.append(("h", (y0 + y1) / 2.0, x0, x1))
        elif h >= tables.LEAST_RULING and w <= thin:
            out.append(("v", (x0 + x1) / 2.0, y0, y1))
        elif stroked and w >= tables.LEAST_RULING and h >= tables.LEAST_RULING:
            inset = min(stroke, w / 2.0, h / 2.0)
            a, b, c, d = x0 + inset, y0 + inset, x1 - inset, y1 - inset
            out += [("h", b, a, c), ("h", d, a, c), ("v", a, b, d), ("v", c, b, d)]
    return out


def _ordered(e: dict) -> bool:
    """As ``geometry.ordered_box``."""
    edges = [e[c] for c in G.BOX]
    return all(v is not None and math.isfinite(v) for v in edges) and edges[2] >= edges[0] and edges[3] >= edges[1]


def _detect(texts: list[dict], paths: list[dict]) -> list[dict]:
    """As ``tables.detect`` with Markdown's limits, of one page."""
    lines, texts = _rulings(paths), [e for e in texts if _ordered(e)]
    across = sum(r[0] == "h" for r in lines)
    ruled = across >= 3 and len(lines) - across >= 3
    dense = ruled and len(lines) > tables.MARKDOWN.items
    if not ruled and not 6 <= len(texts) <= tables.MARKDOWN.items:
        return []
    lines = lines if ruled and not dense else []
    rows = {c: np.array([e[c] for e in texts], object if c in ("element", "content") else float) for c in ("element", "content", *G.BOX)}
    held = {c: np.array([r[n] for r in lines], float if n else object) for n, c in enumerate(("axis", "position", "low", "high"))}
    return tables.page_tables(rows, held, dense, tables.MARKDOWN)


def _body_size(blocks: list[dict]) -> float:
    """As ``layout.body_size``, of one document."""
    sized = sorted((b["size"], min(max(len(b["clean"]) // 8, 1), 12)) for b in blocks if 0 < b["size"] < math.inf)
    total, at = sum(n for _, n in sized), 0
    if not total:
        return layout.BODY
    middle = []
    for size, n in sized:
        middle += [size for place in {(total - 1) // 2, total // 2} if at <= place < at + n]
        at += n
    return sum(middle) / len(middle)


def _columns(blocks: list[dict], width: float | None) -> list[tuple[float, float]]:
    """As ``layout.columns``, of one page: left and right edges."""
    if width is None:
        return []
    anchors = [b for b in blocks if len(b["clean"]) >= layout.ANCHOR_CHARACTERS or b["x1"] - b["x0"] >= width * layout.ANCHOR_WIDTH]
    if len(anchors) < layout.ANCHORS:
        return []
    cw = max(b["x1"] for b in anchors) - min(b["x0"] for b in anchors)
    ch = max(b["y1"] for b in anchors) - min(b["y0"] for b in anchors)
    narrow = sorted((b["x0"], b["x1"], b["element"], b["y0"], b["y1"]) for b in anchors if max(b["x1"] - b["x0"], 0.0) <= cw * layout.SPAN_LIMIT)
    if cw <= 0 or ch <= 0 or len(narrow) < layout.ANCHORS:
        return []
    islands: list[list] = []
    reach = -math.inf
    for b in narrow:
        if not islands or b[0] > reach + max(width * layout.GUTTER_SHARE, layout.GUTTER_LEAST):
            islands.append([])
        islands[-1].append(b)
        reach = max(reach, b[1])
    good = []
    for island in islands:
        left, right = min(b[0] for b in island), max(b[1] for b in island)
        tall = max(b[4] for b in island) - min(b[3] for b in island)
        if len(island) >= max(3, len(narrow) // 8) and right - left >= width * layout.COLUMN_WIDTH and tall >= ch * layout.COLUMN_HEIGHT:
            good.append((left, right))
    return sorted(good) if len(good) >= 2 else []


def _nearest_block(a: dict, blocks: list[dict]) -> str:
    """As ``layout.nearest_block``, of one annotation."""

    def key(b: dict) -> tuple:
        common = max(min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), 0.0) * max(min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]), 0.0)
        away = math.hypot((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2.0, (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2.0)
        return -common, away, b["y0"], b["x0"], b["element"]

    return min(blocks, key=key)["element"]


def _blocks(elements: list[dict], hidden: list[dict], page: int, pdf: bool) -> tuple[list[dict], list[dict], list[tuple[str, str]]]:
    """A page's texts outside of tables and its tables, as blocks, and (kind, warning) of what the detector did not trust."""
    texts = [e | {"clean": _clean(e["content"])} for e in elements if e["type"] == "text" and e["content"] is not None]
    texts = [e for e in texts if e["clean"]]
    found = _detect(texts, [e for e in elements if e["type"] == "path"]) if pdf else []
    drawn = sorted((x for x in found if x["warning"] is None), key=lambda x: (x["y0"], x["x0"], x["y1"], x["x1"]))
    used = {e for x in drawn for e in x["consumed"]}
    levels: dict[str, int] = {}
    for h in hidden:
        if h["kind"] == "role" and h["content"] is not None:
            role = _ROLE.fullmatch(h["content"])
            level = {"title": 1, "ctrTitle": 1, "subTitle": 2}.get(h["content"]) or (int(role[1]) if role else None)
            if level:
                levels[h["element"]] = min(level, levels.get(h["element"], level))
    blocks = []
    for e in texts:
        if e["element"] not in used:
            shown = [r for r in e["runs"] or [] if r["content"] is not None and _clean(r["content"])]
            bold = all(r["bold"] for r in shown) if shown else e["bold"]
            blocks.append(e | {"size": e["size"] or 0.0, "own_bold": e["bold"], "bold": bold, "italic": bool(e["italic"]), "level": levels.get(e["element"]), "rendered": None, "runs": e["runs"] or None})
    grids = []
    for n, x in enumerate(drawn):
        spans = any(c["row_span"] > 1 or c["col_span"] > 1 for c in x["cells"])
        grids.append({c: x[c] for c in G.BOX} | {"element": f"p{page}-table-{n}", "content": "", "size": 0.0, "bold": False, "own_bold": False, "italic": False, "runs": None, "level": None, "rendered": (_html_table if spans else _gfm_table)(x["cells"])})
    return blocks, grids, [(x["kind"], x["warning"]) for x in found if x["warning"] is not None]


def _print(record: dict, tag: str | None) -> str | None:
    """The Markdown of one record; null if there is none."""
    pages: dict[int, dict] = {}
    for p in record["pages"] or []:  # of one number: one page
        held = pages.setdefault(p["page"], {"width": p["width"], "elements": [], "hidden": []})
        held["elements"] += p["elements"] or []
        held["hidden"] += p["hidden"] or []
    placed, late = [], []
    for number, p in sorted(pages.items()):
        blocks, grids, skipped = _blocks(p["elements"], p["hidden"], number, record["format"] == "pdf")
        placed.append((blocks, grids, p))
        for kind, why in sorted(skipped, key=lambda x: (x[0] != "ruled", x[1])):
            late.append(f"page {number}: " + (TOO_DENSE if why.startswith("path density") else f"{SKIPPED[kind]}: {why}"))
    body = _body_size([b for blocks, _, _ in placed for b in blocks])
    printed = []
    for blocks, grids, p in placed:
        every = blocks + grids
        links: dict[str, str] = {}
        for a in p["elements"] if every else []:
            if a["type"] == "annotation" and a["uri"] is not None:
                links.setdefault(_nearest_block(a, every), a["uri"])
        columns = _columns(blocks, p["width"])
        for b in every:
            x = b["x0"]
            away = [(left - x if x < left else x - right if x > right else 0.0, n) for n, (left, right) in enumerate(columns)]
            b["column"], b["link"] = min(away)[1] if away else 0, links.get(b["element"])
        printed.append(_page(every, body))
    text = "\n\n---\n\n".join(x for x in printed if x)
    if tag is None:
        return text + "\n" if text else None
    said = [x for x in record["warnings"] or []] + late
    parts = [text] if text else []
    if said:
        parts.append("\n\n".join(f"> [!WARNING]\n> {escape(_clean(x))}" for x in said if x is not None))
    notes = [(number, n, h) for number, p in sorted(pages.items()) for n, h in enumerate(p["hidden"])]
    if notes:
        safe = lambda s: s.replace("--", "- -").replace(">", "&gt;")
        parts.append("\n".join(f"<!-- {tag}: {safe(h['kind'])}{safe(f' [{h['element']}]' if h['element'] is not None else '')} {safe(_clean(h['content']))} -->" for _, _, h in notes if h["kind"] is not None and h["content"] is not None))
    return "\n\n".join(parts) + "\n" if parts else None


def of_records(rows: DataFrame, tag: str | None = None) -> DataFrame:
    """(doc_id, markdown) of records (as of ``records.SCHEMA`` with doc_id): as ``markdown(records.tables(rows), tag)``, each
    record read once and printed where it is.  Elements of a page have names of their own, documents one record each."""
    ship(rows.sparkSession)
    kinds = ("text", "path", "annotation")
    own = lambda e: F.struct(
        e["type"].alias("type"), e["id"].alias("element"), *(e["bbox"][c].alias(c) for c in G.BOX), e["content"].alias("content"), e["font"]["size"].alias("size"), e["font"]["bold"].alias("bold"), e["font"]["italic"].alias("italic"),
        F.transform(e["runs"], lambda r: F.struct(r["content"].alias("content"), r["font"]["bold"].alias("bold"), r["font"]["italic"].alias("italic"), r["href"].alias("href"))).alias("runs"),
        e["uri"].alias("uri"), e["stroke"].isNotNull().alias("stroked"), e["fill"].isNotNull().alias("filled"), e["stroke_width"].alias("stroke_width"),
    )
    page = lambda p: F.struct(p["page_number"].alias("page"), p["width"].alias("width"), F.transform(F.filter(p["elements"], lambda e: e["type"].isin(*kinds)), own).alias("elements"), p["hidden"].alias("hidden"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.operators.document import _print

        for batch in batches:
            printed = [_print(record, tag) for record in batch.select(["format", "warnings", "pages"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(printed, pa.string())], names=["doc_id", "markdown"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    lean = rows.select("doc_id", F.col("source.format").alias("format"), "warnings", F.transform("pages", page).alias("pages"))
    return lean.mapInArrow(run, f"doc_id {kind}, markdown string").filter("markdown is not null")
