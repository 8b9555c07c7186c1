"""Reading order and Markdown: body size, columns, headings, rows, links, paragraphs, tables and page text.

Blocks are rows (doc_id, page, element, content, x0..y1, size, bold) of a page.  Document and page statistics are
aggregates joined back on their key; what compares with a running extent or a growing row runs per page in pandas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.pages import KEY
from quire.session import cut, ship

#: Thresholds of columns, headings, rows and paragraphs.
BODY, ROW_SHARE = 10.0, 0.35
ANCHOR_CHARACTERS, ANCHOR_WIDTH, SPAN_LIMIT, ANCHORS = 20, 0.16, 0.6, 4
GUTTER_SHARE, GUTTER_LEAST, COLUMN_WIDTH, COLUMN_HEIGHT = 0.02, 6.0, 0.1, 0.5


def body_size(blocks: DataFrame) -> DataFrame:
    """The median font size of each document, a block weighing an eighth of its characters, from 1 to 12; BODY without blocks."""
    weight = G.clamp(F.floor(F.length(T.clean_text("content")) / 8), 1, 12).cast("int")
    sized = blocks.filter("size > 0 and size < double('infinity')").select("doc_id", "size", weight.alias("weight"))
    got = sized.groupBy("doc_id").agg(F.expr("percentile(size, 0.5, weight)").alias("body"))
    return blocks.select("doc_id").distinct().join(got, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(BODY)).alias("body"))


def columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, column, left, right) of pages with two or more text columns: islands of the anchors' horizontal extents."""
    anchor = (F.length(T.clean_text("content")) >= ANCHOR_CHARACTERS) | (F.col("x1") - F.col("x0") >= F.col("width") * ANCHOR_WIDTH)
    anchors = blocks.join(pages.select(*KEY, "width"), KEY).filter(anchor)
    whole = Window.partitionBy(*KEY)
    stats = anchors.withColumn("n", F.count("*").over(whole)).withColumn("cw", F.max("x1").over(whole) - F.min("x0").over(whole)).withColumn("ch", F.max("y1").over(whole) - F.min("y0").over(whole))
    narrow = stats.filter((F.col("n") >= ANCHORS) & (F.col("cw") > 0) & (F.col("ch") > 0) & (F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) <= F.col("cw") * SPAN_LIMIT))
    narrow = narrow.withColumn("m", F.count("*").over(whole)).filter(F.col("m") >= ANCHORS)
    order = Window.partitionBy(*KEY).orderBy("x0", "x1", "element")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("x0") > reach + F.greatest(F.col("width") * GUTTER_SHARE, F.lit(GUTTER_LEAST)), F.lit(True)).cast("int")
    island = narrow.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    runs = island.groupBy(*KEY, "island", "width", "ch", "m").agg(*G.union_box(), F.count("*").alias("support"))
    good = runs.filter((F.col("support") >= F.greatest(F.lit(3), F.floor(F.col("m") / 8))) & (F.col("x1") - F.col("x0") >= F.col("width") * COLUMN_WIDTH) & (F.col("y1") - F.col("y0") >= F.col("ch") * COLUMN_HEIGHT))
    good = good.withColumn("columns", F.count("*").over(whole)).filter("columns >= 2")
    return good.select(*KEY, (F.row_number().over(Window.partitionBy(*KEY).orderBy("x0")) - 1).alias("column"), F.col("x0").alias("left"), F.col("x1").alias("right"))


def assign_columns(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with the nearest column by their left edge, 0 on pages without columns."""
    away = F.when(F.col("x0") < F.col("left"), F.col("left") - F.col("x0")).when(F.col("x0") > F.col("right"), F.col("x0") - F.col("right")).otherwise(0.0)
    near = blocks.select(*KEY, "element", "x0").join(found, KEY).groupBy(*KEY, "element").agg(F.min(F.struct(away.alias("away"), "column"))["column"].alias("nearest"))
    return blocks.join(near, [*KEY, "element"], "left").withColumn("column", F.coalesce("nearest", F.lit(0))).drop("nearest")


def heading_candidates(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Blocks clearly above the body size, or bold, short and not below it."""
    sized = blocks.join(body, "doc_id")
    large = F.col("size") >= F.greatest(F.col("body") + 1.0, F.col("body") * 1.12)
    return sized.filter(large | (F.col("bold") & (F.col("size") >= F.col("body") * 0.98) & T.heading_like("content")))


def _median(sizes: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(sizes)
    return (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2.0


def size_clusters(sizes: Column, body: Column) -> Column:
    """Medians of clusters of sizes (an array, largest first); a size joins the last cluster if it is near its running median."""
    near = F.greatest(F.lit(0.4), body * 0.04)

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joins = F.coalesce(F.abs(s - _median(last)) <= near, F.lit(False))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(last, F.array(s))))).otherwise(F.concat(out, F.array(F.array(s))))

    return F.transform(F.aggregate(sizes, F.array().cast("array<array<double>>"), step), _median)


def heading_levels(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, element, level) of heading candidates: the rank of their size cluster on the page, at most 4, bold ones a level up.

    A page's distinct sizes are folded into clusters; blocks look up the nearest one (of equally near ones, the largest).
    """
    some = heading_candidates(blocks, body).select(*KEY, "element", "size", "bold", "body")
    ranks = some.groupBy(*KEY).agg(size_clusters(F.sort_array(F.collect_set("size"), asc=False), F.min("body")).alias("ranks"))
    away = F.transform("ranks", lambda r: F.abs(F.col("size") - r))
    level = F.least(F.array_position(away, F.array_min(away)), F.lit(4)).cast("int")
    ranked = some.join(ranks, KEY).withColumn("level", level)
    return ranked.select(*KEY, "element", F.when(F.col("bold") & (F.col("level") > 1), F.col("level") - 1).otherwise(F.col("level")).alias("level"))


def merge_rows(blocks: DataFrame) -> DataFrame:
    """Blocks of a column that share a visual row, as one block: smallest id, union box, largest size, bold if all are, texts joined
    with a space where a gap shows.  A block joins the row of the nearest median top among those it overlaps enough.

    Blocks that overlap no other of their column vertically are rows already; only the rest is merged in Python.
    """
    ship(blocks.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = f"doc_id {kind['doc_id']}, page int, column int, element string, content string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, parts int"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", "element"], kind="stable").reset_index(drop=True)
        top, bottom = pdf["y0"].to_numpy(), pdf["y1"].to_numpy()
        rows: list[list[int]] = []
        for n in range(len(pdf)):
            best = None
            for r, row in enumerate(rows):
                shared = np.maximum(0.0, np.minimum(bottom[row], bottom[n]) - np.maximum(top[row], top[n])).max()
                if shared > ROW_SHARE * min(max(0.0, (bottom[row] - top[row]).max()), max(0.0, bottom[n] - top[n])):
                    away = abs(float(np.median(top[row])) - top[n])
                    if best is None or away < best[0]:
                        best = away, r
            if best:
                rows[best[1]].append(n)
            else:
                rows.append([n])
        out = []
        for row in rows:
            got = pdf.loc[row].sort_values(["x0", "x1", "element"], kind="stable")
            gap = got["x0"].to_numpy()[1:] - got["x1"].to_numpy()[:-1] > np.maximum(1.0, got["size"].to_numpy()[1:] * 0.12)
            text = got["content"].iloc[0] + "".join((" " if g else "") + c for g, c in zip(gap, got["content"].iloc[1:], strict=True))
            out.append([key[0], key[1], key[2], got["element"].min(), text, got["x0"].min(), got["y0"].min(), got["x1"].max(), got["y1"].max(), got["size"].max(), bool(got["bold"].all()), len(got)])
        return pd.DataFrame(out, columns=["doc_id", "page", "column", "element", "content", "x0", "y0", "x1", "y1", "size", "bold", "parts"])

    order = Window.partitionBy(*KEY, "column").orderBy("y0", "y1", "x0", "element")
    below = F.col("y0") >= F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.coalesce(F.lead("y0").over(order) >= F.col("y1"), F.lit(True))
    marked = blocks.withColumn("free", F.coalesce(below, F.lit(True)) & ahead)
    free = marked.filter("free").select(*KEY, "column", "element", "content", *G.BOX, F.col("size").cast("double"), "bold", F.lit(1).alias("parts"))
    return free.unionByName(marked.filter("not free").drop("free").groupBy(*KEY, "column").applyInPandas(run, schema))


def paragraph_numbers(blocks: DataFrame, body: DataFrame, heading: str = "level") -> DataFrame:
    """Blocks with a paragraph number, in reading order: headings, list items and tables stand alone; else a gap or a shift breaks."""
    order = Window.partitionBy(*KEY).orderBy("column", "y0", "x0", "y1", "element")
    alone = F.col(heading).isNotNull() | T.list_item("content").isNotNull()
    marked = blocks.join(body, "doc_id").withColumn("alone", alone)
    gap = F.col("y0") - F.lag("y1").over(order) > F.greatest(F.lit(4.0), F.col("body") * 0.65)
    shift = F.abs(F.col("x0") - F.lag("x0").over(order)) > F.greatest(F.lit(18.0), F.col("body") * 1.8)
    fresh = F.coalesce(F.col("alone") | F.lag("alone").over(order) | gap | shift, F.lit(True)).cast("int")
    return marked.withColumn("fresh", fresh).withColumn("paragraph", F.sum("fresh").over(order) - 1).withColumn("place", F.row_number().over(order) - 1).drop("fresh", "alone", "body")


def nearest_block(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block of each annotation: largest common area, then nearest centre, then top, left and id.  Pairs are within a page."""
    a = annotations.select(*KEY, F.col("element").alias("annotation"), *(F.col(c).alias(f"a_{c}") for c in G.BOX))
    pairs = a.join(blocks.select(*KEY, "element", *G.BOX), KEY)
    theirs = tuple(f"a_{c}" for c in G.BOX)
    best = F.struct((-G.overlap(G.BOX, theirs)).alias("o"), G.centre_distance(G.BOX, theirs).alias("d"), "y0", "x0", "element")
    return pairs.groupBy(*KEY, "annotation").agg(F.min(best)["element"].alias("element"))


def inline(content: Column, bold: Column, italic: Column, href: Column) -> Column:
    """Markdown of one run: escaped, emphasised, linked where the link's scheme is allowed; white space at its ends is left out."""
    body = T.escape_markdown(T.inner_whitespace(content))
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    text = F.concat(mark, body, mark)
    return F.when(body == "", "").when(href.isNotNull() & T.href_allowed(href), F.concat(F.lit("["), text, F.lit("]("), T.escape_link_target(href), F.lit(")"))).otherwise(text)


def page_markdown(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Markdown of every page with text: columns, rows, headings, lists and paragraphs."""
    body = body_size(blocks)
    placed = cut(merge_rows(assign_columns(blocks, columns(blocks, pages))))
    levels = heading_levels(placed, body)
    numbered = paragraph_numbers(placed.join(levels, [*KEY, "element"], "left"), body)
    item = T.list_item("content")
    plain = inline(F.col("content"), F.col("bold"), F.lit(False), F.lit(None).cast("string"))
    rest = inline(F.substr(F.col("content"), item["start"] + 1), F.col("bold"), F.lit(False), F.lit(None).cast("string"))
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), inline(F.col("content"), F.lit(False), F.lit(False), F.lit(None).cast("string")))
    line = F.when(item.isNotNull(), F.concat(item["marker"], F.lit(" "), rest)).when(F.col("level").isNotNull(), head).otherwise(plain)
    said = numbered.withColumn("line", line).filter("line <> ''")
    joined = said.groupBy(*KEY, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), " ").alias("text"))
    return joined.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


def document_markdown(page_text: DataFrame) -> DataFrame:
    """Pages joined by rules, empty ones left out, with a final line feed."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "markdown")))
    return page_text.filter("markdown <> ''").groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["markdown"]), "\n\n---\n\n"), F.lit("\n")).alias("markdown"))


def gfm_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """Pipe tables of cells (row, col, content): a dense grid, the first row as head; line breaks become <br>."""
    size = cells.groupBy(*by).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = size.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols"))))
    marked = F.regexp_replace(T.inner_whitespace("content"), "<br>\n", "\uE000")
    text = F.replace(T.escape_markdown(marked), F.lit("\uE000"), F.lit("<br>"))
    full = grid.join(cells.select(*by, "row", "col", text.alias("cell")), [*by, "row", "col"], "left")
    row = full.groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("cell", F.lit("")).alias("cell")))), lambda x: x["cell"]), " | ").alias("line"), F.count("*").alias("n"))
    line = F.concat(F.lit("| "), F.col("line"), F.lit(" |"), F.when(F.col("row") == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n").cast("int")))).otherwise(""))
    return row.withColumn("line", line).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("table"))


def uncovered_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Anchor cells that no earlier cell's span covers."""
    spread = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    under = spread.filter("r <> row or c <> col").select(*by, F.col("r").alias("row"), F.col("c").alias("col")).distinct()
    return cells.join(under, [*by, "row", "col"], "left_anti")


def html_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """HTML tables of anchor cells (row, col, row_span, col_span, content): spans clamped to the grid, covered places left out, the first row as head."""
    size = cells.groupBy(*by).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    grid = size.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    spread = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.greatest("row_span", F.lit(1)) - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest("col_span", F.lit(1)) - 1)))
    under = spread.filter("r <> row or c <> col").select(*by, F.col("r").alias("row"), F.col("c").alias("col")).distinct()
    marked = F.regexp_replace(T.inner_whitespace("content"), "<br>\n", "\uE000")
    body = F.replace(T.escape_html(marked), F.lit("\uE000"), F.lit("<br>"))
    full = grid.join(under, [*by, "row", "col"], "left_anti").join(cells.select(*by, "row", "col", "row_span", "col_span", body.alias("body")), [*by, "row", "col"], "left")
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    across, down = F.least("col_span", F.col("cols") - F.col("col")), F.least("row_span", F.col("rows") - F.col("row"))
    attributes = F.concat(F.when(across > 1, F.concat(F.lit(' colspan="'), across.cast("string"), F.lit('"'))).otherwise(""), F.when(down > 1, F.concat(F.lit(' rowspan="'), down.cast("string"), F.lit('"'))).otherwise(""))
    cell = F.concat(F.lit("<"), tag, attributes, F.lit(">"), F.coalesce("body", F.lit("")), F.lit("</"), tag, F.lit(">\n"))
    row = full.withColumn("cell", cell).groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), "").alias("cells"))
    rows = size.select(*by, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).join(row, [*by, "row"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", F.concat(F.lit("<tr>\n"), F.coalesce("cells", F.lit("")), F.lit("</tr>\n")).alias("line")))), lambda x: x["line"])
    got = rows.groupBy(*by).agg(ordered.alias("q"))
    rest = F.when(F.size("q") > 1, F.concat(F.lit("<tbody>\n"), F.array_join(F.slice("q", F.lit(2), F.size("q")), ""), F.lit("</tbody>\n"))).otherwise("")
    return got.select(*by, F.concat(F.lit("<table>\n<thead>\n"), F.col("q")[0], F.lit("</thead>\n"), rest, F.lit("</table>")).alias("table"))


def flow_markdown(blocks: DataFrame) -> DataFrame:
    """Markdown of flow documents from ordered blocks (doc_id, place, kind, role, content, breaks, list_kind, list_level)."""
    level = F.when(F.col("list_kind").isNull(), F.coalesce(F.least(T.heading_role("role"), F.lit(6)), F.when(F.col("role") == "title", 1)))
    text = inline(F.col("content"), F.lit(False), F.lit(False), F.lit(None).cast("string"))
    item = F.concat(F.repeat(F.lit("  "), F.coalesce(F.col("list_level"), F.lit(0))), F.when(F.col("list_kind") == "ordered", "1. ").otherwise("- "), text)
    quote = F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))
    said = (
        F.when((F.col("kind") == "paragraph") & F.col("list_kind").isNotNull(), item)
        .when((F.col("kind") == "paragraph") & level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when((F.col("kind") == "paragraph") & (F.col("role") == "quote") & (text != ""), quote)
        .when(F.col("kind") == "paragraph", text)
        .when(F.col("kind") == "table", F.col("content"))
        .when(F.col("kind") == "image", "<!-- image -->")
        .when((F.col("kind") == "break") & F.col("content").isin("page", "section"), "---")
    )
    rules = F.transform(F.filter(F.coalesce("breaks", F.array().cast("array<string>")), lambda b: b.isin("page", "section")), lambda b: F.lit("---"))
    each = blocks.select("doc_id", "place", F.posexplode(F.filter(F.concat(rules, F.array(said)), lambda x: x.isNotNull() & (x != ""))).alias("step", "line"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "step", "line")))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("markdown"))


def trailing_context(warnings: DataFrame, hidden: DataFrame, tag: str = "hidden") -> DataFrame:
    """Warnings as callouts, then hidden items as comments that no content can close, by document."""
    callout = F.concat(F.lit("> [!WARNING]\n> "), T.escape_markdown(T.clean_text("message")))
    w = warnings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", callout.alias("t")))), lambda x: x["t"]), "\n\n").alias("callouts"))
    element = F.coalesce(F.concat(F.lit(" ["), F.col("element"), F.lit("]")), F.lit(""))
    comment = F.concat(F.lit(f"<!-- {tag}: "), T.safe_comment("kind"), T.safe_comment(element), F.lit(" "), T.safe_comment(T.clean_text("content")), F.lit(" -->"))
    h = hidden.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", comment.alias("t")))), lambda x: x["t"]), "\n").alias("comments"))
    return w.join(h, "doc_id", "full").select("doc_id", F.concat_ws("\n\n", "callouts", "comments").alias("context"))
