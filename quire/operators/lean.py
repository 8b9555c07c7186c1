"""Line-oriented renderings of paged and flow documents, one row for each output line.

Every record becomes one physical line: content is escaped, so no text can forge a record.  Lines carry a sort key
(page, place, part, step), and a document is its lines in that order; nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T

#: Record tags by block role, list kind and break kind.
ROLES = {"title": "TI", "quote": "Q"}
LIST_KINDS = {"ordered": "o", "bullet": "b"}
#: Versions and legends of the line formats; the longer ones where a document has runs, tables or charts.
PAGED_VERSION, FLOW_VERSION = "1.9", "1.7"
ELEMENT_LEGEND = "#legend T x0 y0 x1 y1 font size style text | r font size style [href#<uri>] text | TB x0 y0 x1 y1 rows cols | c row col rowspan colspan x0 y0 x1 y1 font size style text | CH x0 y0 x1 y1 type [title] | s series-name | p [category] value | I/P x0 y0 x1 y1 | A x0 y0 x1 y1 subtype uri | pt, top-left origin"
WORD_LEGEND = "#legend T x0 y0 x1 y1 font size style | w x0 y0 x1 y1 word | r font size style [href#<uri>] text | TB x0 y0 x1 y1 rows cols | c row col rowspan colspan x0 y0 x1 y1 font size style text | CH x0 y0 x1 y1 type [title] | s series-name | p [category] value | I/P x0 y0 x1 y1 | A x0 y0 x1 y1 subtype uri | pt, top-left origin"
PLAIN_ELEMENT_LEGEND = "#legend T x0 y0 x1 y1 font size style text | I/P x0 y0 x1 y1 | A x0 y0 x1 y1 subtype uri | pt, top-left origin"
PLAIN_WORD_LEGEND = "#legend T x0 y0 x1 y1 font size style | w x0 y0 x1 y1 word | I/P x0 y0 x1 y1 | A x0 y0 x1 y1 subtype uri | pt, top-left origin"
FLOW_LEGEND = "#legend #section width height | H1..H9/TI/Q/P text | LI level o|b label text | r font size style [href#<uri>] text | TB cols col-width... | c row col rowspan colspan text | I [width height] | BR page|column|section | ~page N | pt, authored flow; no resolved coordinates"
HIDDEN_LEGEND = "#legend <hidden> kind [element-id] content | non-visible document context"


def style(bold: str = "bold", italic: str = "italic", fill: str = "fill") -> Column:
    return G.lean_style(F.coalesce(F.col(bold), F.lit(False)), F.coalesce(F.col(italic), F.lit(False)), F.col(fill))


def header_lines(documents: DataFrame, counted: str, legend: Column, granularity: str, version: str, mark: str) -> DataFrame:
    """The first lines of documents: the mark with version and counts, the legend, and that of hidden items if there are any.

    ``documents``: doc_id, n_parts (pages or sections, called ``counted``), n_warnings, any_hidden.
    """
    warned = F.when(F.col("n_warnings") > 0, F.concat(F.lit(" warnings="), F.col("n_warnings").cast("string"))).otherwise("")
    head = F.concat(F.lit(f"#{mark} {granularity} v{version} {counted}="), F.col("n_parts").cast("string"), warned)
    lines = F.array_compact(F.array(head, legend, F.when(F.col("any_hidden"), HIDDEN_LEGEND)))
    return documents.select("doc_id", F.lit(-1).alias("page"), F.lit(-2).alias("place"), F.lit(0).alias("part"), F.posexplode(lines).alias("step", "line"))


def warning_lines(warnings: DataFrame) -> DataFrame:
    line = F.concat(F.lit("#warning "), T.collapse_warning("message"))
    return warnings.select("doc_id", F.lit(-1).alias("page"), F.lit(-1).alias("place"), F.lit(0).alias("part"), F.col("ord").cast("int").alias("step"), line.alias("line"))


def section_lines(sections: DataFrame) -> DataFrame:
    """The header of each section of a flow document (doc_id, section, width, height); its blocks' places are 0 and up."""
    head = F.concat_ws(" ", F.lit("#section"), G.lean_number("width"), G.lean_number("height"))
    return sections.select("doc_id", F.col("section").alias("page"), F.lit(-1).alias("place"), F.lit(0).alias("part"), F.lit(0).alias("step"), head.alias("line"))


def page_lines(pages: DataFrame) -> DataFrame:
    """The header of each page: number, size, rotation if any, and the scanned mark."""
    head = F.concat(
        F.lit("#page "), F.col("page").cast("string"), F.lit(" "), G.lean_number("width"), F.lit("x"), G.lean_number("height"),
        F.when(F.col("rotation") != 0, F.concat(F.lit(" rot="), F.col("rotation").cast("string"))).otherwise(""), F.when(F.col("scanned"), " scanned").otherwise(""),
    )
    return pages.select("doc_id", "page", F.lit(-1).alias("place"), F.lit(0).alias("part"), F.lit(0).alias("step"), head.alias("line"))


def text_lines(elements: DataFrame, with_content: bool = True) -> DataFrame:
    """Text elements: box, font, size, style and, at element granularity, content."""
    parts = [F.lit("T"), G.lean_box(), T.font_name("font"), G.lean_number("size"), style()]
    parts += [T.escape_record("content")] if with_content else []
    return elements.select("doc_id", "page", "place", F.lit(0).alias("part"), F.lit(0).alias("step"), F.concat_ws(" ", *parts).alias("line"))


#: Steps between two cells of a table; a cell's runs take those after its own.
CELL_STEPS = 100_000


def run_lines(runs: DataFrame, cells: bool = False) -> DataFrame:
    """Runs of elements, or of table cells, that have more than one run or a link; ``run`` is the run's place."""
    by = ["doc_id", "page", "place", *(["cell"] if cells else [])]
    some = runs.groupBy(*by).agg(F.count("*").alias("n"), F.max("href").alias("any_href")).filter("n > 1 or any_href is not null")
    head = F.concat_ws(" ", F.lit("r"), T.font_name("font"), G.lean_number("size"), style())
    link = F.when(F.col("href").isNotNull(), F.concat(F.lit("href#<"), T.escape_record("href"), F.lit("> "))).otherwise("")
    line = F.concat(head, F.lit(" "), link, T.escape_record("content"))
    part, step = (3, F.col("cell").cast("long") * CELL_STEPS + F.col("run") + 1) if cells else (1, F.col("run").cast("long"))
    return runs.join(some.select(*by), by, "left_semi").select("doc_id", "page", "place", F.lit(part).alias("part"), step.alias("step"), line.alias("line"))


def word_lines(words: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", F.lit("w"), G.lean_box(), T.escape_record("content"))
    return words.select("doc_id", "page", "place", F.lit(2).alias("part"), F.col("word").cast("int").alias("step"), line.alias("line"))


def cell_lines(cells: DataFrame) -> DataFrame:
    """Table cells: place and spans, box, then font, size and style of the first run (dashes without one) and content."""
    font = F.when(F.col("font").isNull(), "- - -").otherwise(F.concat_ws(" ", T.font_name("font"), G.lean_number("size"), style()))
    line = F.concat_ws(" ", F.lit("c"), "row", "col", "row_span", "col_span", G.lean_box(), font, T.escape_record("content"))
    return cells.select("doc_id", "page", "place", F.lit(3).alias("part"), (F.col("cell").cast("long") * CELL_STEPS).alias("step"), line.alias("line"))


def box_lines(boxes: DataFrame) -> DataFrame:
    """Tables, charts, images, paths and annotations: their head lines."""
    head = (
        F.when(F.col("kind") == "table", F.concat_ws(" ", F.lit("TB"), G.lean_box(), "n_rows", "n_cols"))
        .when(F.col("kind") == "chart", F.concat(F.lit("CH "), G.lean_box(), F.lit(" "), F.col("subtype"), F.coalesce(F.concat(F.lit(" "), T.escape_record("title")), F.lit(""))))
        .when(F.col("kind") == "image", F.concat(F.lit("I "), G.lean_box()))
        .when(F.col("kind") == "path", F.concat(F.lit("P "), G.lean_box()))
        .when(F.col("kind") == "annotation", F.concat_ws(" ", F.lit("A"), G.lean_box(), "subtype", F.coalesce(T.escape_record("uri"), F.lit("-"))))
    )
    return boxes.select("doc_id", "page", "place", F.lit(0).alias("part"), F.lit(0).alias("step"), head.alias("line")).filter("line is not null")


def chart_lines(points: DataFrame) -> DataFrame:
    """Series names and points of charts; ``step`` orders them, a null value marks a series name."""
    point = F.concat(F.lit("p "), F.coalesce(F.concat(T.escape_record("category"), F.lit(" ")), F.lit("")), T.escape_record("value"))
    line = F.when(F.col("value").isNull(), F.concat(F.lit("s "), T.escape_record("name"))).otherwise(point)
    return points.select("doc_id", "page", "place", F.lit(4).alias("part"), F.col("step").cast("int").alias("step"), line.alias("line"))


def hidden_lines(hidden: DataFrame) -> DataFrame:
    """The hidden block of each page that has one: opening mark, items, closing mark."""
    last = (1 << 31) - 1
    item = F.concat(F.col("kind"), F.lit(" "), F.coalesce(F.concat(F.col("element"), F.lit(" ")), F.lit("")), T.escape_record("content"))
    at = lambda part, step, line, df: df.select("doc_id", "page", F.lit(last).alias("place"), F.lit(part).alias("part"), step.alias("step"), line.alias("line"))
    keys = hidden.select("doc_id", "page").distinct()
    return at(0, F.lit(0), F.lit("<hidden>"), keys).unionByName(at(1, F.col("ord").cast("int"), item, hidden)).unionByName(at(2, F.lit(0), F.lit("</hidden>"), keys))


def document_text(*lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines gathered in order: one text for each document, or for each key."""
    by = by or ["doc_id"]
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    ordered = F.array_sort(F.collect_list(F.struct("page", "place", "part", "step", "line")))
    return every.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def paged(t: dict[str, DataFrame], words: bool = False, mark: str = "quire") -> DataFrame:
    """(doc_id, text): documents in the tables of ``records.tables`` as lines, each ended by a line feed; ``mark`` names the producer in the first."""
    detailed, plain = (WORD_LEGEND, PLAIN_WORD_LEGEND) if words else (ELEMENT_LEGEND, PLAIN_ELEMENT_LEGEND)
    legend = F.when(F.col("detailed"), detailed).otherwise(plain)
    head = header_lines(t["documents"], "pages", legend, "word" if words else "element", PAGED_VERSION, mark)
    parts = [warning_lines(t["warnings"]), page_lines(t["pages"]), text_lines(t["texts"], not words), run_lines(t["runs"]), cell_lines(t["cells"]), run_lines(t["cell_runs"], cells=True), box_lines(t["boxes"]), chart_lines(t["points"]), hidden_lines(t["hidden"])]
    return document_text(head, *parts, *([word_lines(t["words"])] if words else [])).select("doc_id", F.concat("text", F.lit("\n")).alias("text"))


def flowing(documents: DataFrame, warnings: DataFrame, sections: DataFrame, blocks: DataFrame, hidden: DataFrame, mark: str = "quire") -> DataFrame:
    """(doc_id, text): flow documents as lines; ``blocks`` as of ``flow_lines``, ``hidden`` with the section as its page."""
    head = header_lines(documents, "sections", F.lit(FLOW_LEGEND), "element", FLOW_VERSION, mark)
    return document_text(head, warning_lines(warnings), section_lines(sections), flow_lines(blocks), hidden_lines(hidden)).select("doc_id", F.concat("text", F.lit("\n")).alias("text"))


def capped(lines: DataFrame, most: int, by: str = "doc_id") -> DataFrame:
    """Documents whose lines, each with its line feed, are at most ``most`` bytes; others only as (id, too_large)."""
    return lines.groupBy(by).agg((F.sum(F.octet_length("line") + 1) > most).alias("too_large"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def paragraph_line(role: Column, content: Column, list_kind: Column, level: Column, label: Column) -> Column:
    """A flow paragraph: heading level, title, quote or plain, or a list item with its level, kind and label."""
    level_of = T.heading_role(role)
    tag = F.when(level_of.isNotNull(), F.concat(F.lit("H"), level_of.cast("string")))
    for name, code in ROLES.items():
        tag = tag.when(role == name, code)
    kind = F.create_map(*(F.lit(x) for kv in LIST_KINDS.items() for x in kv))
    item = F.concat_ws(" ", F.lit("LI"), level.cast("string"), F.coalesce(F.element_at(kind, list_kind), F.lit("-")), T.escape_record(label), T.escape_record(content))
    return F.when(list_kind.isNotNull(), item).otherwise(F.concat_ws(" ", tag.otherwise("P"), T.escape_record(content)))


def flow_lines(blocks: DataFrame) -> DataFrame:
    """Blocks of flow documents (doc_id, place, kind, role, content, breaks, approx_page, list columns, width, height, n_cols, col_widths).

    Breaks come first, then the page estimate, then the block itself; cells are blocks of their own after their table.
    """
    kind = F.col("kind")
    parts = F.array_compact(
        F.concat(
            F.transform(F.coalesce("breaks", F.array().cast("array<string>")), lambda b: F.concat(F.lit("BR "), b)),
            F.array(
                F.when(F.col("approx_page").isNotNull() & kind.isin("paragraph", "table"), F.concat(F.lit("~page "), F.col("approx_page").cast("string"))),
                F.when(kind == "paragraph", paragraph_line(F.col("role"), F.col("content"), F.col("list_kind"), F.col("list_level"), F.col("list_label")))
                .when(kind == "table", F.concat_ws(" ", F.lit("TB"), F.col("n_cols").cast("string"), F.array_join(F.transform("col_widths", G.lean_number), " ")))
                .when(kind == "cell", F.concat_ws(" ", F.lit("c"), "row", "col", "row_span", "col_span", T.escape_record("content")))
                .when((kind == "image") & F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws(" ", F.lit("I"), G.lean_number("width"), G.lean_number("height")))
                .when(kind == "image", "I")
                .when(kind == "break", F.concat(F.lit("BR "), F.col("content"))),
            ),
        )
    )
    return blocks.select("doc_id", F.col("section").alias("page"), "place", F.posexplode(parts).alias("step", "line")).select("doc_id", "page", "place", F.lit(0).alias("part"), "step", "line")
