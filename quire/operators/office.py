"""Column functions and small relational operators of slides, flow documents and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.sources.ooxml import ERRORS

#: Finest granularity, geometry and page selection of each format; ranks of granularities.
CAPABILITIES = (("pdf", "char", "exact", True), ("pptx", "element", "container", True), ("docx", "element", "flow", False))
RANKS = {"element": 0, "word": 1, "char": 2}
EXIT_CODES = {code: exit_code for code, exit_code, _ in ERRORS}
#: Content types of output formats.
CONTENT_TYPES = {"json": "application/json", "lean": "text/plain; charset=utf-8", "markdown": "text/markdown; charset=utf-8"}
#: Names of PDF colour spaces by number, from 1; chart types; frame kinds by the end of a URI; placement frames.
COLOR_SPACES = ("DeviceGray", "DeviceRGB", "DeviceCMYK", "CalGray", "CalRGB", "Lab", "ICCBased", "Separation", "DeviceN", "Indexed", "Pattern")
CHART_TYPES = {"barChart": "bar", "pieChart": "pie", "doughnutChart": "doughnut", "lineChart": "line", "areaChart": "area", "scatterChart": "scatter"}
FRAME_KINDS = {"/chart": "chart", "/diagram": "SmartArt", "/picture": "picture", "/ole": "OLE"}
PLACEMENT_FRAMES = {"page": "page", "margin": "margin", "leftMargin": "margin", "rightMargin": "margin", "insideMargin": "margin", "outsideMargin": "margin", "column": "column", "line": "line"}
#: Page and margins of a section without geometry, in points; blocks of a story at most; default slide style.
PAGE_WIDTH, PAGE_HEIGHT, PAGE_MARGIN, STORY_BLOCKS = 612.0, 792.0, 72.0, 250_000
SLIDE_SIZE, SLIDE_FONT, FALLBACK_FONT = 18.0, "+mn-lt", "Arial"
LAYERS = ("master", "layout", "slide")


def lookup(key: Column, values: dict, other: str | int | None = None) -> Column:
    """The value of a fixed map, ``other`` for keys that it lacks."""
    pairs = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def number(text: Column) -> Column:
    """A finite number, or null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def round3(x: Column) -> Column:
    """Half away from zero, at three decimals."""
    return F.signum(x) * F.floor(F.abs(x) * 1000.0 + 0.5) / 1000.0


# Requests


def granularity_errors(requests: DataFrame) -> DataFrame:
    """(id, format, granularity) with ``error``: a finer granularity than the format has; none stated means char."""
    spark = requests.sparkSession
    known = F.broadcast(spark.createDataFrame([(f, RANKS[g]) for f, g, _, _ in CAPABILITIES], "format string, finest int"))
    rank = lookup(F.coalesce("granularity", F.lit("char")), RANKS)
    got = requests.join(known, "format", "left").withColumn("rank", rank)
    error = F.when(F.col("finest").isNull(), "unsupported_format").when(F.col("rank").isNull(), "bad_granularity").when(F.col("rank") > F.col("finest"), "granularity_unavailable")
    return got.withColumn("error", error).withColumn("exit_code", lookup(F.col("error"), EXIT_CODES)).drop("finest", "rank")


def page_requests(requests: DataFrame) -> DataFrame:
    """(id, pages, first, last, most) with the pages to read or ``error``: the range is checked before the cap, which counts selected pages."""
    asked = F.col("last").isNotNull()
    begin, end = F.when(asked, F.col("first")).otherwise(1), F.when(asked, F.col("last")).otherwise(F.col("pages"))
    error = F.when(asked & (F.col("last") > F.col("pages")), "page_out_of_range").when(end - begin + 1 > F.col("most"), "too_many_pages")
    return requests.select("id", begin.alias("begin"), end.alias("end"), error.alias("error"), lookup(error, EXIT_CODES).alias("exit_code"))


def sniff_errors(files: DataFrame) -> DataFrame:
    """Files (path, format, length) with ``error``: none of the known formats, legacy or encrypted Office, or more than ``most`` bytes."""
    error = F.when(F.col("length") > F.col("most"), "too_large").when(F.col("format").isNull() | (F.col("format") == "cfb"), "unsupported_format")
    return files.withColumn("error", error)


def content_type(output: Column) -> Column:
    return lookup(output, CONTENT_TYPES)


# Slides


def slide_layers(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """Shapes that a slide shows, master's first, then its layout's, then its own, numbered from 0 in that order.

    shapes: slide, layer, ord, shape, placeholder, hidden.  slides: slide, slide_shows, layout_shows (show their master's
    shapes?): a slide that does not hides both inherited layers, a layout that does not the master.  Hidden shapes and the
    inherited layers' placeholders are left out.
    """
    shown = F.when(F.col("layer") == "master", F.col("slide_shows") & F.col("layout_shows")).when(F.col("layer") == "layout", F.col("slide_shows")).otherwise(True)
    kept = shapes.join(slides, "slide").filter(shown & ~F.col("hidden") & ~(F.col("placeholder") & (F.col("layer") != "slide")))
    order = Window.partitionBy("slide").orderBy(lookup(F.col("layer"), {x: n for n, x in enumerate(LAYERS)}), "ord", "shape")
    return kept.withColumn("number", (F.row_number().over(order) - 1).cast("int")).select("slide", "layer", "shape", "number")


def template_chain(slides: DataFrame, rels: DataFrame) -> DataFrame:
    """(path, part, layout, master, theme) of every slide, by the first internal relationship of each type; null where it ends."""
    out = slides
    for source, target, kind in (("part", "layout", "slideLayout"), ("layout", "master", "slideMaster"), ("master", "theme", "theme")):
        first = rels.filter((F.col("type") == kind) & ~F.col("external")).groupBy("path", F.col("source_part").alias(source)).agg(F.min_by("target", "rel_id").alias(target))
        out = out.join(first, ["path", source], "left")
    return out.select("path", "part", "layout", "master", "theme")


def picture_hashes(blips: DataFrame, rels: DataFrame, media: DataFrame) -> DataFrame:
    """(path, part, rel_id, content_hash): the SHA-256 of each picture's media part; null if it is missing or external."""
    inside = rels.filter(~F.col("external")).select("path", F.col("source_part").alias("part"), "rel_id", F.col("target").alias("name"))
    hashed = media.select("path", "name", F.sha2("bytes", 256).alias("content_hash"))
    return blips.join(inside, ["path", "part", "rel_id"], "left").join(hashed, ["path", "name"], "left").select("path", "part", "rel_id", "content_hash")


def drawing_font(token: Column, face: dict[str, Column]) -> Column:
    """A drawing font: theme tokens give the theme's face, other names stay.  face: major and minor by lt, ea and cs."""
    out = token
    for kind, prefix in (("major", "+mj"), ("minor", "+mn")):
        latin = face[f"{kind}_lt"]
        for script in ("lt", "ea", "cs"):
            out = F.when(token == f"{prefix}-{script}", F.coalesce(face[f"{kind}_{script}"], latin, F.lit(FALLBACK_FONT))).otherwise(out)
    return out


def word_font(token: Column, face: dict[str, Column]) -> Column:
    """A flow document's theme font: null for names that are no token and for empty faces."""
    out = F.when(token.rlike("^[+]m[jn]-(lt|ea|cs)$"), drawing_font(token, face))
    for kind in ("major", "minor"):
        latin = face[f"{kind}_lt"]
        out = F.when(token.isin(f"{kind}Ascii", f"{kind}HAnsi"), latin).otherwise(out)
        out = F.when(token == f"{kind}EastAsia", F.coalesce(face[f"{kind}_ea"], latin)).otherwise(out)
        out = F.when(token == f"{kind}Bidi", F.coalesce(face[f"{kind}_cs"], latin)).otherwise(out)
    return F.when(out != "", out)


def slide_style(layers: list[Column]) -> dict[str, Column]:
    """Each property of the nearest layer that has it: layers are structs of font, size, bold and italic, nearest first."""
    first = lambda name, other: F.coalesce(*(x[name] for x in layers), F.lit(other))
    return {"font": first("font", SLIDE_FONT), "size": first("size", SLIDE_SIZE), "bold": first("bold", False), "italic": first("italic", False)}


def scaled_size(size: Column, scale: Column) -> Column:
    """Points of a size in hundredths, shrunk by a scale in thousandths of a percent (none or no number: as it is)."""
    points = number(size) / 100.0
    return round3(points * F.coalesce(number(scale) / 100_000.0, F.lit(1.0)))


def chart_type(name: Column) -> Column:
    return lookup(name, CHART_TYPES, "other")


def frame_kind(uri: Column) -> Column:
    out = F.lit("graphic")
    for end, kind in FRAME_KINDS.items():
        out = F.when(F.endswith(uri, F.lit(end)), kind).otherwise(out)
    return out


def first_text(*values: Column) -> Column:
    """The first that is neither null nor empty: alternative texts."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


# Flow documents


def paragraph_role(outline: Column, chain: Column, style: Column) -> Column:
    """h1 to h9 by the outline level (direct, else of the nearest style of the chain, which is last), else by the style's name."""
    near = F.try_element_at(F.filter(chain, lambda x: x.isNotNull()), F.lit(-1))
    level = F.coalesce(outline, near)
    name = F.lower(F.regexp_replace(F.coalesce(style, F.lit("")), "[^A-Za-z0-9]", ""))
    return F.when(level.between(0, 8), F.concat(F.lit("h"), (level + 1).cast("string"))).when(name == "title", "title").when(name.isin("quote", "intensequote"), "quote").otherwise("body")


def placement_frame(value: Column) -> Column:
    return lookup(value, PLACEMENT_FRAMES, "paragraph")


def twips(text: Column) -> Column:
    return round3(number(text) / 20.0)


def emu(text: Column) -> Column:
    return round3(number(text) / 12700.0)


def section_length(text: Column, default: float) -> tuple[Column, Column]:
    """Points of a length in twips with its default, and whether it is there but no number."""
    return F.coalesce(twips(text), F.lit(default)), F.coalesce(text.isNotNull() & twips(text).isNull(), F.lit(False))


def section_columns(text: Column) -> tuple[Column, Column]:
    """Columns of a section, null for one, and whether the number is there but invalid."""
    value = F.when(text.rlike("^[+]?[0-9]{1,10}$"), text.try_cast("bigint"))
    value = F.when(value < 2**32, value)
    return F.when(value > 1, value), F.coalesce(text.isNotNull() & (F.coalesce(value, F.lit(0)) == 0), F.lit(False))


def story_cap(blocks: DataFrame, by: list[str], order: list[str], most: int = STORY_BLOCKS) -> DataFrame:
    """The first ``most`` blocks of each story, and whether the story had more."""
    story = Window.partitionBy(*by)
    got = blocks.withColumn("place", F.row_number().over(story.orderBy(*order))).withColumn("cut", F.count("*").over(story) > most)
    return got.filter(F.col("place") <= most).drop("place")


# Glyph objects


def visible_runs(runs: DataFrame) -> DataFrame:
    """Text runs with anything but white space, their ends trimmed on the right."""
    return runs.filter(T.clean_text("content") != "").withColumn("content", F.regexp_replace("content", f"{T.WS}+$", ""))


def color_space(code: Column) -> Column:
    return lookup(code, {n: name for n, name in enumerate(COLOR_SPACES, 1)}, "Unknown")


def bold(weight: Column, name: Column) -> Column:
    """Bold by weight or by the font's name."""
    return F.coalesce(weight >= 600, F.lit(False)) | F.contains(F.lower(name), F.lit("bold"))


def last_styles(glyphs: DataFrame, key: list[str], style: list[str], order: list[str]) -> DataFrame:
    """The style of each key (scaled box and content): of glyphs that share it, the last one's."""
    return glyphs.groupBy(*key).agg(F.max_by(F.struct(*style), F.struct(*order)).alias("style")).select(*key, "style.*")


def element_order(elements: DataFrame, by: list[str], index: str) -> DataFrame:
    """Elements numbered from 0 by their scaled top and left edges, then by ``index``."""
    order = Window.partitionBy(*by).orderBy(G.scaled("y0"), G.scaled("x0"), index)
    return elements.withColumn("number", (F.row_number().over(order) - 1).cast("int"))


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The population deviation of each group, null for a single value."""
    return values.groupBy(*by).agg(F.when(F.count(value) >= 2, F.stddev_pop(value)).alias("spread"))
