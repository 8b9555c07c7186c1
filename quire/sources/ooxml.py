"""Relational extraction over the XML trees of Office packages (``opc.xml_nodes``).

A node's subtree is an interval of its part's document order, so "inside" is a range join within a part, "first" is a
minimum by node, and state that runs through a story (fields) is a fold over its ordered events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import flow
from quire.sources.opc import above, descendants, inside, itself, joined, relationship_id

PART = ["path", "part"]
#: Alternate content that is understood, field and group depth, chart types, error codes with their exit codes.
SUPPORTED = ("wps", "wpg", "wpc", "w14", "w15", "a14", "p14")
FIELD_DEPTH, GROUP_DEPTH = 16, 64
CHARTS = {"barChart": "bar", "pieChart": "pie", "doughnutChart": "doughnut", "lineChart": "line", "areaChart": "area", "scatterChart": "scatter"}


def _attr(name: str, key: str) -> Column:
    """Aggregate: the attribute of the first node of a name."""
    hit = F.when(F.col("name") == name, F.col("attrs")[key])
    return F.min_by(hit, F.when(hit.isNotNull(), F.col("node_id")))


def alternate_content(nodes: DataFrame, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Nodes without the branches not taken: the first choice whose requirements are all supported, else the fallback, else none."""
    outer = nodes.filter("name = 'AlternateContent'").select(*PART, F.col("node_id").alias("owner"))
    branch = nodes.filter("name in ('Choice', 'Fallback')").join(outer, [*PART]).filter("parent_id = owner")
    wanted = F.split(F.trim(F.coalesce(F.col("attrs")["Requires"], F.lit(""))), r"\s+")
    usable = F.when(F.col("name") == "Fallback", F.lit(True)).otherwise((F.size(wanted) > 0) & F.forall(wanted, lambda x: x.isin(*supported)))
    ranked = branch.withColumn("usable", usable).withColumn("taken", F.row_number().over(Window.partitionBy(*PART, "owner").orderBy(~F.col("usable"), F.col("name") == "Fallback", "node_id")))
    dropped = ranked.filter("not (usable and taken = 1)").select(*PART, F.col("node_id").alias("d_id"), F.col("last_id").alias("d_last"))
    return nodes.join(dropped, (nodes["path"] == dropped["path"]) & (nodes["part"] == dropped["part"]) & F.col("node_id").between(F.col("d_id"), F.col("d_last")), "left_anti")


def without(nodes: DataFrame, gone: Column) -> DataFrame:
    """Nodes without the subtrees of some (hidden shapes, deleted runs, template placeholders)."""
    d = nodes.filter(gone).select(F.col("path").alias("d_path"), F.col("part").alias("d_part"), F.col("node_id").alias("d_id"), F.col("last_id").alias("d_last"))
    return nodes.join(d, (F.col("path") == F.col("d_path")) & (F.col("part") == F.col("d_part")) & F.col("node_id").between(F.col("d_id"), F.col("d_last")), "left_anti")


def field_events(nodes: DataFrame) -> DataFrame:
    """(path, part, ord, event, text) of field marks, instructions and text, in document order."""
    kind = (
        F.when(F.col("name") == "fldChar", F.col("attrs")["fldCharType"])
        .when(F.col("name") == "instrText", "instruction")
        .when(F.col("name") == "t", "text").when(F.col("name") == "tab", "text").when(F.col("name").isin("br", "cr"), "text")
    )
    text = F.when(F.col("name").isin("t", "instrText"), F.col("text")).when(F.col("name") == "tab", "\t").when(F.col("name").isin("br", "cr"), "\n").otherwise("")
    return nodes.withColumn("event", kind).filter("event is not null").select(*PART, F.col("node_id").alias("ord"), "event", text.alias("text"))


def visible_text(events: DataFrame, by: list[str]) -> DataFrame:
    """Text events with ``visible``: text shows if all open fields are past their separators; fields deeper than FIELD_DEPTH are ignored.

    The state runs through a whole story, over its paragraphs; it is a stack of one flag for each open field.
    """
    item = F.struct("ord", "event")
    start = F.struct(F.array().cast("array<boolean>").alias("stack"), F.lit(0).alias("over"), F.array().cast("array<struct<ord:bigint,visible:boolean>>").alias("out"))

    def fold(acc: Column, e: Column) -> Column:
        stack, over, n = acc["stack"], acc["over"], F.size(acc["stack"])
        full = n >= FIELD_DEPTH
        shorter = F.when(n > 0, F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(stack)
        new = (
            F.when((e["event"] == "begin") & ~full, F.concat(stack, F.array(F.lit(False))))
            .when((e["event"] == "separate") & (over == 0) & (n > 0), F.concat(shorter, F.array(F.lit(True))))
            .when((e["event"] == "end") & (over == 0), shorter).otherwise(stack)
        )
        beyond = F.when((e["event"] == "begin") & full, over + 1).when((e["event"] == "end") & (over > 0), over - 1).otherwise(over)
        shown = F.array(F.struct(e["ord"].cast("bigint").alias("ord"), F.forall(stack, lambda x: x).alias("visible")))
        return F.struct(new.alias("stack"), beyond.cast("int").alias("over"), F.when(e["event"] == "text", F.concat(acc["out"], shown)).otherwise(acc["out"]).alias("out"))

    rest = [c for c in events.columns if c not in (*by, "ord")]
    held = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "event", F.struct(*rest).alias("row")))).alias("q"))
    flags = F.aggregate(F.transform("q", lambda e: F.struct(e["ord"].alias("ord"), e["event"].alias("event"))), start, fold)["out"]
    shown = held.select(*by, F.explode(F.arrays_zip(F.filter("q", lambda e: e["event"] == "text").alias("e"), flags.alias("f"))).alias("z"))
    return shown.select(*by, "z.e.ord", "z.e.row.*", "z.f.visible")


def field_instructions(events: DataFrame, by: list[str]) -> DataFrame:
    """Instructions of outermost fields, each joined from its pieces."""
    order = Window.partitionBy(*by).orderBy("ord")
    opened = F.sum((F.col("event") == "begin").cast("int")).over(order)
    closed = F.sum((F.col("event") == "end").cast("int")).over(order)
    outer = F.sum(F.when((F.col("event") == "begin") & (F.col("opened") - F.col("closed") == 1), 1).otherwise(0)).over(order)
    numbered = events.withColumn("opened", opened).withColumn("closed", closed).withColumn("field", outer)
    pieces = numbered.filter("event = 'instruction' and opened - closed = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return pieces.groupBy(*by, "field").agg(F.trim(text).alias("instruction"))


def _piece() -> Column:
    """(node_id, t) of an element that has or separates text, else null."""
    t = F.when(F.col("name") == "t", F.col("text")).when(F.col("name") == "tab", "\t").when(F.col("name").isin("br", "p"), "\n")
    return F.when(t.isNotNull(), F.struct("node_id", t.alias("t")))


def _story(pieces: Column) -> Column:
    """Text of ``_piece``s, paragraphs by line feeds; null without any."""
    return F.when(F.size(pieces) > 0, F.regexp_replace(joined(pieces), r"^\n+|\n+$", ""))


def notes(nodes: DataFrame) -> DataFrame:
    """(path, kind, id, content, missing): referenced footnotes, endnotes and comments, each once, in order of first reference."""
    refs = {"footnoteReference": "footnote", "endnoteReference": "endnote", "commentReference": "comment"}
    names = list(refs.values())
    kind = F.create_map(*(F.lit(x) for kv in refs.items() for x in kv))
    asked = F.col("part") == "word/document.xml"
    of_notes = F.col("part").isin("word/footnotes.xml", "word/endnotes.xml", "word/comments.xml")
    named = nodes.filter((asked & F.col("name").isin(*refs)) | (of_notes & F.col("name").isin("t", "tab", "br", "p", *names)))
    roots = F.when(asked, F.array("node_id")).otherwise(F.concat(above(*names), itself(*names)))
    each = named.select(*PART, "node_id", F.coalesce(F.try_element_at(kind, F.col("name")), F.col("name")).alias("kind"), F.col("attrs")["id"].alias("id"), _piece().alias("piece"), F.explode(roots).alias("root_id")).repartition("path")
    own = F.col("node_id") == F.col("root_id")
    found = each.groupBy(*PART, "root_id").agg(F.max(F.when(own, F.col("kind"))).alias("kind"), F.max(F.when(own, F.col("id"))).alias("id"), F.collect_list(F.when(~own, F.col("piece"))).alias("q"))
    found = found.filter(asked | ~F.startswith(F.col("id"), F.lit("-")))
    got = found.groupBy("path", "kind", "id").agg(F.min(F.when(asked, F.col("root_id"))).alias("first"), F.flatten(F.collect_list("q")).alias("q")).filter("first is not null")
    order = Window.partitionBy("path").orderBy("first")
    content = _story(F.col("q"))
    return got.select("path", "kind", "id", content.alias("content"), content.isNull().alias("missing"), (F.row_number().over(order) - 1).alias("ord"))


def stories(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(path, section, kind, variant, content) of header and footer stories, by the sections that refer to them."""
    of_doc = F.col("part") == "word/document.xml"
    is_ref = of_doc & F.col("name").isin("headerReference", "footerReference")
    sections = F.when(of_doc & (F.col("name") == "sectPr"), F.col("node_id"))
    asks = F.transform(above("sectPr"), lambda r: F.struct(r.alias("root_id"), F.regexp_replace("name", "Reference$", "").alias("kind"), F.coalesce(F.col("attrs")["type"], F.lit("default")).alias("variant"), relationship_id().alias("rel_id")))
    each = nodes.select(*PART, sections.alias("sect"), F.when(is_ref, asks).alias("asked"), F.when(F.col("parent_id").isNotNull(), _piece()).alias("piece")).filter("sect is not null or asked is not null or piece is not null").repartition("path")
    parts = each.groupBy(*PART).agg(F.array_sort(F.collect_list("sect")).alias("sects"), F.flatten(F.collect_list("asked")).alias("asked"), F.collect_list("piece").alias("q"))
    story = F.struct(F.col("part").alias("story"), _story(F.col("q")).alias("content"))
    whole = parts.groupBy("path").agg(F.flatten(F.collect_list("sects")).alias("sects"), F.flatten(F.collect_list("asked")).alias("asked"), F.collect_list(story).alias("stories")).filter("size(asked) > 0")
    target = rels.filter("source_part = 'word/document.xml'").repartition("path").groupBy("path").agg(F.collect_list(F.struct("rel_id", F.col("target").alias("story"))).alias("targets"))
    both = whole.hint("merge").join(target, "path").withColumn("by_part", F.map_from_entries("stories"))
    content = lambda t: F.when(t["story"].isNotNull(), F.try_element_at("by_part", t["story"]))
    told = lambda a, t: F.struct((F.array_position("sects", a["root_id"]) - 1).cast("int").alias("section"), a["kind"].alias("kind"), a["variant"].alias("variant"), content(t).alias("content"))
    matched = F.flatten(F.transform("asked", lambda a: F.transform(F.filter("targets", lambda t: t["rel_id"] == a["rel_id"]), lambda t: told(a, t))))
    return both.select("path", F.explode(matched).alias("s")).select("path", "s.*")


def charts(nodes: DataFrame) -> dict[str, DataFrame]:
    """``charts`` (path, part, type, title) and ``points`` (path, part, series, name, idx, category, value, place) of chart parts."""
    own = nodes.filter("part like '%/charts/chart%.xml'")
    kinds = F.create_map(*(F.lit(x) for kv in CHARTS.items() for x in kv))
    titled = F.col("trail").rlike("^([0-9]+:[^/]*/){2}[0-9]+:title/")
    chart = F.when(F.col("name").rlike("Chart$"), F.struct("node_id", "name"))
    heads = own.select(*PART, chart.alias("chart"), F.when(titled, _piece()).alias("piece")).filter("chart is not null or piece is not null").repartition(*PART).groupBy(*PART).agg(F.min("chart")["name"].alias("k"), F.collect_list("piece").alias("q")).filter("k is not null")
    heads = heads.select(*PART, F.coalesce(F.try_element_at(kinds, F.col("k")), F.lit("other")).alias("type"), _story(F.col("q")).alias("title"))

    # values and points with the points' own places, then with the series above them
    named = own.filter(F.col("name").isin("ser", "pt", "v", "formatCode"))
    keys = F.concat(F.when(F.col("name") == "v", above("pt")).otherwise(F.array().cast("array<bigint>")), F.array("node_id"))
    each = named.select(*PART, "node_id", "name", "text", "trail", F.expr("try_cast(attrs['idx'] as bigint)").alias("idx"), F.explode(keys).alias("key")).repartition(*PART)
    itself_ = F.col("node_id") == F.col("key")
    held = each.groupBy(*PART, "key").agg(F.max(F.when(itself_, F.struct("name", "trail", "idx", "text"))).alias("e"), F.min(F.when(~itself_ & (F.col("text") != ""), F.struct("node_id", "text"))).alias("raw"))
    held = held.select(*PART, "key", "e.*", "raw").withColumn("node_id", F.col("key"))
    by = [*PART, "ser"]
    held = held.select(*PART, "key", "name", "trail", "idx", "text", "raw", F.explode(F.concat(above("ser"), itself("ser"))).alias("ser"))
    held = held.withColumn("below", F.expr("substring_index(concat('/', trail), concat('/', cast(ser as string), ':ser/'), -1)")).withColumn("idx", F.when(F.col("name") == "pt", F.col("idx")))
    within = lambda name: inside(name, trail="below")
    first = lambda fits: F.min(F.when(fits, F.struct("key", "text")))["text"]
    point = lambda name: F.min(F.when(F.col("idx").isNotNull() & within(name), F.col("raw")))["text"]
    got = held.groupBy(*by, "idx").agg(point("val").alias("raw"), point("cat").alias("category"), first((F.col("name") == "formatCode") & within("val")).alias("code"), first((F.col("name") == "v") & within("tx")).alias("name"))
    series = Window.partitionBy(*by)
    got = got.withColumn("series", F.dense_rank().over(Window.partitionBy(*PART).orderBy("ser")) - 1).withColumn("code", F.max("code").over(series)).withColumn("name", F.max("name").over(series)).withColumn("number", F.expr("try_cast(raw as double)"))
    values = got.filter("idx is not null and number is not null and not isnan(number) and abs(number) < double('infinity')")
    values = values.withColumn("value", flow.chart_number(F.col("number"), F.coalesce("code", F.lit("General"))))
    return {"charts": heads, "points": flow.placed(values, by).select(*PART, "series", "idx", "value", "category", "place", "name")}


def grids(nodes: DataFrame) -> DataFrame:
    """(path, part, table, row, col, row_span, col_span, content) of slide tables; cells that continue a merge are left out.

    Tables, rows and cells are numbered among their siblings, so rows of a table and of a row stand before what they hold.
    """
    named = nodes.filter(F.col("name").isin("tbl", "t", "tab", "br", "p") | ((F.col("name") == "tr") & F.col("trail").rlike("(?<![^/])[0-9]+:tbl/$")) | ((F.col("name") == "tc") & F.col("trail").rlike("(?<![^/])[0-9]+:tbl/[0-9]+:tr/$")))
    keys = F.when(F.col("name").isin("tbl", "tr", "tc"), F.array("node_id")).otherwise(above("tc"))
    on = lambda key: F.coalesce(F.col("attrs")[key].isin("1", "true", "on"), F.lit(False))
    span = lambda key: F.least(F.greatest(F.coalesce(F.expr(f"try_cast(attrs['{key}'] as int)"), F.lit(1)), F.lit(1)), F.lit(10_000))
    tbl = F.when(F.col("name") == "tbl", F.col("node_id")).when(F.col("name") == "tr", F.col("parent_id")).otherwise(F.regexp_extract("trail", "([0-9]+):tbl/[0-9]+:tr/$", 1).cast("bigint"))
    tr = F.when(F.col("name") == "tr", F.col("node_id")).when(F.col("name") == "tc", F.col("parent_id"))
    head = F.when(F.col("name").isin("tbl", "tr", "tc"), F.struct(tbl.alias("tbl"), tr.alias("tr"), F.when(F.col("name") == "tc", F.col("node_id")).alias("tc"), (on("hMerge") | on("vMerge")).alias("merged"), span("rowSpan").alias("row_span"), span("gridSpan").alias("col_span")))
    each = named.select(*PART, head.alias("head"), _piece().alias("piece"), F.explode(keys).alias("key")).repartition(*PART)
    cells = each.groupBy(*PART, "key").agg(F.max("head").alias("head"), F.collect_list("piece").alias("q")).filter("head is not null").select(*PART, "head.*", "q")
    place = lambda by, c, less: F.dense_rank().over(Window.partitionBy(*PART, *by).orderBy(c)) - less
    cells = cells.select("*", place([], "tbl", 1).alias("table")).select("*", place(["tbl"], "tr", 2).alias("row")).select("*", place(["tbl", "tr"], "tc", 2).alias("col"))
    return cells.filter("tc is not null and not merged").select(*PART, "table", "row", "col", "row_span", "col_span", F.coalesce(_story(F.col("q")), F.lit("")).alias("content"))


def group_boxes(nodes: DataFrame) -> DataFrame:
    """(path, part, node_id, x0, y0, x1, y1 in points) of shapes under the transforms of all their groups, innermost first."""
    shape = nodes.filter("name in ('sp', 'pic', 'cxnSp', 'graphicFrame')")
    geometry = descendants(nodes, shape).filter("name in ('off', 'ext')").groupBy(*PART, "root_id").agg(
        *(_attr(n, k).cast("double").alias(k) for n, k in (("off", "x"), ("off", "y"), ("ext", "cx"), ("ext", "cy")))
    ).withColumnRenamed("root_id", "node_id")
    group = nodes.filter("name = 'grpSp'").select(*PART, "node_id", "last_id", "depth")
    own = nodes.filter("name in ('off', 'ext', 'chOff', 'chExt')").join(nodes.filter("name = 'xfrm'").select(*PART, F.col("node_id").alias("parent_id"), F.col("parent_id").alias("props")), [*PART, "parent_id"])
    own = own.join(nodes.filter("name = 'grpSpPr'").select(*PART, F.col("node_id").alias("props"), F.col("parent_id").alias("owner")), [*PART, "props"])
    pick = lambda n, k, a: F.max(F.when(F.col("name") == n, F.col("attrs")[k])).cast("double").alias(a)
    frame = own.groupBy(*PART, "owner").agg(*(pick(n, k, n + k) for n, keys in (("off", "xy"), ("chOff", "xy")) for k in keys), *(pick(n, k, n + k) for n in ("ext", "chExt") for k in ("cx", "cy")))
    frames = group.join(frame, (group["path"] == frame["path"]) & (group["part"] == frame["part"]) & (F.col("node_id") == F.col("owner"))).select(group["path"], group["part"], F.col("node_id").alias("g"), F.col("last_id").alias("g_last"), "depth", *(c for c in frame.columns if c not in (*PART, "owner"))).filter("chExtcx <> 0 and chExtcy <> 0")
    steps = shape.select(*PART, "node_id").join(frames, PART).filter("node_id > g and node_id <= g_last")
    one = F.struct((-F.col("depth")).alias("d"), *(F.col(c) for c in ("offx", "offy", "extcx", "extcy", "chOffx", "chOffy", "chExtcx", "chExtcy")))
    chain = steps.groupBy(*PART, "node_id").agg(F.slice(F.array_sort(F.collect_list(one)), F.lit(1), F.lit(GROUP_DEPTH)).alias("chain"))
    every = geometry.join(chain, [*PART, "node_id"], "left").filter("x is not null and cx is not null")

    def through(x: Column, y: Column) -> Column:
        start = F.struct(x.alias("x"), y.alias("y"))
        step = lambda p, g: F.struct((g["offx"] + (p["x"] - g["chOffx"]) * g["extcx"] / g["chExtcx"]).alias("x"), (g["offy"] + (p["y"] - g["chOffy"]) * g["extcy"] / g["chExtcy"]).alias("y"))
        return F.when(F.col("chain").isNull(), start).otherwise(F.aggregate("chain", start, step))

    a, b = through(F.col("x"), F.col("y")), through(F.col("x") + F.col("cx"), F.col("y") + F.col("cy"))
    pt = lambda f, c: (f(a[c], b[c]) / 12700.0).alias(f"{c}{0 if f is F.least else 1}")
    return every.select(*PART, "node_id", pt(F.least, "x"), pt(F.least, "y"), pt(F.greatest, "x"), pt(F.greatest, "y"))


def placeholder_match(slide: DataFrame, template: DataFrame) -> DataFrame:
    """Slide placeholders (path, page, ord, idx, kind) with the template's one: by index if they have it, else by kind; titles of either kind match."""
    same_kind = lambda c: F.when(F.col(c).isin("title", "ctrTitle"), "title").otherwise(F.col(c))
    t = template.select(F.col("path").alias("t_path"), F.col("page").alias("t_page"), F.col("ord").alias("t_ord"), F.col("idx").alias("t_idx"), same_kind("kind").alias("t_kind"))
    fits = F.when(F.col("idx").isNotNull(), F.col("idx") == F.col("t_idx")).otherwise(same_kind("kind") == F.col("t_kind"))
    hit = slide.join(t, (F.col("path") == F.col("t_path")) & (F.col("page") == F.col("t_page")) & fits)
    return hit.groupBy(*slide.columns).agg(F.min("t_ord").alias("template"))


#: Error codes, their exit codes and their HTTP statuses.
ERRORS = (
    ("unsupported_format", 2, 415), ("encrypted_pdf", 3, 422), ("parse_failure", 4, 422), ("io_error", 5, 500), ("too_many_pages", 6, 413), ("bad_format", 7, 400), ("bad_pages", 7, 400),
    ("granularity_unavailable", 8, 400), ("page_out_of_range", 9, 400), ("page_selection_unsupported", 10, 400), ("timeout", 1, 504), ("crash", 1, 500), ("output_too_large", 1, 500), ("internal", 1, 500),
)


def error_rows(failed: DataFrame) -> DataFrame:
    """(path, code, message) with exit codes and statuses; an unknown code is internal.  The dimension has a fixed, small size."""
    dim = failed.sparkSession.createDataFrame(ERRORS, "code string, exit_code int, status int")
    known = F.when(F.col("code").isin(*(c for c, _, _ in ERRORS)), F.col("code")).otherwise("internal")
    return failed.withColumn("code", known).join(F.broadcast(dim), "code")
