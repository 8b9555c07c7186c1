"""Nested page records as JSON: schema, reader, normalised tables, and back.

A record has one document: source, metadata, warnings and pages of elements.  ``tables`` flattens it into relations that
the operators work on; places in arrays become explicit orders, so nothing depends on row order later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_FONT = "struct<name:string,size:double,bold:boolean,italic:boolean>"
_COLOR = "struct<fill:array<smallint>,stroke:array<smallint>>"
_RUN = f"struct<content:string,font:{_FONT},color:{_COLOR},href:string>"
_GLYPH = f"struct<content:string,bbox:{_BOX},unicode:bigint>"
_WORD = f"struct<content:string,bbox:{_BOX},chars:array<{_GLYPH}>>"
_LINE = f"struct<bbox:{_BOX},baseline_y:double,words:array<{_WORD}>>"
_CELL = f"struct<bbox:{_BOX},`row`:int,col:int,row_span:int,col_span:int,content:string,runs:array<{_RUN}>>"
_SERIES = "struct<name:string,points:array<struct<category:string,value:string>>>"
_ELEMENT = (
    f"struct<type:string,id:string,bbox:{_BOX},content:string,font:{_FONT},color:{_COLOR},lines:array<{_LINE}>,runs:array<{_RUN}>,`rows`:int,cols:int,cells:array<{_CELL}>,"
    f"chart_type:string,title:string,series:array<{_SERIES}>,quad:array<array<double>>,pixel_width:int,pixel_height:int,colorspace:string,content_hash:string,fill:array<smallint>,stroke:array<smallint>,stroke_width:double,subtype:string,uri:string>"
)
_HIDDEN = "struct<kind:string,element:string,content:string>"
_CLASS = "struct<kind:string,confidence:double,needs_ocr:boolean,reasons:array<string>>"
#: The record's columns: explicit, never inferred.
SCHEMA = (
    "granularity string, schema_version string, source struct<format:string,sha256:string,size_bytes:bigint>, document struct<page_count:int,metadata:struct<title:string,author:string>>, warnings array<string>, "
    f"pages array<struct<page_number:int,width:double,height:double,rotation:int,scanned:boolean,classification:{_CLASS},elements:array<{_ELEMENT}>,hidden:array<{_HIDDEN}>>>"
)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records of JSON files (one document each) with doc_id (the file's name), of selected pages only if asked."""
    got = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    if first is None:
        return got
    return got.withColumn("pages", F.filter("pages", lambda p: p["page_number"].between(first, last or first)))


def _flat_box(c: str = "e.bbox") -> list:
    return [F.col(f"{c}.{n}").alias(n) for n in G.BOX]


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """documents, warnings, pages, elements, boxes, texts, glyphs, words, runs, cells, points, paths, annotations, hidden."""
    page = records.select("doc_id", F.col("source.format").alias("format"), F.explode("pages").alias("p"))
    element = page.select("doc_id", "format", F.col("p.page_number").alias("page"), F.posexplode("p.elements").alias("place", "e")).withColumn("element", F.col("e.id"))
    key = ["doc_id", "page", "place", "element"]
    font = [F.col("e.font.name").alias("font"), F.col("e.font.size").alias("size"), F.col("e.font.bold").alias("bold"), F.col("e.font.italic").alias("italic"), F.col("e.color.fill").alias("fill")]
    line = element.filter("e.type = 'text'").select(*key, F.col("e.font.size").alias("font_size"), F.posexplode("e.lines").alias("line", "l"))
    word = line.select(*key, "font_size", "line", F.col("l.baseline_y").alias("baseline"), F.posexplode("l.words").alias("w", "x"))
    glyph = word.select(*key, "font_size", "line", "baseline", "w", F.posexplode("x.chars").alias("k", "g"))
    ord_ = (F.col("line") * 1_000_000 + F.col("w") * 1000 + F.col("k")).cast("int")
    glyphs = glyph.select(*key, "line", "w", ord_.alias("ord"), F.col("g.content").alias("content"), F.col("g.unicode").alias("unicode"), *_flat_box("g.bbox"), "font_size", "baseline")
    characters = F.when(F.col("e.type") == "table", F.aggregate(F.coalesce("e.cells", F.array().cast(f"array<{_CELL}>")), F.lit(0), lambda s, c: s + F.length(c["content"]))).otherwise(F.coalesce(F.length("e.content"), F.lit(0)))
    boxes = element.select(*key, F.col("e.type").alias("kind"), *_flat_box(), characters.alias("characters"), F.col("e.rows").alias("n_rows"), F.col("e.cols").alias("n_cols"), F.coalesce("e.subtype", "e.chart_type").alias("subtype"), F.col("e.title").alias("title"), F.col("e.uri").alias("uri"))
    run = lambda df, extra, col: df.select(*key, *extra, F.posexplode(col).alias("run", "r")).select(*key, *extra, "run", F.col("r.content").alias("content"), F.col("r.font.name").alias("font"), F.col("r.font.size").alias("size"), F.col("r.font.bold").alias("bold"), F.col("r.font.italic").alias("italic"), F.col("r.color.fill").alias("fill"), F.col("r.href").alias("href"))
    cell = element.filter("e.type = 'table'").select(*key, F.posexplode("e.cells").alias("cell", "c"))
    first = F.get("c.runs", F.lit(0))
    point = element.filter("e.type = 'chart'").select(*key, F.posexplode("e.series").alias("series", "s"))
    named = F.concat(F.when(F.col("s.name").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<category:string,value:string>>")), F.col("s.points"))
    detailed = F.exists("pages", lambda p: F.exists(p["elements"], lambda e: e["type"].isin("table", "chart") | ((e["type"] == "text") & e["runs"].isNotNull())))
    counts = [F.greatest(F.size("pages"), F.lit(0)).alias("n_parts"), F.greatest(F.size("warnings"), F.lit(0)).alias("n_warnings"), F.coalesce(F.exists("pages", lambda p: F.size(p["hidden"]) > 0), F.lit(False)).alias("any_hidden"), F.coalesce(detailed, F.lit(False)).alias("detailed")]
    return {
        "documents": records.select("doc_id", "granularity", "schema_version", "source.*", "document.page_count", "document.metadata.title", "document.metadata.author", *counts),
        "warnings": records.select("doc_id", F.posexplode("warnings").alias("ord", "message")),
        "pages": page.select("doc_id", "format", F.col("p.page_number").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.col("p.rotation").alias("rotation"), F.col("p.scanned").alias("scanned")),
        "boxes": boxes,
        "texts": element.filter("e.type = 'text'").select(*key, F.col("e.content").alias("content"), *_flat_box(), *font),
        "glyphs": glyphs,
        "words": word.select(*key, (F.col("line") * 10_000 + F.col("w")).alias("word"), F.col("x.content").alias("content"), *_flat_box("x.bbox")),
        "runs": run(element.filter("e.type = 'text'"), [], "e.runs"),
        "cells": cell.select(*key, "cell", *_flat_box("c.bbox"), "c.row", "c.col", "c.row_span", "c.col_span", "c.content", first["font"]["name"].alias("font"), first["font"]["size"].alias("size"), first["font"]["bold"].alias("bold"), first["font"]["italic"].alias("italic"), first["color"]["fill"].alias("fill")),
        "cell_runs": run(cell, ["cell"], "c.runs"),
        "points": point.select(*key, "series", F.col("s.name").alias("name"), F.posexplode(named).alias("n", "q")).select(*key, "name", (F.col("series") * 100_000 + F.col("n")).alias("step"), "q.category", F.when((F.col("n") == 0) & F.col("name").isNotNull(), None).otherwise(F.col("q.value")).alias("value")),
        "paths": element.filter("e.type = 'path'").select(*key, *_flat_box(), F.col("e.stroke").isNotNull().alias("stroked"), F.col("e.fill").isNotNull().alias("filled"), F.col("e.stroke_width").alias("stroke_width")),
        "annotations": element.filter("e.type = 'annotation'").select(*key, *_flat_box(), F.col("e.subtype").alias("subtype"), F.col("e.uri").alias("uri")),
        "hidden": page.select("doc_id", F.col("p.page_number").alias("page"), F.posexplode("p.hidden").alias("ord", "h")).select("doc_id", "page", "ord", "h.*"),
    }


def garbled_warnings(warnings: DataFrame) -> DataFrame:
    """Keys of pages that a warning calls garbled."""
    got = warnings.withColumn("page", F.regexp_extract("message", r"^page ([0-9]+): suspected_garbled_text:", 1)).filter("page <> ''")
    return got.select("doc_id", F.col("page").cast("int").alias("page"))


def _json(c: Column) -> Column:
    """JSON of a value with the null fields of structs; null for null."""
    whole = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.substr(whole, F.lit(2), F.length(whole) - 2))


def _member(name: str, json: Column, null: bool = False) -> Column:
    """A member of an object; one without value is left out, or null if so asked."""
    return F.concat(F.lit(f'"{name}":'), F.coalesce(json, F.lit("null")) if null else json)


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def with_classes(records: DataFrame, classes: DataFrame) -> DataFrame:
    """Records with a map of each page's class (as of ``pages.classify``) for ``full`` and ``compact``."""
    entry = F.struct("page", F.struct("kind", "confidence", "needs_ocr", "reasons").alias("c"))
    return records.join(classes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("classes")), "doc_id", "left")


def full(records: DataFrame, explicit: bool = False) -> DataFrame:
    """(doc_id, json): whole records down to glyphs, members in schema order.

    Version 1.1, 1.6 with the granularity named if it was asked for (``explicit``), 1.8 with page classes if the records
    have them.  Optional members without value are left out, others are null.  Hex digits of escapes are upper case.
    """
    classified = "classes" in records.columns
    plain = lambda e, *names, null=False: [_member(n, _json(e[n]), null) for n in names]
    run = lambda r: _object(*plain(r, "content", "font", "color", "href"))
    runs = lambda e: _member("runs", _list(F.transform(e["runs"], run)))
    cell = lambda c: _object(*plain(c, "bbox", "row", "col", "row_span", "col_span", "content"), runs(c))
    kinds = {
        "text": lambda e: [*plain(e, "content", "font", "color", "lines"), runs(e)],
        "table": lambda e: [*plain(e, "rows", "cols"), _member("cells", _list(F.transform(e["cells"], cell)))],
        "chart": lambda e: [*plain(e, "chart_type", "title"), _member("series", F.to_json(e["series"]))],
        "image": lambda e: plain(e, "quad", "pixel_width", "pixel_height", "colorspace", "content_hash", null=True),
        "path": lambda e: plain(e, "fill", "stroke", "stroke_width", null=True),
        "annotation": lambda e: [*plain(e, "subtype"), *plain(e, "uri", null=True)],
    }

    def element(e: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, members in reversed(kinds.items()):
            out = F.when(e["type"] == kind, _object(*plain(e, "type", "id", "bbox"), *members(e))).otherwise(out)
        return out

    def page(p: Column) -> Column:
        kind = [_member("classification", _json(F.try_element_at("classes", p["page_number"])))] if classified else []
        hidden = _member("hidden", F.when(F.size(p["hidden"]) > 0, F.to_json(p["hidden"])))
        return _object(*plain(p, "page_number", "width", "height", "rotation", "scanned"), *kind, _member("elements", _list(F.transform(p["elements"], element))), hidden)

    head = [_member("granularity", F.lit('"char"'))] if explicit else []
    head += [_member("schema_version", F.lit('"1.8"' if classified else '"1.6"' if explicit else '"1.1"')), _member("source", _json(F.col("source"))), _member("document", _json(F.col("document")))]
    warnings = F.to_json("warnings")
    if explicit and not classified:
        warnings = F.when(F.size("warnings") > 0, warnings)
    return records.select("doc_id", _object(*head, _member("warnings", warnings), _member("pages", _list(F.transform("pages", page)))).alias("json"))


def compact(records: DataFrame, words: bool = False) -> DataFrame:
    """(doc_id, json): the compact projection at element or word granularity, boxes to one decimal; black, false and absent fields left out.

    Version 1.9, or 1.8 with page classes and all warnings if the records have classes.
    """
    classified = "classes" in records.columns
    kind = lambda p: [F.try_element_at("classes", p["page_number"]).alias("classification")] if classified else []
    box = lambda b: F.array(*(G.round1(b[n]) for n in G.BOX))
    black = lambda c: F.when(c.isNotNull() & (c != F.array(*[F.lit(0).cast("smallint")] * 3)), c)
    color = lambda c: F.when(black(c["fill"]).isNotNull() | black(c["stroke"]).isNotNull(), F.struct(black(c["fill"]).alias("fill"), black(c["stroke"]).alias("stroke")))
    true = lambda c: F.when(c, c)
    font = lambda f: F.when(f.isNotNull(), F.struct(f["name"].alias("name"), f["size"].alias("size"), true(f["bold"]).alias("bold"), true(f["italic"]).alias("italic")))
    run = lambda r: F.struct(r["content"].alias("content"), font(r["font"]).alias("font"), color(r["color"]).alias("color"), r["href"].alias("href"))
    cell = lambda c: F.struct(box(c["bbox"]).alias("bbox"), *(c[n].alias(n) for n in ("row", "col", "row_span", "col_span", "content")), F.transform(c["runs"], run).alias("runs"))
    is_ = lambda e, *kinds: e["type"].isin(*kinds)
    if words:
        number = lambda v: F.to_json(F.array(G.round1(v)))
        item = lambda w: F.concat(F.lit("["), F.substr(F.to_json(F.array(w["content"])), F.lit(2), F.length(F.to_json(F.array(w["content"]))) - 2), *(F.concat(F.lit(","), F.regexp_extract(number(w["bbox"][n]), r"^\[(.*)\]$", 1)) for n in G.BOX), F.lit("]"))
        text = lambda e: F.when(is_(e, "text"), F.concat(F.lit("\x01["), F.array_join(F.flatten(F.transform(F.coalesce(e["lines"], F.array().cast(f"array<{_LINE}>")), lambda line: F.transform(line["words"], item))), ","), F.lit("]\x01")))
    else:
        text = lambda e: F.when(is_(e, "text"), e["content"])
    element = lambda e: F.struct(
        e["type"].alias("type"), box(e["bbox"]).alias("bbox"), text(e).alias("words" if words else "text"), font(e["font"]).alias("font"), F.when(is_(e, "text"), color(e["color"])).alias("color"), F.transform(e["runs"], run).alias("runs"),
        e["rows"].alias("rows"), e["cols"].alias("cols"), F.transform(e["cells"], cell).alias("cells"), e["chart_type"].alias("chart_type"), F.when(is_(e, "chart"), e["title"]).alias("title"), e["series"].alias("series"),
        e["fill"].alias("fill"), e["stroke"].alias("stroke"), G.round1(e["stroke_width"]).alias("stroke_width"), e["subtype"].alias("subtype"), e["uri"].alias("uri"),
    )
    page = lambda p: F.struct(*(p[n].alias(n) for n in ("page_number", "width", "height", "rotation", "scanned")), *kind(p), F.transform(p["elements"], element).alias("elements"), F.when(F.size(p["hidden"]) > 0, p["hidden"]).alias("hidden"))
    whole = F.struct(F.lit("word" if words else "element").alias("granularity"), F.lit("1.8" if classified else "1.9").alias("schema_version"), "source", "document", F.when(F.lit(classified) | (F.size("warnings") > 0), F.col("warnings")).alias("warnings"), F.transform("pages", page).alias("pages"))
    json = F.to_json(whole)
    if words:  # the marked strings are arrays of tuples, which have no Spark type: their quotes go, and what JSON escaped in them
        parts = F.split(json, r'"\\u0001|\\u0001"', -1)
        json = F.array_join(F.transform(parts, lambda s, n: F.when(n % 2 == 1, F.regexp_replace(s, r'\\(["\\])', "$1")).otherwise(s)), "")
    return records.select("doc_id", json.alias("json"))
