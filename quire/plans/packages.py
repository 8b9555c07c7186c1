"""Queries over Office packages, records and drawn pages, one made of each row of ``part``, with the rows that their oracle SQL expects of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import document, lean, tables
from quire.plans.registry import query
from quire.session import spread, table
from quire.sources import ooxml, opc, records

_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _xml(text: str) -> Column:
    """Text with columns of ``part`` in braces."""
    pieces = []
    for n, piece in enumerate(text.replace("{", "\0").replace("}", "\0").split("\0")):
        pieces.append(F.expr(piece).cast("string") if n % 2 else F.lit(piece))
    return F.concat(*pieces)


def _nodes(spark: SparkSession, sf: str, **files: Column) -> DataFrame:
    """The elements of packages with these parts; a part that is null for a row is not there."""
    rows = spread(table(spark, sf, "part"))
    parts = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), text.cast("binary").alias("bytes")) for name, text in files.items())))
    found = rows.select(F.col("p_partkey").cast("string").alias("path"), parts.alias("p")).select("path", "p.name", "p.bytes", F.lit(None).cast("string").alias("error"))
    return opc.xml_nodes(found.filter("bytes is not null"))


def _body(text: str) -> Column:
    return _xml(f'<w:document xmlns:w="w" {_R}><w:body>{text}</w:body></w:document>')


_PARAGRAPHS = (
    '<w:p><w:pPr><w:pStyle w:val="S{p_size}"/></w:pPr><w:r><w:t>{p_name} &amp; {p_brand} &lt;</w:t><w:tab/><w:t>x&#233;</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="{p_size % 4}"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t>{p_type}</w:t><w:br/></w:r></w:p>'
)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 0::INTEGER AS ord, 'S' || p_size AS style, NULL::VARCHAR AS list, NULL::INTEGER AS level, p_name || ' & ' || p_brand || ' <' || chr(9) || 'x' || chr(233) AS content FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, NULL, '7', p_size % 4, p_type || chr(10) FROM part""")
def package_paragraphs(spark, sf):
    return opc.paragraphs(_nodes(spark, sf, **{"word/document.xml": _body(_PARAGRAPHS)})).select("path", "ord", "style", "list", "level", "content")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'footnote' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN id < 3 THEN 'note ' || id || ' of ' || p_brand END AS content, id >= 3 AS missing, CAST(ord AS INTEGER) AS ord
FROM (SELECT *, p_size % 5 AS id, 0 AS ord FROM part UNION ALL SELECT *, p_size % 5 + 1, 1 FROM part)""")
def package_notes(spark, sf):
    refs = '<w:p><w:r><w:footnoteReference w:id="{p_size % 5}"/><w:footnoteReference w:id="{p_size % 5 + 1}"/><w:footnoteReference w:id="{p_size % 5}"/></w:r></w:p>'
    bodies = "".join(f'<w:footnote w:id="{n}"><w:p><w:r><w:t>note {n} of {{p_brand}}</w:t></w:r></w:p></w:footnote>' for n in (-1, 0, 1, 2))
    return ooxml.notes(_nodes(spark, sf, **{"word/document.xml": _body(refs), "word/footnotes.xml": _xml(f'<w:footnotes xmlns:w="w">{bodies}</w:footnotes>')})).select("path", "kind", "id", "content", "missing", "ord")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 0::INTEGER AS section, 'header' AS kind, 'even' AS variant, CASE WHEN p_size % 3 = 0 THEN 'above ' || p_brand END AS content FROM part WHERE p_size % 3 < 2")
def package_stories(spark, sf):
    nodes = _nodes(
        spark, sf, **{
            "word/document.xml": _body('<w:p><w:r><w:t>a</w:t></w:r></w:p><w:sectPr><w:headerReference w:type="even" r:id="R{p_size % 3}"/></w:sectPr>'),
            "word/header5.xml": _xml('<w:hdr xmlns:w="w"><w:p><w:r><w:t>above </w:t></w:r><w:r><w:t>{p_brand}</w:t></w:r></w:p></w:hdr>'),
            "word/_rels/document.xml.rels": _xml('<Relationships xmlns="x"><Relationship Id="R0" Type="t/header" Target="header5.xml"/><Relationship Id="R1" Type="t/header" Target="/word/none.xml"/></Relationships>'),
        }
    )
    return ooxml.stories(nodes, opc.relationships(nodes)).select("path", "section", "kind", "variant", "content")


_FIELD = '<w:p><w:r><w:t>{p_brand}</w:t><w:fldChar w:fldCharType="begin"/><w:instrText> SEQ </w:instrText><w:t>within</w:t></w:r></w:p><w:p><w:r><w:fldChar w:fldCharType="{case when p_size % 2 = 0 then \'separate\' else \'none\' end}"/><w:t>{p_type}</w:t><w:fldChar w:fldCharType="end"/><w:t>after</w:t></w:r></w:p>'


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, t.text, t.visible FROM part, LATERAL (VALUES (p_brand, true), ('within', false), (p_type, p_size % 2 = 0), ('after', true)) t(text, visible)")
def package_field_text(spark, sf):
    events = ooxml.field_events(_nodes(spark, sf, **{"word/document.xml": _body(_FIELD)}))
    return ooxml.visible_text(events.filter("event <> 'none'"), ooxml.PART).select("path", "text", "visible")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(n AS INTEGER) AS page, 'ppt/slides/' || CASE WHEN (p_size % 4 = 0) = (n = 1) THEN 'b' ELSE 'a' END || '.xml' AS part FROM part, (SELECT unnest([1, 2]) AS n)")
def package_slides(spark, sf):
    first, second = "{case when p_size % 4 = 0 then 'k2' else 'k1' end}", "{case when p_size % 4 = 0 then 'k1' else 'k2' end}"
    nodes = _nodes(
        spark, sf, **{
            "ppt/presentation.xml": _xml(f'<p:presentation xmlns:p="p" {_R}><p:sldIdLst><p:sldId id="256" r:id="{first}"/><p:sldId r:id="{second}" id="257"/><p:sldId id="258" r:id="lost"/></p:sldIdLst></p:presentation>'),
            "ppt/_rels/presentation.xml.rels": _xml('<Relationships xmlns="x"><Relationship Id="k1" Type="t/slide" Target="slides/a.xml"/><Relationship Id="k2" Type="t/slide" Target="../ppt/./slides/b.xml"/></Relationships>'),
        }
    )
    return opc.slides(nodes, opc.relationships(nodes)).select("path", "page", "part")


_SHAPES = (
    '<p:sp><p:nvSpPr><p:cNvPr name="box" hidden="{p_size % 2}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{p_size * 12700}" y="25400"/><a:ext cx="38100" cy="6350"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{p_name}</a:t></a:r></a:p><a:p><a:r><a:t>{p_brand}</a:t></a:r></a:p></p:txBody></p:sp>'
    '<p:sp><p:nvSpPr><p:cNvPr name="bare"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>{p_type}</a:t></a:r></a:p></p:txBody></p:sp>'
)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 0::INTEGER AS ord, 'box' AS name, p_size::DOUBLE AS x0, 2.0::DOUBLE AS y0, p_size + 3.0::DOUBLE AS x1, 2.5::DOUBLE AS y1, p_name || chr(10) || p_brand AS content FROM part WHERE p_size % 2 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END, 'bare', NULL, NULL, NULL, NULL, p_type FROM part""")
def package_shapes(spark, sf):
    nodes = _nodes(spark, sf, **{"ppt/slides/a.xml": _xml(f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{_SHAPES}</p:spTree></p:cSld></p:sld>')})
    slide = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(1).alias("page"), F.lit("ppt/slides/a.xml").alias("part"))
    return opc.slide_shapes(nodes, slide).select("path", "ord", "name", "x0", "y0", "x1", "y1", "content")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'line' AS type, 'Of ' || p_name AS title, p_brand AS name, CASE WHEN n = 0 THEN p_type END AS category, CAST(p_size + n AS VARCHAR) AS value FROM part, (SELECT unnest([0, 1]) AS n)")
def package_charts(spark, sf):
    point = lambda k, v: f'<c:pt idx="{k}"><c:v>{v}</c:v></c:pt>'
    series = f'<c:ser><c:tx><c:strRef><c:strCache>{point(0, "{p_brand}")}</c:strCache></c:strRef></c:tx><c:cat><c:strCache>{point(0, "{p_type}")}{point(9, "alone")}</c:strCache></c:cat><c:val><c:numCache>{point(0, "{p_size}")}{point(1, "{p_size + 1}")}{point(2, "n/a")}</c:numCache></c:val></c:ser>'
    text = f'<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart><c:title><c:tx><a:p><a:r><a:t>Of {{p_name}}</a:t></a:r></a:p></c:tx></c:title><c:plotArea><c:lineChart>{series}</c:lineChart></c:plotArea></c:chart></c:chartSpace>'
    got = ooxml.charts(_nodes(spark, sf, **{"ppt/charts/chart3.xml": _xml(text)}))
    return got["points"].hint("merge").join(got["charts"], ooxml.PART).select("path", "type", "title", "name", "category", "value")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(s AS INTEGER) AS col_span, content FROM part, LATERAL (VALUES (0, 0, greatest(p_size % 4, 1), p_name), (1, 0, 1, p_brand), (1, 1, 1, '')) t(r, c, s, content)""")
def package_grids(spark, sf):
    cell = lambda text, attrs="": f"<a:tc{attrs}><a:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></a:txBody></a:tc>"
    rows = "<a:tr>" + cell("{p_name}", ' gridSpan="{p_size % 4}"') + cell("no", ' hMerge="on"') + "</a:tr><a:tr>" + cell("{p_brand}") + "<a:tc/>" + cell("no", ' vMerge="1"') + "</a:tr>"
    nodes = _nodes(spark, sf, **{"ppt/slides/a.xml": _xml(f'<p:sld xmlns:p="p" xmlns:a="a"><a:tbl>{rows}</a:tbl></p:sld>')})
    return ooxml.grids(nodes).select("path", "row", "col", "col_span", "content")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS title, CASE WHEN p_size % 2 = 1 THEN p_brand END AS author FROM part")
def package_metadata(spark, sf):
    text = '<cp:coreProperties xmlns:cp="cp" xmlns:dc="dc"><dc:title>{p_name}</dc:title><dc:creator>{case when p_size % 2 = 1 then p_brand else \'\' end}</dc:creator></cp:coreProperties>'
    return opc.core_metadata(_nodes(spark, sf, **{"docProps/core.xml": _xml(text)}))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, slot, rgb FROM part, LATERAL (VALUES ('dk1', '1A2B3C'), ('accent1', 'AB' || lpad(CAST(p_size AS VARCHAR), 4, '0'))) t(slot, rgb)")
def package_theme_colors(spark, sf):
    text = '<a:theme xmlns:a="a"><a:themeElements><a:clrScheme name="s"><a:dk1><a:sysClr val="windowText" lastClr="1a2b3c"/></a:dk1><a:accent1><a:srgbClr val="ab{lpad(p_size, 4, \'0\')}"/></a:accent1></a:clrScheme></a:themeElements></a:theme>'
    return opc.theme_colors(_nodes(spark, sf, **{"ppt/theme/theme1.xml": _xml(text)})).select("path", "slot", "rgb")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 3 = 0 THEN 'DOCTYPE' WHEN p_size % 3 = 1 THEN 'broken' END AS problem FROM part WHERE p_size % 3 < 2")
def package_errors(spark, sf):
    text = F.when(F.expr("p_size % 3 = 0"), F.lit('<!DOCTYPE a><a/>')).when(F.expr("p_size % 3 = 1"), F.lit("<a><b></a>")).otherwise(F.lit("<a/>"))
    got = _nodes(spark, sf, **{"word/document.xml": text}).filter("error is not null")
    return got.select("path", F.when(F.col("error").contains("document type"), "DOCTYPE").otherwise("broken").alias("problem"))


# Nested records, and tables found on their pages

_TEXT = '{{"type":"text","id":"p1-e{n}","bbox":{{"x0":72.0,"y0":{y}.0,"x1":300.04,"y1":{y1}.0}},"content":"{text}","font":{{"name":"F","size":{size}.0,"bold":{bold},"italic":false}},"color":{{"fill":[{fill},0,0]}}{more}}}'


def _records(spark: SparkSession, sf: str, warnings: str = "", hidden: str = "") -> DataFrame:
    """A record of one page for each row of ``part``: a heading, a paragraph of two lines with runs, a linked line, a list item.

    Every second one has the warning and the hidden item, given as JSON.
    """
    run = lambda text, bold: f'{{"content":"{text}","font":{{"name":"F","size":10.0,"bold":{bold},"italic":false}}}}'
    line = lambda n, text, y, size=10, bold="false", fill=0, more="": _TEXT.format(n=n, text=text, y=y, y1=y + size, size=size, bold=bold, fill=fill, more=more)
    page = ",".join([
        line(0, "[p_name]", 72, 20, "true"),
        line(1, "of *[p_type]* that goes", 110, fill=9),
        line(2, "on [p_brand]", 121, more=f',"runs":[{run("on ", "false")},{run("[p_brand]", "true")}]'),
        line(3, "see [p_size]", 150),
        line(4, "7) item", 180),
        '{"type":"annotation","id":"p1-e5","bbox":{"x0":72.0,"y0":150.0,"x1":90.0,"y1":160.0},"subtype":"link","uri":"https://x.test/[p_partkey] b"}',
    ])
    text = f'{{"schema_version":"1.1","source":{{"format":"pdf","sha256":"0","size_bytes":1}},"document":{{"page_count":1,"metadata":{{"title":"[p_brand]"}}}},"warnings":[[p_warnings]],"pages":[{{"page_number":1,"width":612.0,"height":792.0,"rotation":0,"scanned":false,"elements":[{page}],"hidden":[[p_hidden]]}}]}}'
    pieces = [F.expr(p).cast("string") if n % 2 else F.lit(p) for n, p in enumerate(re.split(r"\[(p_[a-z]+)\]", text))]
    odd = lambda s: F.when(F.col("p_partkey") % 2 == 1, s).otherwise("")
    part = spread(table(spark, sf, "part")).withColumn("p_warnings", odd(warnings)).withColumn("p_hidden", odd(hidden))
    return part.select("p_partkey", F.from_json(F.concat(*pieces), records.SCHEMA).alias("r")).select(F.col("p_partkey").alias("doc_id"), "r.*")


@query("SELECT p_partkey AS doc_id, '# ' || p_name || chr(10) || chr(10) || 'of \\*' || p_type || '\\* that goes on **' || replace(p_brand, '#', '\\#') || '**' || chr(10) || chr(10) || '[see ' || p_size || '](https://x.test/' || p_partkey || '%20b)' || chr(10) || chr(10) || '7. item' || chr(10) AS markdown FROM part")
def record_markdown(spark, sf):
    return document.of_records(_records(spark, sf))


_LINE_JSON = """'{{"type":"text","bbox":[72.0,' || {y} || '.0,300.0,' || {y1} || '.0],"text":"' || {text} || '","font":{{"name":"F","size":' || {size} || '.0{bold}}}{more}}}'"""
_PAGE_JSON = " || ',' || ".join([
    _LINE_JSON.format(y=72, y1=92, size=20, text="p_name", bold=',"bold":true', more=""),
    _LINE_JSON.format(y=110, y1=120, size=10, text="'of *' || p_type || '* that goes'", bold="", more=',"color":{"fill":[9,0,0]}'),
    _LINE_JSON.format(y=121, y1=131, size=10, text="'on ' || p_brand", bold="", more=""",\"runs\":[{\"content\":\"on \",\"font\":{\"name\":\"F\",\"size\":10.0}},{\"content\":\"' || p_brand || '\",\"font\":{\"name\":\"F\",\"size\":10.0,\"bold\":true}}]"""),
    _LINE_JSON.format(y=150, y1=160, size=10, text="'see ' || p_size", bold="", more=""),
    _LINE_JSON.format(y=180, y1=190, size=10, text="'7) item'", bold="", more=""),
    """'{"type":"annotation","bbox":[72.0,150.0,90.0,160.0],"subtype":"link","uri":"https://x.test/' || p_partkey || ' b"}'""",
])


@query(f"""SELECT p_partkey AS doc_id, '{{"granularity":"element","schema_version":"1.9","source":{{"format":"pdf","sha256":"0","size_bytes":1}},"document":{{"page_count":1,"metadata":{{"title":"' || p_brand || '"}}}},"pages":[{{"page_number":1,"width":612.0,"height":792.0,"rotation":0,"scanned":false,"elements":[' || {_PAGE_JSON} || ']}}]}}' AS json FROM part""")
def record_compact(spark, sf):
    return records.compact(_records(spark, sf))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'ruled' ELSE 'aligned' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END::INTEGER AS n_rows, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END::INTEGER AS n_cols,
CASE WHEN p_partkey % 4 = 0 THEN '0:0:2:' || p_size || ' 0 0' || chr(10) || p_size || ' 0 1' || '|' ELSE '' END || array_to_string(list_transform(list_filter(range(0, 12), lambda i: CASE WHEN p_partkey % 2 = 0 THEN i // 3 < 3 AND i % 3 < 2 AND (p_partkey % 4 <> 0 OR i // 3 > 0) ELSE true END), lambda i: (i // 3) || ':' || (i % 3) || ':1:' || p_size || ' ' || (i // 3) || ' ' || (i % 3)), '|') AS cells,
CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 12 END::INTEGER AS consumed FROM part""")
def table_detection(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), "p_size")
    place = part.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).withColumn("r", F.floor(F.col("i") / 3).cast("int")).withColumn("c", F.col("i") % 3)
    ruled = F.col("doc_id") % 2 == 0
    content = F.concat_ws(" ", F.col("p_size").cast("string"), F.col("r").cast("string"), F.col("c").cast("string"))
    x0, y0 = F.lit(105.0) + F.col("c") * 100.0, F.when(ruled, F.lit(104.0) + F.col("r") * 20.0).otherwise(F.lit(100.0) + F.col("r") * 14.0)
    texts = place.filter(~ruled | ((F.col("r") < 3) & (F.col("c") < 2))).select("doc_id", "page", F.concat(F.lit("t"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("element"), content.alias("content"), x0.alias("x0"), y0.alias("y0"), (x0 + 40.0).alias("x1"), (y0 + 10.0).alias("y1"))
    across = F.col("i") < 4  # four rulings across, three down; in every second grid the middle one begins below the first row
    top = F.when((F.col("i") == 5) & (F.col("doc_id") % 4 == 0), 120.0).otherwise(100.0)
    edges = (F.when(across, 100.0).otherwise(F.lit(100.0) + (F.col("i") - 4) * 100.0), F.when(across, F.lit(100.0) + F.col("i") * 20.0).otherwise(top), F.when(across, 300.0).otherwise(F.lit(100.0) + (F.col("i") - 4) * 100.0), F.when(across, F.lit(100.0) + F.col("i") * 20.0).otherwise(160.0))
    paths = place.filter(ruled & (F.col("i") < 7)).select("doc_id", "page", F.concat(F.lit("v"), F.col("i").cast("string")).alias("element"), *(e.alias(n) for e, n in zip(edges, ("x0", "y0", "x1", "y1"), strict=True)), F.lit(True).alias("stroked"), F.lit(False).alias("filled"), F.lit(0.5).alias("stroke_width"))
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["row"].cast("string"), c["col"].cast("string"), c["col_span"].cast("string"), c["content"])), "|")
    return tables.detect(texts, paths).filter("warning is null").select("doc_id", "kind", "n_rows", "n_cols", cells.alias("cells"), F.size("consumed").alias("consumed"))


_WARNING, _HIDDEN = '"two\\nlines_"', '{"kind":"note","element":"p1-e0","content":"a --> b"}'
_FULL_TEXT = """'{{"type":"text","id":"p1-e{n}","bbox":{{"x0":72.0,"y0":{y}.0,"x1":300.04,"y1":{y1}.0}},"content":"' || {text} || '","font":{{"name":"F","size":{size}.0,"bold":{bold},"italic":false}},"color":{{"fill":[{fill},0,0],"stroke":null}}{more}}}'"""
_FULL_PAGE = " || ',' || ".join([
    _FULL_TEXT.format(n=0, y=72, y1=92, size=20, text="p_name", bold="true", fill=0, more=""),
    _FULL_TEXT.format(n=1, y=110, y1=120, size=10, text="'of *' || p_type || '* that goes'", bold="false", fill=9, more=""),
    _FULL_TEXT.format(n=2, y=121, y1=131, size=10, text="'on ' || p_brand", bold="false", fill=0, more=""",\"runs\":[{\"content\":\"on \",\"font\":{\"name\":\"F\",\"size\":10.0,\"bold\":false,\"italic\":false}},{\"content\":\"' || p_brand || '\",\"font\":{\"name\":\"F\",\"size\":10.0,\"bold\":true,\"italic\":false}}]"""),
    _FULL_TEXT.format(n=3, y=150, y1=160, size=10, text="'see ' || p_size", bold="false", fill=0, more=""),
    _FULL_TEXT.format(n=4, y=180, y1=190, size=10, text="'7) item'", bold="false", fill=0, more=""),
    """'{"type":"annotation","id":"p1-e5","bbox":{"x0":72.0,"y0":150.0,"x1":90.0,"y1":160.0},"subtype":"link","uri":"https://x.test/' || p_partkey || ' b"}'""",
])
_SOURCE = '"source":{"format":"pdf","sha256":"0","size_bytes":1},"document":{"page_count":1,"metadata":{"title":"\' || p_brand || \'"'
_PAGE = '"pages":[{"page_number":1,"width":612.0,"height":792.0,"rotation":0,"scanned":false'
#: The texts cover 228.04 by 60 of 612 by 792 points; the confidence grows from a half with the share over 0.005, up to 0.15.
_CLASS = ""","classification":{"kind":"text","confidence":' || CAST(round(0.5::DOUBLE + 0.5::DOUBLE * (228.04::DOUBLE * 60 / (612 * 792) - 0.005) / 0.145, 3) AS VARCHAR) || ',"needs_ocr":false,"reasons":["text_coverage=0.028","text_elements=5"]}"""
_IF_ODD = "CASE WHEN p_partkey % 2 = 1 THEN '{}' ELSE '{}' END"


def _json_of(head: str, warnings: str, kind: str, elements: str, null_author: bool = True) -> str:
    author = ',"author":null' if null_author else ""
    hidden = _IF_ODD.format(f',"hidden":[{_HIDDEN}]', "")
    return f"SELECT p_partkey AS doc_id, '{{{head},{_SOURCE}{author}}}}},' || {warnings} || '{_PAGE}{kind},\"elements\":[' || {elements} || ']' || {hidden} || '}}]}}' AS json FROM part"


_ALL_WARNINGS, _SOME_WARNINGS = (_IF_ODD.format(f'"warnings":[{_WARNING}],', none) for none in ('"warnings":[],', ""))


@query(_json_of('"schema_version":"1.1"', _ALL_WARNINGS, "", _FULL_PAGE))
def record_full(spark, sf):
    return records.full(_records(spark, sf, _WARNING, _HIDDEN))


@query(_json_of('"granularity":"char","schema_version":"1.6"', _SOME_WARNINGS, "", _FULL_PAGE))
def record_explicit(spark, sf):
    return records.full(_records(spark, sf, _WARNING, _HIDDEN), explicit=True)


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf, _WARNING, _HIDDEN)
    return records.with_classes(rows, document.classes(records.tables(rows)))


@query(_json_of('"schema_version":"1.8"', _ALL_WARNINGS, _CLASS, _FULL_PAGE))
def record_classified(spark, sf):
    return records.full(_classified(spark, sf))


@query(_json_of('"granularity":"element","schema_version":"1.8"', _ALL_WARNINGS, _CLASS, _PAGE_JSON, null_author=False))
def record_classified_compact(spark, sf):
    return records.compact(_classified(spark, sf))


def _lean_of(granularity: str, legend: str, texts: bool) -> str:
    """Lines of the records above."""
    line = lambda y, y1, style, text, size=10: f"T 72 {y} 300 {y1} F {size} {style}" + (f" ' || {text} || '" if texts else "")
    rows = [
        line(72, 92, "b", "p_name", 20), line(110, 120, "-#090000", "'of *' || p_type || '* that goes'"), line(121, 131, "-", "'on ' || p_brand"), "r F 10 - on ", "r F 10 b ' || p_brand || '",
        line(150, 160, "-", "'see ' || p_size"), line(180, 190, "-", "'7) item'"), "A 72 150 90 160 link https://x.test/' || p_partkey || ' b",
    ]
    out = [f"'#quire {granularity} v1.9 pages=1'", _IF_ODD.format(" warnings=1", ""), f"chr(10) || '{legend}' || chr(10)"]
    out += [_IF_ODD.format(f"{lean.HIDDEN_LEGEND}@#warning two lines_@", ""), "'#page 1 612x792' || chr(10)", *(f"'{row}' || chr(10)" for row in rows), _IF_ODD.format("<hidden>@note p1-e0 a --> b@</hidden>@", "")]
    return f"SELECT p_partkey AS doc_id, replace({' || '.join(out)}, '@', chr(10)) AS text FROM part"


@query(_lean_of("element", lean.ELEMENT_LEGEND, True))
def record_lean(spark, sf):
    return lean.paged(records.tables(_records(spark, sf, _WARNING, _HIDDEN)))


@query(_lean_of("word", lean.WORD_LEGEND, False))
def record_lean_words(spark, sf):
    return lean.paged(records.tables(_records(spark, sf, _WARNING, _HIDDEN)), words=True)


@query("SELECT p_partkey AS doc_id, right(replace(CASE WHEN p_partkey % 2 = 1 THEN '7. item@@> [!WARNING]@> two lines\\_@@<!-- hidden: note [p1-e0] a - -&gt; b -->@' ELSE 'b)@@7. item@' END, '@', chr(10)), 12) AS ending, p_partkey % 2 = 1 AS noted FROM part")
def record_context(spark, sf):
    got = document.of_records(_records(spark, sf, _WARNING, _HIDDEN), "hidden")
    return got.select("doc_id", F.substring("markdown", -12, 12).alias("ending"), F.col("markdown").contains("\n\n7. item\n\n> [!WARNING]\n> two lines\\_\n\n<!-- hidden: note [p1-e0] a - -&gt; b -->\n").alias("noted"))


@query(f"""SELECT p_partkey AS doc_id, replace('#quire element v1.7 sections=2' || CASE WHEN p_size % 2 = 0 THEN ' warnings=1' ELSE '' END || '@{lean.FLOW_LEGEND}@' || CASE WHEN p_size % 2 = 0 THEN '{lean.HIDDEN_LEGEND}@#warning of it@' ELSE '' END || '#section 612 792@TI ' || p_name || '@#section 500.5 ' || p_size || '@BR page@~page 3@P ' || p_brand || '@' || CASE WHEN p_size % 2 = 0 THEN '<hidden>@comment c1 ' || p_type || '@</hidden>@' ELSE '' END, '@', chr(10)) AS text FROM part""")
def flow_document_lines(spark, sf):
    part, null = table(spark, sf, "part").withColumn("doc_id", F.col("p_partkey")), lambda kind: F.lit(None).cast(kind)
    some = part.filter("p_size % 2 = 0")
    documents = part.select("doc_id", F.lit(2).alias("n_parts"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("n_warnings"), (F.col("p_size") % 2 == 0).alias("any_hidden"))
    sections = part.select("doc_id", F.lit(0).alias("section"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).unionByName(part.select("doc_id", F.lit(1).alias("section"), F.lit(500.5).alias("width"), F.col("p_size").cast("double").alias("height")))
    more = [null("string").alias(n) for n in ("list_kind", "list_label")] + [null("int").alias(n) for n in ("list_level", "row", "col", "row_span", "col_span", "n_cols")] + [null("double").alias(n) for n in ("width", "height")] + [null("array<double>").alias("col_widths")]
    block = lambda section, role, content, breaks, approx: part.select("doc_id", F.lit(section).alias("section"), F.lit(0).alias("place"), F.lit("paragraph").alias("kind"), F.lit(role).alias("role"), F.col(content).alias("content"), breaks.alias("breaks"), approx.alias("approx_page"), *more)
    blocks = block(0, "title", "p_name", null("array<string>"), null("int")).unionByName(block(1, "body", "p_brand", F.array(F.lit("page")), F.lit(3)))
    warnings = some.select("doc_id", F.lit(0).alias("ord"), F.lit("of\n\tit").alias("message"))
    hidden = some.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("ord"), F.lit("comment").alias("kind"), F.lit("c1").alias("element"), F.col("p_type").alias("content"))
    return lean.flowing(documents, warnings, sections, blocks, hidden)
