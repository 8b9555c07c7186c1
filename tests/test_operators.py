"""Hand-made cases of operators that SQL can't express, and of functions on hostile text."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import flow, layout, pages, tables
from quire.sources import opc
from quire.streaming import jobs

TEXT = "doc_id bigint, page int, element string, content string, x0 double, y0 double, x1 double, y1 double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [("  a \n b  ", "a<br>\nb"), ("a \t b", "a b"), ("", ""), (" ", ""), ("a  b", "a<br>\nb")],
)
def test_inner_whitespace(spark, text, want):
    assert one(spark, T.inner_whitespace(F.lit(text))) == want


def test_escapes(spark):
    assert one(spark, T.escape_markdown(F.lit("a*b_<&>\x07"))) == "a\\*b\\_&lt;&amp;&gt; "
    assert one(spark, T.escape_record(F.lit("a\\b\nc \x1b"))) == "a\\\\b\\nc\\u{2028}\\u{1b}"
    assert one(spark, T.escape_link_target(F.lit("a b(c)\n"))) == "a%20b%28c%29%0A"


def test_numbers(spark):
    assert one(spark, G.round3(F.lit(0.5005))) == 0.5
    assert str(one(spark, G.round1(F.lit(-0.01)))) == "0.0"
    assert one(spark, G.lean_number(F.lit(12.04))) == "12"
    assert one(spark, G.scaled(F.lit(2.03))) == 2030
    assert one(spark, T.roman(F.lit(1994))) == "mcmxciv"
    assert one(spark, T.letters(F.lit(703))) == "aaa"
    assert one(spark, flow.chart_number(F.lit(0.41), F.lit("0%"))) == "41%"
    assert one(spark, flow.chart_number(F.lit(1234.5), F.lit("General"))) == "1234.5"


def test_style_layers_and_colours(spark):
    steps = F.array(F.struct(F.lit("lumMod").alias("kind"), F.lit(0.5).alias("v")), F.struct(F.lit("lumOff").alias("kind"), F.lit(0.1).alias("v")))
    assert one(spark, G.modified(F.array(*(F.lit(x).cast("smallint") for x in (100, 200, 0))), steps)) == [76, 126, 26]
    assert one(spark, G.lean_style(F.lit(True), F.lit(False), F.array(*map(F.lit, (255, 0, 16))))) == "b#ff0010"
    assert one(spark, G.lean_style(F.lit(False), F.lit(False), F.array(*map(F.lit, (0, 0, 0))))) == "-"


def grid(spark):
    paths = [(1, 1, f"h{k}", 50.0, 100.0 + 20 * k, 250.0, 100.0 + 20 * k) for k in range(4)] + [(1, 1, f"v{k}", 50.0 + 100 * k, 100.0, 50.0 + 100 * k, 160.0) for k in range(3)]
    p = spark.createDataFrame(paths, "doc_id bigint, page int, element string, x0 double, y0 double, x1 double, y1 double")
    p = p.withColumn("stroked", F.lit(True)).withColumn("filled", F.lit(False)).withColumn("stroke_width", F.lit(1.0))
    texts = [(1, 1, f"t{r}{c}", f"cell {r} {c}", 55.0 + 100 * c, 104.0 + 20 * r, 95.0 + 100 * c, 114.0 + 20 * r) for r in range(3) for c in range(2)]
    return spark.createDataFrame([*texts, (1, 1, "out", "outside", 50.0, 400.0, 90.0, 410.0)], TEXT), p


def test_ruled_table(spark):
    found = tables.detect(*grid(spark)).collect()
    assert [(t.kind, t.n_rows, t.n_cols, len(t.cells), t.warning) for t in found] == [("ruled", 3, 2, 6, None)]
    assert found[0].cells[3].content == "cell 1 1" and "out" not in found[0].consumed


def test_ruled_table_merges_cells_without_a_wall(spark):
    texts, paths = grid(spark)
    paths = paths.withColumn("y0", F.when(F.col("element") == "v1", 120.0).otherwise(F.col("y0")))
    found = tables.detect(texts, paths).collect()
    assert [(c.row, c.col, c.col_span, c.content) for c in found[0].cells if c.row == 0] == [(0, 0, 2, "cell 0 0\ncell 0 1")]


def test_borderless_table_and_prose(spark):
    cells = [(1, 1, f"t{r}{c}", f"w{r}{c}", 50.0 + 80 * c, 100.0 + 14 * r, 80.0 + 80 * c, 110.0 + 14 * r) for r in range(4) for c in range(3)]
    prose = [(2, 1, f"p{r}", "a whole line of running text that fills the page", 50.0, 100.0 + 14 * r, 400.0, 110.0 + 14 * r) for r in range(8)]
    none = spark.createDataFrame([], "doc_id bigint, page int, element string, x0 double, y0 double, x1 double, y1 double, stroked boolean, filled boolean, stroke_width double")
    found = tables.detect(spark.createDataFrame(cells + prose, TEXT), none).collect()
    assert [(t.doc_id, t.kind, t.n_rows, t.n_cols) for t in found] == [(1, "aligned", 4, 3)]


def large_pages(spark):
    """By page: a grid of 1,105 rulings, 800 aligned texts, 70 aligned columns, a region of 5,000 buckets, a grid of 71 separators."""
    sizes = {1: (100, 5, 100.0), 2: (200, 4, 80.0), 3: (10, 70, 80.0), 4: (4, 4, 5000.0), 5: (4, 70, 60.0)}
    texts = [(1, p, f"t{r:03}-{c:02}", f"w{r} {c}", 55.0 + w * c, 104.0 + 14 * r, 80.0 + w * c, 114.0 + 14 * r) for p, (rows, cols, w) in sizes.items() for r in range(rows) for c in range(cols)]
    paths = []
    for p in (1, 5):
        rows, cols, w = sizes[p]
        paths += [(1, p, f"h{r}-{c}", 50.0 + w * c, 102.0 + 14 * r, 50.0 + w * (c + 1), 102.0 + 14 * r) for r in range(rows + 1) for c in range(cols)]
        paths += [(1, p, f"v{r}-{c}", 50.0 + w * c, 102.0 + 14 * r, 50.0 + w * c, 102.0 + 14 * (r + 1)) for r in range(rows) for c in range(cols + 1)]
    paths = spark.createDataFrame(paths, "doc_id bigint, page int, element string, x0 double, y0 double, x1 double, y1 double").withColumn("stroked", F.lit(True)).withColumn("filled", F.lit(False)).withColumn("stroke_width", F.lit(1.0))
    return spark.createDataFrame(texts, TEXT), paths


def test_tables_of_large_pages_are_whole(spark):
    found = tables.detect(*large_pages(spark)).orderBy("page").collect()
    assert [(t.page, t.kind, t.n_rows, t.n_cols, len(t.cells or ()), len(t.consumed or ()), t.warning) for t in found] == [
        (1, "ruled", 100, 5, 500, 500, None),
        (2, "aligned", 200, 4, 800, 800, None),
        (3, "aligned", 10, 70, 700, 700, None),
        (4, "aligned", 4, 4, 16, 16, None),
        (5, "ruled", 4, 70, 280, 280, None),
    ]
    assert all(c.content == f"w{c.row} {c.col}" for t in found for c in t.cells or ())


def test_markdown_keeps_its_limits(spark):
    found = tables.detect(*large_pages(spark), tables.MARKDOWN).collect()
    dense = "path density exceeded the detector limit"
    assert sorted((t.page, t.kind, t.warning or "") for t in found) == [(1, "aligned", ""), (1, "ruled", dense), (5, "ruled", dense)]


def test_lines_compare_with_their_first_glyph(spark):
    base = [0.0, 3.0, 6.0, 9.0]  # a slow drift: each near its neighbour, not near the first
    g = spark.createDataFrame([(1, 1, "e", n, "x", 10.0 * n, 0.0, 10.0 * n + 9, 10.0, 10.0, b) for n, b in enumerate(base)], "doc_id bigint, page int, element string, ord int, content string, x0 double, y0 double, x1 double, y1 double, font_size double, baseline double")
    got = {r.ord: r.line for r in pages.group_glyphs(g, ["doc_id", "page", "element"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_columns_and_reading_order(spark):
    rows = [(1, 1, f"{'l' if c == 0 else 'r'}{k}", "some twenty characters of text", 50.0 + 280 * c, 80.0 + 14 * k, 290.0 + 280 * c, 90.0 + 14 * k, 10.0, False) for c in range(2) for k in range(8)]
    b = spark.createDataFrame(rows, TEXT + ", size double, bold boolean")
    p = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id bigint, page int, width double, height double")
    assert [(r.column, r.left) for r in layout.columns(b, p).orderBy("column").collect()] == [(0, 50.0), (1, 330.0)]
    assert {r.element: r.column for r in layout.assign_columns(b, layout.columns(b, p)).collect()}["r3"] == 1


def test_numbering_restarts(spark):
    levels = spark.createDataFrame([("1", 0, 1, "decimal", "%1", None), ("1", 1, 3, "lowerRoman", "%1.%2", None)], "list string, level int, start int, format string, text string, restart int")
    p = spark.createDataFrame([(n, "1", level) for n, level in enumerate([0, 1, 1, 0, 1])], "ord int, list string, level int").withColumn("s", F.lit(1))
    assert [r.label for r in flow.numbering(p, levels, ["s"]).orderBy("ord").collect()] == ["1", "1.iii", "1.iv", "2", "2.iii"]


def test_style_chain_ends_at_cycles(spark):
    s = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "style string, based_on string")
    got = {(r.style, r.ancestor) for r in flow.style_chain(s).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", "d")}


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_packages(spark):
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t><w:tab/></w:r></w:p><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p></w:body></w:document>'
    rels = '<Relationships xmlns="r"><Relationship Id="r1" Type="a/b/image" Target="../media/x.png"/><Relationship Id="r2" Type="t" Target="../../../x"/></Relationships>'
    files = [
        ("good", package(**{"word/document.xml": doc, "word/_rels/document.xml.rels": rels, "[Content_Types].xml": "<Types/>"})),
        ("bomb", package(**{"a.xml": b"0" * (30 << 20)})),
        ("climbs", package(**{"../a.xml": "<a/>"})),
        ("entity", package(**{"word/document.xml": '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'})),
        ("junk", b"PK\x03\x04 not a package"),
    ]
    f = spark.createDataFrame(files, "path string, content binary")
    parts = opc.parts(f).cache()
    assert {r.path for r in parts.filter("error is not null").collect()} == {"bomb", "climbs", "junk"}
    assert {r.path: r.kind for r in opc.office_kind(parts.filter("error is null")).collect()}["good"] == "docx"
    nodes = opc.xml_nodes(parts).cache()
    assert [r.path for r in nodes.filter("error is not null").collect()] == ["entity"]
    assert [(r.style, r.content) for r in opc.paragraphs(nodes).filter("path = 'good'").orderBy("ord").collect()] == [("Heading1", "Hello world\t"), (None, "")]
    assert {r.rel_id: r.target for r in opc.relationships(nodes).collect()} == {"r1": "media/x.png", "r2": None}


def test_sniff(spark):
    files = [("z", b"PK\x03\x04.."), ("p", b" " * 1023 + b"%PDF-1.7"), ("late", b" " * 1024 + b"%PDF-1.7"), ("cfb", bytes.fromhex("D0CF11E0A1B11AE1")), ("empty", b"")]
    got = {r.path: r.format for r in opc.provenance(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"z": "zip", "p": "pdf", "late": None, "cfb": "cfb", "empty": None}


def test_ingest_takes_each_file_once(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.pdf").write_bytes(b"%PDF-1.4")
    for n in range(2):
        jobs.ingest(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        (drop / f"b{n}.zip").write_bytes(b"PK\x03\x04")
    assert sorted(r.format for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["pdf", "zip"]
