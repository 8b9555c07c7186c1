"""Queries over requests, slides, flow documents and glyph objects, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import lean
from quire.operators import office as O
from quire.plans import inputs as I
from quire.plans.registry import query
from quire.session import table
from quire.sources import ooxml, opc
from quire.streaming import jobs


def _pick(key: str, *values) -> Column:
    """One of some literals, by a whole number."""
    n = F.pmod(F.col(key).cast("bigint"), F.lit(len(values)))
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        if v is not None:
            out = F.when(n == k, F.lit(v)).otherwise(out)
    return out


def _sql(key: str, *values) -> str:
    """The same choice in SQL."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None)
    return f"(CASE CAST({key} AS BIGINT) % {len(values)} {cases} END)"


_FORMATS, _LEVELS = ("pdf", "pptx", "docx", "odt"), ("char", "word", "element", None, "line")
_RANK = "CASE coalesce(g, 'char') WHEN 'element' THEN 0 WHEN 'word' THEN 1 WHEN 'char' THEN 2 END"


@query(f"""SELECT id, format, error, CASE error WHEN 'unsupported_format' THEN 2 WHEN 'granularity_unavailable' THEN 8 END AS exit_code FROM (SELECT id, format, CASE WHEN format = 'odt' THEN 'unsupported_format' WHEN {_RANK} IS NULL THEN 'bad_granularity' WHEN {_RANK} > CASE format WHEN 'pdf' THEN 2 ELSE 0 END THEN 'granularity_unavailable' END AS error
FROM (SELECT o_orderkey AS id, {_sql('o_orderkey', *_FORMATS)} AS format, {_sql('o_custkey', *_LEVELS)} AS g FROM orders))""")
def granularity_check(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _pick("o_orderkey", *_FORMATS).alias("format"), _pick("o_custkey", *_LEVELS).alias("granularity"))
    return O.granularity_errors(asked).select("id", "format", "error", "exit_code")


@query("""SELECT id, b AS "begin", e AS "end", error, CASE error WHEN 'page_out_of_range' THEN 9 WHEN 'too_many_pages' THEN 6 END AS exit_code FROM (SELECT id, b, e, CASE WHEN l IS NOT NULL AND l > pages THEN 'page_out_of_range' WHEN e - b + 1 > most THEN 'too_many_pages' END AS error
FROM (SELECT *, CASE WHEN l IS NOT NULL THEN f ELSE 1 END AS b, coalesce(l, pages) AS e FROM (SELECT c_custkey AS id, c_custkey % 40 AS pages, c_custkey % 7 + 1 AS f, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 + 1 + c_custkey % 11 END AS l, CASE WHEN c_custkey % 3 <> 0 THEN 8 END AS most FROM customer)))""")
def page_requests(spark, sf):
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(k.alias("id"), (k % 40).alias("pages"), (k % 7 + 1).alias("first"), F.when(k % 5 != 0, k % 7 + 1 + k % 11).alias("last"), F.when(k % 3 != 0, 8).alias("most"))
    return O.page_requests(asked)


_OUTPUTS = ("json", "lean", "markdown")


@query(f"SELECT id, CASE {_sql('id', *_OUTPUTS)} WHEN 'json' THEN 'application/json' WHEN 'lean' THEN 'text/plain; charset=utf-8' ELSE 'text/markdown; charset=utf-8' END AS content_type FROM ({I.JOBS}) WHERE status = 'succeeded'")
def result_content_types(spark, sf):
    return I.jobs(spark, sf).filter("status = 'succeeded'").select("id", O.content_type(_pick("id", *_OUTPUTS)).alias("content_type"))


_SHAPES = "SELECT l_orderkey AS slide, CASE l_linenumber % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'layout' ELSE 'slide' END AS layer, l_partkey AS ord, l_partkey * 10 + l_linenumber AS shape, CAST(l_quantity AS BIGINT) % 5 = 0 AS placeholder, l_returnflag = 'R' AS hidden FROM lineitem"


@query(f"""SELECT slide, layer, shape, CAST(row_number() OVER (PARTITION BY slide ORDER BY CASE layer WHEN 'master' THEN 0 WHEN 'layout' THEN 1 ELSE 2 END, ord, shape) - 1 AS INTEGER) AS number FROM ({_SHAPES}) JOIN (SELECT o_orderkey AS slide, o_orderstatus <> 'F' AS slide_shows, o_orderkey % 4 <> 0 AS layout_shows FROM orders) USING (slide)
WHERE NOT hidden AND NOT (placeholder AND layer <> 'slide') AND CASE layer WHEN 'master' THEN slide_shows AND layout_shows WHEN 'layout' THEN slide_shows ELSE true END""")
def slide_layers(spark, sf):
    layer = F.when(F.col("l_linenumber") % 3 == 0, "master").when(F.col("l_linenumber") % 3 == 1, "layout").otherwise("slide")
    shapes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide"), layer.alias("layer"), F.col("l_partkey").alias("ord"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("shape"), (F.col("l_quantity").cast("bigint") % 5 == 0).alias("placeholder"), (F.col("l_returnflag") == "R").alias("hidden"))
    slides = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slide"), (F.col("o_orderstatus") != "F").alias("slide_shows"), (F.col("o_orderkey") % 4 != 0).alias("layout_shows"))
    return O.slide_layers(shapes, slides)


@query("""SELECT s_nationkey AS path, 's' || s_suppkey AS part, CASE WHEN s_suppkey % 5 <> 0 THEN 'l' || (s_suppkey % 7) END AS layout, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 3 THEN 'm' || (s_suppkey % 7 % 2) END AS master, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 3 AND s_suppkey % 7 % 2 = 0 THEN 't0' END AS theme FROM supplier""")
def template_chain(spark, sf):
    s = table(spark, sf, "supplier").withColumn("n", F.col("s_suppkey") % 7)
    slides = s.select(F.col("s_nationkey").alias("path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("part"))
    rel = lambda rows, source, kind, target, external=F.lit(False): rows.select(F.col("s_nationkey").alias("path"), source.alias("source_part"), F.lit("rId1").alias("rel_id"), F.lit(kind).alias("type"), target.alias("target"), external.alias("external")).distinct()
    name = lambda mark, key: F.concat(F.lit(mark), key.cast("string"))
    rels = rel(s, name("s", F.col("s_suppkey")), "slideLayout", name("l", F.col("n")), F.col("s_suppkey") % 5 == 0)
    rels = rels.unionByName(rel(s.filter("n <> 3"), name("l", F.col("n")), "slideMaster", name("m", F.col("n") % 2)))
    rels = rels.unionByName(rel(s.filter("n <> 3 and n % 2 = 0"), F.lit("m0"), "theme", F.lit("t0")))
    return O.template_chain(slides, rels)


@query("SELECT p_partkey AS path, 'slide' AS part, 'rId2' AS rel_id, CASE WHEN p_partkey % 4 > 1 THEN sha256(p_name) END AS content_hash FROM part")
def picture_hashes(spark, sf):
    part = table(spark, sf, "part").withColumn("path", F.col("p_partkey"))
    blips = part.select("path", F.lit("slide").alias("part"), F.lit("rId2").alias("rel_id"))
    rels = part.filter("p_partkey % 4 > 0").select("path", F.lit("slide").alias("source_part"), F.lit("rId2").alias("rel_id"), F.lit("media").alias("target"), (F.col("p_partkey") % 4 == 1).alias("external"))
    return O.picture_hashes(blips, rels, part.select("path", F.lit("media").alias("name"), F.col("p_name").cast("binary").alias("bytes")))


_TOKENS = ("+mj-lt", "+mj-ea", "+mj-cs", "+mn-lt", "+mn-ea", "+mn-cs", "majorAscii", "majorHAnsi", "majorEastAsia", "majorBidi", "minorAscii", "minorHAnsi", "minorEastAsia", "minorBidi", "Calibri")
_FACES = {"major_lt": (4, "L"), "major_ea": (3, "E"), "major_cs": (5, "C"), "minor_lt": (7, "l"), "minor_ea": (2, "e"), "minor_cs": (3, "c")}


def _face_sql(kind: str, script: str, fallback: str) -> str:
    latin = f"{kind}_lt"
    return f"coalesce({kind}_{script}, {latin}{fallback})"


_DRAWN = "CASE token " + " ".join(f"WHEN '+m{k[1] if k == 'minor' else 'j'}-{s}' THEN {_face_sql(k, s, chr(44) + ' ' + chr(39) + 'Arial' + chr(39))}" for k in ("major", "minor") for s in ("lt", "ea", "cs")).replace("+mi", "+mn") + " ELSE token END"
_WORDED = "CASE WHEN token LIKE '+m%' THEN " + _DRAWN + " WHEN token LIKE 'm%' THEN CASE " + " ".join(f"WHEN token IN ('{k}Ascii', '{k}HAnsi') THEN {k}_lt WHEN token = '{k}EastAsia' THEN coalesce({k}_ea, {k}_lt) WHEN token = '{k}Bidi' THEN coalesce({k}_cs, {k}_lt)" for k in ("major", "minor")) + " END END"
_FACED = ", ".join(f"CASE WHEN p_size % {m} = 0 THEN '' WHEN p_size % {m} > 1 OR {m} = 2 THEN '{c} ' || p_brand END AS {n}" for n, (m, c) in _FACES.items())


@query(f"SELECT p_partkey, token, {_DRAWN} AS drawing, nullif({_WORDED}, '') AS word FROM (SELECT p_partkey, {_sql('p_partkey', *_TOKENS)} AS token, {_FACED} FROM part)")
def theme_fonts(spark, sf):
    size = F.col("p_size")
    face = {n: F.when(size % m == 0, "").when((size % m > 1) | F.lit(m == 2), F.concat(F.lit(f"{c} "), F.col("p_brand"))) for n, (m, c) in _FACES.items()}
    token = _pick("p_partkey", *_TOKENS)
    return table(spark, sf, "part").select("p_partkey", token.alias("token"), O.drawing_font(token, face).alias("drawing"), O.word_font(token, face).alias("word"))


def _style(n: int) -> Column:
    key = F.col("l_partkey")
    return F.struct(F.when(key % (n + 2) == 0, F.concat(F.lit(f"f{n}-"), F.col("l_returnflag"))).alias("font"), F.when(key % (n + 3) == 1, F.lit(10.0 + n)).alias("size"), F.when(key % (n + 4) == 2, F.lit(n % 2 == 0)).alias("bold"), F.when(key % (n + 5) == 3, F.lit(n % 2 == 1)).alias("italic"))


def _style_sql(what: str, add: int, hit: int, value: str, other: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN l_partkey % {n + add} = {hit} THEN {value.format(n=n, even=str(n % 2 == 0).lower(), odd=str(n % 2 == 1).lower())} END" for n in range(4)) + f", {other}) AS {what}"


@query("SELECT l_orderkey, l_linenumber, " + ", ".join([_style_sql("font", 2, 0, "'f{n}-' || l_returnflag", "'+mn-lt'"), _style_sql("size", 3, 1, "10.0::DOUBLE + {n}", "18.0::DOUBLE"), _style_sql("bold", 4, 2, "{even}", "false"), _style_sql("italic", 5, 3, "{odd}", "false")]) + " FROM lineitem")
def slide_styles(spark, sf):
    got = O.slide_style([_style(n) for n in range(4)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in got.items()))


_SCALES = (None, "62500", "x", "90000", "NaN")
_ROUND3 = "(sign({x}) * floor(abs({x}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE)"
_NUMBER = "(CASE WHEN isfinite(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) END)"


@query("SELECT p_partkey, " + _ROUND3.format(x=f"(CAST(p_size * 37 AS DOUBLE) / 100.0::DOUBLE * coalesce({_NUMBER.format(x=_sql('p_partkey', *_SCALES))} / 100000.0::DOUBLE, 1.0::DOUBLE))") + " AS size FROM part")
def autofit_sizes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", O.scaled_size((F.col("p_size") * 37).cast("string"), _pick("p_partkey", *_SCALES)).alias("size"))


_CHARTS = ("barChart", "pieChart", "doughnutChart", "lineChart", "areaChart", "scatterChart", "radarChart")
_URIS = ("x/chart", "x/diagram", "x/picture", "x/ole", "x/charts", "")


@query(f"SELECT p_partkey, CASE p_partkey % 7 WHEN 6 THEN 'other' ELSE replace({_sql('p_partkey', *_CHARTS)}, 'Chart', '') END AS chart, CASE p_partkey % 6 WHEN 0 THEN 'chart' WHEN 1 THEN 'SmartArt' WHEN 2 THEN 'picture' WHEN 3 THEN 'OLE' ELSE 'graphic' END AS frame FROM part")
def frame_kinds(spark, sf):
    return table(spark, sf, "part").select("p_partkey", O.chart_type(_pick("p_partkey", *_CHARTS)).alias("chart"), O.frame_kind(_pick("p_partkey", *_URIS)).alias("frame"))


_NAMES = ("Title", "Intense Quote", "quote!", "Body Text", None, "TI-TLE", "Heading 1")


@query(f"""SELECT p_partkey, CASE WHEN level BETWEEN 0 AND 8 THEN 'h' || (level + 1) WHEN name = 'title' THEN 'title' WHEN name IN ('quote', 'intensequote') THEN 'quote' ELSE 'body' END AS role
FROM (SELECT p_partkey, coalesce(CASE WHEN p_size % 7 = 0 THEN p_size % 12 END, CASE WHEN p_size % 5 = 1 THEN p_size % 10 END, CASE WHEN p_size % 3 = 1 THEN p_size % 4 END) AS level, lower(regexp_replace(coalesce({_sql('p_partkey', *_NAMES)}, ''), '[^A-Za-z0-9]', '', 'g')) AS name FROM part)""")
def paragraph_roles(spark, sf):
    s = F.col("p_size")
    chain = F.array(F.when(s % 3 == 1, s % 4), F.when(s % 5 == 1, s % 10), F.lit(None).cast("int"))
    return table(spark, sf, "part").select("p_partkey", O.paragraph_role(F.when(s % 7 == 0, s % 12), chain, _pick("p_partkey", *_NAMES)).alias("role"))


_TWIPS, _COLS = (None, "12240", "bad", "9639.5", "-20", "inf"), (None, "0", "1", "2", "x", "+3", "-1")
_TW = _ROUND3.format(x=f"({_NUMBER.format(x='w')} / 20.0::DOUBLE)")
_EM = _ROUND3.format(x=f"({_NUMBER.format(x='w')} / 12700.0::DOUBLE)")


@query(f"""SELECT o_orderkey, coalesce({_TW}, 612.0::DOUBLE) AS width, {_EM} AS inset, w IS NOT NULL AND {_TW} IS NULL AS bad_width, CASE c WHEN '2' THEN 2 WHEN '+3' THEN 3 END::BIGINT AS columns, coalesce(c IN ('0', 'x', '-1'), false) AS bad_columns
FROM (SELECT o_orderkey, {_sql('o_orderkey', *_TWIPS)} AS w, {_sql('o_custkey', *_COLS)} AS c FROM orders)""")
def section_geometry(spark, sf):
    w = _pick("o_orderkey", *_TWIPS)
    width, bad_width = O.section_length(w, O.PAGE_WIDTH)
    columns, bad_columns = O.section_columns(_pick("o_custkey", *_COLS))
    return table(spark, sf, "orders").select("o_orderkey", width.alias("width"), O.emu(w).alias("inset"), bad_width.alias("bad_width"), columns.alias("columns"), bad_columns.alias("bad_columns"))


_FRAMES, _ALTS, _TITLES = ("page", "margin", "leftMargin", "outsideMargin", "column", "line", "character", None), ("", None, "a picture"), ("a title", "", None, "other")


@query(f"SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'page' WHEN 1 THEN 'margin' WHEN 2 THEN 'margin' WHEN 3 THEN 'margin' WHEN 4 THEN 'column' WHEN 5 THEN 'line' ELSE 'paragraph' END AS frame, coalesce(nullif({_sql('c_custkey', *_ALTS)}, ''), nullif({_sql('c_custkey', *_TITLES)}, '')) AS alt FROM customer")
def placements(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", O.placement_frame(_pick("c_custkey", *_FRAMES)).alias("frame"), O.first_text(_pick("c_custkey", *_ALTS), _pick("c_custkey", *_TITLES)).alias("alt"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, n > 3 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE k <= 3")
def story_caps(spark, sf):
    return O.story_cap(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"], 3)


@query(f"SELECT doc_id, i, regexp_replace(t, '{I.WS}+$', '') AS content FROM ({I.LINES}) WHERE regexp_replace(t, '{I.WS}', '', 'g') <> ''")
def visible_runs(spark, sf):
    return O.visible_runs(I.lines(spark, sf).withColumnRenamed("t", "content")).select("doc_id", F.col("i").cast("bigint").alias("i"), "content")


_SPACES = ("", *O.COLOR_SPACES, "")
_FONTS = ("Helvetica-Bold", "Times", "SEMIBOLD", "Courier")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 13 IN (0, 12) THEN 'Unknown' ELSE {_sql('p_partkey', *_SPACES)} END AS space, coalesce(CASE WHEN p_size % 4 > 0 THEN p_size * 20 END >= 600, false) OR lower({_sql('p_partkey', *_FONTS)}) LIKE '%bold%' AS bold FROM part")
def color_spaces(spark, sf):
    weight = F.when(F.col("p_size") % 4 > 0, F.col("p_size") * 20)
    return table(spark, sf, "part").select("p_partkey", O.color_space((F.col("p_partkey") % 13).cast("int")).alias("space"), O.bold(weight, _pick("p_partkey", *_FONTS)).alias("bold"))


@query("SELECT l_partkey, l_suppkey, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_quantity, l_returnflag)) AS font, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity, l_returnflag)) AS size FROM lineitem GROUP BY ALL")
def glyph_styles(spark, sf):
    got = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("font"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber")
    return O.last_styles(got, ["l_partkey", "l_suppkey"], ["font", "size"], ["l_orderkey", "l_linenumber", "size", "font"])


@query("SELECT l_orderkey, CASE WHEN count(*) >= 2 THEN round(stddev_pop(l_quantity) * 1000) / 1000 END AS spread FROM lineitem GROUP BY ALL")
def column_spread(spark, sf):
    got = O.spread(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity")
    return got.withColumn("spread", F.round(F.col("spread") * 1000) / 1000)


_HEADS = ("255044462d312e37", "504b0304aa", "d0cf11e0a1b11ae1ff", "00255044462d", "504b0506", "")
_KINDS = "CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'cfb' WHEN 3 THEN 'pdf' END"


@query(f"SELECT path, format, CASE WHEN length > 12 THEN 'too_large' WHEN format IS NULL OR format = 'cfb' THEN 'unsupported_format' END AS error FROM (SELECT p_partkey AS path, {_KINDS} AS format, CASE p_partkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 9 WHEN 3 THEN 6 WHEN 4 THEN 4 ELSE 0 END + p_size % 9 AS length FROM part)")
def sniffed_files(spark, sf):
    content = F.concat(F.unhex(_pick("p_partkey", *_HEADS)), F.repeat(F.lit(" "), F.col("p_size") % 9).cast("binary"))
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), content.alias("content"), F.lit(12).alias("most"))
    return O.sniff_errors(files.select("path", "most", F.octet_length("content").alias("length"), opc.sniff(F.col("content")).alias("format"))).select("path", "format", "error")


_CODES = ("unsupported_format", "encrypted_pdf", "parse_failure", "io_error", "too_many_pages", "timeout", "no such code")


@query(f"SELECT path, CASE WHEN path % 7 = 6 THEN 'internal' ELSE {_sql('path', *_CODES)} END AS code, CASE path % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 ELSE 1 END AS exit_code, CASE path % 7 WHEN 0 THEN 415 WHEN 1 THEN 422 WHEN 2 THEN 422 WHEN 3 THEN 500 WHEN 4 THEN 413 WHEN 5 THEN 504 ELSE 500 END AS status FROM (SELECT c_custkey AS path FROM customer)")
def error_envelopes(spark, sf):
    failed = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), _pick("c_custkey", *_CODES).alias("code"))
    return ooxml.error_rows(failed).select("path", "code", "exit_code", "status")


_EDGES = "l_quantity AS x0, CASE WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE ELSE l_discount END AS y0, l_extendedprice / 1000.0::DOUBLE AS x1, CASE WHEN l_linenumber = 6 THEN 'Infinity'::DOUBLE ELSE l_tax END AS y1"


@query(f"SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, {_EDGES} FROM lineitem) WHERE isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1) AND x1 >= x0 AND y1 >= y0 GROUP BY l_orderkey")
def ordered_boxes(spark, sf):
    number = F.col("l_linenumber")
    y0, y1 = F.when(number == 5, float("nan")).otherwise(F.col("l_discount")), F.when(number == 6, float("inf")).otherwise(F.col("l_tax"))
    boxes = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), y0.alias("y0"), (F.col("l_extendedprice") / 1000.0).alias("x1"), y1.alias("y1"))
    return boxes.filter(G.ordered_box()).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, page, element, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, element) - 1 AS INTEGER) AS number FROM ({I.BLOCKS})")
def element_order(spark, sf):
    return O.element_order(I.blocks(spark, sf), ["doc_id", "page"], "element").select("doc_id", "page", "element", "number")


@query(f"SELECT id, status, 'char' AS granularity, 'json' AS format, id % 2 = 0 AS classify, CAST(NULL AS VARCHAR) AS pages FROM ({I.JOBS})")
def job_migration(spark, sf):
    old = I.jobs(spark, sf).withColumn("classify", F.col("id") % 2 == 0)
    return jobs.migrate(old).select("id", "status", "granularity", "format", "classify", "pages")


@query(f"SELECT id, CASE WHEN k <= 5 THEN 'running' ELSE status END AS status FROM (SELECT id, status, CASE WHEN status = 'queued' THEN row_number() OVER (PARTITION BY status ORDER BY created_at, id) END AS k FROM ({I.JOBS}))")
def job_claims(spark, sf):
    return jobs.claim(I.jobs(spark, sf), F.current_timestamp(), 5).select("id", "status")


@query(f"SELECT doc_id, sum(strlen(t) + 1) > 2000 AS too_large, CAST(sum(strlen(t) + 1) AS BIGINT) AS bytes FROM ({I.LINES}) GROUP BY doc_id")
def byte_caps(spark, sf):
    return lean.capped(I.lines(spark, sf).withColumnRenamed("t", "line"), 2000)


_ROLES, _LISTS = ("h1", "h9", "title", "quote", "body", "h10"), ("ordered", "bullet", None, None, None)


@query(f"""SELECT p_partkey, CASE {_sql('p_size', *_LISTS)} WHEN 'ordered' THEN 'LI ' || (p_size % 9) || ' o ' || p_brand || ' ' || p_name WHEN 'bullet' THEN 'LI ' || (p_size % 9) || ' b ' || p_brand || ' ' || p_name
ELSE CASE p_partkey % 6 WHEN 0 THEN 'H1' WHEN 1 THEN 'H9' WHEN 2 THEN 'TI' WHEN 3 THEN 'Q' ELSE 'P' END || ' ' || p_name END AS line FROM part""")
def flow_paragraph_lines(spark, sf):
    line = lean.paragraph_line(_pick("p_partkey", *_ROLES), F.col("p_name"), _pick("p_size", *_LISTS), F.col("p_size") % 9, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", line.alias("line"))
