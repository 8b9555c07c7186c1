"""Deterministic document-structure inputs over the driver's tables, as DataFrames and as DuckDB SQL of the same rows.

Text becomes a page layout: a line each 14 points, 50 lines a page of 612 by 792, a glyph each 6 points, with a gap of 4
more after each comma.  Every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import table

#: White space, as DuckDB's regular expressions spell it.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))


LINES = "SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    got = lines(spark, sf).groupBy("doc_id").agg(F.max("i").alias("m")).select("doc_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("m") / 50).cast("int") + 1)).alias("page"))
    return got.withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))


PAGES = f"SELECT doc_id, unnest(range(1, CAST(m // 50 + 2 AS INTEGER))) AS page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM (SELECT doc_id, max(i) AS m FROM ({LINES}) GROUP BY doc_id)"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with page, element, their place on the page and their baseline."""
    at = F.pmod("i", F.lit(50))
    page = F.floor(F.col("i") / 50).cast("int")
    return lines(spark, sf).filter("t <> ''").select("doc_id", (page + 1).alias("page"), F.concat(F.lit("e"), page.cast("string")).alias("element"), (at * 1000000).alias("first"), (F.lit(72.0) + at * 14.0).alias("base"), "t")


def glyphs(spark: SparkSession, sf: str) -> DataFrame:
    # a line in pieces that end with a comma: the piece's number is that of the commas before, so no window is needed
    piece = _placed(spark, sf).select("*", F.posexplode(F.split("t", "(?<=,)", -1)).alias("commas", "p")).filter("p <> ''")
    start = F.when(F.col("commas") == 0, 0).otherwise(F.length(F.expr("substring_index(t, ',', commas)")) + 1)
    piece = piece.select("doc_id", "page", "element", "base", (F.col("first") + start).alias("first"), (F.lit(72.0) + start * 6.0 + F.col("commas") * 4.0).alias("x"), "p")
    each = piece.select("*", F.posexplode(F.split("p", "", -1)).alias("k", "content"))
    x0, base = F.col("x") + F.col("k") * 6.0, F.col("base")
    return each.select("doc_id", "page", "element", (F.col("first") + F.col("k")).cast("int").alias("ord"), "content", x0.alias("x0"), (base - 10.0).alias("y0"), (x0 + 6.0).alias("x1"), (base + 2.0).alias("y1"), F.lit(10.0).alias("font_size"), base.alias("baseline"))


GLYPHS = f"""SELECT doc_id, CAST(i // 50 + 1 AS INTEGER) AS page, 'e' || (i // 50) AS element, (i % 50) * 1000000 + j AS ord, content, x0, base - 10.0 AS y0, x0 + 6.0 AS x1, base + 2.0 AS y1, 10.0::DOUBLE AS font_size, base AS baseline, i % 50 AS row
FROM (SELECT doc_id, i, j, content, 72.0::DOUBLE + (i % 50) * 14.0::DOUBLE AS base, 72.0::DOUBLE + j * 6.0::DOUBLE + 4.0::DOUBLE * coalesce(sum(CASE WHEN content = ',' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0
FROM (SELECT doc_id, i, unnest(range(len(c))) AS j, unnest(c) AS content FROM (SELECT doc_id, i, regexp_extract_all(t, '(?s).') AS c FROM ({LINES}))))"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A text box of each page with glyphs, an image on each page that covers none to nine tenths of it, by the id, and a path."""
    # a line's glyphs go from 72 to the right edge of the last one, which the commas before it shift
    before = F.expr("length(t) - 1 - length(replace(substring(t, 1, length(t) - 1), ',', ''))")
    right = F.lit(72.0) + F.length("t") * 6.0 + before * 4.0
    text = _placed(spark, sf).groupBy("doc_id", "page", "element").agg(F.min(F.lit(72.0)).alias("x0"), (F.min("base") - 10.0).alias("y0"), F.max(right).alias("x1"), (F.max("base") + 2.0).alias("y1"), F.sum(F.length("t")).alias("characters"))
    text = text.select("doc_id", "page", F.lit("text").alias("kind"), "element", "x0", "y0", "x1", "y1", "characters")
    share = F.element_at(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.65), F.lit(0.9)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    p = pages(spark, sf)
    image = p.select("doc_id", "page", F.lit("image").alias("kind"), F.lit("i").alias("element"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), (F.lit(792.0) * share).alias("y1"), F.lit(0).alias("characters"))
    path = p.select("doc_id", "page", F.lit("path").alias("kind"), F.lit("r").alias("element"), F.lit(72.0).alias("x0"), F.lit(700.0).alias("y0"), F.lit(540.0).alias("x1"), F.lit(701.0).alias("y1"), F.lit(0).alias("characters"))
    return text.unionByName(image).unionByName(path)


BOXES = f"""SELECT doc_id, page, 'text' AS kind, element, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS characters FROM ({GLYPHS}) GROUP BY doc_id, page, element
UNION ALL SELECT doc_id, page, 'image', 'i', 0.0, 0.0, 612.0, 792.0::DOUBLE * CASE doc_id % 4 WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 0.65::DOUBLE WHEN 3 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END, 0 FROM ({PAGES})
UNION ALL SELECT doc_id, page, 'path', 'r', 72.0, 700.0, 540.0, 701.0, 0 FROM ({PAGES})"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A block of each line with text: its size goes by its place, every seventh is bold."""
    size = F.when(F.col("i") == 0, 18.0).when(F.pmod("i", F.lit(5)) == 0, 12.0).otherwise(10.0)
    y = F.lit(72.0) + F.pmod("i", F.lit(50)) * 14.0 + F.when(F.pmod("i", F.lit(4)) == 0, 5.0).otherwise(0.0)
    x0 = F.lit(72.0) + F.when(F.pmod("i", F.lit(9)) == 8, 40.0).otherwise(0.0)
    got = lines(spark, sf).select("doc_id", (F.floor(F.col("i") / 50).cast("int") + 1).alias("page"), F.concat(F.lit("b"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("element"), F.col("t").alias("content"), x0.alias("x0"), (y - 8.0).alias("y0"), (x0 + F.length("t") * 4.0).alias("x1"), y.alias("y1"), size.alias("size"), (F.pmod("i", F.lit(7)) == 6).alias("bold"))
    return got.filter("content <> ''")


BLOCKS = f"""SELECT doc_id, page, element, content, x0, y - 8.0 AS y0, x0 + length(content) * 4.0::DOUBLE AS x1, y AS y1, size, bold FROM (SELECT doc_id, CAST(i // 50 + 1 AS INTEGER) AS page, 'b' || lpad(CAST(i AS VARCHAR), 6, '0') AS element, t AS content,
72.0::DOUBLE + CASE WHEN i % 9 = 8 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS x0, 72.0::DOUBLE + (i % 50) * 14.0::DOUBLE + CASE WHEN i % 4 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN i = 0 THEN 18.0::DOUBLE WHEN i % 5 = 0 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS size, i % 7 = 6 AS bold FROM ({LINES}) WHERE t <> '')"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs: the status goes by the type's length, ``updated_at`` is an hour after ``created_at`` for each tenth of the value."""
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed"))), (F.pmod(F.length("event_type") + F.col("event_id"), F.lit(4)) + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), status.alias("status"), ts.alias("created_at"), (ts + F.expr("make_interval(0,0,0,0,cast(event_id % 48 as int),0,0)")).alias("updated_at"))


JOBS = "SELECT event_id AS id, CASE (length(event_type) + event_id) % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, ts AS created_at, ts + to_hours(CAST(event_id % 48 AS INTEGER)) AS updated_at FROM events"
