"""Flow documents: list numbering, style chains and layers, run merging, breaks, sections, approximate pages, charts, tracks.

Blocks of a story are rows with an explicit order ``ord``.  Counters, resets and segments are windows over that order; no
state is kept in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

LEVELS = 9
#: Limits of style chains and of the runs of a paragraph, blocks for each allowed page.
CHAIN, RUNS, BLOCKS_PER_PAGE = 16, 100, 200


def resolved_levels(nums: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """(list, level, start, format, text, restart): the levels of each list's abstract definition under its overrides."""
    base = nums.join(levels, "abstract").select("list", "level", "start", "format", "text", "restart")
    o = overrides.select("list", "level", *(F.col(c).alias(f"o_{c}") for c in ("start", "format", "text", "restart")))
    got = base.join(o, ["list", "level"], "full")
    replaced = F.col("o_format").isNotNull()
    pick = lambda c: F.when(replaced, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    return got.select("list", "level", F.coalesce("o_start", "start", F.lit(1)).alias("start"), pick("format"), pick("text"), pick("restart"))


def numbering(paragraphs: DataFrame, resolved: DataFrame, story: list[str]) -> DataFrame:
    """Paragraphs (story, ord, list, level) with the counter of their level and their label.

    A counter counts its level's paragraphs since the last paragraph that restarts it: one of a level below the level's
    restart value (by default: any shallower one; 0: none).  ``%k`` in a label is level k's counter, or its start.
    """
    wide = resolved.groupBy("list").agg(*(F.max(F.when(F.col("level") == k, F.struct("start", "format", "text", "restart"))).alias(f"l{k}") for k in range(LEVELS)))
    rows = paragraphs.withColumn("level", F.least("level", F.lit(LEVELS - 1))).join(wide, "list")
    by = Window.partitionBy(*story, "list").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.col("level")
    rows = rows.select("*", *(F.sum((level == k).cast("int")).over(by).alias(f"c{k}") for k in range(LEVELS)))
    trigger = lambda k: F.coalesce(F.col(f"l{k}.restart"), F.lit(k))
    resets = lambda k: (level < k) & (trigger(k) != 0) & (level <= trigger(k) - 1)
    rows = rows.select("*", *(F.coalesce(F.max(F.when(resets(k), F.col(f"c{k}"))).over(by), F.lit(0)).alias(f"r{k}") for k in range(LEVELS)))
    start = lambda k: F.coalesce(F.col(f"l{k}.start"), F.lit(1))
    value = [F.when(F.col(f"c{k}") > F.col(f"r{k}"), start(k) + F.col(f"c{k}") - F.col(f"r{k}") - 1).otherwise(start(k)) for k in range(LEVELS)]
    pick = lambda what: F.coalesce(*(F.when(level == k, what(k)) for k in range(LEVELS)))
    label = pick(lambda k: F.col(f"l{k}.text"))
    for k in range(LEVELS):
        style = F.coalesce(F.col(f"l{k}.format"), F.lit("decimal"))
        label = F.replace(label, F.lit(f"%{k + 1}"), F.when(style == "bullet", "•").otherwise(T.list_number(value[k], style)))
    kind = F.when(pick(lambda k: F.col(f"l{k}.format")) == "bullet", "bullet").otherwise("ordered")
    return rows.select(*paragraphs.columns, pick(lambda k: value[k]).alias("counter"), kind.alias("kind"), label.alias("label"))


def style_chain(styles: DataFrame) -> DataFrame:
    """(style, ancestor, depth) along ``based_on``, itself at depth 0, up to CHAIN styles; a cycle ends at its first repeat."""
    chain = styles.select("style", F.col("style").alias("ancestor"), F.lit(0).alias("depth"), F.array("style").alias("path"), F.col("based_on").alias("next"))
    every, parents = chain, styles.select(F.col("style").alias("p_style"), F.col("based_on").alias("p_next"))
    for depth in range(1, CHAIN):
        step = chain.filter(F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))).join(parents, F.col("next") == F.col("p_style"))
        chain = step.select("style", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("next")).alias("path"), F.col("p_next").alias("next"))
        every = every.unionByName(chain)
    return every.select("style", "ancestor", "depth")


def resolve_layers(layers: DataFrame, by: list[str]) -> DataFrame:
    """Run properties over ordered layers: the last layer that names a font, size or colour wins; bold and italic are true in an
    odd number of layers that set them."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("layer"))).alias(c)
    odd = lambda c: (F.count_if(F.col(c)) % 2 == 1).alias(c)
    return layers.groupBy(*by).agg(last("font"), last("size"), last("color"), odd("bold"), odd("italic"))


def merge_runs(runs: DataFrame, by: list[str], style: list[str], most: int = RUNS) -> DataFrame:
    """Neighbours of equal style as one run; runs from place ``most`` - 1 on are one, in the style of its first."""
    order = Window.partitionBy(*by).orderBy("ord")
    key = F.struct(*style)
    change = F.coalesce(~key.eqNullSafe(F.lag(key).over(order)), F.lit(True)).cast("int")
    numbered = runs.withColumn("change", change).withColumn("run", F.least(F.sum("change").over(order) - 1, F.lit(most - 1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda r: r["content"]), "")
    return numbered.groupBy(*by, "run").agg(text.alias("content"), *(F.min_by(c, "ord").alias(c) for c in style))


def sections(blocks: DataFrame, by: list[str], end: str = "ends_section") -> DataFrame:
    """Blocks with a section number: a block that ends a section belongs to it."""
    order = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("section", F.coalesce(F.sum(F.col(end).cast("int")).over(order), F.lit(0)))


def approximate_pages(events: DataFrame, by: list[str], hint: str = "page_hint") -> DataFrame:
    """Page estimates from rendered page breaks, from 1; null where a document has none."""
    order = Window.partitionBy(*by).orderBy("ord")
    any_ = F.max(F.col(hint).cast("int")).over(Window.partitionBy(*by))
    return events.withColumn("approx_page", F.when(any_ == 1, F.sum(F.col(hint).cast("int")).over(order) + 1))


def page_cap(blocks: DataFrame, most: int) -> DataFrame:
    """Documents over the page limit: by their estimated pages, or without estimates by BLOCKS_PER_PAGE blocks a page."""
    got = blocks.groupBy("doc_id").agg(F.max("approx_page").alias("pages"), F.count("*").alias("blocks"))
    over = F.when(F.col("pages").isNotNull(), F.col("pages") > most).otherwise(F.col("blocks") > most * BLOCKS_PER_PAGE)
    return got.select("doc_id", "pages", "blocks", over.alias("too_many"))


def pending_breaks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Breaks (rows with ``break_kind``) gathered before the next paragraph; those after the last stand alone (null ord)."""
    order = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    target = F.min(F.when(F.col("break_kind").isNull(), F.col("ord"))).over(order)
    breaks = blocks.withColumn("target", target).filter("break_kind is not null")
    return breaks.groupBy(*by, "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "break_kind"))), lambda b: b["break_kind"]).alias("breaks"))


def vertical_anchors(cells: DataFrame, by: list[str]) -> DataFrame:
    """Merged cells: each run of continuations in a column belongs to the last cell before it that starts one."""
    order = Window.partitionBy(*by, "col", "col_span").orderBy("row")
    anchor = F.last(F.when(~F.col("continues"), F.col("row")), ignorenulls=True).over(order)
    return cells.withColumn("anchor", anchor).filter("anchor is not null").groupBy(*by, "col", "col_span", F.col("anchor").alias("row")).agg((F.max("row") - F.min("anchor") + 1).cast("int").alias("row_span"))


def tracks(sizes: DataFrame, by: list[str], extent: str) -> DataFrame:
    """Track sizes and offsets: tracks without a size share what the frame has left, or all of it if none has one."""
    whole = Window.partitionBy(*by)
    zero, given = F.sum((F.col("size") <= 0).cast("int")).over(whole), F.sum(F.greatest("size", F.lit(0.0))).over(whole)
    left = F.greatest(F.col(extent) - given, F.lit(0.0))
    even = (given <= 0) & (F.col(extent) > 0)
    size = F.when(F.col("size") > 0, F.col("size")).when(even, F.col(extent) / F.count("*").over(whole)).when((given > 0) & (left > 0), left / zero).otherwise(F.col("size"))
    sized = sizes.withColumn("fitted", size)
    before = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("fitted").over(before), F.lit(0.0)))


def pair_points(categories: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Chart points paired by index: values with a category first, then those without; categories without a value are dropped."""
    return placed(values.join(categories, [*by, "idx"], "left"), by)


def placed(points: DataFrame, by: list[str]) -> DataFrame:
    """Points with ``place``: those with a category first, each kind by index."""
    order = Window.partitionBy(*by).orderBy(F.col("category").isNull(), "idx")
    return points.withColumn("place", F.row_number().over(order) - 1)


def chart_number(value: Column, code: Column) -> Column:
    """A chart value in its number format: percent, fixed decimals, or at most four without trailing zeros."""
    decimals = F.length(F.regexp_extract(F.regexp_replace(code, "%.*$", ""), r"\.([0#]*)[^.]*$", 1))
    fixed = lambda v, n: F.call_function("format_string", F.concat(F.lit("%."), n.cast("string"), F.lit("f")), v)
    plain = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", ""))
    return F.when(code.contains("%"), F.concat(fixed(value * 100.0, decimals), F.lit("%"))).when(code.contains(".") & code.rlike("[0#]"), fixed(value, decimals)).otherwise(plain)


def resolve_target(source: Column, target: Column) -> Column:
    """The part that a relationship's target names, from the part that holds it; null if it leaves the package."""
    bare = F.replace(F.regexp_replace(target, "#.*$", ""), F.lit("\\"), F.lit("/"))
    folder = F.when(F.startswith(bare, F.lit("/")) | ~source.contains("/"), F.lit("")).otherwise(F.regexp_replace(source, "/[^/]*$", ""))
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), F.regexp_replace(bare, "^/+", "")), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    step = lambda acc, p: F.when(acc.isNull(), acc).when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
