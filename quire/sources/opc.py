"""Office packages: sniffing, parts, XML trees, relationships, themes, and text of slides and paragraphs.

Parsing binary parts is the one thing that runs in Python (zipfile and expat, in Arrow batches): each file becomes rows of
``parts``, each XML part rows of ``xml_nodes`` in document order.  All else is joins and windows over these tables.
Hostile input gives an error row instead of a failure: too many or too large parts, bombs, paths that leave the package,
duplicate names, DTDs, deep or malformed XML.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.flow import resolve_target
from quire.session import ship

#: Limits of packages and of XML parts.
ENTRIES, ENTRY_BYTES, TOTAL_BYTES, RATIO, DEPTH, NODES = 4096, 64 << 20, 512 << 20, 200, 256, 5_000_000
PARTS = "path string, name string, size bigint, compressed bigint, bytes binary, error string"
XML = "path string, part string, node_id bigint, parent_id bigint, last_id bigint, depth int, ord int, name string, ns string, attrs map<string,string>, text string, error string, trail string"
#: Rows and characters of a batch of elements.
BATCH_ROWS, BATCH_CHARACTERS = 8192, 4 << 20


def sniff(content: Column) -> Column:
    """zip, pdf, cfb (legacy or encrypted Office) or null, from the first bytes; a PDF mark may start anywhere below byte 1024."""
    head = F.substring(content, 1, 1028)
    pdf = F.locate("%PDF-", F.decode(head, "ISO-8859-1"))
    return (
        F.when(F.hex(F.substring(content, 1, 4)) == "504B0304", "zip")
        .when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", "cfb")
        .when((pdf > 0) & (pdf <= 1024), "pdf")
    )


def provenance(files: DataFrame) -> DataFrame:
    """Files with their format, SHA-256 and size."""
    return files.withColumn("format", sniff(F.col("content"))).withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content"))


def parts(files: DataFrame) -> DataFrame:
    """A row for each part of each package, or one row with an error."""
    ship(files.sparkSession)

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                names = [i.filename for i in infos]
                if len(infos) > ENTRIES or len(set(names)) != len(names):
                    return [(path, None, None, None, None, "too many entries or duplicate names")]
                if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") for n in names):
                    return [(path, None, None, None, None, "an entry leaves the package")]
                if sum(i.file_size for i in infos) > TOTAL_BYTES or any(i.file_size > ENTRY_BYTES or i.file_size > RATIO * max(i.compress_size, 1) + 1024 for i in infos):
                    return [(path, None, None, None, None, "an entry is too large")]
                out = []
                for i in infos:
                    with z.open(i) as f:
                        data = f.read(i.file_size + 1)
                    if len(data) > i.file_size:
                        return [(path, None, None, None, None, "an entry is larger than declared")]
                    out.append((path, i.filename, i.file_size, i.compress_size, data, None))
                return out
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
            return [(path, None, None, None, None, f"not a readable package: {type(e).__name__}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = read(path, content.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "name", "size", "compressed", "bytes", "error"]) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=["path", "name", "size", "compressed", "bytes", "error"])

    return files.select("path", "content").mapInArrow(run, PARTS)


def office_kind(found: DataFrame) -> DataFrame:
    """(path, kind): pptx before docx by their main parts, docm if the content types say macros, else other."""
    has = lambda name: F.max((F.col("name") == name).cast("int")) == 1
    macros = F.max((F.col("name") == "[Content_Types].xml") & F.decode("bytes", "UTF-8").contains("macroEnabled.main+xml"))
    return found.groupBy("path").agg(F.when(has("ppt/presentation.xml"), "pptx").when(has("word/document.xml"), F.when(macros, "docm").otherwise("docx")).otherwise("other").alias("kind"))


def attributes(attrs: dict[str, str]) -> dict[str, str]:
    """Attributes by local name, those of a namespace also by "namespace}name"; a name without namespace wins over one with."""
    out = {k.rpartition("}")[2]: v for k, v in reversed(attrs.items()) if "}" in k}
    return out | attrs


class Tree:
    """Expat events of one part as rows in document order; a text row's words are its own text pieces joined."""

    def __init__(self):
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: list[int] = []

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if len(self.open) >= DEPTH or len(self.rows) >= NODES:
            raise ValueError("the part is too deep or too large")
        ns, _, local = name.rpartition("}")
        parent = self.open[-1] if self.open else None
        if parent is not None:
            self.children[parent] += 1
        self.rows.append([len(self.rows), parent, None, len(self.open), self.children[parent] - 1 if parent is not None else 0, local, ns, attributes(attrs), ""])
        self.children.append(0)
        self.open.append(len(self.rows) - 1)

    def end(self, _: str) -> None:
        self.rows[self.open.pop()][2] = len(self.rows) - 1

    def data(self, text: str) -> None:
        if self.open:
            self.rows[self.open[-1]][8] += text

    def doctype(self, *_) -> None:
        raise ValueError("the part has a document type")


def parse(data: bytes) -> list[list]:
    """(node, parent, last descendant, depth, place, name, namespace, attributes, text) of every element."""
    tree, p = Tree(), expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = tree.start, tree.end, tree.data, tree.doctype
    p.Parse(data, True)
    return tree.rows


def trails(rows: list[list]) -> Iterator[str]:
    """For each row of ``parse`` the elements above it, outermost first, as "node:name/" each."""
    above: list[str] = []
    for r in rows:
        del above[r[3] :]
        trail = above[-1] if above else ""
        yield trail
        above.append(f"{trail}{r[0]}:{r[5]}/")


def xml_nodes(found: DataFrame) -> DataFrame:
    """The elements of all XML parts (names ending in .xml or .rels), or an error row for a part.

    ``trail`` names what is above an element, so "inside" needs no join (``above``).  Batches hold many small parts, or
    a piece of a large one.
    """
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.sources.opc import BATCH_CHARACTERS, BATCH_ROWS, parse, trails

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.string()]
        names = ["path", "part", "node_id", "parent_id", "last_id", "depth", "ord", "name", "ns", "attrs", "text", "error", "trail"]
        held: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    rows = parse(data.as_py())
                except (expat.ExpatError, ValueError) as e:
                    held.append((path, part, *[None] * 9, f"{type(e).__name__}: {e}", None))
                    rows = []
                for r, trail in zip(rows, trails(rows), strict=True):
                    held.append((path, part, *r[:7], list(r[7].items()), r[8], None, trail))
                    size += len(r[8]) + len(trail) + sum(map(len, r[7].values()))
                    if len(held) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
                        yield batch_of()
                        held, size = [], 0
        if held:
            yield batch_of()

    return found.filter("error is null and (name like '%.xml' or name like '%.rels')").select("path", "name", "bytes").mapInArrow(run, XML)


def _link(*names: str) -> str:
    return rf"(?<![^/])([0-9]+):(?:{'|'.join(names)})/"


def above(*names: str) -> Column:
    """The ids of the elements of some names above an element, outermost first."""
    return F.transform(F.regexp_extract_all("trail", F.lit(_link(*names))), lambda x: x.cast("bigint"))


def inside(*names: str, trail: str = "trail") -> Column:
    """Whether an element of one of some names is above."""
    return F.col(trail).rlike(_link(*names))


def itself(*names: str) -> Column:
    """The element's own id if it has one of some names, as an array like ``above``."""
    return F.when(F.col("name").isin(*names), F.array("node_id")).otherwise(F.array().cast("array<bigint>"))


def descendants(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Descendants of some nodes (path, part, node_id, last_id as of ``xml_nodes``): interval containment in document order."""
    a = above.select("path", "part", F.col("node_id").alias("root_id"), F.col("last_id").alias("root_last"))
    return nodes.join(a, ["path", "part"]).filter((F.col("node_id") > F.col("root_id")) & (F.col("node_id") <= F.col("root_last")))


def relationships(nodes: DataFrame) -> DataFrame:
    """(path, source_part, rel_id, type, target, external): internal targets resolved, null if they leave the package."""
    rel = nodes.filter("name = 'Relationship' and part like '%.rels'")
    folder, file = F.regexp_extract("part", r"^(.*?)_rels/([^/]+)\.rels$", 1), F.regexp_extract("part", r"^(.*?)_rels/([^/]+)\.rels$", 2)
    source, external = F.concat(folder, file), F.coalesce(F.col("attrs")["TargetMode"] == "External", F.lit(False))
    target = F.when(external, F.col("attrs")["Target"]).otherwise(resolve_target(source, F.col("attrs")["Target"]))
    return rel.select("path", source.alias("source_part"), F.col("attrs")["Id"].alias("rel_id"), F.regexp_extract(F.col("attrs")["Type"], "[^/]*$", 0).alias("type"), target.alias("target"), external.alias("external"))


def theme_colors(nodes: DataFrame) -> DataFrame:
    """(path, part, slot, rgb) of the theme parts' colour schemes, sRGB or last system colour."""
    scheme = descendants(nodes, nodes.filter("name = 'clrScheme'"))
    slot = scheme.filter("depth > 0").alias("s").join(scheme.alias("c"), (F.col("c.parent_id") == F.col("s.node_id")) & (F.col("c.path") == F.col("s.path")) & (F.col("c.part") == F.col("s.part")))
    value = F.when(F.col("c.name") == "srgbClr", F.col("c.attrs")["val"]).when(F.col("c.name") == "sysClr", F.col("c.attrs")["lastClr"])
    return slot.filter(value.isNotNull()).select("s.path", "s.part", F.col("s.name").alias("slot"), F.upper(value).alias("rgb"))


def core_metadata(nodes: DataFrame) -> DataFrame:
    """(path, title, author) of packages; empty is null."""
    core = nodes.filter("part = 'docProps/core.xml'")
    pick = lambda name: F.nullif(F.max(F.when(F.col("name") == name, F.col("text"))), F.lit(""))
    return core.groupBy("path").agg(pick("title").alias("title"), pick("creator").alias("author"))


def _texts(inside: DataFrame, by: list[str], leaf: Column, value: Column) -> DataFrame:
    """Values of leaves below roots, joined in document order."""
    got = inside.filter(leaf).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node_id", value.alias("t")))).alias("q"))
    return got.select(*by, F.array_join(F.transform("q", lambda x: x["t"]), "").alias("content"))


def joined(pieces: Column) -> Column:
    """Texts of (node_id, t) in document order, joined."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["t"]), "")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraphs of main document parts: path, ord, style, list, level, content (tabs and breaks as white space, deletions left out).

    An element counts for each paragraph above it.
    """
    named = nodes.filter("part = 'word/document.xml'").filter(F.col("name").isin("p", "t", "tab", "br", "cr", "pStyle", "numId", "ilvl"))
    value = F.when(F.col("name") == "t", F.col("text")).when(F.col("name") == "tab", "\t").when(F.col("name").isin("br", "cr"), "\n")
    piece = F.when(value.isNotNull() & ~inside("del", "moveFrom"), F.struct("node_id", value.alias("t")))
    each = named.select("path", "name", F.col("attrs")["val"].alias("val"), piece.alias("piece"), F.explode(F.concat(above("p"), itself("p"))).alias("root_id"))
    attr = lambda name: F.max(F.when(F.col("name") == name, F.col("val")))
    out = each.repartition("path").groupBy("path", "root_id").agg(attr("pStyle").alias("style"), attr("numId").alias("list"), attr("ilvl").cast("int").alias("level"), joined(F.collect_list("piece")).alias("content"))
    order = Window.partitionBy("path").orderBy("root_id")
    return out.select("path", (F.row_number().over(order) - 1).alias("ord"), "style", "list", F.when(F.col("list").isNotNull(), F.coalesce("level", F.lit(0))).alias("level"), "content")


def relationship_id() -> Column:
    """The id of an element's relationship, whatever its form; null without one."""
    return F.try_element_at(F.map_values(F.map_filter("attrs", lambda k, _: k.rlike("/relationships}id$"))), F.lit(1))


def slides(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(path, page, part) of slides in presentation order."""
    ids = nodes.filter("part = 'ppt/presentation.xml' and name = 'sldId'")
    rel = rels.filter("source_part = 'ppt/presentation.xml'").select("path", F.col("rel_id").alias("r"), F.col("target").alias("part"))
    order = Window.partitionBy("path").orderBy("node_id")
    keyed = ids.select("path", "node_id", relationship_id().alias("r"))
    # dealt by the package alone, which the numbers need; never broadcast: what Python makes is larger than Spark's estimate
    return keyed.repartition("path").hint("merge").join(rel.repartition("path"), ["path", "r"]).select("path", F.row_number().over(order).alias("page"), "part")


def slide_shapes(nodes: DataFrame, slide: DataFrame) -> DataFrame:
    """Visible text shapes of slides: path, page, ord, name, box in points (null without geometry) and content, paragraphs by line feeds."""
    own = nodes.join(slide.select("path", "page", "part"), ["path", "part"])
    sp = own.filter("name = 'sp'")
    inside = descendants(own.drop("page"), sp).join(slide.select("path", "part", "page"), ["path", "part"])
    attr = lambda name, key: F.max(F.when(F.col("name") == name, F.col("attrs")[key]))
    first = inside.groupBy("path", "page", "root_id").agg(
        attr("cNvPr", "name").alias("name"), attr("cNvPr", "hidden").alias("hidden"),
        F.min_by(F.when(F.col("name") == "off", F.struct(F.col("attrs")["x"].cast("double").alias("x"), F.col("attrs")["y"].cast("double").alias("y"))), F.when(F.col("name") == "off", F.col("node_id"))).alias("o"),
        F.min_by(F.when(F.col("name") == "ext", F.struct(F.col("attrs")["cx"].cast("double").alias("w"), F.col("attrs")["cy"].cast("double").alias("h"))), F.when((F.col("name") == "ext") & F.col("attrs")["cx"].isNotNull(), F.col("node_id"))).alias("e"),
    )
    leaf = F.col("name").isin("t", "br", "p")
    value = F.when(F.col("name") == "t", F.col("text")).otherwise("\n")
    text = _texts(inside, ["path", "page", "root_id"], leaf, value).withColumn("content", F.regexp_replace("content", "^\n", ""))
    order = Window.partitionBy("path", "page").orderBy("root_id")
    got = first.filter("coalesce(hidden, '0') not in ('1', 'true')").join(text, ["path", "page", "root_id"])
    x, y, w, h = F.col("o.x") / 12700.0, F.col("o.y") / 12700.0, F.col("e.w") / 12700.0, F.col("e.h") / 12700.0
    return got.select("path", "page", (F.row_number().over(order) - 1).alias("ord"), "name", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), "content")


def rels_path(part: str) -> str:
    """Where a part's relationships are."""
    return posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
