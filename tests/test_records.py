"""Nested records: tables, compact projection and whole-document Markdown."""

import json
import random

import pytest

from quire.operators import document, layout, lean
from quire.plans.registry import QUERIES
from quire.sources import records


def text(n, content, y, size=10.0, bold=False, x=72.0, **more):
    box = {"x0": x, "y0": y, "x1": x + 6.0 * len(content), "y1": y + size}
    return {"type": "text", "id": f"p1-e{n}", "bbox": box, "content": content, "font": {"name": "F", "size": size, "bold": bold, "italic": False}, "color": {"fill": [0, 0, 0], "stroke": None}} | more


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("records")
    link = {"type": "annotation", "id": "p1-e5", "bbox": {"x0": 72.0, "y0": 150.0, "x1": 90.0, "y1": 160.0}, "subtype": "link", "uri": "https://x.test/a b"}
    run = lambda c, bold, href=None: {"content": c, "font": {"name": "F", "size": 10.0, "bold": bold, "italic": False}, "color": {"fill": None, "stroke": None}} | ({"href": href} if href else {})
    page = [
        text(0, "A Title", 72.0, 20.0, True),
        text(1, "plain *text* that goes", 110.0),
        text(2, "on below", 121.0, runs=[run("on ", False), run("below", True, "javascript:x")]),
        text(3, "linked", 150.0),
        text(4, "3) third item", 180.0),
        link,
        text(6, "Same", 200.0, x=72.0),
        text(7, "row", 200.0, x=100.0),
    ]
    doc = {"schema_version": "1.1", "source": {"format": "pdf", "sha256": "0", "size_bytes": 1}, "document": {"page_count": 1, "metadata": {"title": None, "author": None}}, "warnings": ["page 1: suspected_garbled_text: x"], "pages": [{"page_number": 1, "width": 612.0, "height": 792.0, "rotation": 0, "scanned": False, "elements": page, "hidden": []}]}
    (at / "one.json").write_text(json.dumps(doc))
    return str(at)


def test_markdown_of_a_document(spark, folder):
    got = document.markdown(records.tables(records.read(spark, folder))).collect()
    assert [r.markdown for r in got] == ["# A Title\n\nplain \\*text\\* that goes on **below**\n\n[linked](https://x.test/a%20b)\n\n3. third item\n\nSame row\n"]


def test_compact_projection(spark, folder):
    for words in (False, True):
        got = json.loads(records.compact(records.read(spark, folder), words).first().json)
        first = got["pages"][0]["elements"][0]
        assert got["granularity"] == ("word" if words else "element") and got["document"] == {"page_count": 1, "metadata": {}}
        assert first["font"] == {"name": "F", "size": 20.0, "bold": True} and "color" not in first
        assert first["bbox"] == [72.0, 72.0, 114.0, 92.0]


def test_page_selection_and_warnings(spark, folder):
    t = records.tables(records.read(spark, folder, 2, 3))
    assert t["pages"].count() == 0
    assert [tuple(r) for r in records.garbled_warnings(records.tables(records.read(spark, folder))["warnings"]).collect()] == [("one", 1)]


@pytest.fixture(scope="module")
def rich(tmp_path_factory):
    """A page with every kind of element, optional members with and without values, and an empty document."""
    at = tmp_path_factory.mktemp("rich")
    box = {"x0": 1.0, "y0": 2.0, "x1": 3.25, "y1": 4.0}
    run = lambda c, **more: {"content": c, "font": {"name": "A B", "size": 9.0, "bold": False, "italic": True}, "color": {"fill": [1, 2, 3], "stroke": None}} | more
    cell = lambda n, content, **more: {"bbox": box, "row": 0, "col": n, "row_span": 1, "col_span": 1, "content": content} | more
    glyph = {"content": "h", "bbox": box, "unicode": 104}
    elements = [
        text(0, "hi", 10.0, lines=[{"bbox": box, "baseline_y": 3.0, "words": [{"content": 'h"', "bbox": box, "chars": [glyph]}]}]),
        {"type": "table", "id": "t", "bbox": box, "rows": 1, "cols": 3, "cells": [cell(0, "one", runs=[run("o"), run("ne")]), cell(1, ""), cell(2, "x", runs=[run("x", href="https://x.test/")])]},
        {"type": "chart", "id": "c", "bbox": box, "chart_type": "bar", "title": "T", "series": [{"name": "s1", "points": [{"category": "k", "value": "1"}, {"value": "2"}]}, {"points": [{"value": "3"}]}]},
        {"type": "image", "id": "i", "bbox": box, "quad": [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]], "pixel_width": 7, "pixel_height": None, "colorspace": None, "content_hash": "ab"},
        {"type": "path", "id": "p", "bbox": box, "fill": None, "stroke": [0, 0, 0], "stroke_width": 0.5},
        {"type": "annotation", "id": "a", "bbox": box, "subtype": "widget", "uri": None},
    ]
    pages = [{"page_number": 4, "width": 612.0, "height": 792.5, "rotation": 90, "scanned": True, "elements": elements, "hidden": [{"kind": "note", "content": "below"}]}]
    whole = {"schema_version": "1.1", "source": {"format": "pptx", "sha256": "0", "size_bytes": 1}, "document": {"page_count": 1, "metadata": {"title": None, "author": "me"}}, "warnings": [], "pages": pages}
    (at / "all.json").write_text(json.dumps(whole))
    (at / "none.json").write_text(json.dumps(whole | {"pages": []}))
    return str(at)


def test_full_records_come_back(spark, rich):
    rows = records.read(spark, rich)
    got = {r.doc_id: json.loads(r.json) for r in records.full(rows).collect()}
    for name in ("all", "none"):
        want = json.loads(open(f"{rich}/{name}.json").read())
        assert got[name] == want and list(got[name]) == list(want)
    explicit = json.loads(records.full(rows, explicit=True).filter("doc_id = 'all'").first().json)
    assert list(explicit) == ["granularity", "schema_version", "source", "document", "pages"] and explicit["pages"] == got["all"]["pages"]


def test_classes_of_full_and_compact_records(spark, rich):
    rows = records.read(spark, rich)
    rows = records.with_classes(rows, document.classes(records.tables(rows)))
    full, small = ({r.doc_id: json.loads(r.json) for r in f(rows).collect()} for f in (records.full, records.compact))
    assert full["none"]["pages"] == [] and full["all"]["schema_version"] == small["all"]["schema_version"] == "1.8"
    page = full["all"]["pages"][0]
    assert list(page).index("classification") == 5 and page["classification"] == small["all"]["pages"][0]["classification"]
    assert small["all"]["warnings"] == []


def test_lean_documents(spark, rich):
    got = {r.doc_id: r.text for r in lean.paged(records.tables(records.read(spark, rich)), words=True, mark="m").collect()}
    assert got["none"] == f"#m word v1.9 pages=0\n{lean.PLAIN_WORD_LEGEND}\n"
    box = "1 2 3.3 4"
    want = [
        "#m word v1.9 pages=1", lean.WORD_LEGEND, lean.HIDDEN_LEGEND, "#page 4 612x792.5 rot=90 scanned", "T 72 10 84 20 F 10 -", f'w {box} h"',
        f"TB {box} 1 3", f"c 0 0 1 1 {box} A_B 9 i#010203 one", "r A_B 9 i#010203 o", "r A_B 9 i#010203 ne", f"c 0 1 1 1 {box} - - - ", f"c 0 2 1 1 {box} A_B 9 i#010203 x", "r A_B 9 i#010203 href#<https://x.test/> x",
        f"CH {box} bar T", "s s1", "p k 1", "p 2", "p 3", f"I {box}", f"P {box}", f"A {box} widget -", "<hidden>", "note below", "</hidden>",
    ]
    assert got["all"].split("\n") == [*want, ""]


def test_context_follows_the_pages(spark, folder, rich):
    assert document.markdown(records.tables(records.read(spark, folder)), "hid").first().markdown.endswith("\n\nSame row\n\n> [!WARNING]\n> page 1: suspected\\_garbled\\_text: x\n")
    got = [(r.doc_id, r.markdown) for r in document.markdown(records.tables(records.read(spark, rich)), "hid").collect()]
    assert len(got) == 1 and got[0][1].endswith("\n\n<!-- hid: note below -->\n")


def drawn(rng, n):
    """A record with pages of running text, columns, ruled and borderless tables, links, runs, roles and warnings, as the dice fall."""
    pages = []
    for number in range(1, rng.randrange(2, 5)):
        elements, hidden, y = [], [], 40.0

        def add(content, x, y, size=10.0, elements=elements, hidden=hidden, number=number, **more):
            e = text(0, content, y, size, rng.random() < 0.2, x, **more) | {"id": f"p{number}-e{len(elements)}"}
            if rng.random() < 0.15:
                part = content[: len(content) // 2]
                e["runs"] = [{"content": c, "font": {"name": "F", "size": size, "bold": rng.random() < 0.5, "italic": rng.random() < 0.3}} | ({"href": "https://x.test/r"} if rng.random() < 0.3 else {}) for c in (part, content[len(part) :]) if c]
            if rng.random() < 0.1:
                hidden.append({"kind": rng.choice(["role", "note --x"]), "element": e["id"], "content": rng.choice(["title", "subTitle", "h3", "h+02", "other > --"])})
            elements.append(e)

        path = lambda x0, y0, x1, y1, elements=elements: elements.append({"type": "path", "id": f"v{len(elements)}", "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "stroke": [0, 0, 0], "stroke_width": 0.5})
        for _ in range(rng.randrange(0, 5)):
            kind = rng.choice(["prose", "prose", "ruled", "merged", "aligned", "columns", "open"])
            if kind == "prose":
                for _ in range(rng.randrange(1, 5)):
                    add(rng.choice(["Some *text* of a paragraph that goes on", "7) an item", "- dash <br>", "• dot", "short", " \n ", "a\nb  c", "Head & <b>"]), rng.choice([72.0, 72.0, 90.0]), y, rng.choice([10.0, 10.0, 10.2, 14.0, 20.0]))
                    y += rng.choice([11.0, 11.0, 25.0])
            elif kind == "columns":
                for _ in range(5):
                    add("a column of running text here", 72.0, y)
                    add("and another that is as wide", 340.0, y + rng.choice([0.0, 3.0]))
                    y += 12.0
            elif kind == "aligned":
                for r in range(4):
                    for c in range(3):
                        add(f"c{r} {c}", 72.0 + 120.0 * c, y + 14.0 * r)
                y += 56.0
            else:
                for r in range(4):
                    path(72.0, y + 20.0 * r, 150.0 if kind == "open" and r in (1, 2) else 372.0, y + 20.0 * r)
                for c in range(4):
                    path(72.0 + 100.0 * c, y + (20.0 if kind == "merged" and c == 1 else 0.0), 72.0 + 100.0 * c, y + 60.0)
                for r in range(3):
                    for c in range(3):
                        if rng.random() < 0.9:
                            add(f"r{r} |{c}", 77.0 + 100.0 * c, y + 20.0 * r + 2.0, 6.0)
                            if rng.random() < 0.3:
                                add("<br> & below", 77.0 + 100.0 * c, y + 20.0 * r + 10.0, 6.0)
                y += 60.0
            y += 30.0
        for e in [e for e in elements if e["type"] == "text" and rng.random() < 0.1]:
            elements.append({"type": "annotation", "id": f"a{len(elements)}", "bbox": e["bbox"] | {"x1": e["bbox"]["x1"] + 0.5}, "subtype": "link", "uri": rng.choice(["https://x.test/(a) b", "javascript:x", None])})
        pages.append({"page_number": number, "width": 612.0, "height": 792.0, "rotation": 0, "scanned": False, "elements": elements, "hidden": hidden})
    source = {"format": "pdf" if n % 5 else "pptx", "sha256": "0", "size_bytes": 1}
    return {"schema_version": "1.1", "source": source, "document": {"page_count": 1, "metadata": {}}, "warnings": ["one\n_two_"] if n % 3 == 0 else [], "pages": pages}


def test_records_are_printed_where_they_are_as_by_tables(spark, tmp_path, data):
    rng = random.Random(11)
    for n in range(60):
        (tmp_path / f"d{n}.json").write_text(json.dumps(drawn(rng, n)))
    rows = records.read(spark, str(tmp_path))
    for tag in (None, "hid"):
        got, want = ({r.doc_id: r.markdown for r in f.collect()} for f in (document.of_records(rows, tag), document.markdown(records.tables(rows), tag)))
        assert got == want
    assert any("colspan" in x for x in got.values()) and any("| --- |" in x for x in got.values()) and any("skipped" in x for x in got.values())
    for name in ("record_context", "record_markdown"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_line_breaks_in_pipe_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a\n<br> b"), (1, 0, 1, "c|")], "t int, row int, col int, content string")
    want = "| a<br>&lt;br&gt; b | c\\| |\n| --- | --- |"
    assert layout.gfm_table(cells, ["t"]).first().table == want == document._gfm_table([r.asDict() for r in cells.collect()])
