"""Office files, books and data files as Markdown. All are read with the standard library; a broken file raises."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile

from leafmill.sources.markup import Node, decoded, parse
from leafmill.sources.render import html_to_markdown, join_blocks, pipe_table, squeeze, tidy


class Package:
    """The parts of a zipped document."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()

    def xml(self, name: str) -> Node:
        return parse(decoded(self.zip.read(name)), xml=True)

    def relations(self, name: str) -> dict[str, str]:
        """Targets of a part's relations by their id."""
        folder, _, base = name.rpartition("/")
        path = f"{folder}/_rels/{base}.rels"
        if path not in self.names:
            return {}
        return {n.attrs.get("Id", ""): posixpath.normpath(posixpath.join(folder, n.attrs.get("Target", ""))).lstrip("/") for n in self.xml(path).walk() if n.name == "Relationship"}


def attribute(node: Node | None, name: str) -> str:
    """An attribute whatever its prefix."""
    return next((v for k, v in node.attrs.items() if k.rpartition(":")[2] == name), "") if node is not None else ""


def _runs(paragraph: Node) -> str:
    """Text of a paragraph, bold and italic runs marked."""
    out = []
    for run in (n for n in paragraph.walk() if n.name == "r"):
        text = "".join("\t" if n.name == "tab" else "\n" if n.name in ("br", "cr") else n.text() for n in run.elements() if n.name in ("t", "tab", "br", "cr"))
        style = run.child("rPr")
        on = lambda name: style is not None and (n := style.child(name)) is not None and attribute(n, "val") not in ("0", "false") or attribute(style, name) == "1"  # noqa: E731, B023
        mark = ("**" if on("b") else "") + ("*" if on("i") else "")
        body = text.strip()
        out.append(text.replace(body, mark + body + mark[::-1], 1) if mark and body else text)
    return "".join(out).strip()


def _grid(table: Node) -> str:
    rows = [[squeeze(" ".join(_runs(p) for p in cell.walk() if p.name == "p")) for cell in row.elements() if cell.name == "tc"] for row in table.elements() if row.name == "tr"]
    return pipe_table(rows)


def word(content: bytes, _: str | None = None) -> str:
    """A text document: headings by style, lists by numbering, tables."""
    body = Package(content).xml("word/document.xml").find("body")
    blocks: list[str] = []
    listed = False
    for node in body.elements() if body is not None else ():
        if node.name == "tbl":
            blocks.append(_grid(node))
        if node.name != "p" or not (text := _runs(node)):
            listed = False
            continue
        style = attribute(node.find("pStyle"), "val").lower()
        level = 1 if style == "title" else int(m[1]) if (m := re.fullmatch(r"(?:heading|kop|berschrift|titre)\s?([1-6])", style.lstrip("ü"))) else 0
        numbering = node.find("numPr")
        if numbering is not None and not level:
            depth = attribute(numbering.child("ilvl"), "val")
            line = "  " * int(depth if depth.isdigit() else 0) + "- " + text
            if listed:
                blocks[-1] += "\n" + line
            else:
                blocks.append(line)
            listed = True
            continue
        listed = False
        blocks.append("#" * level + " " * bool(level) + text)
    return join_blocks(blocks)


def slides(content: bytes, _: str | None = None) -> str:
    """A presentation: a comment with the number of each slide, its title as heading, its texts, tables and notes."""
    package = Package(content)
    paths = sorted((n for n in package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    blocks = []
    for number, path in enumerate(paths, 1):
        blocks.append(f"<!-- Slide number: {number} -->")
        for shape in (n for n in package.xml(path).walk() if n.name in ("sp", "tbl")):
            if shape.name == "tbl":
                blocks.append(_grid(shape))
                continue
            lines = [t for p in shape.walk() if p.name == "p" and (t := _runs(p))]
            if lines:
                title = attribute(shape.find("ph"), "type") in ("title", "ctrTitle")
                blocks.append("# " + " ".join(lines) if title else "\n".join(lines))
        for target in package.relations(path).values():
            if "notesSlide" in target and target in package.names:
                notes = [t for s in package.xml(target).walk() if s.name == "sp" and attribute(s.find("ph"), "type") == "body" for p in s.walk() if p.name == "p" and (t := _runs(p))]
                blocks += ["### Notes:", "\n".join(notes)] if notes else []
    return join_blocks(blocks)


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheets(content: bytes, _: str | None = None) -> str:
    """A workbook: each sheet as a heading and a table; empty rows and sheets are left out."""
    package = Package(content)
    shared = [n.text() for n in package.xml("xl/sharedStrings.xml").walk() if n.name == "si"] if "xl/sharedStrings.xml" in package.names else []
    targets = package.relations("xl/workbook.xml")
    blocks = []
    for sheet in (n for n in package.xml("xl/workbook.xml").walk() if n.name == "sheet"):
        path = targets.get(attribute(sheet, "id"), "")
        if path not in package.names:
            continue
        rows = []
        for row in (n for n in package.xml(path).walk() if n.name == "row"):
            cells: list[str] = []
            for cell in (n for n in row.elements() if n.name == "c"):
                kind, value = cell.attrs.get("t", "n"), cell.child("v").text() if cell.child("v") is not None else cell.text()
                at = max(len(cells), _column(cell.attrs.get("r", "")))
                cells += [""] * (at - len(cells))
                cells.append(shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value)
            if any(c.strip() for c in cells):
                rows.append(cells)
        if rows:
            blocks += [f"## {attribute(sheet, 'name')}", pipe_table(rows)]
    return join_blocks(blocks)


def book(content: bytes, _: str | None = None) -> str:
    """A book: its data, and its chapters in reading order."""
    package = Package(content)
    root = attribute(package.xml("META-INF/container.xml").find("rootfile"), "full-path")
    opf = package.xml(root)
    data = [f"**{name.title()}:** {', '.join(found)}" for name in ("title", "creator", "language", "publisher", "date", "description") if (found := [squeeze(n.text()) for n in opf.walk() if n.name == name and squeeze(n.text())])]
    items = {n.attrs.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(root), n.attrs.get("href", ""))) for n in opf.walk() if n.name == "item"}
    order = [items.get(n.attrs.get("idref")) for n in opf.walk() if n.name == "itemref"]
    chapters = [html_to_markdown(decoded(package.zip.read(path))).strip() for path in order if path in package.names]
    return join_blocks(["\n".join(data), *chapters])


def delimited(text: str, _: str | None = None) -> str:
    """Delimited values as a table; the separator is the one that occurs most in the first line."""
    first = text.lstrip("﻿").split("\n", 1)[0]
    separator = max(",;\t|", key=lambda c: (first.count(c), c == ","))
    return tidy(pipe_table([[squeeze(c) for c in row] for row in csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=separator) if any(c.strip() for c in row)]))


def json_data(text: str, _: str | None = None) -> str:
    """A list of flat records as a table; other JSON as it stands."""
    value = json.loads(text)
    flat = isinstance(value, list) and value and all(isinstance(r, dict) and not any(isinstance(v, (dict, list)) for v in r.values()) for r in value)
    if not flat:
        return tidy(text)
    names = list(dict.fromkeys(k for r in value for k in r))
    shown = lambda v: "" if v is None else str(v) if isinstance(v, str) else json.dumps(v)
    return tidy(pipe_table([names, *([squeeze(shown(r.get(k))) for k in names] for r in value)]))


def zipped_xml(content: bytes) -> str:
    """The first XML file of an archive."""
    package = Package(content)
    name = next((n for n in package.names if n.endswith(".xml")), None)
    if name is None:
        raise LookupError("xml")
    return decoded(package.zip.read(name))
