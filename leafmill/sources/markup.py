"""A small tree for HTML and XML that survives broken markup. One pass, no recursion while parsing."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element that a tag of the group closes by itself.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre article section fieldset hr".split())
RAW = frozenset(("script", "style"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</\s*(?P<end>[A-Za-z_][\w.:\-]*)[^>]*>|<(?P<tag>[A-Za-z_][\w.:\-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element: name, attributes, children (nodes and strings)."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def child(self, name: str) -> Node | None:
        return next((c for c in self.elements() if c.name == name), None)

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.elements())

    def find(self, name: str | None = None, **attrs: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and (name is None or n.name == name) and all(n.attrs.get(k.rstrip("_")) == v for k, v in attrs.items())), None)

    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                todo += reversed(part.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def parse(markup: str, xml: bool) -> Node:
    """The root of a tree. Unclosed elements end with their parent, stray end tags are ignored, comments vanish.

    In XML names lose their prefix and keep their case; only the five predefined and numeric entities are resolved.
    """
    root = node = Node("")
    at = 0

    def add(text: str) -> None:
        if text:
            node.children.append(_entities(text) if xml else html.unescape(text))

    while at < len(markup):
        if not xml and node.name in RAW:
            stop = re.compile(rf"</\s*{node.name}\b[^>]*>", re.IGNORECASE).search(markup, at)
            node.children.append(markup[at : stop.start() if stop else len(markup)])
            at, node = (stop.end() if stop else len(markup)), node.parent
            continue
        m = TOKEN.search(markup, at)
        if m is None:
            add(markup[at:])
            break
        add(markup[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            node.children.append(m["cdata"])
        elif m["end"]:
            name = m["end"].rpartition(":")[2] if xml else m["end"].lower()
            open_ = node
            while open_ is not root and open_.name != name:
                open_ = open_.parent
            if open_ is not root:
                node = open_.parent
        elif m["tag"]:
            raw = m["attrs"]
            name = m["tag"].rpartition(":")[2] if xml else m["tag"].lower()
            attrs = {}
            for key, *values in ATTR.findall(raw.rstrip("/")):
                attrs[key if xml else key.lower()] = html.unescape(next((v for v in values if v), ""))
            if not xml:
                while node is not root and (node.name in CLOSES.get(name, ()) or node.name == "p" and name in BREAKS_P):
                    node = node.parent
            new = Node(name, attrs, node)
            node.children.append(new)
            if not (raw.rstrip().endswith("/") if xml else name in VOID):
                node = new
    return root


ENTITY = re.compile(r"&(?:#(\d+)|#x([0-9A-Fa-f]+)|(lt|gt|amp|quot|apos));")
NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _entities(text: str) -> str:
    def one(m: re.Match[str]) -> str:
        if m[3]:
            return NAMED[m[3]]
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""

    return ENTITY.sub(one, text) if "&" in text else text


def decoded(content: bytes) -> str:
    """Text of bytes: byte order mark, declared encoding, UTF-8, Latin-1, in this order."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    head = content[:2000]
    names = [m[1].decode("ascii", "replace") for m in re.finditer(rb"(?:encoding|charset)\s*=\s*[\"']?([\w\-]+)", head)]
    for name in (*names, "utf-8"):
        try:
            return content.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("latin-1")
