"""One pass over a page (EXT0): a fold of the page's tokens with a stack of
open elements.

``page_parts`` is a column: the fold runs inside the row, so nothing is
exchanged and no token leaves the task. What needs no nesting (cleaning,
choice of the text) stays with column expressions in ``operators/html.py``.

Rules of the stack:

* an open tag first ends the elements whose end tag may be left out
  (``ENDED_BY``), up to the nearest element that bounds the search;
* a close tag of a block ends its element and all that is open inside it; one
  of an inline element ends that element only where blocks are open inside;
  one without an open element is ignored, and none reaches out of a table cell;
* ``script`` and ``style`` without an end take the rest of the page;
* all that is open at the end of the page ends there.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaudit.functions.batches import by_slices

# Elements removed with their content before the fallback
# extraction, the fallback selectors in priority order, and void elements.
EXCLUDED_TAGS = ("header", "footer", "nav", "aside", "script", "style", "noscript", "svg",
                 "iframe", "form", "button", "input", "select", "option")
FALLBACK_SELECTORS = ("article", "main", '[role="main"]', "section", "div")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr")
# Block elements that split the primary extractor's text into blocks.
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "body", "dd", "details", "dialog",
              "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
              "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p",
              "pre", "section", "summary", "table", "td", "th", "tr", "ul", "br", "title", "head")
# Elements that leave the head open.
HEAD_CONTENT = ("base", "basefont", "bgsound", "head", "html", "link", "meta", "noscript",
                "script", "style", "template", "title")

TOKEN_RE = ("(?is)(<!--.*?-->|<(script|style|title)\\b[^>]*>.*?</\\2\\s*>"
            # A quoted value may hold ">".
            "|<![^>]*>|</?[A-Za-z](?:[^>=]++|=\\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>|<|[^<]+)")

_CELLS = frozenset(("table", "caption", "td", "th"))
_TABLE = frozenset(("table", "caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"))
_BLOCKS = frozenset(BLOCK_TAGS) | _TABLE | {"html", "select", "button", "svg", "iframe", "noscript"}
_EXCLUDED = frozenset(EXCLUDED_TAGS)
_VOID = frozenset(VOID_TAGS)
_BREAKS = frozenset(BLOCK_TAGS)
_HEAD = frozenset(HEAD_CONTENT)
_SECTIONS = frozenset(("article", "aside", "blockquote", "body", "button", "footer", "form",
                       "header", "main", "nav", "section", "select"))


def _ended_by() -> dict[str, tuple[frozenset, frozenset]]:
    """Open tag -> (elements it ends, elements that bound the search)."""
    lists = _CELLS | _SECTIONS
    rows = {
        ("li",): (("li",), lists | {"ul", "ol", "menu"}),
        ("dt", "dd"): (("dt", "dd"), lists | {"dl"}),
        ("rt", "rp"): (("rt", "rp"), lists | {"ruby"}),
        ("option",): (("option",), _CELLS | {"select", "datalist", "optgroup"}),
        ("optgroup",): (("option", "optgroup"), _CELLS | {"select"}),
        ("td", "th"): (("td", "th"), frozenset(("tr", "table"))),
        ("tr",): (("tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
        ("thead", "tbody", "tfoot"): (_TABLE - {"table"}, frozenset(("table",))),
        ("body",): (("head",), frozenset()),
    }
    out = {tag: (frozenset(ends), frozenset(stop)) for tags, (ends, stop) in rows.items() for tag in tags}
    paragraph = frozenset(("p",)), _CELLS | {"button"}
    for tag in _BREAKS - _TABLE - {"body", "br", "title", "head", "li", "dt", "dd"}:
        out[tag] = paragraph
    return out


ENDED_BY = _ended_by()

_TOKEN = re.compile(TOKEN_RE, re.ASCII)
_RAW = re.compile(r"(?is)^<(script|style|title)\b.*</", re.ASCII)
_TAG = re.compile(r"^</?([A-Za-z][^\s/>]*)", re.ASCII)
_TITLE = re.compile(r"(?is)^<title\b[^>]*>(.*)</title\s*>$", re.ASCII)
_ANY_TAG = re.compile("<[^>]*>")


def attr_pattern(name: str) -> str:
    """Pattern of the value of attribute ``name`` in a raw start tag."""
    return ("(?is)^<[A-Za-z][^\\s/>]*(?:\\s+.*?)?[\\s\"'/]" + name
            + "\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'=<>`]+))")


def _attr(raw: str, name: str) -> str:
    found = re.match(attr_pattern(name), raw, re.ASCII)
    return "".join(g or "" for g in found.groups()) if found else ""


def _decoded(text: str) -> str:
    """Entities are decoded twice (by the page and by the cleaner), then NFKC."""
    if text.isascii() and "&" not in text:
        return text
    return unicodedata.normalize("NFKC", _html.unescape(_html.unescape(text)))


class _Open:
    """The open elements of a page and what they mean for the text in them."""

    def __init__(self, selectors: Sequence[str]):
        self.by_tag = {s: k for k, s in enumerate(selectors) if not s.startswith("[")}
        self.by_attr = [(*s.strip("[]").replace('"', "").split("=", 1), k)
                        for k, s in enumerate(selectors) if s.startswith("[")]
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.tags: Counter = Counter()
        self.excluded = 0
        self.depth = [0] * len(selectors)
        self.start = [0] * len(selectors)
        self.ranges: list[dict] = []

    def push(self, tag: str, raw: str, n: int) -> None:
        hits = [self.by_tag[tag]] if tag in self.by_tag else []
        hits += [k for name, value, k in self.by_attr if name in raw.lower() and _attr(raw, name) == value]
        for k in hits:
            if not self.depth[k]:
                self.start[k] = n
            self.depth[k] += 1
        self.tags[tag] += 1
        self.excluded += tag in _EXCLUDED
        self.stack.append((tag, tuple(hits)))

    def remove(self, i: int, n: int) -> None:
        tag, hits = self.stack.pop(i)
        self.tags[tag] -= 1
        self.excluded -= tag in _EXCLUDED
        for k in hits:
            self.depth[k] -= 1
            if not self.depth[k]:
                self.ranges.append({"sel": k, "first": self.start[k], "n": n - self.start[k]})

    def cut(self, i: int, n: int) -> None:
        while len(self.stack) > i:
            self.remove(-1, n)

    def make_room(self, tag: str, n: int) -> None:
        """End what the open tag ``tag`` ends."""
        if tag not in _HEAD and self.tags["head"]:
            self.close("head", n)
        if tag == "a" and self.tags["a"]:
            self.close("a", n)
        ends, stop = ENDED_BY.get(tag, ((), ()))
        if not any(self.tags[e] for e in ends):
            return
        last = None
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in ends:
                last = i
            elif name in stop:
                break
        if last is not None:
            self.cut(last, n)

    def close(self, tag: str, n: int) -> None:
        if not self.tags[tag]:
            return
        block, crossed = tag in _BLOCKS, False
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                if block or not crossed:
                    self.cut(i, n)
                else:
                    self.remove(i, n)
                return
            crossed |= name in _BLOCKS
            bound = name == "table" or (name in _CELLS and tag not in _TABLE)
            if bound and tag not in ("body", "html"):
                return


def fold_page(page: str, selectors: Sequence[str] = FALLBACK_SELECTORS, min_block_chars: int = 1,
              max_link_density: float = 0.5) -> dict:
    """The parts of one page: ``title`` (first one, as text; null if none),
    ``meta_name`` and ``meta_content`` of the first robots meta with noindex,
    ``primary`` (EXT6: blocks of text between block tags with enough
    characters and few enough of them in links; null if none), ``nodes`` (the
    stripped texts outside excluded elements and the head, in order) and
    ``ranges`` (per selector the nodes of each of its outermost elements)."""
    opened = _Open(selectors)
    title = meta = None
    nodes: list[str] = []
    primary: list[str] = []
    block: list[str] = []
    chars = in_links = 0

    def end_block() -> None:
        nonlocal chars, in_links
        if block and chars >= min_block_chars and in_links <= chars * max_link_density:
            primary.append("".join(block))
        block.clear()
        chars = in_links = 0

    for found in _TOKEN.finditer(page):
        raw = found.group(1)
        named = _TAG.match(raw) if raw.startswith("<") else None
        if named is None:
            if raw.startswith("<!"):
                continue
            text = raw.strip()
            if text and not opened.excluded and not opened.tags["head"]:
                nodes.append(_decoded(text))
                block.append(text)
                chars += len(text)
                in_links += len(text) if opened.tags["a"] else 0
            continue
        tag, n = named.group(1).lower(), len(nodes)
        if tag in _BREAKS:
            end_block()
        if raw.startswith("</"):
            opened.close(tag, n)
        elif _RAW.match(raw):
            if tag == "title" and title is None:
                title = _decoded(_ANY_TAG.sub(" ", _TITLE.sub(r"\1", raw)).strip())
        elif tag in ("script", "style"):
            break
        else:
            if tag == "meta" and meta is None:
                name, content = _attr(raw, "name").strip().lower(), _attr(raw, "content").strip()
                if name in ("robots", "googlebot") and "noindex" in content.lower():
                    meta = name, content
            opened.make_room(tag, n)
            drawn = tag == "svg" or opened.tags["svg"]
            if tag not in _VOID and not (drawn and raw.endswith("/>")):
                opened.push(tag, raw, n)
    end_block()
    opened.cut(0, len(nodes))
    name, content = meta or (None, None)
    return {"title": title, "meta_name": name, "meta_content": content,
            "primary": _decoded("\n".join(primary)) if primary else None,
            "nodes": nodes, "ranges": opened.ranges}


PARTS = pa.struct([("title", pa.string()), ("meta_name", pa.string()), ("meta_content", pa.string()),
                   ("primary", pa.string()), ("nodes", pa.list_(pa.string())),
                   ("ranges", pa.list_(pa.struct([("sel", pa.int32()), ("first", pa.int32()),
                                                  ("n", pa.int32())]))),
                   ("error", pa.string())])
PARTS_DDL = ("title string, meta_name string, meta_content string, primary string, nodes array<string>, "
             "ranges array<struct<sel: int, first: int, n: int>>, error string")


def page_parts(html: Column, parse: Callable[[str], dict] = fold_page) -> Column:
    """The parts of each page as a struct; null for a null page. A page for
    which ``parse`` raises has only ``error``, the name of the exception's
    type (EXT13); the other pages of its batch go on."""
    def one(page: str | None) -> dict | None:
        if page is None:
            return None
        try:
            parts = {**parse(page), "error": None}
            # A part of a wrong type is the page's fault as well.
            pa.array([parts], PARTS)
            return parts
        except Exception as raised:  # noqa: BLE001
            return {"error": type(raised).__name__}

    # The parts of a few pages at a time are Python objects.
    some = by_slices(lambda pages: pa.array([one(page) for page in pages.to_pylist()], PARTS), PARTS)

    def batch(pages: pa.Array) -> pa.Array:
        return some(pages)

    batch.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    # Marked non-deterministic so that Catalyst never calls it twice.
    return F.arrow_udf(batch, PARTS_DDL).asNondeterministic()(html)
