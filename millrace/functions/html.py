"""HTML in one pass over its tags: readable text, main text, links and metadata.

Each function looks for an end only from where it stands, and stops looking for one that is not there, so that its
time is in proportion to the page, whatever is unclosed or nested in it. Pages come as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text; and those of a page's furniture.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head", "title")
FURNITURE = ("nav", "header", "footer", "aside", "form")
BLOCKS = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "main", "body", "html")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: A block of the main text has so many characters at least, and this part of them in links at most.
LEAST_CHARS, MOST_LINKED = 25, 0.33

_SPACE = " \t\n\x0b\x0c\r"
_ASCII = re.ASCII | re.IGNORECASE
_WHITE = re.compile(r"\s+", re.ASCII)
_BLANKS = re.compile(r"[ \t]+")
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))})(?=[\s/>])", _ASCII)
_LINK = re.compile(r"<(/?)a(?=[\s>])", _ASCII)
_OPEN, _SHUT = "\x01", "\x02"


def _without(html: str, start: str, end: str) -> str:
    """Without what lies between two marks; an open one without an end stays."""
    out, at = [], 0
    while (p := html.find(start, at)) >= 0 and (q := html.find(end, p + len(start))) >= 0:
        out.append(html[at:p])
        at = q + len(end)
    return "".join([*out, html[at:]]) if at else html


def _elements(tag: str) -> tuple[re.Pattern, re.Pattern]:
    return re.compile(rf"<{tag}(?=[\s>])", _ASCII), re.compile(rf"</{tag}\s*>", _ASCII)


_MARKS = {t: _elements(t) for t in (*HIDDEN, *FURNITURE, "table")}


def _without_element(html: str, tag: str) -> str:
    """Elements up to their first closing tag become a space."""
    first, last = _MARKS[tag]
    out, at, begin = [], 0, 0
    while m := first.search(html, begin):
        gt = html.find(">", m.end())
        end = last.search(html, gt + 1) if gt >= 0 else None
        if end is None:
            break
        out += [html[at : m.start()], " "]
        at = begin = end.end()
    return "".join([*out, html[at:]]) if at else html


def _tags(html: str, heads: re.Pattern, put: Callable[[re.Match], str], closed: bool = False) -> str:
    """Tags with these heads (which end before white space, / or >) become what put() says. closed: `/` only before the end."""
    out, at, begin = [], 0, 0
    while m := heads.search(html, begin):
        begin = m.end()
        if closed and html[begin] == "/":
            if html[begin + 1 : begin + 2] != ">":
                continue
            gt = begin + 1
        else:
            gt = html.find(">", begin)
            if gt < 0:
                break
        out += [html[at : m.start()], put(m)]
        at = begin = gt + 1
    return "".join([*out, html[at:]]) if at else html


def _lines(html: str, strip_nav: bool, include_tables: bool, linked: bool = False) -> list[str]:
    """The lines of text. linked: links stand between two marks."""
    out = _without(html, "<!--", "-->")
    for tag in (*HIDDEN, *(FURNITURE if strip_nav else ()), *(() if include_tables else ("table",))):
        out = _without_element(out, tag)
    out = _WHITE.sub(" ", out)
    if linked:
        out = _tags(out.replace(_OPEN, " ").replace(_SHUT, " "), _LINK, lambda m: _SHUT if m[1] else _OPEN)
    out = _tags(out, _BLOCK, lambda _: "\n", closed=True)
    out = _without(out, "<", ">")
    for name, char in ENTITIES:
        out = out.replace(name, char)
    return [x for line in out.split("\n") if (x := _BLANKS.sub(" ", line).strip(" "))]


def readable(html: str, strip_nav: bool = True, include_tables: bool = True) -> str:
    return "\n".join(_lines(html, strip_nav, include_tables))


def _density(line: str) -> tuple[str, int]:
    """A line without its marks, and how many of its characters stand in links; a link that is not closed goes to the end."""
    if _OPEN not in line and _SHUT not in line:
        return line, 0
    parts, linked = line.split(_OPEN), 0
    for p in parts[1:]:
        linked += len(p.partition(_SHUT)[0])
    return line.replace(_OPEN, "").replace(_SHUT, ""), linked


def main(html: str, least: int = LEAST_CHARS, most: float = MOST_LINKED) -> str:
    """The blocks of text that are long enough and hold few links, page furniture left out beforehand."""
    found = (_density(line) for line in _lines(html, True, True, linked=True))
    return "\n".join(x.strip(" ") for x, linked in found if len(x) >= least and linked <= most * len(x))


_ANCHOR = re.compile(r"<a(?=\s)", _ASCII)
_HREF = re.compile(r"""href\s*=\s*["']([^"'>]*)["']""", _ASCII)


def hrefs(html: str) -> Iterator[str]:
    """The href of each anchor, as it stands there."""
    begin, gt = 0, -1
    while m := _ANCHOR.search(html, begin):
        if gt < m.end():
            gt = html.find(">", m.end())
            gt = len(html) if gt < 0 else gt
        if found := _HREF.search(html, m.end() + 1, gt):
            yield found[1]
            begin = found.end()
        else:
            begin = gt


_META = re.compile(r"<meta(?=\s)", _ASCII)
_NAMED = re.compile(r"""(?:name|property)=["'](author|article:published_time|date|og:site_name)["']""", _ASCII)
_VALUE = re.compile("""content=["']""", _ASCII)
_CONTENT = re.compile(r"""content=["']([^"']*)["']""", _ASCII)
_LANG = re.compile(r"""lang=["']([^"']*)["']""", _ASCII)
_FIELDS = {"author": "author", "article:published_time": "date", "date": "date", "og:site_name": "sitename"}


def metadata(html: str) -> dict[str, str]:
    """title, author, date, sitename and language, the first of each that is given; and the format."""
    out, begin = {}, 0
    if (p := re.search("<title", html, _ASCII)) and (gt := html.find(">", p.end())) >= 0 and (end := _MARKS["title"][1].search(html, gt + 1)):
        out["title"] = html[gt + 1 : end.start()].strip(" ")
    while m := _META.search(html, begin):
        gt = html.find(">", m.end())
        gt = len(html) if gt < 0 else gt
        named, value = _NAMED.search(html, m.end(), gt), _VALUE.search(html, m.end(), gt)
        value = _CONTENT.match(html, value.start()) if value else None  # a value may hold the sign that ends a tag
        if named and value:
            out.setdefault(_FIELDS[named[1].lower()], value[1])
        begin = gt
    if p := re.search(r"<html(?=\s)", html, _ASCII):
        gt = html.find(">", p.end())
        if found := _LANG.search(html, p.end(), len(html) if gt < 0 else gt):
            out["language"] = found[1]
    return {"format": "html"} | {k: out[k] for k in ("title", "author", "date", "sitename", "language") if out.get(k)}


def _batched(f: Callable[[str], object], kind: pa.DataType, name: str) -> Callable[[Column], Column]:
    @F.arrow_udf(name)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else f(p) for p in pages.to_pylist()], kind)

    return run


def readable_text(html: Column, strip_nav: bool = True, include_tables: bool = True) -> Column:
    """The readable text: scripts, styles, comments and, with strip_nav, page furniture go; blocks end lines; the common entities are resolved."""
    return _batched(lambda p: readable(p, strip_nav, include_tables), pa.string(), "string")(html)


def main_text(html: Column, least: int = LEAST_CHARS, most: float = MOST_LINKED) -> Column:
    """The main text: blocks of at least so many characters, of which links hold at most a part."""
    return _batched(lambda p: main(p, least, most), pa.string(), "string")(html)


def anchors(html: Column) -> Column:
    """The trimmed href of every anchor."""
    return _batched(lambda p: [h.strip(_SPACE) for h in hrefs(p)], pa.list_(pa.string()), "array<string>")(html)


def page_metadata(html: Column) -> Column:
    return _batched(lambda p: list(metadata(p).items()), pa.map_(pa.string(), pa.string()), "map<string,string>")(html)
