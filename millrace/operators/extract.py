"""Extraction: bytes or text in, text with pages, structure and metadata out.

Plain text is an expression; HTML is scanned in Arrow batches, in one pass; office and PDF formats are parsed in Arrow batches, a
failure of one file staying a column of its row. Other backends register under an extractor's name.
"""

from __future__ import annotations

import io
import re
import signal
import threading
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import html as markup
from millrace.functions import text

VERSION = "0.1.0"
SCANNED_BELOW = 50
MAX_ROWS_PER_SHEET = 10_000
TIMEOUT = 60
_TABULAR = {"csv": ",", "tsv": "\t"}

Extracted = dict  # text, pages [(index, text, title)], metadata {str: str}
Backend = Callable[[bytes, str], Extracted]


def plain(docs: DataFrame, content: str = "text") -> DataFrame:
    """Adds metadata (format) and structure (format, delimiter) of tabular texts; the text passes through."""
    ext = text.extension(F.col("path"))
    structure = F.lit(None).cast("map<string,string>")
    for k, d in _TABULAR.items():
        structure = F.when(ext == k, F.create_map(F.lit("format"), F.lit("tabular"), F.lit("delimiter"), F.lit(d))).otherwise(structure)
    metadata = F.when(ext != "", F.create_map(F.lit("format"), ext)).otherwise(F.create_map().cast("map<string,string>"))
    return docs.withColumns({"text": F.col(content), "structure": structure, "metadata": metadata, "extractor_id": F.lit("plain"), "extractor_version": F.lit(VERSION)})


def html(docs: DataFrame, content: str = "html", main: bool = False, **options) -> DataFrame:
    """Adds text (with main, only that of long blocks of few links) and metadata."""
    body = F.col(content)
    found = markup.main_text(body, **options) if main else markup.readable_text(body, **options)
    return docs.withColumns({"text": found, "metadata": markup.page_metadata(body), "extractor_id": F.lit("html"), "extractor_version": F.lit(VERSION)})


def properties(author: Column, title: Column, subject: Column, last_modified_by: Column, created_at: Column) -> Column:
    """Document properties as a map of those that are there."""
    pairs = [("author", author), ("title", title), ("subject", subject), ("last_modified_by", last_modified_by), ("created_at", created_at)]
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & (v != ""))


# ---- formats that need a parser: standard library only


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(archive.read(name))
    except KeyError:
        return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _core(archive: zipfile.ZipFile) -> dict[str, str]:
    root = _xml(archive, "docProps/core.xml")
    names = {"creator": "author", "title": "title", "subject": "subject", "lastModifiedBy": "last_modified_by", "created": "created_at"}
    return {names[_local(e.tag)]: e.text for e in (root if root is not None else ()) if _local(e.tag) in names and e.text}


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(raw: bytes, path: str = "") -> Extracted:
    """Paragraphs that are not empty, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _xml(z, "word/document.xml")
        lines = []
        for p in body.iter() if body is not None else ():
            if _local(p.tag) == "p":
                parts = [e.text or "" if _local(e.tag) == "t" else "\t" if _local(e.tag) == "tab" else "\n" for e in p.iter() if _local(e.tag) in ("t", "tab", "br")]
                lines.append("".join(parts))
        return {"text": "\n".join(x for x in lines if x), "pages": [], "metadata": _core(z) | {"format": "docx"}}


def xlsx(raw: bytes, path: str = "", max_rows: int = MAX_ROWS_PER_SHEET) -> Extracted:
    """A page per sheet: cells by tabs, rows by lines. Sheets cut at max_rows are named."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared_root = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in (shared_root if shared_root is not None else ())]
        book, rels = _xml(z, "xl/workbook.xml"), _xml(z, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target", "") for r in (rels if rels is not None else ())}
        pages, parts, cut = [], [], []
        sheets = [e for e in (book.iter() if book is not None else ()) if _local(e.tag) == "sheet"]
        for index, sheet in enumerate(sheets):
            title = sheet.get("name") or ""
            target = next((targets.get(v, "") for k, v in sheet.attrib.items() if _local(k) == "id"), "").lstrip("/")
            root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
            rows = [r for r in (root.iter() if root is not None else ()) if _local(r.tag) == "row"]
            if len(rows) > max_rows:
                cut.append(title)
            lines = []
            for row in rows[:max_rows]:
                cells: list[str] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.get("r", ""))
                    at = 0
                    for ch in letters[0] if letters else "":
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (max(at, len(cells) + 1) - 1 - len(cells))
                    value = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    elif c.get("t") == "b":
                        value = "True" if value == "1" else "False"
                    cells.append(value)
                lines.append("\t".join(cells))
            body = "\n".join(lines)
            pages.append((index, body, title))
            parts.append(f"# {title}\n{body}")
        extra = {"truncated_sheets": ",".join(cut)} if cut else {}
        return {"text": "\n\n".join(parts), "pages": pages, "metadata": _core(z) | {"format": "xlsx"} | extra}


def pptx(raw: bytes, path: str = "", speaker_notes: bool = True) -> Extracted:
    """A page per slide: the text of each paragraph a line, then the notes."""

    def lines_of(root) -> list[str]:
        found = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in (root.iter() if root is not None else ()) if _local(p.tag) == "p"]
        return [x for x in found if x]

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        pages = []
        for index, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml")):
            root = _xml(z, name)
            title = None
            for shape in (s for s in root.iter() if _local(s.tag) == "sp"):
                if any(_local(e.tag) == "ph" and e.get("type") in ("title", "ctrTitle") for e in shape.iter()):
                    title = "\n".join(lines_of(shape)) or None
            lines = lines_of(root)
            notes = lines_of(_xml(z, f"ppt/notesSlides/notesSlide{index + 1}.xml")) if speaker_notes else []
            if notes:
                lines.append("[notes] " + "\n".join(notes))
            pages.append((index, "\n".join(lines), title))
        return {"text": "\n\n".join(p[1] for p in pages), "pages": pages, "metadata": _core(z) | {"format": "pptx"}}


def office(raw: bytes, path: str) -> Extracted:
    ext = path.rpartition(".")[2].lower()
    if ext not in ("docx", "xlsx", "pptx"):
        raise ValueError(f"no backend for {ext!r}: register one under 'office'")
    return {"docx": docx, "xlsx": xlsx, "pptx": pptx}[ext](raw, path)


_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|(?<![A-Za-z])(?:Td|TD|T\*|ET|')(?![A-Za-z])", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_text(stream: bytes) -> str:
    """The strings that text operators show, as Latin-1; moves to another line end a line."""
    out: list[str] = []
    for token in _PDF_STRING.findall(stream):
        if token[:1] == b"(":
            raw = re.sub(rb"\\([0-7]{1,3})|\\(.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPES.get(m[2], m[2]), token[1:-1], flags=re.S)
            out.append(raw.decode("latin-1"))
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).strip("\n")


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page, for simple PDFs: plain or deflated content streams with single-byte fonts."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S)}

    def stream_of(number: int) -> bytes:
        m = re.search(rb"^(.*?)\bstream\r?\n(.*)\r?\n?endstream", objects.get(number, b""), re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]

    pages = []
    for body in objects.values():
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            numbers = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
            pages.append(_pdf_text(b"\n".join(map(stream_of, numbers))))
    return pages


def pdf(raw: bytes, path: str = "") -> Extracted:
    if raw[:5] != b"%PDF-":
        raise ValueError("not a PDF file")
    pages = pdf_pages(raw)
    full = "\n".join(pages)
    scanned = {"likely_scanned": "true"} if len(full.strip()) < SCANNED_BELOW else {}
    return {"text": full, "pages": [(i, t, None) for i, t in enumerate(pages)], "metadata": {"format": "pdf", "page_count": str(len(pages))} | scanned}


def likely_scanned(content: Column) -> Column:
    return F.length(text.strip(content)) < SCANNED_BELOW


BACKENDS: dict[str, Backend] = {"office": office, "pdf-text": pdf}

_PAGES = pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("title", pa.string())]))
_RESULT = "key string, text string, pages array<struct<index:int,text:string,title:string>>, metadata map<string,string>, error string"


class _Limit:
    """Ends a parse that takes too long, where the worker's main thread runs it."""

    def __init__(self, seconds: int):
        self.seconds = seconds if threading.current_thread() is threading.main_thread() else 0

    def __enter__(self):
        if self.seconds:
            self.before = signal.signal(signal.SIGALRM, self._late)
            signal.alarm(self.seconds)

    def __exit__(self, *_):
        if self.seconds:
            signal.alarm(0)
            signal.signal(signal.SIGALRM, self.before)

    def _late(self, *_):
        raise TimeoutError(f"took more than {self.seconds} s")


def parsed(files: DataFrame, extractor: str, key: str = "event_id", backend: Backend | None = None, timeout: int = TIMEOUT) -> DataFrame:
    """files: key, path, content. key, text, pages, metadata, error: a file that cannot be parsed has its error instead."""
    parse = backend or BACKENDS[extractor]

    def run(batches):
        for b in batches:
            rows = []
            for k, path, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    with _Limit(timeout):
                        x = parse(raw or b"", path or "")
                    rows.append((k, x["text"], [dict(zip(("index", "text", "title"), p, strict=True)) for p in x["pages"]], list(x["metadata"].items()), None))
                except Exception as e:
                    rows.append((k, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            kinds = (pa.string(), pa.string(), _PAGES, pa.map_(pa.string(), pa.string()), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "text", "pages", "metadata", "error"])

    out = files.select(F.col(key).cast("string"), "path", "content").mapInArrow(run, _RESULT)
    return out.withColumnRenamed("key", key).withColumns({"extractor_id": F.lit(extractor), "extractor_version": F.lit(VERSION)})


def extracted(events: DataFrame, **options) -> DataFrame:
    """Routed events with content (binary): one row each with text, pages, structure, metadata, extractor and error."""
    body = events.where("route = 'extract'").select("event_id", "extractor", "source_id", "path", "content")
    text_ = body.withColumn("html", text.decoded(F.col("content")))
    keep = ["event_id", "source_id", "path", "text", "pages", "structure", "metadata", "extractor_id", "extractor_version", "error"]
    nothing = {"pages": F.lit(None).cast("array<struct<index:int,text:string,title:string>>"), "structure": F.lit(None).cast("map<string,string>"), "error": F.lit(None).cast("string")}
    out = plain(text_.where("extractor = 'plain'"), "html").withColumns({k: v for k, v in nothing.items() if k != "structure"}).select(*keep)
    out = out.unionByName(html(text_.where("extractor = 'html'"), **options).withColumns(nothing).select(*keep))
    for name in sorted(BACKENDS):
        own = body.where(F.col("extractor") == name)
        got = parsed(own, name).join(own.select("event_id", "source_id", "path"), "event_id").withColumn("structure", nothing["structure"])
        out = out.unionByName(got.select(*keep))
    return out
