"""Text functions: token counts, splitters, overlap, globs, modality, highlights. All of them Catalyst expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it, for both Java and RE2 classes.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEPARATORS = ("\n\n", "\n", ". ", " ")
# The extensions that count as images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif", "webp", "ico")
# Extensions that adapters give the image modality; all others are text.
ADAPTER_IMAGES = ("jpg", "jpeg", "png", "gif", "webp")


def not_blank(text: Column) -> Column:
    return text.rlike(f"[^{SPACE}]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def count_tokens(text: Column) -> Column:
    """Empty: 0, else a quarter of the characters, at least 1."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def fits(text: Column, most: int) -> Column:
    """count_tokens(text) <= most, on the length alone: 4 * (most + 1) characters are the first too many."""
    return F.length(text) < 4 * (most + 1) if most >= 1 else F.length(text) == 0


def split_on(text: Column, separator: str) -> Column:
    """Blank lines collapse; an empty separator does not split; others are literal."""
    if separator == "":
        return F.array(text)
    if separator == "\n\n":
        return F.split(text, rf"\n[{SPACE}]*\n")
    return F.split(text, r"\Q" + separator + r"\E")


def _state(out: Column, cur: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur"))


def _flushed(state: Column) -> Column:
    return F.when(state["cur"] != "", F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"])


_EMPTY = "array<string>"


def merge_pieces(pieces: Column, joiner: str, most: int) -> Column:
    """A greedy fold: neighbours join while they fit; empty pieces are skipped."""

    def step(state: Column, piece: Column) -> Column:
        joined = F.when(state["cur"] != "", F.concat(state["cur"], F.lit(joiner), piece)).otherwise(piece)
        grown = F.when(fits(joined, most), _state(state["out"], joined)).otherwise(_state(_flushed(state), piece))
        return F.when(piece == "", state).otherwise(grown)

    return F.aggregate(pieces, _state(F.array().cast(_EMPTY), F.lit("")), step, _flushed)


def hard_slices(text: Column, most: int) -> Column:
    """Windows of 4 * most characters."""
    width = max(1, 4 * most)
    return F.when(F.length(text) == 0, F.array().cast(_EMPTY)).otherwise(F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(width)), lambda at: F.substring(text, at + 1, F.lit(width))))


def recursive_split(text: Column, most: int = 512, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> Column:
    """Split by the first separator, merge what fits, and go on with finer separators inside what does not; at last slice."""

    def level(part: Column, k: int) -> Column:
        if k == len(separators) or separators[k] == "":
            return hard_slices(part, most)
        merged = merge_pieces(split_on(part, separators[k]), separators[k], most)
        return F.flatten(F.transform(merged, lambda m: F.when(fits(m, most), F.when(not_blank(m), F.array(m)).otherwise(F.array().cast(_EMPTY))).otherwise(level(m, k + 1))))

    none = F.array().cast(_EMPTY)
    pieces = F.when(~not_blank(text), none).when(fits(text, most), F.array(text)).otherwise(level(text, 0))
    return with_overlap(pieces, overlap) if overlap > 0 else pieces


def paragraph_split(text: Column, most: int = 512) -> Column:
    """Paragraphs join while they fit; one too long falls into sentences, and a sentence too long into slices. What is left of a paragraph goes on into the next."""

    def sentence(state: Column, sent: Column) -> Column:
        joined = F.when(state["cur"] != "", F.concat(state["cur"], F.lit(" "), sent)).otherwise(sent)
        out = _flushed(state)
        long = _state(F.concat(out, hard_slices(sent, most)), F.lit(""))
        return F.when(fits(joined, most), _state(state["out"], joined)).when(~fits(sent, most), long).otherwise(_state(out, sent))

    def paragraph(state: Column, para: Column) -> Column:
        joined = F.when(state["cur"] != "", F.concat(state["cur"], F.lit("\n\n"), para)).otherwise(para)
        inner = F.aggregate(F.split(para, rf"(?<=[.!?])[{SPACE}]+"), _state(_flushed(state), F.lit("")), sentence)
        return F.when(para == "", state).when(fits(joined, most), _state(state["out"], joined)).when(~fits(para, most), inner).otherwise(_state(_flushed(state), para))

    pieces = F.aggregate(split_on(text, "\n\n"), _state(F.array().cast(_EMPTY), F.lit("")), paragraph, _flushed)
    return F.when(not_blank(text), pieces).otherwise(F.array().cast(_EMPTY))


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk but the first begins with the end of the one before, apart by a space unless there is white space already."""
    if overlap <= 0:
        return chunks

    def joined(all_: Column, chunk: Column, at: Column) -> Column:
        previous = F.element_at(all_, at)  # at counts from 0, element_at from 1: the one before
        tail = F.right(previous, F.lit(4 * overlap))
        bare = (tail == "") | F.right(tail, F.lit(1)).isin("\n", " ") | F.left(chunk, F.lit(1)).isin("\n", " ")
        return lstrip(F.concat(tail, F.when(bare, "").otherwise(" "), chunk))

    def lapped(all_: Column) -> Column:
        return F.transform(all_, lambda c, i: F.when(i == 0, c).otherwise(joined(all_, c, F.greatest(i, F.lit(1)))))

    return F.transform(F.array(chunks), lapped)[0]  # bound to a variable, so that the chunks are made once


def extension(path: Column) -> Column:
    """The suffix of the last path component, lower case, without its dot; empty for dot files."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def detect_modality(path: Column) -> Column:
    """By what follows the last dot of the whole path."""
    return F.when(F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*IMAGE_EXTENSIONS), "image").otherwise("text")


def adapter_modality(path: Column) -> Column:
    return F.when(extension(path).isin(*ADAPTER_IMAGES), "image").otherwise("text")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole strings; a star crosses slashes."""
    body = re.sub(r"\\[zZ]$", "", fnmatch.translate(pattern))
    return "^" + body.replace("(?>", "(?:") + r"\z"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern matches the whole path or its last component."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
    return out


def selected(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Exclusion first; no inclusion pattern includes everything."""
    kept = ~matches_any(path, exclude) if exclude else F.lit(True)
    return kept & matches_any(path, include) if include else kept


def highlight(text: Column, terms: Sequence[str], before: str = "<em>", after: str = "</em>") -> Column:
    if not terms:
        return text
    words = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)\b({words})\b", f"{before}$1{after}")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, malformed ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


# MIME types by extension where platform tables differ.
MIMES = {
    "md": "text/markdown", "markdown": "text/markdown", "yaml": "text/yaml", "yml": "text/yaml", "py": "text/x-python", "txt": "text/plain",
    "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "tsv": "text/tab-separated-values", "pdf": "application/pdf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
}


def mime(path: Column) -> Column:
    """The MIME type by extension, or null."""
    pairs = [F.lit(x) for k, v in MIMES.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), extension(path))
