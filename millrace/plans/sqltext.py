"""SQL of the catalogue that is built from pieces: splitters as folds over lists."""

from __future__ import annotations

from millrace.functions.html import LEAST_CHARS, MOST_LINKED
from millrace.functions.text import SEPARATORS, SPACE

_NONE = "[]::varchar[]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+', '')"


def _blank(x: str) -> str:
    return f"not regexp_matches({x}, '[^{SPACE}]')"


def _lit(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def _fits(x: str, most: int) -> str:
    return f"length({x}) < {4 * (most + 1)}"


def hard(x: str, most: int) -> str:
    return f"list_transform(range(0, length({x}), {4 * most}), lambda i: substring({x}, i + 1, {4 * most}))"


def _flush(state: str) -> str:
    return f"case when {state}.cur <> '' then list_append({state}.out, {state}.cur) else {state}.out end"


def _done(fold: str, name: str) -> str:
    return f"list_transform([{fold}], lambda {name}: {_flush(name)})[1]"


def _merge(pieces: str, joiner: str, most: int, k: int) -> str:
    a, p = f"a{k}", f"p{k}"
    joined = f"(case when {a}.cur <> '' then {a}.cur || {joiner} || {p} else {p} end)"
    step = f"case when {p} = '' then {a} when {_fits(joined, most)} then {{'out': {a}.out, 'cur': {joined}}} else {{'out': {_flush(a)}, 'cur': {p}}} end"
    return _done(f"list_reduce({pieces}, lambda {a}, {p}: {step}, {{'out': {_NONE}, 'cur': ''}})", f"z{k}")


def _split(x: str, separator: str) -> str:
    return f"string_split_regex({x}, '\\n[{SPACE}]*\\n')" if separator == "\n\n" else f"string_split({x}, {_lit(separator)})"


def recursive(x: str, most: int) -> str:
    def level(part: str, k: int) -> str:
        if k == len(SEPARATORS):
            return hard(part, most)
        m = f"m{k}"
        merged = _merge(_split(part, SEPARATORS[k]), _lit(SEPARATORS[k]), most, k)
        return f"flatten(list_transform({merged}, lambda {m}: case when {_fits(m, most)} then case when {_blank(m)} then {_NONE} else [{m}] end else {level(m, k + 1)} end))"

    return f"case when {_blank(x)} then {_NONE} when {_fits(x, most)} then [{x}] else {level(x, 0)} end"


def paragraphs(x: str, most: int) -> str:
    cut = f"string_split(regexp_replace(p, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
    sub = "(case when b.cur <> '' then b.cur || ' ' || s else s end)"
    sentence = f"case when {_fits(sub, most)} then {{'out': b.out, 'cur': {sub}}} when not ({_fits('s', most)}) then {{'out': list_concat({_flush('b')}, {hard('s', most)}), 'cur': ''}} else {{'out': {_flush('b')}, 'cur': s}} end"
    joined = "(case when a.cur <> '' then a.cur || chr(10) || chr(10) || p else p end)"
    step = f"case when p = '' then a when {_fits(joined, most)} then {{'out': a.out, 'cur': {joined}}} when not ({_fits('p', most)}) then list_reduce({cut}, lambda b, s: {sentence}, {{'out': {_flush('a')}, 'cur': ''}}) else {{'out': {_flush('a')}, 'cur': p}} end"
    fold = f"list_reduce({_split(x, chr(10) * 2)}, lambda a, p: {step}, {{'out': {_NONE}, 'cur': ''}})"
    return f"case when {_blank(x)} then {_NONE} else {_done(fold, 'z')} end"


def chunked(prefix: str, pieces: str, overlap: int) -> str:
    """prefix ends in a view src (source_id, path, body)."""
    tail = f"right(ps[(i - 1)::int], {4 * overlap})"
    gap = f"case when {tail} = '' or right({tail}, 1) in (chr(10), ' ') or left(c, 1) in (chr(10), ' ') then '' else ' ' end"
    body = f"case when i = 1 then c else {lstrip(f'({tail} || {gap} || c)')} end" if overlap else "c"
    return f"""{prefix}, cut as (select source_id, path, {pieces} as ps from src), lap as (select source_id, path, list_transform(ps, lambda c, i: {body}) as ps from cut),
one as (select source_id, path, len(ps) as total_chunks, unnest(ps) as content, generate_subscripts(ps, 1) - 1 as chunk_index from lap)
select source_id || ':' || path || ':' || chunk_index as chunk_id, chunk_index, total_chunks, content from one"""


def main_text(x: str) -> str:
    """Of the lines of html(x, linked=True) those that are long enough and hold few links."""
    clean = "replace(replace(l, chr(1), ''), chr(2), '')"
    linked = f"length({clean}) - length(replace(regexp_replace(l, chr(1) || '[^' || chr(1) || chr(2) || ']*', '', 'g'), chr(2), ''))"
    kept = f"list_filter(string_split({html(x, True)}, chr(10)), lambda l: length({clean}) >= {LEAST_CHARS} and {linked} <= {MOST_LINKED} * length({clean}))"
    return f"array_to_string(list_transform({kept}, lambda l: trim({clean}, ' ')), chr(10))"


def html(x: str, linked: bool = False) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "template", "svg", "head", "title", "nav", "header", "footer", "aside", "form"):
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    if linked:
        for slash, mark in (("", 1), ("/", 2)):
            out = f"regexp_replace({out}, '(?i)<{slash}a(\\s[^>]*)?>', chr({mark}), 'g')"
    out = f"regexp_replace({out}, '(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|blockquote|pre|main|body|html)(\\s[^>]*)?/?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{name}', {char})"
    out = f"regexp_replace({out}, '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
