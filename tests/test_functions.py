import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import identity, ranking, text, urls
from millrace.operators import chunking


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_identity(spark):
    key = lambda **k: one(spark, identity.idempotency_key(*[F.lit(k.get(n, d)) for n, d in (("s", "a"), ("p", "b"), ("h", None), ("m", "text"))]))
    assert key() == key() and key(s="z") != key() and key(h="") == key()
    import hashlib

    big = next(f"c{k}" for k in range(99) if int(hashlib.md5(f"c{k}".encode()).hexdigest()[:16], 16) > 2**63)
    assert int(one(spark, identity.point_id(F.lit(big)))) == int(hashlib.md5(big.encode()).hexdigest()[:16], 16)
    assert one(spark, identity.base_path(F.lit("a/b#page=12"))) == "a/b"


def reference_recursive(t, most, seps=text.SEPARATORS):
    """The splitter in plain Python, for comparison."""
    import re

    count = lambda x: max(1, len(x) // 4) if x else 0
    if count(t) <= most:
        return [t] if t.strip() else []
    if not seps:
        return [t[i : i + 4 * most] for i in range(0, len(t), 4 * most)]
    parts = re.split(r"\n\s*\n", t) if seps[0] == "\n\n" else t.split(seps[0])
    merged, cur = [], ""
    for p in filter(None, parts):
        both = cur + seps[0] + p if cur else p
        if count(both) <= most:
            cur = both
        else:
            merged += [cur] if cur else []
            cur = p
    merged += [cur] if cur else []
    return [x for m in merged for x in ([m] if count(m) <= most and m.strip() else [] if count(m) <= most else reference_recursive(m, most, seps[1:]))]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\té", max_size=120), min_size=1, max_size=20), st.integers(1, 12))
def test_recursive_split_equals_plain_python(spark, texts, most):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.recursive_split(F.col("t"), most).alias("x"))
    assert [r.x for r in df.collect()] == [reference_recursive(t, most) if t.strip() else [] for t in texts]


def test_chunks_overlap_and_cover(spark):
    body = "\n\n".join(f"para {i} " + " ".join(f"word{j}" for j in range(50)) for i in range(10))
    rows = chunking.chunk(spark.createDataFrame([("s", "p", body)], "source_id string, path string, text string"), most=80, overlap=20).orderBy("chunk_index").collect()
    assert len(rows) > 1 and [r.chunk_index for r in rows] == list(range(len(rows))) and {r.total_chunks for r in rows} == {len(rows)}
    for a, b in zip(rows, rows[1:], strict=False):
        assert set(a.content.split()) & set(b.content.split())
    bare = one(spark, text.recursive_split(F.lit(body), 80))
    kept = sum(len("".join(c.split())) for c in bare)
    assert kept >= 0.95 * len("".join(body.split())) and all(len(c) // 4 <= 160 for c in bare)


def test_hard_slices_paragraphs_and_blank(spark):
    assert one(spark, text.hard_slices(F.lit("a" * 10), 1)) == ["aaaa", "aaaa", "aa"]
    assert one(spark, text.recursive_split(F.lit(" \n\xa0"), 5, 2)) == []
    assert one(spark, text.paragraph_split(F.lit("One two. Three four!\n\nx"), 2)) == ["One two.", "Three four!", "x"]
    with pytest.raises(ValueError, match="strategy"):
        chunking.pieces(F.lit("a"), strategy="other")


@pytest.mark.parametrize(("path", "pattern", "want"), [("a/b/c.md", "*.md", True), ("a/b/c.md", "a/*.md", True), ("a/c.MD", "*.md", False), ("x.txt", "[!y].txt", True), ("dir/x", "dir", False), ("a.mdx", "*.md", False)])
def test_globs(spark, path, pattern, want):
    assert one(spark, text.matches_any(F.lit(path), [pattern])) is want
    assert one(spark, text.selected(F.lit(path), [], [pattern])) is (not want)


@pytest.mark.parametrize(("path", "want", "adapter"), [("a/b.PNG", "image", "image"), ("x.bmp", "image", "text"), ("noext", "text", "text"), (".png", "image", "text"), ("a.tar.gz", "text", "text")])
def test_modality(spark, path, want, adapter):
    assert one(spark, text.detect_modality(F.lit(path))) == want
    assert one(spark, text.adapter_modality(F.lit(path))) == adapter


def test_urls(spark):
    assert one(spark, urls.canonical(F.lit("HTTPS://Example.COM/A?q=1#frag"))) == "https://example.com/A?q=1"
    page = """<a href="/x">1</a> <A class="b" href=' y/z '>2</a> <a href="#top">3</a><a href="mailto:q@w">4</a><a href="//h.org/p">5</a><a href="?k=1">6</a><a href="ftp://a/b">7</a>"""
    assert one(spark, urls.links(F.lit(page), F.lit("http://s.com/d/e?f"))) == ["http://s.com/x", "http://s.com/d/y/z", "http://h.org/p", "http://s.com/d/e?k=1"]
    assert urls.request_spacing("2/s") == 0.5 and urls.request_spacing("30/min") == 2
    for bad in ("5", "0/s", "1/h", None):
        with pytest.raises(ValueError):
            urls.request_spacing(bad)
    assert str(one(spark, urls.http_time(F.lit("Wed, 21 Oct 2015 07:28:00 GMT")))) == "2015-10-21 07:28:00"
    assert one(spark, urls.http_time(F.lit("yesterday"))) is None
    assert one(spark, urls.repository(F.lit("https://h/o/name.git"))) == "name"
    assert urls.with_token("https://h/o.git", "t") == "https://oauth2:t@h/o.git" and urls.with_token("https://u@h/o", "t") == "https://u@h/o"
    assert one(spark, urls.relative_key("pre", F.lit("pre/a/b"))) == "a/b" and one(spark, urls.relative_key("pre", F.lit("prefix/a"))) == "prefix/a"


def test_freshness(spark):
    now = 1_700_000_000
    at = lambda days: one(spark, ranking.freshness(F.lit(None if days is None else now - int(days * 86400)).cast("long"), now))
    assert at(0) == 1 and at(-5) == 1 and at(None) == 0.5 and math.isclose(at(180), math.exp(-1))
    assert ranking.cutoff(now, None) is None and ranking.cutoff(now, -1) is None and ranking.cutoff(now, 2) == now - 172800
    mixed = [one(spark, ranking.blended(F.lit(0.2), F.lit(0.9), b)) for b in (-1, 0, 0.3, 1, 99)]
    assert mixed[0] == mixed[1] == 0.2 and mixed == sorted(mixed) and math.isclose(mixed[3], 0.9) and mixed[3] == mixed[4]
    assert [ranking.fetch_size(k, 0.1) for k in (1, 10, 100)] == [20, 40, 200] and ranking.fetch_size(7, 0) == 7
