"""The scanner of HTML against plain regular expressions, and its time on pages that make those quadratic."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import html
from millrace.operators import extract

PARTS = ["<p>", "</p>", "<br/>", "<br />", "<p/x>", "<div class='a'>", "<nav>", "</nav >", "<nav x>", "<script>", "</script>", "<!--", "-->", "<!-->", "<", ">", "<a href='/x'>", '<A HREF = "y.html" >', "</a>", "<a ", "<preview>", "<pre>", "text", " more ", "&nbsp;", "&amp;lt;", "\n", "\t", "<style", "</style>", "<title>", "</title>", "é", "<h1 id=a>", "a <b> c"]


def plain(x, strip_nav=True):
    """The readable text by regular expressions, one after the other."""
    out = re.sub(r"(?s)<!--.*?-->", "", x)
    for tag in (*html.HIDDEN, *(html.FURNITURE if strip_nav else ())):
        out = re.sub(rf"(?isa)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ", out)
    out = re.sub(r"(?a)\s+", " ", out)
    out = re.sub(rf"(?ia)</?({'|'.join(html.BLOCKS)})(\s[^>]*)?/?>", "\n", out)
    out = re.sub(r"<[^>]*>", "", out)
    for name, char in html.ENTITIES:
        out = out.replace(name, char)
    return re.sub(r"^[ \n]+|[ \n]+$", "", re.sub(r"[ \t]+", " ", re.sub(r"[ \t]*\n[ \t\n]*", "\n", out)))


def test_readable_text_and_links_equal_regular_expressions():
    r = random.Random(11)
    for _ in range(6000):
        x = "".join(r.choices(PARTS, k=r.randrange(14)))
        assert html.readable(x) == plain(x) and html.readable(x, strip_nav=False) == plain(x, False)
        assert list(html.hrefs(x)) == re.findall(r"""(?ia)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']""", x)


@pytest.mark.parametrize("unit", ["<", "<!--", "<a ", "<nav>", "<nav ", "<p ", "<a href='x' ", "&nbsp;", "<script></script", "<meta name='author' ", "<meta content='", "</p", "<div/", "<title>", "\x01", "<a>x"])
def test_time_is_linear(unit):
    """A million characters of what makes regular expressions quadratic."""
    page = unit * (1_000_000 // len(unit))
    for f in (html.readable, html.main, lambda x: list(html.hrefs(x)), html.metadata):
        began = time.process_time()
        f(page)
        assert time.process_time() - began < 2


def test_main_text_and_metadata(spark):
    page = """<html lang="en"><head><title> A  title </title><meta property="og:site_name" content="Site > 1"><META content='Ann' name='author'></head><body><nav>menu of many words that is long enough</nav>
      <div><a href="/1">one link</a> | <a href="/2">another link in a list of links</a></div><p>A paragraph with a <a href="/3">link</a> that is long enough &amp; stays.</p><p>short</p><p>unclosed <a href=x>a link that goes on to the end of its block</p></body></html>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    rows = {r.id: r for r in extract.html(df, main=True).collect()}
    assert rows[1].text == "A paragraph with a link that is long enough & stays."
    assert rows[1].metadata == {"format": "html", "title": "A  title", "author": "Ann", "sitename": "Site > 1", "language": "en"}
    assert rows[2].text is None and rows[3].text == "" and rows[3].metadata == {"format": "html"}
    assert "menu" in df.select(html.readable_text(F.col("html"), strip_nav=False)).first()[0]
