"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed URL's hash picks one block of eight 64-bit words and one bit in each word; the blocks are made by one
aggregation (bit_or), about BITS bits for a listed URL. A page whose bits are not all there is certainly not listed;
those that pass are joined with the list itself, which removes the false positives. Above the list stand rules for
hosts and paths. Everything is built-in expressions.

The filter and the list are broadcast while they are small (counted beforehand). Beyond that both are dealt: the
filter's blocks are joined with the distinct URLs of the pages, so a URL that a third of the pages have is one row
there, and only possible hits are exchanged for the exact join; the pages take the hits that are left by a broadcast
or, if these are many, by a salted join that moves the pages' columns (select narrow ones).

Defined results: a url that is null or without `://` has empty host and path, meets no rule and is never listed;
letters of the host are lowered in ASCII only; of rules of one length that of the longer host wins; repeated rows are judged alike; a list may repeat itself; very long urls are read
whole; an empty table gives an empty result; other columns are carried along (those named as outputs are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, materialise

#: (verdict, host and path prefix); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words in a label of a host that put the pages of the host on the query's list.
LISTED = ("adult", "ads", "bets", "casino", "pills", "spam")
#: Filter bits for each listed URL: with eight bits set for each, under one in a thousand others passes.
BITS = 16
WORDS = 8
SALTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Parameters of a query that name no other page.
_TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, default port and last dot, path without last slashes, and the query in order without tracking; no scheme and fragment. Null without `://`."""
    name = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)?$", ""), r"\.$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    joined = F.array_join(kept, "&")
    return F.when(url.contains("://"), F.concat(F.regexp_replace(name, r"^www\.", ""), F.rtrim(path(url), F.lit("/")), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def ruled(hosts: Column, paths: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. A rule holds for its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        name, _, start = text.partition("/")
        fits = ((hosts == name) | hosts.endswith(f".{name}")) & paths.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("long")


def _bits(h: Column) -> list[Column]:
    """One bit for each word, by six bits each of another hash of the hash."""
    spread, one = F.xxhash64(h, F.lit(1)), F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(spread, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom(urls: DataFrame, blocks: int) -> DataFrame:
    """urls: __url (distinct). The filter as a table: block, w0 to w7; blocks without bits are absent."""
    h = F.xxhash64("__url")
    bits = urls.select(_block(h, blocks).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(_bits(h))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def _passes(h: Column) -> Column:
    """Whether all bits of a hash are in the words of its block."""
    return F.coalesce(reduce(lambda x, y: x & y, [F.col(f"w{k}").bitwiseAND(b) == b for k, b in enumerate(_bits(h))]), F.lit(False))


def _possible(rows: DataFrame, filter_: DataFrame, blocks: int, column: str) -> DataFrame:
    """rows with `__possible`: column where the filter has all its bits, else null. filter_: as bloom() gives it, with a hint for its join or none."""
    h = F.xxhash64(column)
    return rows.join(filter_, _block(h, blocks) == F.col("block"), "left").select(*rows.columns, F.when(_passes(h), F.col(column)).alias("__possible"))


def listed(pages: DataFrame, urls: DataFrame, column: str = "canonical", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages and whether the URL in a column is listed, in `listed`. urls: canonical, repeated or not."""
    urls = materialise(urls.where("canonical is not null").select(F.col("canonical").alias("__url")).distinct(), "url-list")
    n = urls.count()
    blocks = max(1, -(-n * BITS // (64 * WORDS)))
    filter_ = bloom(urls, blocks)
    if n <= broadcast_rows:
        # a page that cannot be listed asks the list for nothing
        asked = _possible(pages, F.broadcast(filter_), blocks, column)
        return asked.join(F.broadcast(urls), F.col("__possible") == F.col("__url"), "left").select(*pages.columns, F.col("__url").isNotNull().alias("listed"))
    possible = _possible(pages.select(F.col(column).alias("__asked")).distinct(), filter_, blocks, "__asked").where("__possible is not null")
    hits = materialise(possible.join(urls.hint("shuffle_hash"), F.col("__possible") == F.col("__url")).select("__url"), "url-hits")
    if hits.count() <= broadcast_rows:
        found = pages.join(F.broadcast(hits), F.col(column) == F.col("__url"), "left")
    else:
        salted = pages.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        dealt = hits.select("__url", F.explode(F.lit(list(range(SALTS)))).alias("__dealt"))
        found = salted.join(dealt, (F.col(column) == F.col("__url")) & (F.col("__salt") == F.col("__dealt")), "left")
    return found.select(*pages.columns, F.col("__url").isNotNull().alias("listed"))


def judge(pages: DataFrame, urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with host, path, canonical, listed, rule and verdict. urls: the listed ones, canonical."""
    added = ("host", "path", "canonical", "listed", "rule", "verdict")
    kept = [c for c in pages.columns if c not in added]
    # the pages' columns travel in one struct, so that none of their names meets one of the filter
    own = pages.select(F.struct(*kept).alias("page"), canonical(F.col(url_col)).alias("canonical"))
    url = F.col("page").getField(url_col)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    found = listed(own, urls, broadcast_rows=broadcast_rows).select("page", host(url).alias("host"), path(url).alias("path"), "canonical", "listed")
    judged = found.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})
    return judged.select(*(F.col("page").getField(c).alias(c) for c in kept), *added)


def named_hosts(pages: DataFrame, words: Sequence[str] = LISTED, url_col: str = "url") -> DataFrame:
    """canonical: the URLs of pages whose host has a label with one of the words in it, as a list."""
    own = host(F.col(url_col)).rlike(f"(^|[.-])({'|'.join(words)})([.-]|$)")
    return pages.where(own).select(canonical(F.col(url_col)).alias("canonical"))


def op11(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, named_hosts(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


_CANONICAL = r"""case when url like '%://%' then regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '\.$', ''), '^www\.', '') || rtrim(path, '/')
  || case when query <> '' then '?' || query else '' end end"""

ORACLE = rf"""
with s as (select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '{_TRACKING}'))), '&') as query from pages),
c as (select *, {_CANONICAL} as canonical from s),
l as (select distinct canonical from c where regexp_matches(host, '(^|[.-])({'|'.join(LISTED)})([.-]|$)')),
r as (select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
  canonical is not null and canonical in (select canonical from l where canonical is not null) as listed from c)
select page_id, host, path, rule, listed, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when listed then 'block' else 'allow' end as verdict from r"""
