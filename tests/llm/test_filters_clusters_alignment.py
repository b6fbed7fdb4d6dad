"""URL filter, centroid clustering and token alignment against brute force."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tests.llm.conftest import TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, clustering, queries, url_filter
from millrace.llm.common import documents

URLS = [
    None, "", "no scheme", "://", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://net/", "http://xnet/y", "https://b.example.net/en/1", "https://example.net/en", "http://example.com/de/9?x=1#y",
    "http://q.org/fr/?", "http://q.org?/fr/", "http://u@ads.x.example.com:8080/p", "http://WWW.ads-x.example.com:80/a//?b=2&a=1&utm_source=z", "https://ads-x.example.com/a?a=1&b=2#f", "http://ads-x.example.com/b",
    "http://Ä.example.ORG/fr/é", "x://y://z.net/a", "http://a.org/fr/\n#q", "http://pills/" + "p" * 50_000, "http://roads.example.com/1", "http://ads-x.example.com/a?b=2&a=1",
]


def judged(url):
    at = (url or "").find("://")
    name, path = ("", "") if at < 0 else re.match(r"(?s)([^/?#]*)([^?#]*)", url[at + 3 :]).groups()
    name = "".join(c.lower() if "A" <= c <= "Z" else c for c in name)
    best = max(((len(t), v, t) for v, t in url_filter.RULES for h, s, p in [t.partition("/")] if (name == h or name.endswith("." + h)) and path.startswith(s + p)), default=(0, None, None))
    return name, path, best[2], best[1]


def named(url):
    """The canonical form, read plainly."""
    if "://" not in (url or ""):
        return None
    name, path, *_ = judged(url)
    name = re.sub(r"\.$", "", re.sub(r":(80|443)?$", "", name))
    query = re.match(r"(?s)[^?#]*(?:\?([^#]*))?", url[url.find("://") + 3 :]).group(1) or ""
    kept = sorted(p for p in query.split("&") if p and not re.match("(utm_[^=]*|ref|fbclid|gclid)(=|$)", p))
    return re.sub(r"^www\.", "", name) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    rows = [(k, u, "<p>") for k, u in enumerate(URLS)] + [(1, "http://ads-x.example.com/b", None), (None, "http://a.org/fr/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("host", "path", "rule", "verdict", "listed", "canonical", "block", "w0")})
    df.repartition(3).write.parquet(f"{folder}/pages.parquet")
    return folder, rows


def test_url_filter(spark, pages):
    folder, rows = pages
    listed = {named(u) for _, u, _ in rows if u and re.search("(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)", judged(u)[0])}
    want = []
    for i, u, _ in rows:
        name, path, rule, verdict = judged(u)
        want.append((i, name, path, rule, verdict or ("block" if named(u) in listed else "allow"), named(u) in listed))
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, queries.QUERIES["op11_url_filter"](spark, folder).collect()), key=order) == sorted(want, key=order)
    assert sum(w[5] for w in want) >= 6


@pytest.mark.parametrize("most", [10**6, 0, 40])
def test_url_filter_by_exchange_equals_broadcast(spark, pages, most):
    """With lists too long to broadcast, and hits too many or not."""
    table = spark.read.parquet(f"{pages[0]}/pages.parquet")
    urls = url_filter.named_hosts(table).unionByName(spark.range(60).select(F.concat(F.lit("z.com/"), "id").alias("canonical")))
    out = url_filter.judge(table, urls, broadcast_rows=most)
    assert {"html", "block", "w0"} < set(out.columns)
    got = Counter((r.page_id, r.url, r.listed) for r in out.collect())
    assert got == Counter((r.page_id, r.url, r.listed) for r in url_filter.judge(table, urls).collect())


def test_url_filter_has_no_false_negatives_and_few_false_positives(spark):
    urls = spark.range(5000).select(F.concat(F.lit("l.com/"), "id").alias("__url"))
    blocks = 5000 * url_filter.BITS // 512
    filter_ = url_filter.bloom(urls, blocks)
    assert url_filter._possible(urls, filter_, blocks, "__url").where("__possible is null").count() == 0
    others = spark.range(20000).select(F.concat(F.lit("o.com/"), "id").alias("u"))
    assert url_filter._possible(others, filter_, blocks, "u").where("__possible is not null").count() < 60


def test_url_filter_of_no_pages_and_empty_lists(spark, pages):
    table = spark.read.parquet(f"{pages[0]}/pages.parquet")
    none = table.limit(0)
    assert url_filter.judge(none, url_filter.named_hosts(none)).count() == 0
    assert {r.listed for r in url_filter.judge(table, url_filter.named_hosts(none)).collect()} == {False}


def test_sql_of_filter_and_clusters(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in ("op11_url_filter", "op12_centroid_clustering"):
        rel = con.sql(queries.ORACLES[name])
        got = queries.QUERIES[name](spark, sf_dir).select(*rel.columns)
        assert Counter(map(tuple, got.collect())) == Counter(rel.fetchall())


def brute_clusters(rows, n=40, rounds=5):
    own = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [max(-clustering.MOST, min(clustering.MOST, x)) for x in v]) for i, v in own]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(own, key=lambda r: (digest(r[0]), r[1]))[:n]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in own]
        for k in range(len(cents)):
            mine = [v for (_, v), a in zip(own, at, strict=True) if a == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in own]
    sums = defaultdict(int)
    for _, d, k in last:
        sums[k] += d
    cap = lambda x: min(x, (1 << 63) - 1)
    return [(i, k, d, cap(sums[k]), cap(sum(sums.values())), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in last]


@pytest.mark.parametrize("kind", ["random", "few", "odd", "empty"])
def test_clusters(spark, tmp_path, kind):
    r = random.Random(7)
    vector = lambda: [struct.unpack("f", struct.pack("f", r.gauss(0, 0.3)))[0] for _ in range(64)]
    rows = [(k, vector()) for k in range({"random": 150, "few": 9, "odd": 60, "empty": 0}[kind])]
    if kind in ("random", "odd"):
        rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(1000, rows[0][1]), (3, rows[5][1])]
    if kind == "odd":
        bad = [vector() for _ in range(4)]
        bad[0][3], bad[1][4], bad[2][0] = None, float("nan"), float("inf")
        rows += [(2000 + k, v) for k, v in enumerate(bad[:3])] + [(2010, []), (2011, None), (2012, vector()[:63]), (None, vector()), (None, bad[3]), (2013, [3e38, -3e38] * 32), (2014, [-3e38] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cluster", "vector", "distance", "n")})
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op12_centroid_clustering"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_clusters(rows))


def brute_alignment(texts):
    """Token groups and links by sets of ends, with fresh tokenizers over whole texts."""
    a_file, b_file = alignment.vocabularies()
    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    letters = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if chr(x) not in letters or x in (127, 173))}
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode()
    docs = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ends = []
        for ids, of in ((x, lambda k: bytes(letters[c] for c in a.id_to_token(k))), (y, piece)):
            joined, at = b"", []
            for k in ids:
                joined += of(k)
                at.append(len(joined))
            ends.append((joined, at))
        if not t or {j for j, _ in ends} != {(" " + t).encode()}:
            docs.append(([], [], [], []))
            continue
        both = sorted(set(ends[0][1]) & set(ends[1][1]))
        groups, links = [], []
        for lo, hi in zip([0, *both], both, strict=False):
            groups.append(tuple([k for k, e in zip(ids, at, strict=True) if lo < e <= hi] for ids, (_, at) in zip((x, y), ends, strict=True)))
        for k, e in zip(x, ends[0][1], strict=True):
            links += [(k, m) for m, f in zip(y, ends[1][1], strict=True) if e == f]
        docs.append((x, y, groups, links))
    n = Counter(p for d in docs for p in d[3])
    most = defaultdict(int)
    for (_, m), c in n.items():
        most[m] = max(most[m], c)
    out = []
    for x, y, groups, links in docs:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((len(x), len(y), len(groups), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), digest))
    return out


AWKWARD = [
    "two  spaces", " lead", "trail ", "trail  ", "\ttab\n new\r\nline", "don't we'll 'x", "sign \u2581 here", "a\u2581", "nbsp\u00a0 x\u3000 y", "<s> </s> <unk> <0x41> <|endoftext|>", "emoji \U0001f600 \u200d x",
    "\u00e9t\u00e9 \u00e0 l'\u00e9cole \u00d7 \u00f7", "e\u0301 combining \u0301x", "zero\x00byte \x7f del", "\u65e5\u672c\u8a9e \u306e \u6587", "9" * 3000, "ab" * 3000 + " end", " ", "   ", "\n", "x" * 70_000, "word " * 5000,
]


@pytest.mark.parametrize("head", [10**6, 3, 0])
def test_alignment(spark, tmp_path, sf_dir, head, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 500)
    texts = [*TEXTS, *AWKWARD, *AWKWARD[:3], *(r.text for r in documents(spark, sf_dir).limit(60).collect())]
    rows = [(None if k == 1 else k % 70, t, k) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, codes int").withColumns({"key": F.lit(1), "n": F.lit(2), "times": F.lit(3)}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    links = alignment.linked(documents(spark, str(tmp_path)))
    pairs = alignment.pair_counts(links, 32_000)
    got = alignment.scored(links, pairs, head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want = [(i, *x) for (i, *_), x in zip(rows, brute_alignment(texts), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[-1] == "" for w in want) >= 4  # null, empty, and texts that B cannot spell


def test_alignment_after_forgetting(monkeypatch):
    """Remembered and forgotten segments give the same tokens."""
    own = alignment.Aligner.of(*alignment.vocabularies())
    first = [x.tolist() for x in (own.texts(pa.array(AWKWARD))[0:2])] and own.ids_a.take(own.texts(pa.array(AWKWARD))[0]).tolist()
    monkeypatch.setattr(alignment, "MEMO", 0)
    of, edges, good = own.texts(pa.array(["other words", *AWKWARD]))
    assert own.ids_a.take(of[edges[1] :]).tolist() == first and len(good) == 1 + len(AWKWARD)


def test_alignments_hold_the_tokens(spark, tables):
    got = alignment.alignments(documents(spark, tables["tricky"])).collect()
    rows = documents(spark, tables["tricky"]).collect()
    assert len(got) == len(rows)
    by_text = dict(zip([r.text for r in rows], brute_alignment([r.text for r in rows]), strict=True))
    text_of = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 99)}
    for r in got:
        if r.doc_id in text_of:
            n_a, n_b, n_groups, *_, digest = by_text[text_of[r.doc_id]]
            cuts = [np.cumsum([0, *x]).tolist() for x in (r.group_a, r.group_b)]
            text = ";".join("|".join(",".join(map(str, ids[p:q])) for ids, p, q in ((r.a_ids, *a), (r.b_ids, *b))) for a, b in zip(zip(cuts[0], cuts[0][1:]), zip(cuts[1], cuts[1][1:])))  # noqa: B905
            assert (len(r.a_ids), len(r.b_ids), len(r.group_a)) == (n_a, n_b, n_groups)
            assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == digest
            assert sum(r.group_bytes) == (len(text_of[r.doc_id].encode()) + 1 if digest else 0)


def test_interval_index_lists_overlaps():
    r = random.Random(3)
    for _ in range(50):
        a, b = (sorted({*r.sample(range(1, 40), 12), 40}) for _ in range(2))
        starts = [0, *b[:-1]]
        lo, hi = alignment.IntervalIndex(np.array(starts), np.array(b)).stab(np.array([0, *a[:-1]]), np.array(a))
        for p, q, x, y in zip([0, *a[:-1]], a, lo, hi, strict=True):
            assert list(range(x, y)) == [k for k, (s, e) in enumerate(zip(starts, b, strict=True)) if s < q and p < e]
        after_a, after_b = alignment.groups(np.array(a), np.array(b))
        assert [a[k - 1] for k in after_a] == [b[k - 1] for k in after_b] == sorted(set(a) & set(b))
