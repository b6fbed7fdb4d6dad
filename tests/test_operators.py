import zipfile
from datetime import datetime, timezone
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from millrace.operators import cdc, crawl, embed, extract, hybrid, index, routing, search


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_snapshot_diff_and_retry_of_failures(spark):
    cur = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 1)], "path string, modified int, size long")
    prev = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("d", 1, 1)], "path string, modified int, size long")
    assert rows(cdc.snapshot_diff(cur, prev), "path", "operation") == [("b", "modify"), ("c", "add"), ("d", "delete")]
    failed = spark.createDataFrame([("b",)], "path string")
    assert rows(cdc.next_snapshot(cur, prev, failed), "path", "modified") == [("a", 1), ("b", 1), ("c", 1)]


def test_events_and_renames(spark):
    lines = spark.createDataFrame([("A\tx",), ("R100\told\tnew",), ("C50\tp\tq",), ("D\tz",)], "line string")
    changes = cdc.split_renames(cdc.git_status(lines))
    assert rows(changes, "operation", "path") == [("add", "new"), ("add", "x"), ("delete", "old"), ("delete", "z")]
    ev = cdc.events(changes.withColumn("content_hash", F.lit("h")), "src", "git", F.lit("2024-01-01").cast("timestamp"))
    assert {r.operation: r.content_hash for r in ev.collect()} == {"add": "h", "delete": None}
    assert ev.select("idempotency_key").distinct().count() == 4


CAPS = {"plain": {"mimes": ["text/plain"], "extensions": [".txt", ".md"], "priority": 0}, "office": {"extensions": [".docx"], "priority": 10}, "html": {"mimes": ["text/html"], "extensions": [".html"], "priority": 20}, "also": {"extensions": ["md"], "priority": 0}}


@pytest.mark.parametrize(("path", "mime", "want"), [("a.MD", None, "also"), ("a.txt", "text/html; charset=utf-8", "html"), ("a.bin", "TEXT/PLAIN", "plain"), ("a.xyz", None, None), ("d.docx", "text/plain", "office")])
def test_pick_extractor(spark, path, mime, want):
    ev = spark.createDataFrame([("1", path, mime)], "event_id string, path string, content_mime string")
    assert routing.pick_extractor(ev, routing.capabilities(spark, CAPS)).first()["extractor"] == want


def test_route_attach_and_references(spark):
    ref = "struct<kind:string,path:string,bytes_b64:string,text:string,url:string,bucket:string,key:string>"
    ok = ("path", "p", None, None, None, None, None)
    data = [("1", "a.sql", None, "add", 0, "text", ok), ("2", "a.png", None, "add", 0, "image", ok), ("3", "a.txt", None, "add", 3, "text", ok), ("4", "a.txt", None, "delete", 0, "text", None), ("5", "a.txt", None, "add", 0, "text", None)]
    ev = spark.createDataFrame(data, f"event_id string, path string, content_mime string, operation string, depth int, modality string, content_ref {ref}")
    got = {r.event_id: (r.route, r.extractor) for r in routing.route(ev, routing.capabilities(spark)).collect()}
    assert got["1"] == ("extract", "plain") and [got[k][0] for k in "2345"] == ["image", "too_deep", "delete", "no_content"]
    assert routing.route(ev, routing.capabilities(spark), text_fallback=False).where("event_id = '1'").first().route == "skip"
    kinds = spark.createDataFrame([(ok,), (("url", "p", None, None, None, None, None),), (("object_storage", None, None, None, None, "b", None),), (("odd", "p", None, None, None, None, None),)], f"r {ref}")
    assert [r[0] for r in kinds.select(routing.valid_reference(F.col("r"))).collect()] == [True, False, False, False]
    parents = spark.createDataFrame([("p", "s", "folder", 0), ("q", "s", "folder", 2)], "event_id string, source_id string, source_type string, depth int")
    kids = spark.createDataFrame([("p", "", "", "d#img-0", None, "image"), ("q", "", "", "d#img-1", None, "image")], "parent_event_id string, source_id string, source_type string, path string, content_hash string, modality string")
    assert rows(routing.attach(kids, parents), "path", "source_id", "depth") == [("d#img-0", "s", 1)]


def archive(**files):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(**{"word__document_dot_xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>", "docProps__core_dot_xml": '<c:x xmlns:c="c" xmlns:d="d"><d:creator>Ann</d:creator><d:title/></c:x>'})
XLSX = archive(
    **{
        "xl__workbook_dot_xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>',
        "xl___rels__workbook_dot_xml_dot_rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl__sharedStrings_dot_xml": "<sst><si><t>name</t></si></sst>",
        "xl__worksheets__sheet1_dot_xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A3"><v>9</v></c></row></sheetData></worksheet>',
    }
)
PPTX = archive(**{"ppt__slides__slide1_dot_xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>bo</a:t></a:r><a:r><a:t>dy</a:t></a:r></a:p></p:sp></p:sld>', "ppt__notesSlides__notesSlide1_dot_xml": '<n xmlns:a="a"><a:p><a:r><a:t>say</a:t></a:r></a:p></n>'})
PDF = b"%PDF-1.4\n1 0 obj<</Type/Page/Contents 2 0 R>>endobj\n2 0 obj<</Length 44>>stream\nBT (Hello \\(pdf\\)) Tj 0 -12 Td (line two) Tj ET\nendstream endobj\n%%EOF"


def test_formats():
    assert extract.docx(DOCX) == {"text": "One two\nThree", "pages": [], "metadata": {"author": "Ann", "format": "docx"}}
    x = extract.xlsx(XLSX, max_rows=2)
    assert x["text"] == "# S1\nname\t\t3\nx" and x["pages"] == [(0, "name\t\t3\nx", "S1")] and x["metadata"]["truncated_sheets"] == "S1"
    p = extract.pptx(PPTX)
    assert p["pages"] == [(0, "Title\nbody\n[notes] say", "Title")]
    d = extract.pdf(PDF)
    assert d["text"] == "Hello (pdf)\nline two" and d["metadata"] == {"format": "pdf", "page_count": "1", "likely_scanned": "true"}
    with pytest.raises(ValueError):
        extract.pdf(b"no")


def test_extracted_keeps_failures_apart(spark):
    data = [("1", "plain", "s", "a.csv", b"a,b\xff"), ("2", "html", "s", "b.html", b"<title>T</title><nav>n</nav><p>x &amp; y</p>"), ("3", "office", "s", "c.docx", DOCX), ("4", "office", "s", "d.docx", b"broken"), ("5", "pdf-text", "s", "e.pdf", PDF)]
    ev = spark.createDataFrame(data, "event_id string, extractor string, source_id string, path string, content binary").withColumn("route", F.lit("extract"))
    got = {r.event_id: r for r in extract.extracted(ev).collect()}
    assert got["1"].text == "a,b�" and got["1"].structure["delimiter"] == "," and got["2"].text == "x & y" and got["2"].metadata["title"] == "T"
    assert got["3"].text == "One two\nThree" and got["4"].text is None and "BadZipFile" in got["4"].error and len(got["5"].pages) == 1


def test_embedding(spark):
    chunks = spark.createDataFrame([("a b",), ("",), ("boom",)], "content string")
    v = embed.embed(chunks.where("content <> 'boom'")).collect()
    assert abs(sum(x * x for x in v[0].vector) - 1) < 1e-6 and set(v[1].vector) == {0.0}

    def make():
        def run(texts):
            if "boom" in texts:
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return run

    good, bad = embed.split_errors(embed.embed(chunks, make))
    assert rows(good, "content", "vector") == [("", [0.0, 1.0]), ("a b", [3.0, 1.0])] and "RuntimeError" in bad.first().error
    assert [embed.batch_size(x) for x in (None, "x", 0, 7, 99)] == [10, 10, 1, 7, 50]
    for m in ("image", "other"):
        with pytest.raises(ValueError):
            embed.embed_query("q", m, spark=spark)


def test_upsert_replace_delete(spark):
    schema = "source_id string, path string, derived_from string, chunk_id string, seq int"
    table = spark.createDataFrame([("s", "a", "", "1", 0), ("s", "a#page=1", "", "2", 0), ("s", "b", "a", "3", 0), ("t", "a", "", "4", 0)], schema)
    batch = spark.createDataFrame([("s", "a", "", "1", 1), ("s", "a", "", "1", 2)], schema)
    assert rows(index.upsert(table, batch, "chunk_id", "seq"), "chunk_id", "seq") == [("1", 2), ("2", 0), ("3", 0), ("4", 0)]
    assert rows(index.replace_paths(table, batch.where("seq = 2")), "chunk_id", "seq") == [("1", 2), ("3", 0), ("4", 0)]
    assert rows(index.delete_paths(table, batch), "chunk_id") == [("4",)]
    kept, n = index.purge_source(table, "s")
    assert n.first()[0] == 3 and kept.count() == 1


def test_points_set_unknown_modalities_apart(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    e = spark.createDataFrame([("c1", [1.0], "m", "text", "p", None, "s", None, "x" * 5000, at), ("c2", [1.0], "m", "hologram", "p", None, "s", None, "x", None)], "chunk_id string, vector array<float>, model string, modality string, path string, repo string, source_id string, derived_from string, snippet string, content_modified_at timestamp")
    ok, bad = index.points(e)
    r = ok.first()
    assert len(r.snippet) == 4000 and r.repo == "" and r.content_modified_ts == 1704067200 and bad.first().error == "unsupported modality hologram"
    assert index.lexical_docs(ok).first().last_indexed == "m"


def test_crawl_is_first_in_first_out(spark):
    links = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "r", 0), ("c", "d", 0), ("b", "c", 1)], "src string, dst string, link_pos int")
    roots = spark.createDataFrame([("r",)], "url string")
    assert rows(crawl.crawl(roots, links, 2), "rank", "url", "depth") == [(1, "r", 0), (2, "a", 1), (3, "b", 1), (4, "c", 2)]
    assert rows(crawl.crawl(roots, links, 3, 2), "url") == [("a",), ("r",)]


def test_context_budget_and_ties(spark):
    schema = "doc_id int, source_id string, repo string, path string, snippet string, score double, pos long"
    sem = spark.createDataFrame([(1, "s", "r", "p1", "x" * 50, 0.9, 0), (2, "s", "r", "p2", "y" * 50, 0.9, 1), (3, "s", "r", "p1", "z", 0.1, 2)], schema)
    lex = spark.createDataFrame([(1, "s", "r", "p1", "x" * 50, 0.0, 0), (4, "s", "r", "p3", "  ", 0.0, 1)], schema)
    m = hybrid.merge(sem, lex)
    assert round(m.where("doc_id = 1").first().combined_score, 6) == 0.78 and m.count() == 4
    assert hybrid.merge(sem, lex, strict=True).count() == 5
    used = hybrid.budgeted(hybrid.best_per_path(m), 80)
    assert rows(used, "path_rank", "path", "chars") == [(1, "p1", 50), (2, "p2", 11)]
    assert hybrid.context(used).first().context.startswith("### p1 (score: 0.78)\nxxx")
    assert hybrid.context(used.where("false")).first().context == hybrid.EMPTY_CONTEXT


def test_threshold_prefix_and_age(spark):
    v = spark.createDataFrame([("a", "x/1", [1.0, 0.0], 100), ("b", "y/1", [0.9, 0.1], None), ("c", "x/2", [0.0, 1.0], 10**9)], "chunk_id string, path string, vector array<float>, content_modified_ts long")
    assert rows(search.semantic(v, [1.0, 0.0], 5, 0.5), "chunk_id") == [("a",), ("b",)]
    assert rows(search.semantic(v, [1.0, 0.0], 1, -1, path_prefix="x/2"), "chunk_id") == [("c",)]
    assert rows(search.semantic(v, [1.0, 0.0], 5, -1, as_of=10**9, max_age_days=10), "chunk_id") == [("c",)]
    with pytest.raises(ValueError):
        search.semantic(v, [1.0, 0.0], max_age_days=1)


def test_vector_index_recall_and_exact_way(spark, tmp_path):
    """A third of the cells finds nine in ten of the nearest; all cells find them all."""
    import numpy as np

    from millrace.operators import search
    from millrace.operators.vector_index import VectorIndex

    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 32))
    x = centres[r.integers(0, 20, 3000)] + 0.6 * r.normal(size=(3000, 32))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 32)], "chunk_id long, vector array<double>")
    ix = VectorIndex.build(rows, str(tmp_path / "ix"), cells=30)
    found = total = 0
    for q in (0, 700, 1500, 2900):
        exact = [h.chunk_id for h in search.semantic(rows, x[q].tolist(), 10).collect()]
        assert [h.chunk_id for h in ix.search(x[q].tolist(), 10).collect()] == exact
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert exact == np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist()
        found += len(set(exact) & {h.chunk_id for h in ix.search(x[q].tolist(), 10, probes=10).collect()})
        total += 10
    assert found / total >= 0.9
    batch = search.semantic_batch(rows, spark.createDataFrame([(q, x[q].tolist()) for q in (0, 700)], "query_id int, query_vector array<double>"), 10)
    assert [h.chunk_id for h in batch.where("query_id = 700").orderBy("rank").collect()] == [h.chunk_id for h in search.semantic(rows, x[700].tolist(), 10).collect()]


def test_cells_split_until_they_are_small_and_batches_are_exact(spark, tmp_path):
    """Cells divide as rows grow, one of equal rows stays whole; through all cells a batch is exact, through some nearly so."""
    import numpy as np

    from millrace.operators import search
    from millrace.operators.vector_index import VectorIndex

    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(40, 16))[r.integers(0, 40, 4000)] + 0.3 * r.normal(size=(4000, 16)), np.tile(r.normal(size=(1, 16)), (1500, 1))])
    rows = spark.createDataFrame([(f"k{k}", v.tolist(), k) for k, v in enumerate(x)] + [(f"n{k}", None, k) for k in range(5)], "chunk_id string, vector array<double>, n int").repartition(5)
    ix = VectorIndex.build(rows, str(tmp_path / "ix"), cells=4, most=300)
    sizes = {r.cell: r["count"] for r in ix.rows([0.0]).groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 5505 and sum(n > 300 for n in sizes.values()) <= 1 and len(sizes) > 12 and sizes.keys() <= set(ix.codebook.leaves().tolist())
    qs = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 4000, 80)] + [(-1, None), (-2, x[4100].tolist())], "query_id int, query_vector array<double>")
    exact, unit = {}, x / np.linalg.norm(x, axis=1, keepdims=True)
    names = np.array([f"k{k}" for k in range(len(x))])
    for h in search.semantic_batch(rows, qs, 5, -1.0).collect():
        exact.setdefault(h.query_id, []).append((h["rank"], h.chunk_id))
    for q, hits in exact.items():
        if q >= 0:
            score = unit @ unit[q]
            best = np.lexsort((names, -np.round(score, 12)))[:5]
            assert [c for _, c in sorted(hits)] == names[best].tolist()
    routed = lambda probes: {(h.query_id, h["rank"], h.chunk_id) for h in ix.batch(qs, 5, probes, -1.0).collect()}
    every = {(q, k, c) for q, hits in exact.items() for k, c in hits}
    assert routed(10**6) == every and len({(q, c) for q, _, c in routed(6)} & {(q, c) for q, _, c in every}) >= 0.9 * len(every)
    tuned = ix.probes_for(0.95, 5)
    assert 1 <= tuned < len(sizes) and len({(q, c) for q, _, c in routed(tuned)} & {(q, c) for q, _, c in every}) >= 0.9 * len(every)
    held = search.semantic_batch(rows, qs, 5, -1.0)
    assert held._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = total = 0
    for k in range(0, 4000, 400):
        want = {c for _, c in exact[k]}
        found, total = found + len(want & {h.chunk_id for h in ix.search(x[k].tolist(), 5, 6, -1.0).collect()}), total + len(want)
    assert found >= 0.9 * total
    assert {h.chunk_id for h in ix.search(x[0].tolist(), 3, 8, -1.0, n=7).collect()} <= {"k7"}  # filters come first


def test_best_of_many_batches_keeps_ties(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from millrace.operators.search import _Best

    r = np.random.default_rng(1)
    score = np.round(r.normal(size=(500, 7)), 1)
    heap = _Best(7, 4, -0.5)
    heap.most = 40
    names = np.array([f"{k:04d}" for k in r.permutation(500)])
    for at in range(0, 500, 13):
        own = np.arange(at, min(500, at + 13))
        heap.add(score[own], pa.array(names[own]), np.arange(len(own)), np.arange(7))
    query, keys, _ = heap.all()
    for q in range(7):
        want = [names[k] for k in np.lexsort((names, -score[:, q])) if score[k, q] >= -0.5][:4]
        assert [k for k, p in zip(keys.to_pylist(), query, strict=True) if p == q] == want


def test_lexical_index_scores_like_a_scan(spark, tmp_path):
    import random

    from millrace.operators import search
    from millrace.operators.lexical_index import LexicalIndex

    r = random.Random(2)
    words = ["mill", "river", "rivers", "wheel", "granite", "slate", "é"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randrange(40)))) for k in range(200)] + [(200, None), (201, "x" * 9000 + " granite")], "doc_id long, text string")
    ix = LexicalIndex.build(docs, str(tmp_path / "ix"))
    for terms, typos in ((["granite", "mill"], False), (["rivres", "slat"], True), (["none"], False), ([], False)):
        a, b = (sorted((x.doc_id, round(x.bm25, 9)) for x in s.collect()) for s in (ix.scores(terms, typos), search.lexical_scores(docs, terms, typos=typos)))
        assert a == b and (bool(a) == (terms not in (["none"], [])))


def test_lexical_index_keeps_the_postings_of_a_document_together(spark, tmp_path, monkeypatch):
    """Postings lie in the file of their document, in order of term; for typos, the near words go to the postings."""
    from millrace.operators import lexical_index

    monkeypatch.setattr(lexical_index, "FILE_BYTES", 500)
    docs = spark.createDataFrame([(k, f"mill river rivers w{k}") for k in range(300)] + [(300, None), (301, "")], "doc_id long, text string")
    ix = lexical_index.LexicalIndex.build(docs, str(tmp_path / "ix"))
    assert ix.n_docs == 302 and abs(ix.mean_len - 1200 / 301) < 1e-12
    held = spark.read.parquet(f"{ix.path}/postings").select("doc_id", "term", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("n")).collect()
    files = {r.f: [x.term for x in sorted((y for y in held if y.f == r.f), key=lambda y: y.n)] for r in held}
    assert len(held) == 1200 and len(files) > 5 and len({(r.doc_id, r.f) for r in held}) == 300
    assert all(terms == sorted(terms) for terms in files.values())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for listed in (1000, 0):
            monkeypatch.setattr(lexical_index, "LISTED", listed)
            found = ix.matches(["rivrs"], True)
            assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
            assert {(r.doc_id, r.doc_len, r.term, r.tf) for r in found.collect()} == {(k, 4, "rivrs", 1) for k in range(300)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_postings_are_counted_where_the_rows_lie(spark):
    """No posting is shuffled where keys are distinct; rows of one key and length are summed, as by a grouping of all words."""
    import re
    from collections import Counter

    rows = [(1, "b a, B é b!"), (2, ""), (3, None), (4, " ... "), (5, "x " * 3000 + "y"), (None, "a")]
    for own in (rows, [*rows, (1, "a a a b c"), (1, "z"), (None, "a")]):
        docs = spark.createDataFrame(own, "doc_id long, text string")
        want = Counter()
        for k, t in own:
            words = re.findall(r"[^\W_]+", (t or "").lower())
            want.update((w, k, len(words)) for w in words)
        found = index.postings(docs)
        assert {(r.term, r.doc_id, r.doc_len): r.tf for r in found.collect()} == want and found.count() == len(want)
    assert "Exchange" not in index.postings(docs.where("doc_id > 1"))._jdf.queryExecution().executedPlan().toString()


def test_hashing_embedding_equals_plain_counting(spark):
    import math
    import re

    import xxhash

    from millrace.operators.embed import hashing_embedding

    texts = ["The mill, the wheel and the river", "", None, "... !!", "a " * 500 + "B", "straße Ünder 12 x1"]
    for dimensions in (64, 7):
        got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select(hashing_embedding(F.col("t"), dimensions).alias("v")).collect()]
        for t, v in zip(texts, got, strict=True):
            want = [0.0] * dimensions
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(w, seed=42)
                want[(h - (1 << 64) if h >> 63 else h) % dimensions] += -1.0 if h >> 40 & 1 else 1.0
            size = math.sqrt(sum(x * x for x in want))
            assert all(abs(a - (b / size if size else 0.0)) < 1e-6 for a, b in zip(v, want, strict=True))
