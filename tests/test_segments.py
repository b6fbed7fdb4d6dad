"""The store of segments against a plain dictionary of documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity
from millrace.operators import segments
from millrace.operators.segments import Conflict, SegmentStore

SCHEMA = "chunk_id string, source_id string, path string, repo string, modality string, snippet string, derived_from string, content_modified_ts long, content string, model string, vector array<float>"
WORDS = ["mill", "wheel", "river", "granite", "slate", "water", "turns", "stone", "mills", "grenite"]


def points(spark, rows):
    """rows: source, path, texts of its chunks (None: an image)."""
    return spark.createDataFrame([(f"{s}:{p}:{k}", s, p, "r", "image" if t is None else "text", t, "", 5, t or "", "m", [1.0]) for s, p, ts in rows for k, t in enumerate(ts)], SCHEMA)


def gone(spark, names):
    return spark.createDataFrame(names, "source_id string, path string")


def brute(model, terms):
    docs = {(s, p, k): re.findall(r"[^\W_]+", t.lower()) for (s, p), ts in model.items() for k, t in enumerate(ts) if t is not None}
    mean = sum(map(len, docs.values())) / max(1, len(docs))
    df = {t: sum(t in w for w in docs.values()) for t in terms}
    out = {}
    for key, w in docs.items():
        n = Counter(w)
        if any(n[t] for t in terms):
            out[key] = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if n[t])
    return out


def check(store, model, manifest=None):
    held = store.rows(manifest)
    got = Counter((r.source_id, r.path, int(r.chunk_id.rsplit(":", 1)[1]), r.content) for r in held.collect()) if held is not None else Counter()
    assert got == Counter((s, p, k, t or "") for (s, p), ts in model.items() for k, t in enumerate(ts))
    manifest = manifest or store.head()
    texts = [re.findall(r"[^\W_]+", t.lower()) for ts in model.values() for t in ts if t is not None]
    assert (manifest["docs"], manifest["words"]) == (len(texts), sum(map(len, texts)))
    if held is not None:
        keys = held.select("doc_id", "source_id", "path", "chunk_id")
        scores = {(r.source_id, r.path, int(r.chunk_id.rsplit(":", 1)[1])): r.bm25 for r in store.index(manifest).scores(["mill", "river", "none"]).join(keys, "doc_id").collect()}
        want = brute(model, ["mill", "river", "none"])
        assert scores.keys() == want.keys() and all(abs(scores[k] - want[k]) < 1e-9 for k in want)


def test_random_commits_equal_a_dictionary(spark, tmp_path, monkeypatch):
    """Insert, replace (also by fewer chunks), remove, purge and compact, in any order; old manifests stay readable until they are removed."""
    monkeypatch.setattr(segments, "FAN", 3)
    monkeypatch.setattr(segments, "FILE_WORDS", 40)
    r, store, model = random.Random(4), SegmentStore(spark, str(tmp_path / "s")), {}
    assert store.rows() is None and store.index().scores(["mill"]).count() == 0
    text = lambda: None if r.random() < 0.1 else " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 9)))
    kept = {}
    for step in range(9):
        put = {(r.choice("ab"), f"p{r.randrange(12)}"): [text() for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(0, 7))}
        away = [k for k in model if r.random() < 0.2 and k not in put]
        if step == 4:
            n = store.purge("a")
            mine = [t for (s, _), ts in model.items() if s == "a" for t in ts]
            assert n == {"vectors": len(mine), "lexical": sum(t is not None for t in mine)}
            model = {k: v for k, v in model.items() if k[0] != "a"}
        else:
            store.upsert(points(spark, [(*k, v) for k, v in put.items()]), gone(spark, away) if away else None)
            model = {k: v for k, v in model.items() if k not in away} | put
        kept[store.head()["version"]] = dict(model)
        if step in (3, 6):
            store.compact()
            kept[store.head()["version"]] = dict(model)
            check(store, model)
    assert len(store.head()["segments"]) < 8
    first = min(kept)
    check(store, kept[first], store.manifest(first))
    store.compact(everything=True)
    check(store, model)
    assert len(store.head()["segments"]) == 1 and not store.head()["deletions"]
    monkeypatch.setattr(segments, "STALE", -1)
    assert store.vacuum(keep=1) > 0 and store.manifest(first) is None
    check(store, model)


@pytest.mark.parametrize("listed", [1000, 0])
def test_best_documents_without_reading_all_parts(spark, tmp_path, monkeypatch, listed):
    """The k best equal those of a full scoring, with deletions and over several segments; parts that cannot hold one are not read."""
    for name, value in (("PART_DOCS", 2), ("FREQUENT", 20), ("FIRST_PARTS", 4), ("LISTED", listed)):
        monkeypatch.setattr(segments, name, value)
    r, store = random.Random(8), SegmentStore(spark, str(tmp_path / "s"))
    text = lambda: " ".join(r.choices([*WORDS, *(f"u{k}" for k in range(300))], k=int(2 + r.paretovariate(0.7) % 200)))
    model = {("a", f"p{k}"): [text()] for k in range(700)}
    store.upsert(points(spark, [(*k, v) for k, v in model.items()]))
    new = {("a", f"p{k}"): [text()] for k in range(600, 800)}
    store.upsert(points(spark, [(*k, v) for k, v in new.items()]), gone(spark, [("a", f"p{k}") for k in range(0, 100)]))
    model = {k: v for k, v in (model | new).items() if int(k[1][1:]) >= 100}
    keys = {r.doc_id: (r.source_id, r.path, 0) for r in store.rows().collect()}
    queries = ((["mill", "u7"], 5), (["u3", "u4", "u5"], 3), (["none"], 4), (["mill", "wheel", "river", "stone"], 2000))
    for own in (queries, queries[:1]) if listed else (queries[:1],):
        ix = store.index()
        for terms, k in own:
            want = brute(model, terms)
            order = sorted(want, key=lambda x: (-round(want[x], 6), next(d for d, y in keys.items() if y == x)))[:k]
            found, read = ix.top(terms, k)
            got = sorted(found.collect(), key=lambda x: (-x.bm25, x.doc_id))[:k]
            assert [keys[x.doc_id] for x in got] == order and all(abs(x.bm25 - want[keys[x.doc_id]]) < 1e-5 for x in got)
            assert read["read"] <= read["parts"]
            if terms == ["mill", "u7"]:
                assert read["read"] < read["parts"] / 2
        some = store.rows().where("path like 'p7%'")
        got = sorted(ix.top(["mill"], 3, some)[0].collect(), key=lambda x: (-x.bm25, x.doc_id))[:3]
        want = {k: v for k, v in brute(model, ["mill"]).items() if k[1].startswith("p7")}
        assert [round(x.bm25, 5) for x in got] == [round(v, 5) for v in sorted(want.values(), reverse=True)[:3]]
        store.compact(everything=True)


def test_many_dead_rows_move_no_texts(spark, tmp_path, monkeypatch):
    """Beyond what may be broadcast, only keys are joined: no text and no posting of the store is shuffled, but for texts that are dealt out once."""
    store, model = SegmentStore(spark, str(tmp_path / "s")), {("a", f"p{k}"): [f"mill w{k} " * (k % 7)] for k in range(300)}
    store.upsert(points(spark, [(*k, v) for k, v in model.items()]))
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 0)
    new = {("a", f"p{k}"): [f"river v{k}"] for k in range(0, 300, 5)}
    store.upsert(points(spark, [(*k, v) for k, v in new.items()]), gone(spark, [("a", f"p{k}") for k in range(0, 300, 7) if k % 5]))
    back = {("a", "p7"): ["granite"]}
    store.upsert(points(spark, [(*k, v) for k, v in back.items()]))
    model = {k: v for k, v in (model | new).items() if int(k[1][1:]) % 7 or int(k[1][1:]) % 5 == 0} | back
    check(store, model)
    plan = store.rows()._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0]]
    assert moved and not any("content" in part for part in moved)
    store.compact(everything=True)
    check(store, model)


def test_all_postings_of_a_document_lie_in_one_file(spark, tmp_path, monkeypatch):
    """Postings are written where the texts were counted, in order of term."""
    monkeypatch.setattr(segments, "FILE_WORDS", 200)
    store = SegmentStore(spark, str(tmp_path / "s"))
    head = store.upsert(points(spark, [("a", f"p{k}", [f"mill wheel river slate w{k}"]) for k in range(400)]))
    held = spark.read.parquet(f"{store.root}/segments/{head['segments'][0]['id']}/postings").select("doc_id", "term", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("n")).collect()
    files = {r.f: [x.term for x in sorted((y for y in held if y.f == r.f), key=lambda y: y.n)] for r in held}
    assert len(held) == 2000 and len(files) > 5 and len({(r.doc_id, r.f) for r in held}) == 400
    assert all(terms == sorted(terms) for terms in files.values())


def test_a_commit_writes_in_proportion_to_what_changed(spark, tmp_path):
    """One changed document of 400 writes one row, its own postings and one key; nothing that lay there is touched."""
    store = SegmentStore(spark, str(tmp_path / "s"))
    store.upsert(points(spark, [("a", f"p{k}", [f"mill number {k} " * 50]) for k in range(400)]))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    before = sum(f.stat().st_size for f in files)
    head = store.upsert(points(spark, [("a", "p7", ["granite"])]))
    now = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    assert all(now[f] == t for f, t in files.items())
    assert [s["rows"] for s in head["segments"]] == [400, 1] and [d["rows"] for d in head["deletions"]] == [1]
    new = spark.read.parquet(f"{store.root}/segments/{head['segments'][1]['id']}/postings")
    assert [r.term for r in new.collect()] == ["granite"]
    assert sum(f.stat().st_size for f in now if f not in files) < before


def test_writers_of_one_number_and_a_dead_one(spark, tmp_path, monkeypatch):
    """The second of two writers starts again from the first one's manifest; a manifest that is not whole is waited for, then removed."""
    store, other = (SegmentStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.upsert(points(spark, [("a", "p", ["mill"])]))
    made = []

    def late(head):
        if not made:
            made.append(other.upsert(points(spark, [("a", "q", ["river"]), ("a", "p", ["slate"])])))
        return store._next(head, None, store._write_deletions(head, gone(spark, [("a", "p")]).withColumnRenamed("path", "document"), None))

    assert store._commit(late)["version"] == 3
    check(store, {("a", "q"): ["river"]})
    (tmp_path / "s/commits/000000000004.json").write_text('{"version": 4, "seg')
    assert store.head()["version"] == 3
    with pytest.raises(Conflict):
        store._commit(lambda head: dict(head), tries=2)
    monkeypatch.setattr(segments, "STALE", -1)
    store.upsert(points(spark, [("a", "r", ["mill"])]))
    check(store, {("a", "q"): ["river"], ("a", "r"): ["mill"]})


def test_a_merge_meets_later_commits(spark, tmp_path):
    """What was removed while segments were merged is dead in the merged one; segments that others merged are left alone."""
    store = SegmentStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.upsert(points(spark, [("a", f"p{k}", ["mill"])]))
    head = store.head()
    store.upsert(points(spark, []), gone(spark, [("a", "p1")]))
    store._merge(head, head["segments"])
    check(store, {("a", "p0"): ["mill"], ("a", "p2"): ["mill"]})
    n = store.head()["version"]
    assert store._merge(head, head["segments"])["version"] == n


def test_nearest_by_codes_follows_commits(spark, tmp_path, monkeypatch):
    """Codes are made once and by each later commit; what is replaced or removed is not found; merged parts give the same."""
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    x = centres[r.integers(0, 12, 900)] + 0.2 * r.normal(size=(900, 8))

    def rows(keys, shift=0):
        made = [(f"a:p{k}:0", "a", f"p{k}", "r", "text", "t", "", 5, f"mill {k}", "m", x[(k + shift) % 900].tolist()) for k in keys]
        return spark.createDataFrame(made, SCHEMA)

    store = SegmentStore(spark, str(tmp_path / "s"))
    assert store.nearest([0.0] * 8) is None
    store.upsert(rows(range(600)))
    head = store.train(8, cells=12)
    assert head["book"]["rows"] == 600 and store.nearest([0.0] * 7) is None
    now = {k: x[k] for k in range(600)}
    store.upsert(rows(range(600, 900)))
    now |= {k: x[k] for k in range(600, 900)}
    store.upsert(rows(range(0, 900, 9), 100), gone(spark, [("a", f"p{k}") for k in range(1, 900, 10)]))
    now = {k: v for k, v in now.items() if k % 10 != 1} | {k: x[(k + 100) % 900] for k in range(0, 900, 9)}
    monkeypatch.setattr(segments, "FAN", 2)

    def recalled():
        got = total = 0
        for q in range(0, 900, 150):
            score = {k: v @ x[q] / np.linalg.norm(v) for k, v in now.items()}
            best = {f"p{k}" for k in sorted(score, key=lambda k: (-score[k], k))[:10]}
            hits = store.nearest(x[q].tolist(), 10, 0.95, -1.0, path_prefix="p").collect()
            assert len(hits) == 10 and all(abs(h.score - score[int(h.path[1:])] / np.linalg.norm(x[q])) < 1e-5 for h in hits)
            got, total = got + len(best & {h.path for h in hits}), total + 10
        return got / total

    assert recalled() >= 0.9 and len(store.head()["codes"]) == 3
    assert len(store.compact(everything=True)["codes"]) == 1 and recalled() >= 0.9
    store.train(8, cells=12)
    monkeypatch.setattr(segments, "STALE", -1)
    store.vacuum(keep=1)
    assert recalled() >= 0.9
    assert [h.path for h in store.nearest(x[5].tolist(), 3, 0.99, -1.0, repo="none").collect()] == []


def test_near_words_and_derived_rows(spark, tmp_path, monkeypatch):
    store = SegmentStore(spark, str(tmp_path / "s"))
    rows = points(spark, [("a", "p", ["granite mills"]), ("a", "q", ["grenite"]), ("a", "d.pdf#page=2", ["slate"]), ("a", "img", ["stone"])])
    store.upsert(rows.withColumn("derived_from", F.when(F.col("path") == "img", "d.pdf").otherwise("")))
    for most in (1000, 0):
        monkeypatch.setattr(segments, "LISTED", most)
        found = {r.doc_id for r in store.index().scores(["granite"], typos=True).collect()}
        want = store.rows().where("path in ('p', 'q')").select(identity.lexical_id(F.col("chunk_id")).alias("x")).collect()
        assert found == {r.x for r in want}
    store.upsert(points(spark, []), gone(spark, [("a", "d.pdf")]))
    assert sorted(r.path for r in store.rows().collect()) == ["p", "q"]
