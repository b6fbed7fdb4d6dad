"""The pipeline stage by stage against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import langid, mixing, ngram_join, packing
from millrace.llm.common import documents
from tests.llm.test_operators import WHITE, brute_join, brute_languages, brute_mix

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs, kept = documents(spark, sf_dir), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows = [tuple(r) for r in before.collect()]
        if k < 4:
            assert docs.columns == columns
        kept.append(docs)
        if name == "language_id":
            train = [tuple(r) for r in langid.training_rows(before).collect()]
            want = brute_languages(train, [r[1] for r in rows])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r, (lang, p) in zip(rows, want, strict=True) if lang != "und" and p >= 0.3)
        elif name == "exact_dedup":
            best = {}
            for r in rows:
                t = WHITE.sub("", r[1] or "")
                best[t] = min(best.get(t, (0, 10**9)), (-len(r[1] or ""), r[0]))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for _, i in best.values())
        elif name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _, c in brute_join([(r[0], r[1]) for r in rows]) if i == c)
        elif name == "mix_sources":
            want = brute_mix([(r[0], r[1], r[2], r[3]) for r in rows], corpus_pipeline.MIX_SHARE, mixing.MAX_EPOCHS, mixing.SEED)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(w[0] for w in want)
        else:
            plain, pieces = Tokenizer.from_file(packing.vocabulary()), []
            for r in rows:
                ids = np.array([*plain.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
                pieces += [(r[0], p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
            got = [tuple(r) for r in docs.collect()]
            assert sorted(r[:5] for r in got) == sorted(pieces)
            filled = {}
            for *_, n, _, seq, at in sorted(got, key=lambda r: r[5:]):
                assert at == filled.get(seq, 0)
                filled[seq] = at + n
            assert max(filled.values()) <= 2048 and len(filled) <= sum(p[3] for p in pieces) // 2048 * 1.02 + 2
    assert kept[-1].count() > 0


@pytest.mark.parametrize("kind", ["tricky", "wide", "empty", "blank"])
def test_awkward_tables(spark, tables, kind, tmp_path):
    """Stages run on every table, columns of whatever name come through, and no language, dedup or join stage loses a text for its id."""
    docs = documents(spark, tables[kind])
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables[kind])
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and not {tuple(r) for r in docs.collect()} - {tuple(r) for r in before.collect()}
        if k == 1:
            assert sorted(WHITE.sub("", r.text) for r in docs.collect()) == sorted({WHITE.sub("", r.text) for r in before.collect()})
    assert (docs.count() > 0) == (kind in ("tricky", "wide"))


def test_near_copies_share_four_fifths_of_five_words(spark):
    r = random.Random(8)
    rows = []
    for f in range(20):
        words = [f"{f}_{r.randrange(60)}" for _ in range(r.randrange(4, 120))]
        for _ in range(r.randrange(1, 6)):
            own = [w if r.random() > 0.018 else f"z{r.randrange(10**6)}" for w in words]
            rows.append((len(rows), " ".join(own + [f"y{r.randrange(10**6)}" for _ in range(r.choice([0, len(words) // 5]))])))
    grams = []
    for _, t in rows:
        w = t.split()
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [k for k, x in enumerate(root) if k == x]
    assert got != sorted(i for i, _, c in brute_join(rows) if i == c)


def test_an_appended_fifth_is_a_near_copy(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join(words + [f"more{k}" for k in range(44)]))]
    assert [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()] == [0]


def test_hashes_of_five_words_depend_on_their_order():
    a, b = ngram_join.sets(pa.array(["a b c d e", "e b c d a"]), 5)
    assert a[0] != b[0]
