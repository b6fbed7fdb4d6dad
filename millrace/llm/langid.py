"""Language identification, word first.

A word that training has seen scores by its log frequency in each language. An unseen word backs off to its
character n-grams: the longest size with a known n-gram decides, each backoff step costs a factor, and a word
without any known n-gram says nothing. Training counts a sample of about TRAIN_ROWS labelled rows, drawn evenly
by a hash of the id: this documented bound is the only one, for the tables keep every word and n-gram that the
sample has twice or more, in whatever language. Words and n-grams are known by 64-bit hashes, in sorted arrays.
Distinct words of a batch are scored once, all together, with numpy.

Defined results: text that is null or has no letter is `und` with score 0; with no training rows at all every
text is `und`; ties go to the language first in the alphabet; rows repeat as they are; a text in several
languages gets the one with the most evidence; very long texts and words are read whole (a text without white
space is one word, judged by all its n-grams); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, crc_split, discard, documents, materialise, plain_words, slices

#: Labelled rows that training uses (expected number); the bound of the model.
TRAIN_ROWS = 20_000
#: How often the sample must have a word or n-gram.
LEAST = 2
GRAM_SIZES = (5, 4, 3, 2, 1)
#: Factor on the evidence of a word for each step it had to back off.
BACKOFF = 0.6

def _letters(word: str) -> str:
    return word if word.isascii() else "".join(filter(str.isalpha, word.lower()))


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words between white space and ASCII signs, lower-case letters only; the place of each word of the texts among
    them (a spelling may be listed twice), and where each text begins and ends."""
    words, index, edges = plain_words(texts)
    return [_letters(w) for w in words], index, edges


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: list[str]):
    """For each size: the hashes of the n-grams of all words, with their words' numbers."""
    padded = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(p) for p in padded], np.int64)
    ends = np.repeat(np.cumsum(lens), lens)
    owner = np.repeat(np.arange(len(words)), lens)
    h = np.zeros(len(points), np.uint64)
    by_size = {}
    for size in range(1, max(GRAM_SIZES) + 1):
        h[: len(h) - size + 1] = h[: len(h) - size + 1] * np.uint64(0x100000001B3) + points[size - 1 :] + np.uint64(1)
        if size in GRAM_SIZES:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            by_size[size] = mixed ^ (mixed >> np.uint64(32))
    at = np.arange(len(points))
    return {size: (by_size[size], at + size <= ends) for size in GRAM_SIZES}, owner


_COUNTED = "lang string, size int, h long, n long"


def _counts(batches):
    """Counts of words (size 0) and n-grams per language; the n-grams of a word weigh as often as it occurs."""

    def batch(lang, size, h, n):
        m = len(h)
        return pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(np.full(m, size, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], [x.split()[0] for x in _COUNTED.split(", ")])

    for part in slices(batches):
        words, index, edges = split_words(part.column("text"))
        tags = part.column("lang").to_pylist()
        tag_of = np.repeat(np.arange(len(tags)), np.diff(edges))
        for lang in sorted(set(tags)):
            own = np.isin(tag_of, [k for k, t in enumerate(tags) if t == lang])
            n = np.bincount(index[own], minlength=len(words))
            there = [k for k in np.flatnonzero(n).tolist() if words[k]]
            if not there:
                continue
            keys, weights = [words[k] for k in there], n[there]
            yield batch(lang, 0, word_hashes(keys), weights)
            grams, owner = gram_hashes(keys)
            for size, (h, valid) in grams.items():
                unique, inverse = np.unique(h[valid], return_inverse=True)
                yield batch(lang, size, unique, np.bincount(inverse, weights[owner[valid]]))


Table = tuple[np.ndarray, np.ndarray]


def _lookup(table: Table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes a table has, and in what rows."""
    keys = table[0]
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[place] == h, place


class Model:
    """Log probabilities, one column per language; a table is sorted hashes and their rows. words: one table; grams: one per size."""

    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def unseen(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not words:
            return out
        hashed, owner = gram_hashes(words)
        waiting = np.ones(len(words), bool)
        for step, size in enumerate(GRAM_SIZES):
            h, valid = hashed[size]
            at = np.flatnonzero(valid & waiting[owner])
            hit, place = _lookup(self.grams[size], h[at])
            who, place = owner[at[hit]], place[hit]
            n = np.bincount(who, minlength=len(words))
            found = n > 0
            for k in range(len(self.langs)):
                total = np.bincount(who, self.grams[size][1][place, k], len(words))
                out[found, k] = total[found] / n[found] * BACKOFF ** (step + 1)
            waiting &= ~found
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        words, index, edges = split_words(texts)
        n = len(texts)
        if not self.langs or not words:
            return ["und"] * n, [0.0] * n
        real = np.array([bool(w) for w in words])
        known, place = _lookup(self.words, word_hashes(words))
        known &= real
        table = np.zeros((len(words), len(self.langs)), np.float64)
        table[known] = self.words[1][place[known]]
        fresh = np.flatnonzero(real & ~known).tolist()
        table[fresh] = self.unseen([words[k] for k in fresh])
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(table[index], 0)])
        total = sums[edges[1:]] - sums[edges[:-1]]
        counts = np.concatenate([[0], np.cumsum(real[index])])
        m = counts[edges[1:]] - counts[edges[:-1]]
        best = np.round(total, 6).argmax(1)
        logit = total / np.maximum(m, 1)[:, None] * np.sqrt(np.minimum(m, 20))[:, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p = p[np.arange(n), best] / p.sum(1)
        return [self.langs[b] if k else "und" for b, k in zip(best, m, strict=True)], np.where(m > 0, p, 0.0).tolist()


def train(rows: DataFrame) -> Model:
    """rows: text, lang (not null). Counting is distributed; one row per word and n-gram of the bounded sample comes back."""
    counted = rows.select("text", "lang").mapInArrow(_counts, _COUNTED).groupBy("size", "h", "lang").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "langid-counts")
    totals = {(r[0], r[1]): r[2] for r in counted.groupBy("size", "lang").agg(F.sum("n")).collect()}  # six rows a language
    langs = sorted({lang for _, lang in totals})
    per_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)]
    found = counted.groupBy("size", "h").agg(F.sum("n").alias("n"), *per_lang).where(F.col("n") >= LEAST).drop("n").toArrow()
    discard(counted)
    sizes, h = found.column("size").to_numpy(), found.column("h").to_numpy().view(np.uint64)
    n = np.stack([found.column(f"n{k}").to_numpy() for k in range(len(langs))], 1) if langs else np.zeros((len(h), 0))

    def table(size: int) -> Table:
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(h[own])]
        p = np.log((n[own] + 0.5) / np.array([totals.get((size, x), 0) + 1000 for x in langs]))
        return h[own], (p - p.mean(1, keepdims=True) if langs else p).astype(np.float32)

    return Model(langs, table(0), {size: table(size) for size in GRAM_SIZES})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score per row of docs."""

    def score(batch: pa.RecordBatch, own: Model) -> pa.RecordBatch:
        lang, p = own.predict(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), score, "doc_id long, lang_pred string, score double", model=model)


def held_out(doc_id: Column) -> Column:
    return crc_split(doc_id, 4, 2)


def training_rows(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "lang")


def accept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose language is told with a score of at least `least`; `und` goes."""

    def keep(batch: pa.RecordBatch, own: Model) -> pa.RecordBatch:
        lang, p = own.predict(batch.column("text"))
        return batch.filter(pa.array([x != "und" and q >= least for x, q in zip(lang, p, strict=True)], pa.bool_()))

    return arrow_map(docs, keep, docs.schema, model=model)


def op4(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = identify(docs, train(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
