"""Toxicity by weak supervision.

Lexicons of words and word beginnings are drawn from training labels; together with fixed lexicons and surface
patterns they make about thirty voters, each voting toxic, clean or nothing. A training row's own label is one more
voter of the label model and nothing else. The generative label model (EM) gives each voter a table of vote
probabilities per class, so its accuracy; correlations that remain given the class are measured, and voters that move
together share one voice. A linear classifier on term and vote features (without the label) is trained on the
model's posteriors alone, and its scores are calibrated on the training rows' labels.

Labels come only from rows outside the held-out split, about TRAIN_ROWS of them (drawn by a hash of the id): the one
documented bound. Every term of that sample whose class is sure enough is kept. Scoring covers every document.

Defined results: a null text counts as empty and scores like a text without any evidence; without training
labels of both classes every score is 0; rows repeat as they are; ids may be null (such rows have no label); several
labels of one id count as their maximum; very long texts are read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, crc_split, discard, documents, materialise, plain_words, ragged, slices, small

TRAIN_ROWS = 20_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: Log odds that a term must reach at least, drawn towards 0 by their uncertainty; and those of a strong term.
SURE, STRONG = 0.3, 1.2

# Seed lexicons, as voters of their own.
SEEDS = {
    "insults_en": ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "fool", "hate"),
    "insults_de": ("idiot", "dumm", "trottel", "abschaum", "widerlich", "wertlos", "versager", "dreck", "hasse"),
    "insults_fr": ("idiot", "imbécile", "stupide", "ordure", "minable", "crétin", "dégoûtant", "nul", "déteste"),
    "insults_es": ("idiota", "imbécil", "estúpido", "basura", "patético", "inútil", "asqueroso", "payaso", "odio"),
}
_SECOND = frozenset(("you", "your", "yours", "du", "dich", "dir", "tu", "toi", "te", "vous", "usted", "ti"))
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return crc_split(doc_id, 3, 1)


def terms_of(words) -> set[str]:
    """Of distinct words: each, and its beginnings marked with a star."""
    out = set(words)
    for w in words:
        for n in PREFIXES:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


def labelled(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most so many labelled training rows; only their ids are broadcast."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, most / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(own), "doc_id").select("text", "toxic")


def _count_terms(batches):
    for part in slices(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            counts[int(toxic > 0)].update(terms_of(set(_WORD.findall((text or "").lower()))))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


class Voters:
    """Votes and term features of texts.

    Items are the terms, the seeds and the words of address. The items of each distinct word of a batch are looked up
    once; what a text has follows from its words by numpy."""

    def __init__(self, terms: dict[str, float]):
        """terms: log odds of being in toxic rather than clean texts, drawn towards 0 by their uncertainty."""
        self.terms = sorted(terms)
        seeds = sorted({w for own in SEEDS.values() for w in own})
        self.items: dict[str, list[int]] = {}
        for k, t in enumerate([*self.terms, *seeds, *sorted(_SECOND)]):
            self.items.setdefault(t, []).append(k)
        #: How a word of ASCII letters begins that has an item.
        self.heads = frozenset(t.rstrip("*")[: min(PREFIXES)] for t in self.items)
        n = len(self.terms)
        kinds = {"word": [], **{f"begin{k}": [] for k in PREFIXES}}
        number = {t: k for k, t in enumerate(self.terms)}
        for t in sorted(terms, key=lambda t: (-terms[t], t)):
            if terms[t] > 0:
                kinds[f"begin{len(t) - 1}" if t.endswith("*") else "word"].append(number[t])
        lexicons = {f"{kind}_{part}": own[part::4] for kind, own in kinds.items() for part in range(4) if own[part::4]}
        place = {w: n + k for k, w in enumerate(seeds)}
        lexicons |= {name: [place[w] for w in own] for name, own in SEEDS.items()}
        self.member = np.array(sorted((i, k) for k, own in enumerate(lexicons.values()) for i in own), np.int64).reshape(-1, 2)
        every = n + len(seeds) + len(_SECOND)
        self.begin = np.searchsorted(self.member[:, 0], np.arange(every + 1))
        self.strong = np.zeros(every, bool)
        self.strong[[number[t] for t, v in terms.items() if v >= STRONG]] = True
        self.whole = np.array([not t.endswith("*") for t in self.terms] + [False] * (every - n), bool) & self.strong
        self.seed, self.second = np.zeros((2, every), bool)
        self.seed[n : n + len(seeds)], self.second[n + len(seeds) :] = True, True
        self.lexicons = list(lexicons)
        self.names = [*lexicons, "any_strong", "several_strong", "dense_strong", "aimed", "shouting", "exclaiming", "several_seeds", "long_and_quiet", "short_and_quiet"]

    def _of_word(self, word: str) -> tuple[int, list[int]]:
        """How many words of letters a word is, and the items they have."""
        words = [word] if word.isascii() else _WORD.findall(word.lower())
        return len(words), sorted({k for t in terms_of(words) if t in self.items for k in self.items[t]})

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes (a row per text), and pairs of text and term, as two arrays."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        words, index, edges = plain_words(texts)
        heads, nothing = self.heads, (1, [])
        found = [(self._of_word(w) if w else (0, [])) if w[:4] in heads or not w.isascii() or not w else nothing for w in words]
        many = np.array([m for m, _ in found], np.int64)
        width = np.array([len(i) for _, i in found], np.int64)
        flat = np.array([i for _, own in found for i in own], np.int64)
        begin = np.cumsum(width) - width
        at = np.flatnonzero(width[index]) if len(words) else np.zeros(0, np.int64)
        owner = np.searchsorted(edges, at, "right") - 1
        w = index[at]
        pairs = np.unique(np.repeat(owner, width[w]) * len(self.strong) + flat[ragged(begin[w], width[w])])
        text, item = np.divmod(pairs, len(self.strong))

        counted = lambda mask: np.bincount(text[mask[item]], minlength=n)
        total = np.concatenate([[0], np.cumsum(many[index])]) if len(words) else np.zeros(1, np.int64)
        size = np.maximum(total[edges[1:]] - total[edges[:-1]], 1)
        strong, whole, seeds, aimed = counted(self.strong), counted(self.whole), counted(self.seed), counted(self.second) > 0
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        marks = pc.count_substring(texts, "!").to_numpy(zero_copy_only=False)
        capitals = np.zeros(n, np.int64)
        for k in np.flatnonzero(strong).tolist():
            capitals[k] = sum(map(str.isupper, texts[k].as_py()))
        votes = np.zeros((n, len(self.names)), np.int8)
        in_lexicon = self.begin[item + 1] - self.begin[item]
        votes[np.repeat(text, in_lexicon), self.member[ragged(self.begin[item], in_lexicon), 1]] = 1
        some = strong > 0
        patterns = [
            np.where(some, 1, -1),
            np.where(strong >= 3, 1, np.where(some, 0, -1)),
            np.where(strong / size > 0.004, 1, np.where(some, 0, -1)),
            some & aimed,
            some & (capitals > 0.4 * length),
            some & (marks > 0.02 * length),
            seeds >= 2,
            -((size > 200) & ~some).astype(int),
            -((size <= 200) & ~some & (whole == 0)).astype(int),
        ]
        votes[:, len(self.lexicons) :] = np.stack(patterns, 1)
        own = item < len(self.terms)
        return votes, text[own], item[own]

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        votes, _, terms = self.batch(pa.array([text], pa.string()))
        return votes[0].tolist(), terms.tolist()


class LabelModel:
    """Class-conditional vote tables by EM; correlated voters share a voice. Rows with the same votes are counted, not repeated."""

    #: Votes correlated beyond this over all texts are not used to judge each other.
    ALIKE = 0.8

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 25):
        self.prior = prior
        n, k = votes.shape
        votes, times = np.unique(votes.astype(np.int64), axis=0, return_counts=True)
        one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
        mean = times @ votes / n
        centred = votes - mean
        sd = np.sqrt(times @ (centred * centred) / n)
        centred = centred / np.where(sd > 0, sd, 1)
        self.marginal = centred.T @ (centred * times[:, None]) / max(n, 1)
        alike = np.abs(self.marginal) > self.ALIKE
        np.fill_diagonal(alike, True)
        self.voice = 1 / alike.sum(1)
        posterior = np.clip(prior + ((votes * self.voice).sum(1) / max(self.voice.sum(), 1e-9)), 0.02, 0.98)
        for turn in range(rounds):
            self.tables = []
            for p in (1 - posterior, posterior):
                t = (one_hot * (p * times)[:, None, None]).sum(0) + 0.5
                self.tables.append(t / t.sum(1, keepdims=True))
            if turn == rounds // 3:
                self.voice = self._voices(votes, times)
            posterior = self.posterior(votes)
        right = (one_hot[:, :, 2] * posterior[:, None] + one_hot[:, :, 0] * (1 - posterior)[:, None]) * times[:, None]
        self.accuracy = (right.sum(0) / np.maximum(1e-9, (times[:, None] * (1 - one_hot[:, :, 1])).sum(0))).tolist()

    def _voices(self, votes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """One over the number of voters that a voter effectively repeats: its correlations with others given the class.

        The class is told without the two voters in question and without those much like them."""
        k = votes.shape[1]
        evidence = self._evidence(votes)
        whole, share = evidence.sum(1), times / times.sum()
        apart = [float((t1 - t0) @ (-1, 0, 1)) for t0, t1 in zip(*self.tables, strict=True)]  # how far the classes move each vote
        self.correlation = np.eye(k)
        for i in range(k):
            for j in range(i):
                left_out = (np.abs(self.marginal[i]) > self.ALIKE) | (np.abs(self.marginal[j]) > self.ALIKE)
                left_out[[i, j]] = True
                p1 = self._logistic(whole - evidence[:, left_out].sum(1))
                cov, vi, vj = 0.0, 0.0, 0.0
                for p in ((1 - p1) * share, p1 * share):
                    w = p / max(p.sum(), 1e-9)
                    a, b = votes[:, i] - w @ votes[:, i], votes[:, j] - w @ votes[:, j]
                    cov, vi, vj = cov + p.sum() * (w @ (a * b)), vi + p.sum() * (w @ (a * a)), vj + p.sum() * (w @ (b * b))
                unsure = float((p1 * (1 - p1)) @ share)  # what the classes still explain where they are not certain
                cov, vi, vj = cov - apart[i] * apart[j] * unsure, vi - apart[i] ** 2 * unsure, vj - apart[j] ** 2 * unsure
                self.correlation[i, j] = self.correlation[j, i] = np.clip(cov / np.sqrt(max(vi, 1e-9) * max(vj, 1e-9)), -1, 1)
        strong = np.where(self.correlation > 0.15, self.correlation, 0)
        return 1 / strong.sum(1)

    def _evidence(self, votes: np.ndarray) -> np.ndarray:
        at, cols = votes + 1, np.arange(votes.shape[1])
        return (np.log(self.tables[1][cols, at]) - np.log(self.tables[0][cols, at])) * self.voice

    def _logistic(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence + math.log(self.prior / (1 - self.prior)), -30, 30)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._logistic(self._evidence(votes).sum(1))


class Classifier:
    """Voters, a linear model over their votes and the terms, and its calibration."""

    def __init__(self, voters: Voters, weights: np.ndarray, bias: float, calibration: Calibration):
        self.voters, self.weights, self.bias, self.calibration = voters, weights, bias, calibration

    def scores(self, texts: pa.Array) -> np.ndarray:
        votes, text, term = self.voters.batch(texts)
        k = votes.shape[1]
        return self.calibration(self.bias + votes @ self.weights[:k] + np.bincount(text, self.weights[k:][term], len(texts)))


class Calibration:
    """Isotonic steps, smoothed and joined by lines, so that toxic texts without any evidence do not pull the others down; a logistic part keeps it strictly rising."""

    def __init__(self, z: np.ndarray, y: np.ndarray, logistic: float = 0.03):
        order = np.argsort(z, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, size, sum of z
        for zi, yi in zip(z[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([yi, 1.0, zi])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
        mean = float(y.mean())
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.p = np.maximum.accumulate([(b[0] + mean) / (b[1] + 1) for b in blocks])
        spread = max(float(z.std()), 1e-9)
        self.share, self.middle, self.spread = logistic, float(z.mean()), spread

    def __call__(self, z: np.ndarray) -> np.ndarray:
        x = np.clip((z - self.middle) / self.spread, -30, 30)
        return (1 - self.share) * np.interp(z, self.at, self.p) + self.share / (1 + np.exp(-x))


def _logistic(dense: np.ndarray, row: np.ndarray, column: np.ndarray, columns: int, y: np.ndarray, ridge: float, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights of the dense columns, of the sparse ones (1 at each row, column) and the bias, by Adam on the mean log loss; the bias is not shrunk."""
    n, k = dense.shape
    w, m, s = (np.zeros(k + columns + 1, np.float64) for _ in range(3))
    shrink = np.full(len(w), ridge)
    shrink[-1] = 0
    for t in range(1, steps + 1):
        z = dense @ w[:k] + np.bincount(row, w[k + column], n) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([off @ dense, np.bincount(column, off[row], columns), [off.sum()]]) + shrink * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _likelihood_ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Twice the log likelihood ratio of a of n_a and b of n_b rows against equal shares."""
    share = (a + b) / F.lit(float(n_a + n_b))
    cells = [(a, n_a * share), (b, n_b * share), (n_a - a, n_a * (1 - share)), (n_b - b, n_b * (1 - share))]
    return 2 * sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))


def train(sample: DataFrame) -> Classifier | None:
    """sample: text, toxic. Counts terms, collects votes and features (bounded by the sample), fits."""
    sample = materialise(sample, "toxicity-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    if len(sizes) < 2:
        return None
    n0, n1 = sizes[False], sizes[True]
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    counted = sample.mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialise(counted.where("toxic + clean >= 4"), "toxicity-terms")
    # a term counts by what its log odds are at least (or at most), so that few texts make no strong term; the more terms
    # there are, the more its likelihood ratio must exceed chance, so that hardly one of them passes by luck
    spread = 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    ranked = counted.withColumn("odds", odds).withColumn("sure", F.signum("odds") * F.greatest(F.lit(0.0), F.abs("odds") - spread))
    ranked = ranked.where(_likelihood_ratio(F.col("toxic"), F.col("clean"), n1, n0) > 2 * math.log(max(2, counted.count())))
    terms = ranked.where(F.abs("sure") > SURE).select("term", "sure").toArrow()  # terms of the bounded sample
    voters = Voters(dict(zip(terms.column("term").to_pylist(), terms.column("sure").to_pylist(), strict=True)))

    def votes(batches):
        for part in slices(batches):
            v, text, term = voters.batch(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(v) + 1)), pa.int32()), pa.array(term, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(v.astype(np.int32)), pa.list_(pa.int32())), lists], ["toxic", "votes", "terms"])

    rows = sample.mapInArrow(votes, "toxic int, votes array<int>, terms array<int>").toArrow()  # the bounded sample
    discard(sample)
    discard(counted)
    y = (rows.column("toxic").to_numpy() > 0).astype(float)
    v = np.array(rows.column("votes").to_pylist(), np.int64)
    posterior = posteriors(v, y, n1 / (n0 + n1))
    lists = rows.column("terms").combine_chunks()
    width = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row, term = np.repeat(np.arange(len(y)), width), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    w = _logistic(v.astype(np.float64), row, term, len(voters.terms), posterior, 1e-4)
    k = v.shape[1]
    z = v @ w[:k] + np.bincount(row, w[k + term], len(y)) + w[-1]
    return Classifier(voters, w[:-1], float(w[-1]), Calibration(z, y))


def posteriors(votes: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Of each training row, from its votes and its label, which votes too."""
    every = np.concatenate([np.where(toxic > 0, 1, -1)[:, None], votes], 1)
    return LabelModel(every, prior).posterior(every)


def score_toxicity(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted per row."""

    def run(batch: pa.RecordBatch, own: Classifier | None = None) -> pa.RecordBatch:
        p = own.scores(batch.column("text")) if own is not None else np.zeros(batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, predicted int", model=model)


def op3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
