"""Alignment of two tokenizers' tokens over the same bytes.

B's tokens are put into a static interval index; each of A's tokens asks it by bisection for the tokens it overlaps.
Where no token of B reaches over the gap after a token of A, a group ends: groups are the finest cuts at which tokens
of both end. The last tokens of a group end together and are linked. How often an id pair is linked in the corpus is
counted in one aggregation, and each text reads the counts of its own pairs.

Both tokenizers never join what lies before a single space with what comes after it, so a text is cut there into
segments, each with its leading space; the distinct segments of a batch are tokenized and aligned once, all together,
and remembered by the worker up to a bound.

The most frequent id pairs, at most HEAD of them (a counted bound), are broadcast; the links of the others, none of
which is frequent then, are joined with their counts by a shuffle.

Defined results: a text that is null, empty, or whose tokens do not spell its bytes (with the leading space) in either
vocabulary has no tokens, zeros and an empty digest; strings of special tokens are plain text; repeated rows count as
often as they are there; a null doc_id stays null; an empty table gives an empty result; a very long text is read
whole (a task holds its tokens; a stretch without a single space goes through the tokenizers at once); other columns
are ignored. Ids other than numbers are beyond this operator.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, documents, lent, materialise, ragged, slices, tidy

#: Id pairs that may be broadcast, about 17 bytes each.
HEAD = 1_000_000
#: Segments, and bytes of them, that a worker remembers.
MEMO, MEMO_BYTES = 400_000, 16 << 20
#: Bytes of a segment up to which it is encoded together with others.
LONG = 1024
#: Links that a task collects before it counts them.
BLOCK = 2_000_000


def vocabularies() -> tuple[str, str]:
    """The files of A, a byte-level vocabulary, and B, a vocabulary of pieces."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes are their own letters, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class IntervalIndex:
    """Half-open intervals in order that do not overlap, as sorted ends and starts; asked by bisection, many at once."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def stab(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each [lo, hi) the first interval that it overlaps, and the one after the last."""
        first = np.searchsorted(self.ends, lo, "right")
        return first, np.maximum(first, np.searchsorted(self.starts, hi, "left"))


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as numbers of tokens of A and of B before. Both ends begin after byte 0 and reach the same last byte."""
    a_starts, b_starts = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_ends, b_ends))
    lo, hi = IntervalIndex(b_starts, b_ends).stab(a_starts, a_ends)
    gap = np.concatenate([hi[:-1] <= lo[1:], [True]]) if len(a_ends) else np.zeros(0, bool)  # no token of B overlaps both neighbours
    return np.flatnonzero(gap) + 1, hi[gap]


def _apart(segment: bytes) -> bool:
    """Whether a segment begins with a single space and ends in no white space, so that another may follow it."""
    return len(segment) > 1 and (32 < segment[1] < 127 or segment[1] == 0xC3) and segment[-1] > 32 and segment[-1] != 127


def _ranked(path: str, spelled: list[bytes]):
    """The same byte-pair vocabulary as ranks, which encode faster; none if its merges are not in the order of their ids or it is cut otherwise."""
    import public_tokenizers
    import tiktoken

    file = json.loads(Path(path).read_text())
    model, cutter = file["model"], file.get("pre_tokenizer") or {}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not file.get("normalizer")
    if not plain or any(p >= q for p, q in zip(merged, merged[1:])):  # noqa: B905
        return None
    used = {*merged, *(k for k, x in enumerate(spelled) if len(x) == 1)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks={spelled[k]: k for k in used}, special_tokens={})


def _spellings(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """What is written for each id: `id,` and `id|` for A, `id,` and `id;` for B."""
    out = [f"{k}{end}".encode() for n, ends in ((a, ",|"), (b, ",;")) for end in ends for k in range(n)]
    return np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out], np.int64)


@dataclass
class Ragged:
    """Rows of unequal length: row k is pool[begin[k] : begin[k] + width[k]]."""

    pool: np.ndarray
    begin: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, pool: np.ndarray, width: np.ndarray) -> Ragged:
        return cls(pool, np.cumsum(width) - width, width)

    def plus(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.pool, other.pool]), np.concatenate([self.begin, other.begin + len(self.pool)]), np.concatenate([self.width, other.width]))

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.begin[rows], self.width[rows])]


def _none() -> Ragged:
    return Ragged.of(np.zeros(0, np.int64), np.zeros(0, np.int64))


def _within(values: np.ndarray, edges: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of values[of] between edges."""
    sums = np.concatenate([[0], np.cumsum(values[of])])
    return sums[edges[1:]] - sums[edges[:-1]]


class Aligner:
    """Aligns texts under two vocabularies. Segment k has the ids a and b, and by group the tokens of each (cut_a, cut_b), its links and its spelling."""

    _kept: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = _byte_letters()
        words = self.a.get_vocab()
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for w, k in words.items():
            self.a_bytes[k] = bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.ranked = _ranked(a, self.a_bytes)
        self.marks = Ragged.of(*_spellings(len(self.a_bytes), len(self.b_bytes)))
        self.forget()

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls._kept:
            cls._kept[a, b] = cls(a, b)
        return cls._kept[a, b]

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.bytes = 0
        self.good = np.zeros(0, bool)
        self.ids_a, self.ids_b, self.cut_a, self.cut_b, self.links = (_none() for _ in range(5))
        self.spelled = Ragged.of(np.zeros(0, np.uint8), np.zeros(0, np.int64))

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair of ids."""
        return a * len(self.b_bytes) + b

    def _ids_a(self, texts: list[str], raw: list[bytes]) -> Ragged:
        """A's ids of segments; short ones that are cut off on both sides are encoded as one text."""
        alone = [k for k, x in enumerate(raw) if self.ranked is None or len(x) > LONG or not _apart(x)]
        own = set(alone)
        rest = [k for k in range(len(texts)) if k not in own]
        flat, width = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for p in range(0, len(rest), 4096):
            part = rest[p : p + 4096]
            ids = np.array(self.ranked.encode_ordinary("".join([texts[k] for k in part])), np.int64)
            ends = np.searchsorted(np.cumsum(self.a_len[ids]), np.cumsum([len(raw[k]) for k in part]), "right")
            width[part] = np.diff(ends, prepend=0)
            flat.append(ids)
        lists = [x.ids for x in self.a.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)]
        width[alone] = [len(x) for x in lists]
        flat += [np.array(x, np.int64) for x in lists]
        order = np.array([*rest, *alone], np.int64)
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(width[order]) - width[order]
        out = Ragged(np.concatenate(flat), begin, width)
        return Ragged.of(out.take(np.arange(len(texts))), width)

    def _learn(self, segments: pa.Array) -> None:
        """Tokenize and align distinct segments, which begin with a space each."""
        texts = segments.to_pylist()
        raw = [t.encode() for t in texts]
        lists = self.b.encode([t[1:] for t in texts], num_threads=1)  # it adds the space
        b = Ragged.of(np.fromiter(chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64))
        a = self._ids_a(texts, raw)
        good = np.ones(len(texts), bool)
        for x, spelled in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join([spelled[k] for k in x.pool.tolist()]) != b"".join(raw):
                ids, at = x.pool.tolist(), [*x.begin.tolist(), len(x.pool)]
                good &= [b"".join([spelled[k] for k in ids[p:q]]) == r for p, q, r in zip(at, at[1:], raw)]  # noqa: B905
        a, b = (Ragged.of(x.take(np.flatnonzero(good)), x.width * good) for x in (a, b))
        # good segments lie one after the other, so that all are aligned at once: both end at each one's end
        after_a, after_b = groups(np.cumsum(self.a_len[a.pool]), np.cumsum(self.b_len[b.pool]))
        of = np.searchsorted(np.cumsum(a.width), after_a, "left")  # the segment of each group
        width = np.bincount(of, minlength=len(texts)).astype(np.int64)
        cut_a, cut_b = (np.diff(x, prepend=0) for x in (after_a, after_b))
        tokens = self._marked(a.pool, b.pool, after_a, after_b)
        spelled = np.concatenate([[0], np.cumsum(self.marks.width[tokens])])
        upto = np.concatenate([[0], np.cumsum(a.width + b.width)])
        self.spelled = self.spelled.plus(Ragged.of(self.marks.take(tokens), np.diff(spelled[upto])))
        self.links = self.links.plus(Ragged.of(self.code(a.pool[after_a - 1], b.pool[after_b - 1]), width))
        self.cut_a, self.cut_b = self.cut_a.plus(Ragged.of(cut_a, width)), self.cut_b.plus(Ragged.of(cut_b, width))
        self.ids_a, self.ids_b = self.ids_a.plus(a), self.ids_b.plus(b)
        self.good = np.concatenate([self.good, good])
        self.known = pa.concat_arrays([self.known, segments])
        self.bytes += sum(map(len, raw))

    def _marked(self, a: np.ndarray, b: np.ndarray, after_a: np.ndarray, after_b: np.ndarray) -> np.ndarray:
        """The tokens in the order of their groups, as numbers of what is written for each: `id,` or, at the end of its group, `id|` and `id;`."""
        at_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], after_b[:-1]]) if len(after_b) else after_b, np.diff(after_a, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(after_a, np.diff(after_b, prepend=0))
        mark_a, mark_b = a.copy(), b + 2 * len(self.a_bytes)
        mark_a[after_a - 1] += len(self.a_bytes)
        mark_b[after_b - 1] += len(self.b_bytes)
        out = np.zeros(len(a) + len(b), np.int64)
        out[at_a], out[at_b] = mark_a, mark_b
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segment numbers of all texts that have tokens, where each text's begin and end, and which texts have some. Numbers hold until the next call."""
        if len(self.known) > MEMO or self.bytes > MEMO_BYTES:
            self.forget()
        segments, edges = cut(texts)
        coded = segments.dictionary_encode()
        distinct = coded.dictionary
        place = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            place[unseen] = len(self.known) + np.arange(len(unseen))
            self._learn(distinct.take(pa.array(unseen)))
        of = place[coded.indices.to_numpy()]
        filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        good = filled & (_within((~self.good).astype(np.int64), edges, of) == 0)
        width = np.diff(edges) * good
        return of[ragged(edges[:-1], width)], np.concatenate([[0], np.cumsum(width)]), good


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of texts with a space before them, and where each text's begin and end. Cuts are before a space between
    a character that is no ASCII white space and a printable ASCII or Latin-1 letter."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
    starts = at[:-1] + np.arange(n)
    whole = np.full(int(at[-1]) + n, 32, np.uint8)
    inner = np.ones(len(whole), bool)
    inner[starts] = False
    whole[inner] = np.frombuffer(data, np.uint8, int(at[-1])) if at[-1] else 0
    begins = np.zeros(len(whole), bool)
    if len(whole) > 2:
        before, after = whole[:-2], whole[2:]
        begins[1:-1] = (whole[1:-1] == 32) & (before > 32) & (before != 127) & (((after > 32) & (after < 127)) | (after == 0xC3))
    begins[starts] = True
    places = np.flatnonzero(begins)
    cuts = np.concatenate([places, [len(whole)]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(cuts), pa.py_buffer(whole)), np.concatenate([np.searchsorted(places, starts), [len(places)]])


def _listed(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, group_a, group_b (how many tokens of each a group has, in order), group_bytes: one row per row of docs.

    The bytes are those of the text with a space before it; without tokens all arrays are empty."""
    files = (a, b) if a and b else vocabularies()
    names = ["a_ids", "b_ids", "group_a", "group_b", "group_bytes"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Aligner.of(*files)
        of, edges, _ = own.texts(batch.column("text"))
        columns = []
        for x in (own.ids_a, own.ids_b, own.cut_a, own.cut_b):
            columns.append((x.take(of), np.concatenate([[0], np.cumsum(x.width[of])])[edges]))
        sums = np.concatenate([[0], np.cumsum(own.a_len[columns[0][0]])])
        upto = np.cumsum(columns[2][0])
        columns.append((sums[upto] - sums[upto - columns[2][0]], columns[2][1]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(_listed(v, e, pa.int32()) for v, e in columns)], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"doc_id long, {', '.join(f'{n} array<int>' for n in names)}")


_LINKED = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def _linked(batches: Iterator[pa.RecordBatch], files: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Per text its digests, and the id pairs that it links, with how often. key: a number of the row."""
    key = TaskContext.get().partitionId() << 40
    own = Aligner.of(*files)
    for batch in slices(batches):
        n = batch.num_rows
        of, edges, good = own.texts(batch.column("text"))
        counts = [_within(x.width, edges, of) for x in (own.ids_a, own.ids_b, own.cut_a, own.links)]
        spelled = memoryview(own.spelled.take(of))
        at = np.concatenate([[0], np.cumsum(own.spelled.width[of])])[edges].tolist()
        digests = [hashlib.sha256(spelled[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(at, at[1:])]  # noqa: B905
        doc = np.repeat(np.repeat(np.arange(n), np.diff(edges)), own.links.width[of])
        codes = own.links.take(of)
        order = np.lexsort((codes, doc))
        doc, codes = doc[order], codes[order]
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])])[: len(doc)]
        place = np.flatnonzero(first)
        times = np.diff(place, append=len(doc))
        cuts = np.searchsorted(doc[place], np.arange(n + 1))
        columns = [pa.array(key + np.arange(n)), batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), _listed(codes[place], cuts, pa.int64()), _listed(times, cuts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _LINKED.split(", ")])
        key += n


def linked(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the figures of its groups and the id pairs that it links, written as a table."""
    files = (a, b) if a and b else vocabularies()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(lambda batches: _linked(batches, files), _LINKED), "align-links")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's rows link each id pair, summed over blocks of links."""
    held, total = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, inverse, np.concatenate([y for _, y in held]))
        return codes, n

    def sent(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    for batch in batches:
        held.append((_flat(batch, "codes"), _flat(batch, "times")))
        total += len(held[-1][0])
        if total > BLOCK:
            held = [summed()]
            total = len(held[0][0])
            if total > BLOCK // 2:  # mostly different pairs: let the exchange sum them
                yield sent(*held[0])
                held, total = [], 0
    if total:
        yield sent(*summed())
    tidy()


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """code, a, b, n, best: how many links hold each id pair, and whether no pair of its b has more; written as a table.

    The best counts by b are no more than B has ids."""
    n = links.select("codes", "times").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = materialise(n.select("code", F.expr(f"code div {b_size}").alias("a"), (F.col("code") % b_size).alias("b"), "n"), "align-counts")
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "b").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(pairs: DataFrame, most: int) -> int:
    """The least count of the pairs that are broadcast, so that these are at most `most`. Counts are grouped by about a twelfth of their size."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    by_size = pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()  # some hundred rows
    least, room = (1 << 63) - 1, most
    for r in sorted(by_size, reverse=True):
        room -= r.pairs
        if room < 0:
            return least
        least = r.least
    return 0


def scored(links: DataFrame, pairs: DataFrame, most: int = HEAD) -> DataFrame:
    """links with n_best (links whose count is the highest of their b) and count_sum (over links)."""
    least = _head(pairs, most)
    head = pairs.where(F.col("n") >= least).select("code", "n", "best").toArrow()
    order = np.argsort(codes := head.column("code").to_numpy())
    held = links.sparkSession.sparkContext.broadcast((codes[order], head.column("n").to_numpy()[order], head.column("best").to_numpy()[order]))
    kept = ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def found(batch: pa.RecordBatch, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, times = _flat(batch, "codes"), _flat(batch, "times")
        place = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
        return own, times, place, (codes[place] == own if len(codes) else np.zeros(len(own), bool))

    def score(batches):
        with lent(held) as (codes, n, best):
            for batch in batches:
                edges = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False))]).astype(np.int64)
                _, times, place, hit = found(batch, codes)
                sums = [_within(np.where(hit, times * x[place], 0) if len(codes) else np.zeros(len(hit), np.int64), edges, slice(None)) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

    def rest(batches):
        with lent(held) as (codes, _, _):
            for batch in batches:
                own, times, _, hit = found(batch, codes)
                row = np.repeat(batch.column("key").to_numpy(), pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(x[~hit]) for x in (row, own, times)], ["key", "code", "times"])

    out = links.mapInArrow(score, "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if least:
        rare = links.select("key", "codes", "times").mapInArrow(rest, "key long, code long, times long").join(pairs.where(F.col("n") < least).select("code", "n", "best"), "code")
        more = rare.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "key", "left").select(*kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    return out.drop("key")


def align(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs."""
    files = (a, b) if a and b else vocabularies()
    links = linked(docs, *files, id_col, text_col)
    return scored(links, pair_counts(links, len(Aligner.of(*files).b_bytes))).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13(spark, sf_dir):
    return align(documents(spark, sf_dir))
