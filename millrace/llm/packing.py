"""Best-fit packing by hierarchical residuals.

Every partition tokenizes its documents, cuts what is longer than a sequence and packs its pieces best-fit
(longest first, into the fullest bin that still takes them). Bins too full for even the smallest bin of the
corpus are done. The others become items of the next round: groups of them are packed best-fit again, with fewer
groups each round, until one group is left or merging gains no more. Only (bin, load) pairs move between rounds;
pieces are given their final sequence and offset by one join at the end.

Defined results: a null text counts as empty and is one piece that holds only the end id; a very long text is
tokenized whole and cut into pieces (a task holds its ids, and of a partition only five numbers a piece); repeated
rows are packed as rows of their own; ties in length go by doc_id, piece (a null id as 0); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, documents, materialise, ragged, slices, small

CAPACITY = 2048
END_ID = 0
#: Bins that one task merges.
GROUP = 16_384
#: A worker remembers the ids of about so many stems and marks; when they are more, the half used last stays.
MEMO = 150_000
SLICE_BYTES = 1 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: A last character that is a letter or number, and stays one when normalised: marks after it are a pre-token.
_CLOSED = "[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]$"


class Words:
    """Token ids of texts for a tokenizer whose pre-tokens never span ASCII white space: words are encoded once.

    A word is its stem (lower case if ASCII) and its closing marks, which are a pre-token of their own; the tokenizer
    lowers case itself, so the ids of both are those of the whole text. A text that holds one of the tokenizer's added
    tokens is encoded whole, since these may begin anywhere in a word. Known stems and marks lie in Arrow and numpy
    arrays; the ids of part k are pool[begin[k] : begin[k] + width[k]]."""

    _kept: dict[str, Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = pa.array([""], pa.string())
        self.begin, self.width, self.used = (np.zeros(1, np.int64) for _ in range(3))
        self.pool = np.zeros(0, "<u2")
        self.turn = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words encoded as one text, joined by spaces, and where each word's begin and how many they are.

        A word of letters is one pre-token, whose last id is a token that ends a word; others are found by their place."""
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        begin, width = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids, at = [], 0
        for group, simple in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
            for k in range(0, len(group), 4_000):
                own = group[k : k + 4_000]
                part = words.take(pa.array(own)).to_pylist()
                joined = " ".join(part)
                got = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0] if simple else None  # without offsets
                new = np.array(got.ids, "<u2") if simple else None
                ends = np.flatnonzero(self.ends_word[new]) + 1 if simple else ()
                if len(ends) != len(part) or not simple:
                    got = self.tokenizer.encode(joined, add_special_tokens=False)
                    new = np.array(got.ids, "<u2")
                if simple and len(ends) == len(part):  # each word has at least one end, so each has one
                    begin[own] = at + np.concatenate([[0], ends[:-1]])
                    width[own] = np.diff(ends, prepend=0)
                else:
                    places = np.cumsum([0, *(len(w) + 1 for w in part)])
                    cut = np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), places)
                    begin[own], width[own] = at + cut[:-1], np.diff(cut)
                ids.append(new)
                at += len(new)
        return np.concatenate([*ids, np.zeros(0, "<u2")]), begin, width

    @staticmethod
    def _split(words: pa.Array) -> pa.Array:
        """Stems, then closing marks, of distinct words."""
        low = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        stem = pc.ascii_rtrim(low, characters=".,!?;:")
        splits = pc.and_(pc.less(pc.binary_length(stem), pc.binary_length(low)), pc.match_substring_regex(stem, _CLOSED))
        stem = pc.if_else(splits, stem, low)
        tail = pa.array([""] * len(words), pa.string())
        at = np.flatnonzero(splits.to_numpy(zero_copy_only=False))
        if len(at):
            lengths = pc.utf8_length(stem).to_numpy(zero_copy_only=False)
            marks = [w[n:] for w, n in zip(low.take(pa.array(at)).to_pylist(), lengths[at].tolist(), strict=True)]
            tail = pc.replace_with_mask(tail, splits, pa.array(marks, pa.string()))
        return pa.concat_arrays([stem, tail])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct parts are known; those that were not are encoded and added."""
        found = pc.index_in(parts, value_set=self.parts)
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            fresh = parts.take(pa.array(unseen))
            ids, begin, width = self._encode(fresh)
            place[unseen] = len(self.parts) + np.arange(len(unseen))
            self.parts = pa.concat_arrays([self.parts, fresh])
            self.begin = np.concatenate([self.begin, len(self.pool) + begin])
            self.width = np.concatenate([self.width, width])
            self.used = np.concatenate([self.used, np.zeros(len(unseen), np.int64)])
            self.pool = np.concatenate([self.pool, ids])
        self.used[place] = self.turn
        return place

    def _forget(self) -> None:
        """Keep the half of MEMO parts that were used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: MEMO // 2])
        self.pool = self.pool[ragged(self.begin[keep], self.width[keep])]
        self.parts, self.width, self.used = self.parts.take(pa.array(keep)), self.width[keep], self.used[keep]
        self.begin = np.cumsum(self.width) - self.width

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. Null counts as empty."""
        self.turn += 1
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        ids, counts = self._by_words(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        for k in np.flatnonzero(special).tolist():
            own = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
            at = int(counts[:k].sum())
            ids, counts[k] = np.concatenate([ids[:at], own, ids[at:]]), len(own)
        return ids, counts

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        parts = self._split(words.dictionary).dictionary_encode()
        place = self._places(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1)
        both = place.T.ravel()  # stem and marks of each distinct word in turn
        widths = self.width[both]
        own = self.pool[ragged(self.begin[both], widths)]
        width = widths.reshape(-1, 2).sum(1)
        begin = np.cumsum(width) - width
        index = words.indices.to_numpy()
        lens = width[index]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = own[ragged(begin[index], lens)].astype("<u4")
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        if len(self.parts) > MEMO:
            self._forget()
        return ids, total[edges[1:]] - total[edges[:-1]]


def best_fit(sizes: Iterable[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """For sizes in descending order: the bin and offset of each, and the load of each bin. The fullest bin that fits takes an item."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    bins, offsets, loads = [], [], []
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            k = len(loads)
            loads.append(0)
        bins.append(k)
        offsets.append(loads[k])
        loads[k] += size
        room = capacity - loads[k]
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(k)
    return bins, offsets, loads


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized, cut and packed within each partition: `bin` and `at` say where a piece lies."""

    def run(batches):
        words = Words.of(vocab)
        cols = [array("q") for _ in range(5)]
        doc_ids: list = []
        for part in slices(batches, limit=SLICE_BYTES):
            ids, counts = words.encode(part.column("text"))
            at = 0
            for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                at += n
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    cut = own[start : start + capacity]
                    doc_ids.append(doc_id)
                    for c, v in zip(cols, (0 if doc_id is None else doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        c.append(v)
        known, piece, start, length, crc = (np.frombuffer(c, np.int64) if len(c) else np.zeros(0, np.int64) for c in cols)
        order = np.lexsort((piece, known, -length))
        bins, offsets, _ = best_fit(length[order].tolist(), capacity)
        own = TaskContext.get().partitionId() << 32
        for k in range(0, len(order), 50_000):
            o = order[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[x] for x in o], pa.int64()), pa.array(piece[o].astype(np.int32)), pa.array(start[o]), pa.array(length[o]), pa.array(crc[o]), pa.array(np.array(bins[k : k + 50_000], np.int64) + own), pa.array(np.array(offsets[k : k + 50_000], np.int64))],
                [x.split()[0] for x in _PIECES.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def _merge(batches, capacity: int):
    """Best fit over the bins of each group in this partition: every bin gets the bin it goes into and its offset there."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    group, bin_, load = (table.column(c).to_numpy() for c in ("group", "bin", "load"))
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        rows = rows[np.lexsort((bin_[rows], -load[rows]))]
        bins, offsets, loads = best_fit(load[rows].tolist(), capacity)
        head: dict[int, int] = {}
        for b, k in zip(bins, bin_[rows].tolist(), strict=True):
            head.setdefault(b, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bin_[rows]), pa.array([head[b] for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([loads[b] for b in bins], pa.int64())],
            ["bin", "into", "base", "load"],
        )


def merge_rounds(bins: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame | None:
    """bins: bin, load. Where each underfull bin ends: bin, into, base; None if no two can go together.

    Rounds go on until all underfull bins were one group's, or a round of new groups moved none."""
    moved, current, turn = None, bins, 0
    while True:
        n, least = current.agg(F.count(F.lit(1)), F.min("load")).first()
        under = current.where(F.col("load") <= capacity - least) if n > 1 else None
        n = under.count() if under is not None else 0
        if n < 2:
            break
        groups = -(-n // group)
        merged = under.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "bin"), F.lit(groups))).repartition(groups, "group").mapInArrow(lambda b: _merge(b, capacity), "bin long, into long, base long, load long")
        merged = materialise(merged, "pack-round")
        if moved is None:
            moved = merged
        else:
            step = merged.select(F.col("bin").alias("into"), F.col("into").alias("further"), F.col("base").alias("more"))
            moved = moved.join(small(step, n), "into", "left").select("bin", F.coalesce("further", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"), "load")
            moved = materialise(moved, "pack-moved")
        current = merged.where("bin = into").select("bin", "load")
        turn += 1
        if groups == 1 or current.count() == n:
            break
    return moved


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    cut = materialise(pieces(docs, vocab or vocabulary(), capacity, id_col, text_col), "pack-pieces")
    bins = cut.groupBy("bin").agg(F.sum("length").alias("load"))
    bins = materialise(bins.where(F.col("load") < capacity), "pack-bins")
    moved = merge_rounds(bins, capacity)
    if moved is not None:
        cut = cut.join(small(moved.select("bin", "into", "base")), "bin", "left").withColumns({"bin": F.coalesce("into", "bin"), "at": F.col("at") + F.coalesce("base", F.lit(0))})
    discard(bins)
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def op7(spark, sf_dir):
    return pack(documents(spark, sf_dir))
