"""N-gram Jaccard self-join by vertical partitioning.

The n-grams are ordered by a 64-bit hash of their words and the order is cut into fragments. What a fragment
counts is a partial result; partial results are summed per text or per pair.

1. Texts with equal n-gram sets form a class. In the first fragments of the order (enough of it for the threshold),
   each fragment counts how many of a class's n-grams other classes have too; summed over these fragments that bounds
   what a class can share, so a class with more n-grams of its own than a link allows is alone (most of a corpus).
   Before anything moves, each task counts the n-grams that several classes of its own block share, and sends such an
   n-gram for two of them only: one that all classes have costs two entries a block. The classes that are left, among
   which are all partners, are counted once more among themselves, over the whole order.
2. The rest post the first n-grams that any partner must meet (prefix filter). For this the n-grams are ordered anew: those
   that many sets have come last, by how many have them, so that lists are short where sets have anything rare. The order only
   decides what is posted: which n-grams count as frequent, and how exactly they were counted, changes no result. Each posting
   list is a star around its most typical member: linearly many pairs, never all of a list.
3. Pairs are verified exactly: the overlap in each fragment is counted apart and summed per pair.
4. Lists that still hold several components are gone through from their smallest components: in each round a bounded
   number of members of each such list meets the members of its other components and leaves the list, until one
   component is left in it; so no list makes more than a bounded number of pairs, or linearly many, in a round. A round reads
   what the one before left open. A length filter, the places of the n-gram in both sets (beyond it there must be enough of both) and a
   parity sketch (it never overstates a difference) spare most verifications. So no link between different
   sets is lost, while members of one component need not meet.

Components come from alternating large-star and small-star steps on tables.

Defined results: a text without words, or null, has an empty set and is linked with nothing; with fewer words than
an n-gram the whole sequence is the one n-gram; repeated rows are copies of each other; a null doc_id cannot name
a component, so a group of such rows alone has a null one; an empty table gives an empty result; other columns are
ignored; very long texts are read whole. N-grams and sets are known by hashes of 64 bits: two n-grams that collide
change an overlap by one, two different sets that collide count as equal. In the counts of step 1 an entry is 32 bits of
an n-gram within its fragment and all 64 of its class, which can only overstate what a class shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import url_filter
from millrace.llm.common import BROADCAST_ROWS, documents, free, join_hot, lent, materialise, ragged, row_keyed, slices, small, tidy

WORDS, PERCENT = 4, 85
#: Text bytes whose n-grams go to one fragment, about: a task sorts 12 bytes for each of these n-grams that lies in the part of the order that is counted.
FRAGMENT_BYTES = 16 << 20
#: Entries that a task collects before it sends them; more where fragments are very many, so that a row holds several, and the most.
BLOCK, BLOCK_MOST = 500_000, 12_000_000
#: Members of a list that meet the others in one round: EASY, or as many (up to TURN) as make LIST_PAIRS pairs.
EASY, TURN, LIST_PAIRS = 512, 2048, 1 << 22
#: Pairs of one text that are verified by one task.
VERIFIED = 500
#: Fragments in which pairs are verified.
PAIR_FRAGMENTS = 8
SKETCH = 16  # longs of 64 bits
#: N-grams that come last in the order of prefixes, at most (they are broadcast, 16 bytes each), and the least number of sets for it.
FREQUENT, OFTEN = 100_000, 8
#: N-grams of sets that a task counts at once.
COUNTED = 1 << 21
_NO_ID = -(1 << 63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    size = int(np.frombuffer(offsets, np.int32, 1, 4 * len(texts))[0]) if len(texts) else 0
    lower = _LOWER[np.frombuffer(data, np.uint8, size)] if size else np.zeros(0, np.uint8)
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(lower)))
    coded = lists.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in unique], np.uint64)
    real = np.array([bool(w) for w in unique], bool)
    index = coded.indices.to_numpy().astype(np.int64)
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    keep = real[index] if len(index) else np.zeros(0, bool)  # white space at the ends leaves empty words
    counts = np.concatenate([[0], np.cumsum(keep)])
    edges = counts[edges]
    w = hashed[index[keep]] if len(index) else np.zeros(0, np.uint64)
    n = len(w)
    h = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        h += w[k : n - words + 1 + k] * _FACTORS[k % len(_FACTORS)] + np.uint64(k) if n >= words else 0
    h = _mix(h)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(h[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(_mix(np.array([int(xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))).astype(np.int64))


def counted_share(percent: int) -> float:
    """The part of the order in which shared n-grams are counted: a class without partners has more n-grams there than a link leaves unshared, by far."""
    return min(1.0, 0.1 + 2 * (100 - percent) / 100)


_SEGMENTS = "frag int, kind int, bucket int, ids binary, tags binary, counts binary, entries binary"
_LOW = np.uint64(0xFFFFFFFF)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [k for k, _ in fields])


def _by_bucket(tags: np.ndarray, counts: np.ndarray, buckets: int):
    """Counts of classes (named by their signature), in one piece per bucket: bucket, tags, counts."""
    if not len(tags):
        return
    bucket = tags % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    there, cuts = np.unique(bucket[order], return_index=True)
    for k, t, n in zip(there.tolist(), np.split(tags[order], cuts[1:]), np.split(counts[order], cuts[1:]), strict=True):
        yield k, t.tobytes(), n.astype(np.uint32).tobytes()


def _shared(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """entries: sorted, distinct (with the rest of their classes); 32 bits of an n-gram, then 32 of a class. Whether each one's n-gram has another class, and whether it is the first or second of its n-gram."""
    gram = entries >> np.uint64(32)
    first = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
    last = np.concatenate([gram[1:] != gram[:-1], [True]])[: len(gram)]
    second = np.concatenate([[False], first[:-1]])[: len(gram)] & ~first
    return ~(first & last), first | second


def _distinct(entries: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order with the upper 32 bits of their classes, each pair of both once; where classes agree in the lower bits, one may stay twice (which overstates)."""
    order = np.argsort(entries)
    entries, high = entries[order], high[order]
    new = np.concatenate([[True], (entries[1:] != entries[:-1]) | (high[1:] != high[:-1])])[: len(entries)]
    return entries[new], high[new]


def _classes(entries: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | (entries & _LOW)


def _segments(batches, fragments: int, words: int, share: float):
    """Kind 0: entries of a fragment, and the upper halves of their classes. Kind 1: ids, signatures, set sizes and how much of each set lies in the counted part. Kind 2: counts of classes within a block."""
    top = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))
    high = np.uint64((int(top) >> 32) + 1)
    turn, held, total = TaskContext.get().partitionId(), [], 0
    block = max(BLOCK, min(BLOCK_MOST, 8 * fragments))

    def sent():
        nonlocal held, total
        frag, entries, upper = (np.concatenate([x[k] for x in held]) for k in range(3))
        held, total = [], 0
        order = np.argsort(frag, kind="stable")
        frag, entries, upper = frag[order], entries[order], upper[order]
        there, cuts = np.unique(frag, return_index=True)
        out, counted = [], []
        for f, p, q in zip(there.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(frag)], strict=True):
            own, own_high = _distinct(entries[p:q], upper[p:q])
            shared, named = _shared(own)
            out.append((f, 0, None, b"", b"", own_high[named].tobytes(), own[named].tobytes()))
            rest = shared & ~named
            counted.append(_classes(own[rest], own_high[rest]))
        tags, n = np.unique(np.concatenate(counted), return_counts=True)
        out += [(k % fragments, 2, k, b"", t, c, b"") for k, t, c in _by_bucket(tags, n, fragments)]
        del frag, entries, upper, order, counted
        tidy()
        return _rows(out, _SEGMENTS)

    for part in slices(batches):
        turn += 7919
        own = sets(part.column("text"), words)
        sigs = np.array([_signature(s) if len(s) else 0 for s in own], np.int64)
        inside = [s[: np.searchsorted(s, top)] for s in own]
        sizes, some = (np.array([len(s) for s in x], np.uint32) for x in (own, inside))
        ids = pc.fill_null(part.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
        yield _rows([(turn % fragments, 1, None, ids.tobytes(), sigs.tobytes(), sizes.tobytes(), some.tobytes())], _SEGMENTS)
        joined = np.concatenate(inside)
        tags = np.repeat(sigs.view(np.uint64), some)
        held.append((((joined >> np.uint64(32)) * np.uint64(fragments) // high).astype(np.int32), joined << np.uint64(32) | (tags & _LOW), (tags >> np.uint64(32)).astype(np.uint32)))
        total += len(joined)
        if total >= block:
            yield sent()
    if total:
        yield sent()


_PARTIAL = "kind int, doc_id long, sig long, n int, inside int, bucket int, tags binary, counts binary"


def _partial(batches, buckets: int):
    """Kind 1: one row per text. Kind 0: how many n-grams of each class other classes have too, in one row per bucket of classes."""
    held: dict[int, list] = {}
    names = [x.split()[0] for x in _PARTIAL.split(", ")]

    def counts(pieces):
        bucket, tags, n = zip(*pieces, strict=True)
        m = len(bucket)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), *none, pa.array(bucket, pa.int32()), pa.array(tags, pa.binary()), pa.array(n, pa.binary())], names)

    for b in batches:
        for f, kind, bucket, ids, tags, n, entries in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            if kind == 1:
                doc = np.frombuffer(ids, np.int64)
                columns = [pa.array(np.frombuffer(x, t).astype(u)) for x, t, u in ((tags, np.int64, np.int64), (n, np.uint32, np.int32), (entries, np.uint32, np.int32))]
                none = [pa.nulls(len(doc), t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(doc), np.int32)), pa.array(doc, mask=doc == _NO_ID), *columns, *none], names)
            elif kind == 2:
                yield counts([(bucket, tags, n)])
            else:
                held.setdefault(f, []).append((entries, n))
    for f in sorted(held):
        pieces = held.pop(f)
        own, high = _distinct(np.concatenate([np.frombuffer(x, np.uint64) for x, _ in pieces]), np.concatenate([np.frombuffer(y, np.uint32) for _, y in pieces]))
        shared = _shared(own)[0]
        tags, n = np.unique(_classes(own[shared], high[shared]), return_counts=True)
        del own, high, pieces
        tidy()
        if len(tags):
            yield counts([*_by_bucket(tags, n, buckets)])


def _summed(batches):
    """The counts of each class, summed. A bucket holds as many classes as a fragment's share of the texts."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        for k, tags, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            own = parts.setdefault(k, [])
            own.append((np.frombuffer(tags, np.uint64), np.frombuffer(counts, np.uint32)))
            if sum(len(x[0]) for x in own[1:]) > max(1 << 20, len(own[0][0])):
                own[:] = [_added(own)]
    for k in sorted(parts):
        tags, n = _added(parts.pop(k))
        yield pa.RecordBatch.from_arrays([pa.array(tags.view(np.int64)), pa.array(n.astype(np.int64))], ["sig", "shared"])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    tags, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return tags, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _whole(batches, words: int):
    """Per text its signature, size, parity sketch and n-grams by pair fragment."""
    for part in slices(batches):
        own = sets(part.column("text"), words)
        rows = []
        for s in own:
            bits = np.zeros(SKETCH * 64, np.uint8)
            np.bitwise_xor.at(bits, (s >> np.uint64(20)).astype(np.int64) % (SKETCH * 64), 1)
            cut = np.searchsorted(s, np.arange(1, PAIR_FRAGMENTS).astype(np.uint64) * np.uint64((1 << 64) // PAIR_FRAGMENTS))
            rows.append((_signature(s), len(s), np.packbits(bits).view(np.int64), np.split(s.view(np.int64), cut)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.list_(pa.int64())))],
            ["sig", "n", "sketch", "parts"],
        )


def _repeated(batches):
    """N-grams that several sets of a block have, and how many have them."""
    held, total = [], 0

    def sent():
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["h", "sets"])

    for b in batches:
        held.append(b.column("parts").flatten().flatten().to_numpy(zero_copy_only=False))
        total += len(held[-1])
        if total >= COUNTED:
            yield sent()
            held, total = [], 0
    if total:
        yield sent()
    del held
    tidy()


def _frequent(whole: DataFrame) -> np.ndarray:
    """N-grams that many sets have, those that most have last: at most FREQUENT, all that at least some power of two of sets have (as counted in blocks)."""
    found = whole.select("parts").mapInArrow(_repeated, "h long, sets long").groupBy("h").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= OFTEN)
    found = materialise(found, "join-frequent")
    least, held = None, 0
    for level, n in sorted(found.groupBy(F.floor(F.log2("sets"))).count().collect(), reverse=True):
        held += n
        if held > FREQUENT:
            break
        least = 1 << level
    if least is None:
        return np.zeros(0, np.uint64)
    rows = sorted((r.sets, r.h) for r in found.where(F.col("sets") >= least).collect())
    return np.array([h for _, h in rows], np.int64).view(np.uint64)


def _prefixes(batches, frequent: np.ndarray, percent: int):
    """The n-grams that a partner of a set must meet, first those that are not frequent, and the place of each, from 1."""
    by_hash = np.argsort(frequent)
    hashes, ranks = frequent[by_hash], by_hash + 1
    for b in batches:
        lists = b.column("parts")
        n = b.column("n").to_numpy().astype(np.int64)
        grams = lists.flatten().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        rank = np.zeros(len(grams), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            rank = np.where(hashes[at] == grams, ranks[at], 0)
        order = np.argsort(np.repeat(np.arange(len(n)), n) * (len(hashes) + 1) + rank, kind="stable")
        first = n - (percent * n + 99) // 100 + 1
        picked = grams[order[ragged(np.cumsum(n) - n, first)]].view(np.int64)
        row = pa.array(np.repeat(np.arange(len(n)), first))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("sig", "n", "own")), pa.array(picked), pa.array(ragged(np.ones(len(n), np.int64), first).astype(np.int32))], ["sig", "n", "own", "h", "place"])
    tidy()


def _posts(whole: DataFrame, percent: int) -> DataFrame:
    """h, sig, n, own, place: the n-grams of each set that any partner must meet, and their places in the order."""
    held = whole.sparkSession.sparkContext.broadcast(_frequent(whole))

    def run(batches):
        with lent(held) as frequent:
            yield from _prefixes(batches, frequent, percent)

    return materialise(whole.select("sig", "n", "own", "parts").mapInArrow(run, "sig long, n int, own long, h long, place int"), "join-posts")


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verify(pairs: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b (distinct). whole: sig, n, parts (n-grams by fragment). The pairs that link; the overlap of each fragment is counted apart.

    Only the n-grams of texts in some pair move, once to their partner. A text that many pairs end in is dealt out, VERIFIED pairs to a task."""
    by_end = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    n, most = by_end.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    parts = whole.select("sig", "n", "parts").join(small(ends), "sig", "left_semi").select("sig", "n", F.posexplode("parts").alias("frag", "grams")).where(F.size("grams") > 0)
    dealt = pairs.select("a", "b", F.lit(0).alias("deal"))
    right = parts.select(F.col("sig").alias("b"), F.col("n").alias("nb"), "frag", F.col("grams").alias("gb")).withColumn("deal", F.lit(0))
    if most > VERIFIED:
        many = materialise(by_end.where(F.col("n") > VERIFIED).select("b", F.ceil(F.col("n") / VERIFIED).cast("int").alias("deals")), "join-deals")
        held = many.count()
        dealt = pairs.join(small(many, held), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"))
        right = right.join(small(many, held), "b", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    left = parts.select(F.col("sig").alias("a"), F.col("n").alias("na"), "frag", F.col("grams").alias("ga")).join(small(dealt, n), "a")
    partial = left.join(right, ["b", "frag", "deal"]).select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ga", "gb")).alias("same"))
    total = partial.groupBy("a", "b", "na", "nb", "frag").agg(F.max("same").alias("same")).groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"))
    return total.where((F.col("same") * 100 >= (F.col("na") + F.col("nb") - F.col("same")) * percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node, root: the smallest node that each linked node (itself included) reaches, by large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "join-edges")
    state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        nodes = 2 * state[0]  # at most
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_hot(both, least, "u", F.col("v"), nodes).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = join_hot(large, least, "u", F.col("v"), nodes).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small_, "join-edges")
        # a fixed point when each node has one edge, and its end has none
        before, state = state, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialise(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "join-found")


def _meeting(docs: DataFrame, total: int, words: int, percent: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (doc_id, sig, n_shingles), their classes, and those of the classes (sig, key, n, own) that may have partners, by the n-grams in a share of the order. total: bytes of text."""
    fragments = max(2, -(-int(total * share) // FRAGMENT_BYTES))
    dealt = docs.mapInArrow(lambda b: _segments(b, fragments, words, share), _SEGMENTS).repartitionById(fragments, "frag")
    counted = materialise(dealt.mapInArrow(lambda b: _partial(b, fragments), _PARTIAL), "join-partial")
    texts = counted.where("kind = 1").select("doc_id", "sig", F.col("n").alias("n_shingles"), "inside")
    keyed = F.coalesce(F.col("doc_id"), F.lit(_NO_ID))
    classes = texts.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max(keyed).alias("key"), F.max("n_shingles").alias("n"), F.max("inside").alias("inside"), F.count(F.lit(1)).alias("copies"))
    shared = counted.where("kind = 0").select("bucket", "tags", "counts").repartitionById(fragments, "bucket").mapInArrow(_summed, "sig long, shared long")
    tagged = classes.join(shared, "sig", "left")
    own = F.greatest(F.lit(0), F.col("inside") - F.coalesce("shared", F.lit(0)))
    rest = materialise(tagged.withColumn("own", own).where(f"own * 100 <= n * {100 - percent}").select("sig", "key", "n", "own"), "join-rest")
    return texts, classes, rest


def _having(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The documents (doc_id, text) of the n classes in rows. Where their keys are too many to broadcast, a Bloom filter of them is, and only texts that pass it move."""
    keyed, keys = docs.withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID))), rows.select("key")
    if n > BROADCAST_ROWS:
        blocks = min(BROADCAST_ROWS, -(-n * url_filter.BITS // (64 * url_filter.WORDS)))
        passing = F.broadcast(url_filter.bloom(keys.withColumnRenamed("key", "__url"), blocks))
        keyed = url_filter._possible(keyed, passing, blocks, "key").where("__possible is not null")
    return keyed.join(small(keys, n), "key", "left_semi").select("doc_id", "text")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, sig (class of equal sets, 0 if empty), component_id: one row per row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts, classes, rest = _meeting(docs, total, words, percent, counted_share(percent))

    # partners are among the rest, so the whole order is counted among the rest only
    wanted, n_rest = docs, rest.count()
    if n_rest:
        wanted = materialise(_having(docs, rest, n_rest), "join-docs")
        size = int(total * min(1.0, n_rest / max(1, classes.count())))
        again = _meeting(wanted, size, words, percent, 1.0)[2].join(small(rest.select("sig"), n_rest), "sig", "left_semi")
        rest = materialise(again, "join-rest")
        n_rest = rest.count()
    wanted = _having(wanted, rest, n_rest)
    whole = wanted.mapInArrow(lambda b: _whole(b, words), "sig long, n int, sketch array<long>, parts array<array<long>>")
    whole = materialise(whole.join(small(rest.select("sig", "own"), n_rest), "sig"), "join-sets")
    posts = _posts(whole, percent)

    heads = posts.groupBy("h").agg(F.min(F.struct("own", "sig", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = posts.join(heads, "h").where((F.col("sig") != F.col("head.sig")) & _long_enough(F.col("n"), F.col("head.n"), percent))
    pairs = materialise(stars.select(F.least("sig", "head.sig").alias("a"), F.greatest("sig", "head.sig").alias("b")).distinct(), "join-pairs")
    links = materialise(verify(pairs, whole, percent), "join-links")
    found = components(links)

    found = _cross(posts.select("h", "sig", "n", "place"), whole, pairs, found, percent)

    roots = classes.join(found, F.col("sig") == F.col("node"), "left").select("sig", "rep", "copies", F.coalesce("root", "sig").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = roots.where("linked").groupBy("root").agg(F.min("rep").alias("component_id"))
    mapped = join_hot(roots.where("linked"), named, "root", F.col("sig")).select("sig", "component_id").unionByName(roots.where("not linked and copies > 1").select("sig", F.col("rep").alias("component_id")))
    mapped = materialise(mapped, "join-mapped")
    return texts.join(small(mapped), "sig", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "sig", F.coalesce("component_id", "doc_id").alias("component_id"))


def _candidates(joined: DataFrame, x: str, y: str, percent: int) -> DataFrame:
    """Of pairs with n, comp, place and sketch on both sides (names begin with x and y) those that may link, if this is the first n-gram of both that they share."""
    apart = sum((F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(SKETCH)), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place")) + 1  # they share no more
    may = joined.where((F.col(f"{x}.comp") != F.col(f"{y}.comp")) & _long_enough(n, m, percent) & (left * (100 + percent) >= (n + m) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent)))
    return may.select(F.least(f"{x}.sig", f"{y}.sig").alias("a"), F.greatest(f"{x}.sig", f"{y}.sig").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after further links (a, b): only their roots are gone through again."""
    ends = found.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    step = links.join(small(ends), "a", "left").join(small(ends.toDF("b", "rb")), "b", "left")
    roots = step.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(roots).withColumnRenamed("root", "to")
    old = found.join(small(merged.withColumnRenamed("node", "root")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = merged.select("node", F.col("to").alias("root")).join(small(found.select("node")), "node", "left_anti")
    return materialise(old.unionByName(new), "join-found")


def _cross(posts: DataFrame, whole: DataFrame, pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The components after the links between those that meet in posting lists, beyond the pairs already verified. posts: h, sig, n, place. whole: sig, n, sketch, parts."""
    sketches = whole.select("sig", "sketch").dropDuplicates(["sig"])
    while True:
        placed = posts.join(small(found.select(F.col("node").alias("sig"), "root")), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")
        mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
        open_ = materialise(placed.join(mixed, "h", "left_semi").distinct(), "join-open")
        sizes = materialise(open_.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("size")), "join-sizes")
        lists = sizes.groupBy("h").agg(F.sum("size").alias("all"), F.max("size").alias("most")).withColumn("deals", F.ceil(F.col("all") / max(1, TURN)).cast("int"))
        # the largest component of a list need not meet itself
        bound = F.least(F.lit(max(1, TURN)), F.greatest(F.lit(max(1, EASY)), F.lit(LIST_PAIRS) / F.col("all")))
        left = lists.agg(F.max(F.col("all") - F.col("most") - bound)).first()[0]  # members that no list has to wait with, if not above 0
        if left is None:
            return found
        order = Window.partitionBy("h").orderBy("size", "comp", "sig")  # limited in each task before the exchange
        turn = open_.join(sizes, ["h", "comp"]).withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= max(1, TURN))
        turn = turn.join(lists, "h").where((F.col("place_") <= bound) & (F.col("place_") <= F.col("all") - F.col("most")))
        turn = materialise(turn.select("h", "sig", "n", "place", "comp", "deals").join(sketches, "sig"), "join-turn")
        # a long list is dealt out, and those whose turn it is come to each of its deals
        dealt = open_.join(small(lists.where("deals > 1").select("h", "deals")), "h", "left").join(sketches, "sig").withColumn("deal", F.pmod(F.xxhash64("sig"), F.coalesce("deals", F.lit(1))).cast("int"))
        others = turn.select("h", F.struct("sig", "n", "place", "comp", "sketch").alias("y"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
        met = dealt.select("h", "deal", F.struct("sig", "n", "place", "comp", "sketch").alias("x")).join(others, ["h", "deal"])
        crossing = _candidates(met, "x", "y", percent)
        crossing = materialise(crossing.join(pairs, ["a", "b"], "left_anti"), "join-crossing")
        more = materialise(verify(crossing, whole, percent), "join-links")
        if not more.isEmpty():
            found = _joined(found, more)
        if left <= 0:
            return found
        # members that have met all others leave; a list of one component stays one
        posts = open_.drop("comp").join(turn.select("h", "sig"), ["h", "sig"], "left_anti")
        pairs = materialise(pairs.unionByName(crossing), "join-pairs")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, but of each component only the one with the smallest id (null last; of equal ids the first by place).

    Rows are told apart by their place, not by their id: rows that share an id, or have none, are judged by their own texts."""
    key = free(docs, "__key")[0]
    rows = row_keyed(docs, key)
    found = jaccard_components(rows, key, text_col, words, percent).select(F.col("doc_id").alias("__key"), "component_id")
    linked = found.where("component_id <> __key")
    members = materialise(linked.unionByName(linked.select(F.col("component_id").alias("__key"), "component_id").distinct()), "join-members")
    named = rows.select(F.col(key).alias("__key"), F.col(id_col).alias("id")).join(small(members), "__key")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__key")).alias("first")).select(F.col("first.__key").alias("__key"))
    gone = materialise(members.select("__key").join(stays, "__key", "left_anti"), "join-gone")
    return rows.join(small(gone.toDF(key)), key, "left_anti").select(*docs.columns)


def op5(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
