"""N-gram Jaccard join with parity sketches.

A document's set is its distinct five-word shingles as 64-bit hashes. XOR-ing one bit per shingle gives a
parity sketch; a shingle that only one of two documents has flips at most one bit, so the sketches'
Hamming distance H never exceeds the symmetric difference D, and a Jaccard similarity of 3/4 or more means
``D <= (a + b) / 7`` for set sizes a and b.

1. Candidates come from a prefix filter, the pigeonhole principle on single bits: the sketch that is joined is so wide (2^56 bits)
   that no two shingles of a document are expected to meet in a bit, so its odd bits are the document's hashed shingles and parity plays
   no part yet; it does in step 3. Two documents that link agree on all but D of them, and x has at most ``a - (a + b - D) / 2`` odd bits
   that y lacks: when both list their odd bits in one order, they share one that comes no later in x than
   that (pigeonhole), and likewise in y. The bound depends on both sizes: a bit at place i of a set of a joins it
   only with partners of at most ``reach = (4a - 7i) / 3`` shingles, which makes the size band of each bit exact.
   No bit behind the first quarter can join. Bits are ordered by the number of documents that hold their
   shingle, rare ones first. Any order is exact; this one makes few candidates.
2. Documents with the same set are one class, represented by its smallest doc_id. Representatives that
   share a bit meet in a group. In small groups pairs within reach are listed; in others each is paired with the
   first few members. Of these pairs everyone's smallest and most-sharing partners are compared, components are formed, and
   then only pairs across components that are within each other's reach are compared: all of them. Groups
   of widespread bits are salted and their leaders joined again, so no group is collected into one task, and pairs inside
   a component are not listed.
3. Candidates are filtered by the Hamming distance of whole sketches folded to one width and verified
   on the full sets.

Fixed segments of some bits each, one more than D, would be spoiled by shingles of either document, which doubles the
tolerance: documents that share a passage of 5/7 of their shingles then meet, though their similarity is 0.56.

Edge cases: null and empty texts have no shingles and link with nothing; fewer than five words are one
shingle; a null doc_id links with nothing and has a null component; rows that share a doc_id are one
document, linked through any of its texts; repeated rows and ties are one class; very long texts have long
sketches and nothing is cut; an empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_ids, materialize, sized_join, small_batches, trim
from .components import connected_components

SHINGLE = 5
#: Links: 100 * intersection >= 75 * union.
PERCENT = 75
#: Shingles whose numbers of documents order the parts, at most, and the least number; the choice affects cost only.
KNOWN, LEAST = 1_000_000, 3
#: Members of a group per salt.
SALTED = 20_000
#: Groups of up to so many members list their pairs; in others each is first paired with so many leaders.
SMALL, LEADERS = 16, 8
#: Entries buffered before they are sent, and shingles counted before their counts are.
BUFFER, COUNTED = 500_000, 1_500_000
#: Entries per task of the grouping step, about.
TASK_ENTRIES = 3_000_000

U = np.uint64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_POWER = U(0xE7037ED1A0B428DB)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in order: polynomials in random byte values, one array pass per step."""
    a = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[a]
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(starts):
        return np.empty(0, U)
    first = starts[0]
    a, inside, starts = a[first:], inside[first:], starts - first
    spans = np.diff(np.r_[starts, len(a)])
    powers = np.multiply.accumulate(np.full(int(spans.max()), _POWER, U))
    at = np.arange(len(a)) - np.repeat(starts, spans)
    return mix(np.add.reduceat(_BYTE[a] * powers[at] * inside, starts))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text."""
    h = word_hashes(text.lower())  # on bytes: A-Z only
    if not len(h):
        return h
    if len(h) < SHINGLE:
        out = np.full(1, len(h), U)
        for x in h:
            out = out * U(0xD1B54A32D192ED03) + x
        return mix(out)
    n = len(h) - SHINGLE + 1
    out = h[:n]
    for k in range(1, SHINGLE):
        out = out * U(0x9E3779B97F4A7C15) + h[k : n + k]
    return np.unique(mix(out))


def odd_bits(s: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The odd bits of set ``s`` that can join, in the common order: the level of how many hold them, then their place.

    ``known`` are sorted 48-bit heads of shingles, ``level`` ranks their numbers of documents. Bits that two shingles
    of the set share stay twice, as if the sketch were wider.
    """
    bits = s >> U(8)
    if len(known):
        head = s >> U(16)
        at = np.minimum(np.searchsorted(known, head), len(known) - 1)
        bits |= np.where(known[at] == head, level[at], U(0)) << U(56)
    bits.sort()
    return bits[: len(s) // 4 + 1]


def reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Largest size of a partner that the odd bit at ``place`` of a set of ``n`` can join.

    A partner of m with at least 3/7 (n + m) common shingles leaves n - 3/7 (n + m) others at most before the first common one.
    """
    return (4 * n - 7 * place) // 3


def level_of(n: np.ndarray) -> np.ndarray:
    """Ranks of numbers of documents, in steps of a quarter of an octave, up to 255."""
    return np.minimum(255, np.round(4 * np.log2(np.maximum(n, 1)))).astype(U)


def width_of(n: int) -> int:
    """Bits of the folded sketch of a set of ``n``."""
    return max(64, 4 ** ((n.bit_length() - 1) // 2 + 1))


def sketch(s: np.ndarray) -> bytes:
    """Folded parity sketch."""
    width = width_of(len(s))
    bits = np.bincount((s % U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two parity sketches, the wider one folded: bits that fall together are XOR-ed."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _signed(x) -> np.ndarray:
    return np.asarray(x, U).view(np.int64)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2) per row; d1 and d2 digest the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2 = [], [], []
            for text in _texts(b.column(1)):
                s = shingles(text)
                m = mix(s + U(0x632BE59BD9B4E019))
                n.append(len(s))
                d1.append(int(m.sum(dtype=U)) if len(s) else 0)
                d2.append(int(np.bitwise_xor.reduce(mix(m))) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(_signed(d1)), pa.array(_signed(d2))], ["doc_id", "n", "d1", "d2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long")
    return materialize(rows, "jaccard-measure")


def widespread(reps: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of documents of the shingles that most hold: sorted 48-bit heads and counts, at most KNOWN of them.

    All shingles of all representatives are counted: buffers are summed before they are sent as packed
    arrays, and a bucket is a range of values. Only values of LEAST documents or more are written.
    """
    buckets = 4 * tasks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for text in _texts(b.column(0)):
                held.append(shingles(text) >> U(16))
                size += len(held[-1])
                if size > COUNTED:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)
        del held
        trim()

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted((value * U(buckets)) >> U(48), np.arange(buckets + 1, dtype=U))
        rows = []
        for k in range(buckets):
            v, c = value[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]
            if len(v):
                more = np.flatnonzero(c > 1)
                rows.append((k, v.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), more.astype(np.int32).tobytes(), c[more].astype(np.int64).tobytes()))
        types = [pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["bucket", "heads", "places", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = [], []
        for b in batches:
            for heads, places, more in zip(*(_texts(c) for c in b.columns[1:]), strict=True):
                v = np.zeros((len(heads) // 6, 8), np.uint8)
                v[:, :6] = np.frombuffer(heads, np.uint8).reshape(-1, 6)
                n = np.ones(len(v), np.int64)
                n[np.frombuffer(places, np.int32)] = np.frombuffer(more, np.int64)
                values.append(v.view(U).ravel())
                counts.append(n)
        if not values:
            return
        value, n = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(value)
        value, n = value[order], n[order]
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        value, n = value[starts], np.add.reduceat(n, starts)
        at = n >= LEAST
        yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), pa.array(n[at])], ["head", "n"])

    sent = reps.select("text").mapInArrow(send, "bucket int, heads binary, places binary, counts binary")
    counted = materialize(sent.repartition(tasks, "bucket").mapInArrow(total, "head long, n long"), "jaccard-counts")
    least, room = LEAST, KNOWN
    for r in counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("values")).orderBy(F.desc("n")).collect():
        room -= r["values"]
        if room < 0:
            least = r["n"] + 1
            break
    top = counted.where(F.col("n") >= least).toArrow()
    value, n = top["head"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def pairs_of(key: np.ndarray, salt: np.ndarray, doc: np.ndarray, n: np.ndarray, far: np.ndarray):
    """Pairs within groups and members of groups that go on.

    Takes entries (bit, salt, doc_id, size, reach); gives pairs as rows (a, b, na, nb) with a < b, their numbers of shared
    bits, the indexes of members of groups that go on (large or salted ones), and which of these lead a salted one; all
    refer to the entries as sorted, which come first.
    """
    order = np.lexsort((doc, salt, key))
    key, salt, doc, n, far = key[order], salt[order], doc[order], n[order], far[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
    starts = np.flatnonzero(new)
    held = np.diff(np.r_[starts, len(key)])
    start, size = np.repeat(starts, held), np.repeat(held, held)
    place = np.arange(len(key)) - start
    fits = lambda i, j: (n[j] <= far[i]) & (n[i] <= far[j]) & (doc[i] != doc[j])
    found = []
    for k in range(1, SMALL):
        i = np.flatnonzero((size <= SMALL) & (place + k < size))
        if not len(i):
            break
        found.append((i, i + k))
    large = np.flatnonzero(size > SMALL)
    for k in range(LEADERS) if len(large) else ():
        later = large[place[large] > k]
        found.append((start[later] + k, later))
    found = [(i[ok], j[ok]) for i, j in found for ok in (fits(i, j),)]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    pairs, shared = np.unique(np.stack([doc[i], doc[j], n[i], n[j]]).astype(np.int64), axis=1, return_counts=True)
    lives = np.repeat(np.logical_or.reduceat(far >= n, starts), held) if len(starts) else np.empty(0, bool)
    on = np.flatnonzero((salt > 0) | (size > SMALL) & lives)
    return (key, doc, n, far), pairs, shared, on, (salt[on] > 0) & (place[on] == 0)


def _meet(reps: DataFrame, counts: tuple[np.ndarray, np.ndarray], tasks: int) -> DataFrame:
    """Pairs of representatives that share an odd bit, and members of groups that are large or salted.

    Rows: (a, b, na, nb, shared) for pairs; (key, a, na, far) with null b for members of groups, ``leads`` for the first
    of a salted one. Entries are sent to ``bucket``s as packed arrays, which shuffles bytes instead of rows.
    """
    context = reps.sparkSession.sparkContext
    known, n = counts
    shared = context.broadcast((known, level_of(n)))
    salts, salted_level = (-(-int(n.max()) // SALTED) if len(n) else 1), level_of(np.array([SALTED]))[0]
    buckets = 4 * tasks

    def pack(keys, docs, sizes) -> Iterator[pa.RecordBatch]:
        lengths = [len(k) for k in keys]
        key, at, place = np.concatenate(keys), np.repeat(np.arange(len(docs)), lengths), np.concatenate([np.arange(k) for k in lengths])
        ids, n = np.array(docs, np.int64)[at], np.array(sizes, np.int64)[at]
        salt = np.where((salts > 1) & (key >> U(56) >= salted_level), 1 + ids % salts, 0).astype(np.uint32)
        bucket = (mix(key + salt.astype(U) * U(0x9E3779B97F4A7C15)) >> U(33)) % U(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
        rows = []
        for k in range(buckets):
            o = order[edges[k] : edges[k + 1]]
            if len(o):
                rows.append((k, key[o].tobytes(), salt[o].tobytes() if salt[o].any() else b"", ids[o].tobytes(), n[o].astype(np.int32).tobytes(), reach(n[o], place[o]).astype(np.int32).tobytes()))
        types = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["bucket", "keys", "salts", "docs", "sizes", "fars"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = shared.value
        keys, docs, sizes, size = [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                s = shingles(text)
                if len(s):
                    keys.append(odd_bits(s, known, level))
                    docs.append(doc)
                    sizes.append(len(s))
                    size += len(keys[-1])
                if size > BUFFER:
                    yield from pack(keys, docs, sizes)
                    keys, docs, sizes, size = [], [], [], 0
        if keys:
            yield from pack(keys, docs, sizes)
        del keys
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for b in batches:
            for k, s, *rest in zip(*(_texts(c) for c in b.columns[1:]), strict=True):
                got[0].append(np.frombuffer(k, U))
                got[1].append(np.frombuffer(s, np.uint32) if s else np.zeros(len(got[0][-1]), np.uint32))
                for x, data, kind in zip(got[2:], rest, (np.int64, np.int32, np.int32), strict=True):
                    x.append(np.frombuffer(data, kind))
        if not got[0]:
            return
        (key, doc, n, far), pairs, shared_bits, on, leads = pairs_of(*map(np.concatenate, got))
        nulls = lambda size: pa.nulls(size, pa.int64())
        for k in range(0, pairs.shape[1], 50_000):
            p = pairs[:, k : k + 50_000]
            size = p.shape[1]
            yield pa.RecordBatch.from_arrays([nulls(size), *(pa.array(x) for x in p), nulls(size), pa.nulls(size, pa.bool_()), pa.array(shared_bits[k : k + 50_000])], out)
        for k in range(0, len(on), 50_000):
            w = on[k : k + 50_000]
            longs = [pa.array(x[w].astype(np.int64)) for x in (doc, n, far)]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key[w])), longs[0], nulls(len(w)), longs[1], nulls(len(w)), longs[2], pa.array(leads[k : k + 50_000]), nulls(len(w))], out)
        del key, doc, n, far, pairs, on, got
        trim()

    out = ["key", "a", "b", "na", "nb", "far", "leads", "shared"]
    sent = reps.select("doc_id", "text").mapInArrow(send, "bucket int, keys binary, salts binary, docs binary, sizes binary, fars binary")
    return materialize(sent.repartition(tasks, "bucket").mapInArrow(meet, "key long, a long, b long, na long, nb long, far long, leads boolean, shared long"), "jaccard-groups")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, sketch, members) of the documents in ``ids`` (doc_id; distinct, materialised)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "sketch", "members"])

    chosen = sized_join(docs, ids, "doc_id", "left_semi")
    return materialize(chosen.select("doc_id", "text").mapInArrow(run, "doc_id long, sketch binary, members binary"), "jaccard-sets")


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link: sketches first, then the full sets."""
    sets = _sets(docs, materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ids"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [hamming(x, y) <= (p + q) // 7 for x, y, p, q in zip(_texts(b.column(4)), _texts(b.column(5)), na, nb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(_texts(b.column(2)), _texts(b.column(3)), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= PERCENT * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    def attached(df: DataFrame, column: str) -> DataFrame:
        for end in ("a", "b"):
            df = df.join(sets.select(F.col("doc_id").alias(end), F.col(column).alias(f"{column}_{end}")), end)
        return df

    close = attached(pairs.select("a", "b", "na", "nb"), "sketch").select("a", "b", "na", "nb", "sketch_a", "sketch_b").mapInArrow(near, "a long, b long")
    close = materialize(close, "jaccard-close")
    linked = attached(close, "members").select("a", "b", "members_a", "members_b").mapInArrow(exact, "a long, b long")
    return materialize(linked.distinct(), "jaccard-links")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b."""
    turned = F.col("a") > F.col("b")
    return pairs.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()


def _first_pairs(listed: DataFrame, members: DataFrame) -> DataFrame:
    """Of the listed pairs everyone's partners with the smallest doc_id and with most shared bits, and pairs of salts' leaders."""
    both = listed.union(listed.select("b", "a", "nb", "na", "shared"))
    best = both.groupBy("a", "na").agg(F.min(F.struct("b", "nb")).alias("x"), F.max(F.struct("shared", (-F.col("b")).alias("last"), "b", "nb")).alias("y"))
    stars = best.select("a", "na", F.explode(F.array(F.struct("x.b", "x.nb"), F.struct("y.b", "y.nb"))).alias("p")).select("a", "p.b", "na", "p.nb")
    leaders = members.where("leads").select("key", "a", "na", "far")
    chief = leaders.groupBy("key").agg(F.min(F.struct("a", "na", "far")).alias("c")).select("key", F.col("c.a").alias("b"), F.col("c.na").alias("nb"), F.col("c.far").alias("far_b"))
    chiefs = leaders.join(chief, "key").where("nb <= far and na <= far_b").select("a", "b", "na", "nb")
    return _ordered(stars.union(chiefs))


def _across(listed: DataFrame, members: DataFrame, component: DataFrame, done: DataFrame) -> DataFrame:
    """All pairs within each other's reach that share a bit, lie in different components and were not compared yet.

    In a group that goes on, the component with most members is its home. Of two members one is no larger than the
    other and has a reach of at least its own size; it is ``short``. Either it or its partner is not at home.
    """
    ends = lambda df, x: sized_join(df, component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    found = ends(ends(listed, "a"), "b").where("ca <> cb").select("a", "b", "na", "nb")
    m = materialize(ends(members, "a").select("key", "a", "na", "far", F.col("ca").alias("c"), (F.col("far") >= F.col("na")).alias("short")), "jaccard-labelled")
    if not m.isEmpty():
        per = m.groupBy("key", "c").agg(F.count("*").alias("n"), F.max("short").alias("short"))
        home = per.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("home"), F.count("*").alias("of"), F.max("short").alias("lives")).where("of > 1 and lives").select("key", "home")
        m = materialize(m.join(home, "key").withColumn("away", F.col("c") != F.col("home")).drop("home"), "jaccard-open")
        all_ = m.select("key", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("far").alias("far_b"), F.col("c").alias("d"), F.col("away").alias("away_b"))
        fits = "c <> d and na <= nb and nb <= far and na <= far_b"
        one = m.where("short and away").join(all_, "key").where(fits)
        two = m.where("short and not away").join(all_.where("away_b"), "key").where(fits)
        found = found.union(one.select("a", "b", "na", "nb")).union(two.select("a", "b", "na", "nb"))
    return materialize(_ordered(found).join(done.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-across")


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = measure(docs)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = materialize(classes, "jaccard-classes")
    copies = rows.join(classes.where("rows > 1").select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).where("doc_id <> rep").select("doc_id")
    copies = materialize(copies.distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "jaccard-copies")
    reps = drop_ids(docs.where("doc_id is not null"), copies)
    entries = (classes.agg(F.sum(F.expr("n div 4 + 1"))).first()[0]) or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries // TASK_ENTRIES) + 1)
    counts = widespread(reps, tasks)
    met = _meet(reps, counts, tasks)
    members = met.where("b is null").select("key", "a", "na", "far", "leads")
    listed = met.where("b is not null").groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.sum("shared").alias("shared"))
    listed = materialize(listed.select("a", "b", "na", "nb", "shared"), "jaccard-listed")
    pairs = materialize(_first_pairs(listed, members), "jaccard-pairs")
    links = _verify(pairs, reps)
    found = materialize(connected_components(links), "jaccard-components")
    across = _across(listed.drop("shared"), members, found, pairs)
    if not across.isEmpty():
        more = _verify(across, reps)
        if not more.isEmpty():
            found = materialize(connected_components(links.union(more)), "jaccard-components")
    moved = classes.join(found.where("node <> component"), classes["rep"] == F.col("node"), "left")
    moved = moved.where("rows > 1 or component is not null").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    moved = materialize(moved, "jaccard-moved")
    discard(met, listed, pairs, links, across, found, classes, copies)
    out = sized_join(rows, moved, ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id."""
    gone = materialize(components(docs).where("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    return drop_ids(docs, gone)
