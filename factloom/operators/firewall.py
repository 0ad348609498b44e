"""Near-duplicate firewall: postings with BM25, token-set similarity, and first-wins resolution.

Candidates are the best ``k`` by BM25 over significant tokens; parts of the asking facts read the held ones from the shared
folder and sum up in memory. Resolution is iterative: shortlists among the kept facts are taken anew until no outcome
changes, which equals the sequential order.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyspark.sql.types import DoubleType

from factloom.functions import text as T

if TYPE_CHECKING:
    from factloom.operators.text_index import TextIndex

K1, B = 1.2, 0.75
#: Rows of keys or tokens that are sent to every task; beyond they are shuffled.
SENT = 100_000
#: The same for rows of a single number.
SENT_NUMS = 1_000_000


def tokens(text: str) -> Column:
    """Tokens of a column in their order; diacritics stay as tokens of the rest of the word."""
    return F.regexp_extract_all(T.fold(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def postings(facts: DataFrame, key: str = "pulse_id", text: str = "fact_text") -> DataFrame:
    """(key, token, tf, dl): occurrences of every token."""
    each = facts.select(key, tokens(text).alias("ts"))
    each = each.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    return each.groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))


def own_postings(sized: DataFrame) -> DataFrame:
    """(key, token, tf, dl) of rows (key, ts) whose keys are unique: sorted tokens are counted in their row, nothing is shuffled."""
    each = sized.select("key", F.size("ts").alias("dl"), F.array_sort("ts").alias("ts"))
    # Where a run of equal tokens begins; the next one's begin tells how long it is.
    begins = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1)))
    each = each.select("key", "dl", "ts", begins.alias("at"))
    runs = F.transform("at", lambda i, j: F.struct(F.get("ts", i).alias("token"), (F.coalesce(F.get("at", j + 1), F.col("dl")) - i).cast("long").alias("tf")))
    return each.select("key", "dl", F.explode(runs).alias("x")).select("key", "x.token", "x.tf", "dl")


def bm25_weights(index: DataFrame, key: str = "pulse_id", size: tuple[int, int] | None = None) -> DataFrame:
    """(key, token, w): what a token adds to its fact's score. ``size`` tells facts and tokens in all where ``index`` holds some tokens alone."""
    docs = index.select(key, "dl").distinct()
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    if size is not None:
        stats = index.sparkSession.range(1).select(F.lit(size[0]).alias("n"), F.lit(size[1] / max(1, size[0])).alias("avgdl"))
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.join(df, "token").crossJoin(F.broadcast(stats)).select(  # one row of statistics
        key, "token",
        (F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("w"),
    )


def bm25_topk(index: DataFrame, probes: DataFrame, k: int = 20, key: str = "pulse_id", probe: str = "probe_id", text: str = "probe_text") -> DataFrame:
    """(probe, key, score, rank): the best ``k`` facts per probe over its first 12 significant tokens; lower scores are better."""
    asked = probes.select(probe, F.explode(T.query_tokens(F.col(text))).alias("token"))
    scored = asked.join(bm25_weights(index, key), "token").groupBy(probe, key).agg((-F.sum("w")).alias("score"))
    best = W.partitionBy(probe).orderBy(F.round("score", 9), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _indel(a: str, b: str) -> float:
    """100 times the normalised insertion-deletion similarity."""
    if not a and not b:
        return 100.0
    head = len(os.path.commonprefix((a, b)))
    x, y = a[head:], b[head:]
    if len(x) < len(y):
        x, y = y, x
    # Bit-parallel longest common subsequence: a bit per character of y, cleared where a row of the table steps up.
    at: dict[str, int] = {}
    for j, c in enumerate(y):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for c in x:
        if hit := row & at.get(c, 0):
            row = (row + hit | row - hit) & full
    return 100.0 * 2 * (head + len(y) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts by their token sets, 0 to 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = _indel(with_a, with_b)
    if both:
        part = lambda whole: 100.0 * 2 * len(both) / (len(both) + len(whole))
        best = max(best, part(with_a), part(with_b))
    return best


#: Cells of a table of character positions, and 64-bit words of a text beyond which pairs are compared one by one.
CELLS, WORDS = 500_000, 8


def _common(xs: list[str], ys: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, ys the shorter ones: the rows of ``_indel`` for many pairs at once."""
    out, nx, ny = np.zeros(len(xs), np.int64), np.array([*map(len, xs)], np.int64), np.array([*map(len, ys)], np.int64)
    order, at = np.lexsort((nx, -(-ny // 64))), 0
    while at < len(order):
        words = max(1, -(-int(ny[order[at]]) // 64))
        if words > WORDS:
            out[order[at]] = _indel(xs[order[at]], ys[order[at]]) * (nx[order[at]] + ny[order[at]]) / 200 + 0.5
            at += 1
            continue
        take = order[at : at + max(1, CELLS // (64 * words))]
        take = take[ny[take] <= 64 * words]
        at, m = at + len(take), len(take)
        points = lambda texts, n: np.array([texts[i] for i in take], f"<U{max(1, int(n[take].max()))}").view(np.uint32).reshape(m, -1)
        x, y = points(xs, nx), points(ys, ny)
        codes = np.zeros(max(int(x.max()), int(y.max())) + 1, np.int64)
        codes[x], codes[y] = 1, 1
        codes = np.cumsum(codes)
        # Columns of one pair each; what pads a text has the code 0.
        x, y = (np.where(np.arange(z.shape[1]) < n[take, None], codes[z], 0).T * m + np.arange(m) for z, n in ((x, nx), (y, ny)))
        places = np.zeros((words, (int(codes[-1]) + 1) * m), np.uint64)
        for j in range(y.shape[0]):
            places[j // 64][y[j]] |= np.uint64(1 << j % 64)
        places[:, :m] = 0
        rows = [np.full(m, 2**64 - 1, np.uint64) for _ in range(words)]
        for c in x:
            carry = None
            for n, row in enumerate(rows):
                hit = row & places[n][c]
                up = row + hit
                if words > 1:
                    over = up < row
                    if carry is not None:
                        up += carry
                        over |= up < carry
                    carry = over.astype(np.uint64)
                rows[n] = up | (row - hit)
        for n, row in enumerate(rows):
            bits = np.clip(ny[take] - 64 * n, 0, 64)
            low = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
            out[take] += bits - np.bitwise_count(row & low)
    return out


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set_ratio`` of pairs of texts."""
    out, sets = np.zeros(len(a)), {}
    at, xs, ys, both, whole_a, whole_b = [], [], [], [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        if (x := sets.get(s)) is None:
            x = sets[s] = set(s.split())
        if (y := sets.get(t)) is None:
            y = sets[t] = set(t.split())
        if not x or not y:
            continue
        same = x & y
        if same and (len(same) == len(x) or len(same) == len(y)):
            out[i] = 100.0
            continue
        only_a, only_b = " ".join(sorted(x - same)), " ".join(sorted(y - same))
        n = sum(map(len, same)) + len(same) - 1 if same else 0
        at.append(i)
        both.append(n)
        whole_a.append(len(only_a) + (n + 1 if same else 0))
        whole_b.append(len(only_b) + (n + 1 if same else 0))
        if len(only_a) < len(only_b):
            only_a, only_b = only_b, only_a
        xs.append(only_a)
        ys.append(only_b)
    n, p, q = np.array(both, np.int64), np.array(whole_a, np.int64), np.array(whole_b, np.int64)
    shorter = np.array([*map(len, ys)], np.int64)
    head = np.minimum(p, q) - shorter  # what both have, and a space
    out[at] = np.maximum(100.0 * 2 * (head + _common(xs, ys)) / (p + q), np.maximum(100.0 * 2 * n / (n + p), 100.0 * 2 * n / (n + q)))
    return out


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) / 100.0 if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)


def tier(value: Column) -> Column:
    return F.when(value >= 0.85, "same_wording").when(value >= 0.58, "same_claim").when(value >= 0.35, "related_concept").otherwise("distinct")


def decisions(facts: DataFrame, k: int = 20) -> DataFrame:
    """Best tier of each fact (pulse_id, source_id, fact_text, fingerprint) against other sources' facts."""
    base = facts.select("pulse_id", "source_id", "fact_text", "fingerprint")
    other = base.groupBy("fingerprint").agg(F.countDistinct("source_id").alias("sources"))
    pairs = edges(base, k)
    best = pairs.groupBy("pulse_id").agg(F.max("similarity").alias("similarity"))
    out = base.join(other, "fingerprint").join(best, "pulse_id", "left")
    value = F.coalesce("similarity", F.lit(0.0))
    return out.select("pulse_id", F.when(F.col("sources") > 1, "duplicate").otherwise(tier(value)).alias("tier"), value.alias("similarity"))


def numbered(facts: DataFrame) -> DataFrame:
    """``facts`` with num, in the order of pos or else pulse_id, asks: whether they are not settled, and anchors as one key; written. Only facts of one source may share a pos."""
    asks = ~F.coalesce("settled", F.lit(False)) if "settled" in facts.columns else F.lit(True)
    found = T.anchors(F.col("fact_text"))
    key = F.concat_ws(",", F.concat_ws(",", found["numbers"]), F.when(found["negated"], "not").otherwise("-"), F.concat_ws(",", found["directions"]))
    ordered = facts.orderBy("pos" if "pos" in facts.columns else "pulse_id")
    return _written(ordered.select(F.monotonically_increasing_id().alias("num"), *facts.columns, asks.alias("asks"), key.alias("anchors")))


#: Facts whose postings a task holds at a time, facts that ask it at least and about the most, and into how many parts asking facts are dealt before they exceed the least.
HELD, ASKING, ASKED, PARTS = 1_500_000, 4_000, 50_000, 24
#: Held facts that are read at a time, and pairs that are compared at a time.
READ, PAIRS = 200_000, 50_000
#: Postings of an asking fact's rarest tokens that are summed at once, and cells of tables that tell for the commonest tokens what they add to every held fact.
SUMMED, DENSE = 12_000, 60_000_000


def _rows(files: list[str], most: int, columns: list[str]) -> Iterator[pa.Table]:
    """The rows of Parquet files of the shared folder, up to ``most`` at a time."""
    read, n = [], 0
    for uri in files:
        store, path = pafs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=min(most, 50_000), columns=columns):
                if n and n + batch.num_rows > most:
                    yield pa.Table.from_batches(read)
                    read, n = [], 0
                read.append(batch)
                n += batch.num_rows
    if n:
        yield pa.Table.from_batches(read)


def _blocks(files: list[str], most: int, words: pa.Array, mean: float) -> Iterator[tuple]:
    """Postings of ``words`` in the facts of ``files``, up to ``most`` facts at a time: (b, sb as a dictionary, at, doc, kind, gain).

    Postings ``at[t]`` to ``at[t + 1]`` are those of word t, by fact doc, which is a place in b; it adds the word's idf times ``gain[kind]``.
    """

    def block(parts: list[tuple]) -> tuple:
        bs, sources, counts, docs, tfs, dls = zip(*parts, strict=True)
        at = np.concatenate(([0], np.cumsum(sum(c.astype(np.int64) for c in counts))))
        shapes = np.unique(np.concatenate([np.unique(tf << 32 | dl) for tf, dl in zip(tfs, dls, strict=True)]))
        tf, dl = shapes >> 32, shapes & (2**32 - 1)
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        doc, kind = np.empty(at[-1], np.int32), np.empty(at[-1], np.uint32 if len(shapes) >= 2**16 else np.uint16)
        begin, before = at[:-1].copy(), 0
        for b, count, its, tf, dl in zip(bs, counts, docs, tfs, dls, strict=True):
            to = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(its))
            doc[to], kind[to] = its + np.int32(before), np.searchsorted(shapes, tf << 32 | dl)
            begin += count
            before += len(b)
        return np.concatenate(bs), pa.chunked_array(sources, pa.string()).combine_chunks().dictionary_encode(), at, doc, kind, gain

    parts, n = [], 0
    for held in _rows(files, min(most, READ), ["b", "sb", "dl", "ts"]):
        if n and n + held.num_rows > most:
            yield block(parts)
            parts, n = [], 0
        ts = held.column("ts").combine_chunks()
        told = pc.index_in(ts.flatten(), value_set=words)
        known = pc.is_valid(told).to_numpy(zero_copy_only=False)
        where = np.repeat(np.arange(held.num_rows), pc.list_value_length(ts).to_numpy())[known]
        posting, tf = np.unique(told.drop_null().to_numpy().astype(np.int64) * held.num_rows + where, return_counts=True)
        token, doc = posting // held.num_rows, (posting % held.num_rows).astype(np.int32)
        parts.append((held.column("b").to_numpy(), held.column("sb").combine_chunks(), np.bincount(token, minlength=len(words)).astype(np.int32), doc, tf.astype(np.int64), held.column("dl").to_numpy()[doc].astype(np.int64)))
        n += held.num_rows
    if n:
        yield block(parts)


def _alike(pairs: np.ndarray, bs: np.ndarray, texts: list[str], anchors: pa.ChunkedArray, files: list[str]) -> np.ndarray:
    """How similar the ``pairs``-th asking fact and the held fact bs are, NaN where anchors conflict; held texts are read some at a time."""
    sims, order = np.full(len(bs), np.nan), np.argsort(bs, kind="stable")
    sorted_bs = bs[order]
    for held in _rows(files, READ, ["b", "text", "anchors"]):
        b = held.column("b").to_numpy()
        mine = order[np.searchsorted(sorted_bs, b[0]) : np.searchsorted(sorted_bs, b[-1], "right")]
        spot = np.searchsorted(b, bs[mine])
        keys = pa.chunked_array([*anchors.chunks, *held.column("anchors").chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
        close = keys[pairs[mine]] == keys[len(anchors) + spot]
        mine, spot = mine[close], spot[close]
        by_text = np.argsort(pairs[mine], kind="stable")
        mine, spot = mine[by_text], spot[by_text]
        other = held.column("text").combine_chunks()
        for n in range(0, len(mine), PAIRS):
            some = mine[n : n + PAIRS]
            told, place, x, y = {}, [], [], []  # equal pairs of texts are compared once
            for i, t in zip(pairs[some].tolist(), other.take(pa.array(spot[n : n + PAIRS])).to_pylist(), strict=True):
                key = (texts[i], t)
                if (p := told.get(key)) is None:
                    p = told[key] = len(x)
                    x.append(key[0])
                    y.append(t)
                place.append(p)
            sims[some] = (token_set_ratios(x, y) / 100.0)[place]
    return sims


def _best(k: int, ordered: bool, mean: float, files: list[str], weights: list[str], most_held: int, compare: bool) -> Callable[[pa.Table], pa.Table]:
    """The best ``k`` of the facts in ``files``, which are sorted by b, for each of one part of the asking facts, by sums over postings in memory, and how similar they are.

    Tokens of a fact come from the heaviest to the lightest. When ``k`` facts score more, in full, than all tokens that are left can add, no
    further fact can be among the best: what is left is looked up for those that still can. An asking fact with the text of
    the one before begins with that one's best and asks only facts that come after, unless their sources leave out different facts.
    """

    def run(asked: pa.Table) -> pa.Table:
        flat = lambda table, name: table.column(name).combine_chunks().flatten()
        lengths = lambda table, name: pc.list_value_length(table.column(name)).to_numpy().astype(np.int64)
        named = lambda x, y: pa.chunked_array([*x.chunks, *y.chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
        asked = asked.sort_by([("text", "ascending"), ("a", "ascending")])
        a, texts, sources = asked.column("a").to_numpy(), asked.column("text").to_pylist(), asked.column("sa").to_pylist()
        again = [i > 0 and texts[i] == texts[i - 1] for i in range(len(a))]
        words = flat(asked, "tokens").dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        idf = np.zeros(len(words.dictionary))
        for listed in _rows(weights, most_held, ["token", "idf"]):
            spot = pc.index_in(words.dictionary, value_set=listed.column("token").combine_chunks())
            there = pc.is_valid(spot).to_numpy(zero_copy_only=False)
            idf[there] = listed.column("idf").to_numpy()[spot.drop_null().to_numpy()]
        starts = np.concatenate(([0], np.cumsum(lengths(asked, "tokens"))))
        found = [(np.zeros(0), np.zeros(0, np.int64))] * len(a)
        met: set[str] = set()
        for held in _blocks(files, most_held, words.dictionary, mean):
            b, sb, at, doc, kind, gain = held
            n = len(b)
            sb, names = sb.indices.to_numpy(), sb.dictionary.to_pylist()
            numbers, begun = {x: j for j, x in enumerate(names)}, np.unique(sb, return_index=True)[1].tolist()
            sa = [numbers.get(x, -1) for x in sources]
            # Where each source begins, in this block or before it.
            begin = [-1 if x in met else begun[numbers[x]] if x in numbers else n for x in sources]
            until = np.searchsorted(b, a) if ordered else np.full(len(a), n)
            # Facts of its own source that come right before a fact count for nothing.
            run = np.flatnonzero(np.concatenate(([True], sb[1:] != sb[:-1])))
            last = np.maximum(until - 1, 0)
            until = np.where((until > 0) & (sb[last] == sa), run[np.searchsorted(run, last, "right") - 1], until).astype(np.int32)
            sizes = np.diff(at)
            most = np.zeros(len(idf))
            full = np.flatnonzero(sizes)
            if len(full):
                most[full] = np.maximum.reduceat(gain[kind], at[full])
            # The commonest tokens by fact: 0 where a fact lacks the token.
            dense, gains = {}, np.concatenate(([0.0], gain))
            for t in np.argsort(-sizes)[: DENSE // n].tolist():
                if sizes[t] * 100 < n:
                    break
                dense[t] = np.zeros(n, np.uint32 if len(gain) >= 2**16 - 1 else np.uint16)
                dense[t][doc[at[t] : at[t + 1]]] = kind[at[t] : at[t + 1]].astype(np.int64) + 1

            def sums_of(can: np.ndarray, sums: np.ndarray, lists: list[tuple], rest: list[float], least: float | None, doc=doc, kind=kind, gain=gain, dense=dense, gains=gains) -> tuple[np.ndarray, np.ndarray]:
                """Adds what ``lists`` hold of ``can``; facts that can no longer reach ``least`` are left out."""
                for (_, t, lo, hi), left in zip(lists, rest, strict=True):
                    if t in dense:
                        sums = sums + idf[t] * gains[dense[t][can]]
                    elif hi > lo:
                        d = doc[lo:hi]
                        spot = d.searchsorted(can)
                        np.minimum(spot, hi - lo - 1, out=spot)
                        sums = sums + np.where(d[spot] == can, idf[t] * gain[kind[lo + spot]], 0.0)
                    if least is not None and len(can) > 64:
                        stay = sums + left >= least - 1e-6
                        can, sums = can[stay], sums[stay]
                return can, sums

            for i in range(len(a)):
                low, base = np.int32(0), found[i]
                if again[i] and until[i - 1] and (sa[i] == sa[i - 1] and sources[i] == sources[i - 1] or min(begin[i], begin[i - 1]) >= until[i - 1]):
                    low, base = until[i - 1], found[i - 1]
                high = until[i]
                if low >= high:
                    found[i] = base
                    continue
                scores, bs = base
                floor = -scores[-1] if len(bs) == k else None  # what the facts before ask of these
                mine = code[starts[i] : starts[i + 1]]
                # Postings by what they can add at most: (less than that, token, begin, end).
                ends = zip(mine.tolist(), at[mine].tolist(), at[mine + 1].tolist(), (-idf[mine] * most[mine]).tolist(), strict=True)
                lists = sorted((bound, t, lo, hi) for t, lo, hi, bound in ends if hi > lo)
                if low or high < n:
                    for x, (bound, t, lo, hi) in enumerate(lists):
                        d = doc[lo:hi]
                        lists[x] = bound, t, lo + int(d.searchsorted(low)) if low else lo, lo + int(d.searchsorted(high))
                # What is left to be added, and the postings that are left, after some lists.
                rest, left = [0.0], [0]
                for bound, _, lo, hi in reversed(lists):
                    rest.append(rest[-1] - bound)
                    left.append(left[-1] + hi - lo)
                rest.reverse()
                left.reverse()
                can, sums, least, j = np.zeros(0, np.int32), np.zeros(0), floor, 0
                own = begin[i] < high
                while j < len(lists) and not (least is not None and least > rest[j] + 1e-6):
                    # Lists up to those that can be left out, as far as is known, but at first a few postings, then a few times as many.
                    first, more = j, SUMMED + 3 * (left[0] - left[j])
                    j += 1
                    while j < len(lists) and left[first] - left[j + 1] <= more and not (least is not None and least > rest[j] + 1e-6):
                        j += 1
                    if left[first] == left[j]:
                        continue
                    d = np.concatenate([can, *(doc[lo:hi] for _, _, lo, hi in lists[first:j])])
                    w = np.concatenate([sums, *(idf[t] * gain[kind[lo:hi]] for _, t, lo, hi in lists[first:j])])
                    if own:
                        stay = sb[d] != sa[i]
                        d, w = d[stay], w[stay]
                    if not len(d):
                        continue
                    place = np.sort(d.astype(np.int64) << 32 | np.arange(len(d)))
                    d, w = (place >> 32).astype(np.int32), w[place & (2**32 - 1)]
                    heads = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                    can, sums = d[heads], np.add.reduceat(w, heads)
                    if len(can) >= k and j < len(lists):
                        # The full scores of those that are ahead tell what the best must reach.
                        some = min(len(can), 5 * k)
                        ahead = np.argpartition(sums, len(can) - some)[len(can) - some :]
                        ahead = sums_of(can[ahead], sums[ahead], lists[j:], rest[j + 1 :], None)[1]
                        reached = np.partition(ahead, some - k)[some - k]
                        least = reached if least is None else max(least, reached)
                    if least is not None:
                        stay = sums + rest[j] >= least - 1e-6
                        can, sums = can[stay], sums[stay]
                can, sums = sums_of(can, sums, lists[j:], rest[j + 1 :], least)
                if not len(can):
                    found[i] = base
                    continue
                score = -np.round(sums, 9)
                if len(can) > k:
                    near = score <= np.partition(score, k - 1)[k - 1]
                    can, score = can[near], score[near]
                ids = np.concatenate((bs, b[can]))
                score = np.concatenate((scores, score))
                first = np.lexsort((ids, score))[:k]
                found[i] = score[first], ids[first]
            met.update(names)
            del held, doc, kind, dense, sums_of
        many = np.array([len(x[1]) for x in found], np.int64)
        bs = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        sims = _alike(np.repeat(np.arange(len(a)), many), bs, texts, asked.column("anchors"), files) if compare else np.full(len(bs), np.nan)
        listed = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), values)
        return pa.table({"a": pa.array(a), "bs": listed(pa.array(bs)), "sims": listed(pa.array(sims, mask=np.isnan(sims)))})

    return run


def ranked(facts: DataFrame, k: int, stored: TextIndex | None = None, compare: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(a, bs, sims) by num of ``numbered`` facts, written: the best ``k`` facts of other sources per asking fact a, from the best on; where they have pos, earlier ones only, and ties go by it.

    sims tells how similar each is, null where anchors conflict (or if not to be compared). Pairs that share a token grow with the square of
    a token's facts, so none is written, and no fact is sent to many tasks: held facts are written once, and each part of the asking ones reads them
    from the shared folder and sums up in memory. Of equal texts of a source the first ``k`` can be among the best, as equal scores go by num.
    Postings of settled facts come from the index ``stored``, those of asked tokens alone, if it is given. Of asking facts, those in ``only`` (num) if given.
    """
    ordered = "pos" in facts.columns
    sourced = facts.where("source_id IS NOT NULL")
    probes = sourced.where("asks") if only is None else sourced.where("asks").join(only, "num", "left_semi")
    asked = probes.select(F.col("num").alias("a"), F.col("source_id").alias("sa"), F.col("fact_text").alias("text"), "anchors", T.query_tokens(F.col("fact_text")).alias("tokens")).where("size(tokens) > 0")
    own = facts.select("num", "asks", tokens("fact_text").alias("ts"))
    one = own if stored is None else own.where("asks")
    sizes = one.where("size(ts) > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("ts")), F.lit(0)).alias("tokens")).first()
    n, total = sizes.n, sizes.tokens
    df = one.select(F.explode(F.array_distinct("ts")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    first = W.partitionBy("fact_text", "source_id").orderBy("num")
    kept = sourced.select("num", "source_id", "fact_text", "anchors").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    kept = kept.select(F.col("num").alias("b"), F.col("source_id").alias("sb"), F.col("fact_text").alias("text"), "anchors")
    old = None
    if stored is None:
        held = kept.withColumn("ts", tokens("text")).withColumn("dl", F.size("ts"))
    else:
        before, listed = stored.size()
        n, total = before + n, listed + total
        old = stored.postings(asked.select(F.explode("tokens").alias("token"))).withColumnRenamed("key", "pulse_id").join(facts.where("NOT asks").select("pulse_id", "num"), "pulse_id")
        old = _written(old.select("num", "token", "tf", "dl"))
        again = old.groupBy("num", "dl").agg(F.flatten(F.collect_list(F.array_repeat("token", F.col("tf").cast("int")))).alias("ts"))
        held = kept.join(one.select("num", F.size("ts").alias("dl"), "ts").unionByName(again.select("num", "dl", "ts")).withColumnRenamed("num", "b"), "b")
        df = df.unionByName(old.groupBy("token").agg(F.count("*").alias("df"))).groupBy("token").agg(F.sum("df").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = _written(df.select("token", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf")))
    held = _written(held.where("size(ts) > 0").select("b", "sb", "dl", "ts", "text", "anchors").orderBy("b"))
    # Equal texts ask together, very many of them in parts of the order: there is at most one such text to every ASKED facts.
    alike = asked.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    told = alike.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_list(F.when(F.col("n") > ASKED, F.col("h"))).alias("crowds")).first()
    asking = told.n
    parts = max(1, min(PARTS, -(-asking // ASKING)), -(-asking // ASKED))
    chunk = F.when(F.xxhash64("text").isin(told.crowds), F.shiftright("a", 15)).otherwise(0) if told.crowds else F.lit(0)
    dealt = asked.withColumn("i", F.pmod(F.xxhash64("text", chunk), F.lit(parts)).cast("int")).repartitionByRange(4 * parts, "i")  # each part a task of its own
    run = _best(k, ordered, total / max(1, n), sorted(held.inputFiles()), weights.inputFiles(), HELD, compare)
    best = _written(dealt.groupBy("i").applyInArrow(run, "a long, bs array<long>, sims array<double>"))
    _drop(weights, held, *([] if old is None else [old]))
    return best


def shortlists(facts: DataFrame, k: int, stored: TextIndex | None = None) -> DataFrame:
    """(a, b, rank) of ``ranked`` by pulse_id."""
    made = numbered(facts)
    names = lambda end: made.select(F.col("num").alias(end), F.col("pulse_id").alias(f"id{end}"))
    pairs = ranked(made, k, stored, compare=False).select("a", F.posexplode("bs").alias("rank", "b"))
    return pairs.join(names("a"), "a").join(names("b"), "b").select(F.col("ida").alias("a"), F.col("idb").alias("b"), (F.col("rank") + 1).alias("rank"))


def edges(facts: DataFrame, k: int = 20) -> DataFrame:
    """Comparable pairs (pulse_id, other_id, similarity) of different sources without a conflict of anchors."""
    made = numbered(facts)
    names = lambda end, name: made.select(F.col("num").alias(end), F.col("pulse_id").alias(name))
    pairs = ranked(made, k).select("a", F.explode(F.arrays_zip("bs", "sims")).alias("x")).select("a", F.col("x.bs").alias("b"), F.col("x.sims").alias("similarity"))
    close = pairs.where("similarity IS NOT NULL")
    return close.join(names("a", "pulse_id"), "a").join(names("b", "other_id"), "b").select("pulse_id", "other_id", "similarity")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only on one machine, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, compressed, and gone with ``_drop``."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/factloom/firewall-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.folder = folder
    return out


def _drop(*written: DataFrame) -> None:
    """Delete tables of ``_written`` that nothing reads any more."""
    for t in written:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _sent(nums: DataFrame, n: int) -> DataFrame:
    """``nums``, n rows of one number, for a join: sent to every task if they are few."""
    return F.broadcast(nums) if n <= SENT_NUMS else nums


def _hits(lists: DataFrame, least: float) -> DataFrame:
    """(a, b, rank, near) of ``ranked`` lists up to the last fact that is near: what comes behind it suppresses nobody."""
    close = lists.select("a", "bs", F.transform("sims", lambda x: F.coalesce(x >= least, F.lit(False))).alias("near"))
    behind = F.array_position(F.reverse("near"), F.lit(True))  # 0: none is near
    upto = close.where(behind > 0).select("a", F.slice(F.arrays_zip("bs", "near"), F.lit(1), (F.size("near") + 1 - behind).cast("int")).alias("x"))
    return upto.select("a", F.posexplode("x").alias("rank", "x")).select("a", F.col("x.bs").alias("b"), "rank", F.col("x.near").alias("near"))


def first_wins(facts: DataFrame, k: int = 20, least: float = 0.58, stored: TextIndex | None = None) -> DataFrame:
    """Adds outcome kept or suppressed to facts (pulse_id, source_id, fact_text, fingerprint, pos: build order).

    Facts with a true ``settled`` (optional) were kept before: they stay, and are compared with but ask nothing.
    A suppressed fact suppresses nobody and takes no slot of a shortlist. Every round decides all facts anew from
    the facts kept in the round before. As a fact depends on earlier ones alone, only the sequential outcome stays
    the same in a round, whatever the first guess. Rounds read numbers alone, and tables of earlier rounds are deleted.
    """
    width = 2 * k
    made = numbered(facts)
    lists = ranked(made, width, stored)
    folder, lists = lists.folder, lists.withColumn("width", F.lit(width))
    lists.folder = folder
    near = _written(_hits(lists, least))
    # Facts whose fingerprint several sources hold; its least number stands for it. Facts of different sources differ in pos, so num tells which is earlier.
    sourced = made.where("source_id IS NOT NULL")
    held = sourced.groupBy("fingerprint").agg(F.min("num").alias("print"), F.min("source_id").alias("s0"), F.max("source_id").alias("s1"))
    shared = held.where("s0 <> s1").select("fingerprint", "print")
    copies = _written(sourced.select("num", "source_id", "asks", "fingerprint").join(shared, "fingerprint").select("num", "source_id", "asks", "print"))
    lost, n = _written(made.select("num").limit(0)), 0
    # Round n settles at least the first n facts of every chain, so rounds end, however long a chain is.
    while True:
        gone = _sent(lost, n)
        short = near.join(gone.withColumnRenamed("num", "b"), "b", "left_anti").groupBy("a").agg(F.collect_list(2 * F.col("rank") + F.col("near").cast("int")).alias("x"))
        told = short.where(F.exists(F.slice(F.array_sort("x"), 1, k), lambda x: x % 2 == 1)).select(F.col("a").alias("num"))
        # The first two sources that hold a fingerprint tell for every source whether another one has it earlier.
        firsts = copies.join(gone, "num", "left_anti").groupBy("print", F.col("source_id").alias("sb")).agg(F.min("num").alias("b"))
        firsts = firsts.withColumn("n", F.row_number().over(W.partitionBy("print").orderBy("b"))).where("n <= 2").select("print", "sb", "b")
        same = copies.where("asks").join(firsts, "print").where("source_id <> sb AND b < num").select("num")
        now = _written(told.union(same).distinct())
        many = now.count()
        if many == n and now.join(_sent(lost, n), "num", "left_anti").isEmpty():
            # A list that ends at its width may have more; with fewer than k kept facts in it, it is too short for a fact that is kept.
            gone = _sent(now, many)
            full = lists.where(F.size("bs") >= F.col("width")).join(gone.withColumnRenamed("num", "a"), "a", "left_anti")
            full = full.select("a", "width", F.explode("bs").alias("b")).join(gone.withColumnRenamed("num", "b"), "b", "left_semi")
            open_ = _written(full.groupBy("a", "width").agg(F.count("*").alias("n")).where(F.col("n") > F.col("width") - k).select(F.col("a").alias("num")))
            if open_.isEmpty():
                _drop(lists, near, copies, lost, open_)
                outcome = made.join(now.withColumn("outcome", F.lit("suppressed")), "num", "left")
                return outcome.select(*facts.columns, F.coalesce("outcome", F.lit("kept")).alias("outcome"))
            width *= 4
            longer, begun = ranked(made, width, stored, only=open_), open_.withColumnRenamed("num", "a")
            others = lists.join(begun, "a", "left_anti"), near.join(begun, "a", "left_anti")
            before, lists, near = (lists, near), _written(others[0].unionByName(longer.withColumn("width", F.lit(width)))), _written(others[1].unionByName(_hits(longer, least)))
            _drop(*before, longer, open_)
        _drop(lost)
        lost, n = now, many


def suppressed_pool(pool: DataFrame, recent: DataFrame, k: int = 10, least: float = 0.58, stored: TextIndex | None = None) -> DataFrame:
    """pulse_ids of ``pool`` (pulse_id, source_id, fact_text, fingerprint) that repeat ``recent`` (probe_id, probe_text, fingerprint).

    ``stored`` is an index of all facts, from which the postings of asked tokens come.
    """
    exact = pool.join(recent.select("fingerprint").distinct(), "fingerprint", "left_semi").select("pulse_id")
    if stored is None:
        found = bm25_topk(postings(pool), recent, k).select("probe_id", "pulse_id")
    else:
        asked = recent.select("probe_id", F.explode(T.query_tokens(F.col("probe_text"))).alias("token"))
        weighed = stored.weights(asked).withColumnRenamed("key", "pulse_id").join(pool.select("pulse_id"), "pulse_id", "left_semi")
        scored = asked.join(weighed, "token").groupBy("probe_id", "pulse_id").agg((-F.sum("w")).alias("score"))
        best = W.partitionBy("probe_id").orderBy(F.round("score", 9), "pulse_id")
        found = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("probe_id", "pulse_id")
    texts = found.join(recent.select("probe_id", "probe_text"), "probe_id").join(pool.select("pulse_id", "fact_text"), "pulse_id")
    clear = texts.where(~T.anchor_conflict(T.anchors(F.col("probe_text")), T.anchors(F.col("fact_text"))))
    return exact.union(clear.where(similarity("probe_text", "fact_text") >= least).select("pulse_id")).distinct()
