import hashlib
import math
import random
import re
import zlib

import pyarrow as pa

from factloom.llm import importance as M


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % M.BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20):
    told = [(d, *features(t)) for d, t in docs]
    s, t = [0] * M.BUCKETS, [0] * M.BUCKETS
    for _, _, f in told:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + M.BUCKETS) / ((x + 1) * (sum(t) + M.BUCKETS)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for d, n, f in told:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks, drawn = {}, percent * len(order) // 100
    for k, r in enumerate(order[:drawn]):
        ranks.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], ranks[r[:4]].pop() if ranks.get(r[:4]) else None) for r in rows), key=repr)


def rows():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "ÉTÉ", "x_y", "日本", "İ", "a1"]
    out = [(k, " ".join(r.choice(vocabulary) + r.choice(["", ".", ",\n", "-b"]) for _ in range(r.randint(0, 60)))) for k in range(300)]
    return out + [(None, None), (None, out[3][1]), (5, out[5][1]), (5, out[5][1]), (400, ""), (401, "!!! --- \0"), (402, "w1 w2 w3 " * 60_000), *((500 + k, "same words again " * 8) for k in range(150))]


TARGET = ["w1 w2 w3 w4 über", "w5 w5 w5", None, ""]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*x, "a", 1, 2) for x in rows()], "doc_id long, text string, score string, `part.x` int, times int").repartition(5)
    target = spark.createDataFrame([(x, 1) for x in TARGET], "text string, r int")
    got = M.resample(docs, target, percent=20).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows(), TARGET, 20)


def test_ranks_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 10)
    docs = spark.createDataFrame([(k // 3, "one two three four five six " * 4) for k in range(300)], "doc_id long, text string")
    got = M.resample(docs, docs.limit(0), percent=50)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain([tuple(r) for r in docs.collect()], [], 50)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id string, text string")
    assert M.resample(docs.limit(0), docs).count() == 0
    assert M.resample(docs, docs.limit(0)).select("doc_id", "n_features", "rank").collect() == [("1", 3, None)]


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["", "a" * 50, "b", "c" * 9, None, "d"]})
    assert [x for part in M.slices(batch) for x in part.column(0).to_pylist()] == list(range(6))
    assert len(list(M.slices(batch))) > 1
