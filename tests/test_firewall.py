"""first_wins against the sequential order: every fact is compared with the best k kept earlier facts of other sources."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from factloom.operators import firewall as W

WORDS = "river delta carries sand stone north south heat cold light wave deep salt wind moves slowly toward basin ridge valley".split()


def frame(spark, rows):
    df = spark.createDataFrame([(f"p{random.Random(k).randrange(10**9)}x{k}", s, t, f"{k:04d}") for k, (s, t) in enumerate(rows)], "pulse_id string, source_id string, fact_text string, pos string")
    return df.withColumn("fingerprint", F.sha2("fact_text", 256))


def sequential(facts, k, least=0.58):
    """Outcome by pos, one fact after the other; scores use the whole corpus; the texts have no anchors or stop words."""
    facts = sorted(facts, key=lambda f: f.pos)
    tokens = {f.pos: f.fact_text.lower().split() for f in facts}
    n, mean = len(facts), sum(map(len, tokens.values())) / len(facts)
    df = {}
    for ts in tokens.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1

    def weight(t, ts):
        idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
        tf = ts.count(t)
        return (1e-6 if idf <= 0 else idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))

    kept, out = [], {}
    for f in facts:
        asked = sorted(set(tokens[f.pos]))[:12]
        others = [(round(-sum(weight(t, tokens[o.pos]) for t in asked if t in tokens[o.pos]), 9), o.pos, o) for o in kept if o.source_id != f.source_id and set(asked) & set(tokens[o.pos])]
        hit = any(o.fingerprint == f.fingerprint and o.source_id != f.source_id for o in kept)
        hit = hit or any(W.token_set_ratio(f.fact_text, o.fact_text) / 100 >= least for *_, o in sorted(others, key=lambda x: x[:2])[:k])
        out[f.pos] = "suppressed" if hit else "kept"
        if not hit:
            kept.append(f)
    return out


def test_own_source_takes_no_slots(spark):
    """25 alike facts of one source come before a fact that repeats another source's."""
    rows = [("a", "river delta carries sand slowly")] + [("b", f"basin ridge valley wind {chr(97 + k) * 5}") for k in range(25)] + [("c", "basin ridge valley wind ddddd north")]
    rows = [("z", "basin ridge valley wind"), *rows]
    got = {r.pos: r.outcome for r in W.first_wins(frame(spark, rows), k=3).collect()}
    assert got == sequential(frame(spark, rows).collect(), 3)
    pairs = W.edges(frame(spark, [("b", f"basin ridge valley wind {chr(97 + k) * 5}") for k in range(25)] + [("a", "basin ridge valley stone")] + [("b", "basin ridge valley wind zzzzz")]), 20).collect()
    assert any(p.pulse_id.endswith("x26") and p.other_id.endswith("x25") for p in pairs)


def test_outcomes_are_those_of_the_sequential_order(spark):
    r = random.Random(5)
    rows = [(f"s{min(r.randrange(6), 3)}", " ".join(r.sample(WORDS, r.randint(4, 8)))) for _ in range(150)]
    rows += [(f"s{r.randrange(5)}", rows[r.randrange(150)][1]) for _ in range(20)]
    df = W._checkpoint(frame(spark, rows))
    want = sequential(df.collect(), 2)
    assert {"kept", "suppressed"} == set(want.values())
    assert {r.pos: r.outcome for r in W.first_wins(df, k=2).collect()} == want


def test_shortlists_of_parts_equal_brute_force(spark, monkeypatch):
    """Parts of the facts meet in tasks and no pair that shares a token is written; copies, common tokens and parts change nothing."""
    r = random.Random(9)
    common = WORDS[:3]
    rows = [(r.choice("abcd"), " ".join(r.sample(common, r.randint(0, 2)) + r.sample(WORDS, r.randint(1, 5)))) for _ in range(120)]
    rows += [(r.choice("ab"), "river delta carries ridge") for _ in range(60)] + [(None, "river delta carries ridge"), ("a", "Ü!")]
    df = W._checkpoint(frame(spark, rows))
    facts = sorted(df.collect(), key=lambda f: f.pos)
    ts = {f.pos: "".join(c if c.isascii() and c.isalnum() else " " for c in f.fact_text.lower()).split() for f in facts}
    full = [f for f in facts if ts[f.pos]]
    mean, count = sum(len(ts[f.pos]) for f in full) / len(full), {}
    for f in full:
        for t in set(ts[f.pos]):
            count[t] = count.get(t, 0) + 1

    def score(a, b):
        s = 0.0
        for t in sorted(set(ts[a.pos]))[:12]:
            tf, idf = ts[b.pos].count(t), math.log((len(full) - count[t] + 0.5) / (count[t] + 0.5))
            s += (1e-6 if idf <= 0 else idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts[b.pos]) / mean))
        return round(-s, 9)

    monkeypatch.setattr(W, "HELD", 70)
    monkeypatch.setattr(W, "ASKING", 30)
    for table, earlier in ((df, True), (df.drop("pos"), False)):
        order = "pos" if earlier else "pulse_id"
        want = set()
        for a in full:
            others = [(score(a, b), b[order], b.pulse_id) for b in full if None not in (a.source_id, b.source_id) and a.source_id != b.source_id and (not earlier or b.pos < a.pos)]
            want |= {(a.pulse_id, b, n) for n, (*_, b) in enumerate(sorted(x for x in others if x[0] < 0)[:4], 1)}
        assert {tuple(x) for x in W.shortlists(table, 4).collect()} == want


def test_outcomes_in_parts_are_those_of_the_sequential_order(spark, monkeypatch):
    """Held and asking facts dealt to several parts."""
    monkeypatch.setattr(W, "HELD", 20)
    monkeypatch.setattr(W, "ASKING", 20)
    r = random.Random(6)
    rows = [(f"s{r.randrange(4)}", " ".join(r.sample(WORDS, r.randint(4, 8)))) for _ in range(40)]
    rows += [(f"s{r.randrange(5)}", rows[r.randrange(40)][1]) for _ in range(15)]
    df = W._checkpoint(frame(spark, rows))
    assert {r.pos: r.outcome for r in W.first_wins(df, k=2).collect()} == sequential(df.collect(), 2)


def shuffled(spark, since=-1):
    """The last stage's id, and rows that the stages after ``since`` shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(n) for n in range(stages.size())]
    return max((x.stageId() for x in stages), default=-1), sum(x.shuffleWriteRecords() for x in stages if x.stageId() > since)


def test_no_fact_is_shuffled_once_a_part_nor_its_text_once_a_pair(spark, monkeypatch):
    """Parts read the held facts from the shared folder, pairs are compared where they are found, rounds take lists up to the last near fact."""
    monkeypatch.setattr(W, "ASKING", 25)
    r = random.Random(7)
    rows = [(f"s{r.randrange(4)}", " ".join(["river", *("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(5))])) for _ in range(300)]
    rows += [(f"s{r.randrange(4)}", rows[r.randrange(300)][1]) for _ in range(20)]
    df = W._checkpoint(frame(spark, rows))
    since, _ = shuffled(spark)
    W.first_wins(df).write.format("noop").mode("overwrite").save()
    assert shuffled(spark, since)[1] < 40 * len(rows)


def test_lists_too_short_are_widened(spark):
    """Many of the best are suppressed; lists of the facts that need more are taken anew, of the others they stay."""
    r = random.Random(8)
    rows = [("a", "river delta carries sand north")] + [("b", f"river delta carries sand north {chr(97 + n) * 3}") for n in range(20)]
    rows += [(f"c{n % 3}", " ".join(r.sample(WORDS, 5))) for n in range(30)]
    rows += [("d", "river delta carries sand basin ridge valley wind moves"), ("e", "river delta basin ridge valley wind moves toward")]
    df = W._checkpoint(frame(spark, rows))
    for k in (1, 3):
        assert {x.pos: x.outcome for x in W.first_wins(df, k=k).collect()} == sequential(df.collect(), k)


def best_of(folder, rows, ordered, k=4, held=10**6, read=10**6):
    """Lists of ``_best`` over rows (source, text), run here, and those of brute force; held facts are written as ``ranked`` writes them."""
    ts = [t.split() for _, t in rows]
    mean, df = sum(map(len, ts)) / len(ts), {}
    for t in ts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: max(1e-6, math.log((len(ts) - n + 0.5) / (n + 0.5))) for w, n in df.items()}
    none = pa.array([""] * len(rows))
    pq.write_table(pa.table({"b": pa.array(range(len(rows))), "sb": [s for s, _ in rows], "dl": pa.array(map(len, ts), pa.int32()), "ts": ts, "text": [t for _, t in rows], "anchors": none}), folder / "held.parquet")
    pq.write_table(pa.table({"token": list(idf), "idf": list(idf.values())}), folder / "idf.parquet")
    asked = pa.table({"a": pa.array(range(len(rows))), "sa": [s for s, _ in rows], "text": [t for _, t in rows], "anchors": none, "tokens": [sorted(set(t))[:12] for t in ts]})
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    got = W._best(k, ordered, mean, [f"file://{folder}/held.parquet"], [f"file://{folder}/idf.parquet"], held, True)(asked.take(order)).sort_by("a").to_pydict()

    def score(a, b):
        s = 0.0
        for w in sorted(set(ts[a]))[:12]:
            tf = ts[b].count(w)
            s += idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts[b]) / mean))
        return round(-s, 9)

    want = []
    for a, (source, _) in enumerate(rows):
        others = sorted((score(a, b), b) for b, (s, _) in enumerate(rows) if s != source and (not ordered or b < a))
        want.append([b for s, b in others if s < 0][:k])
    return got, want


def test_best_in_memory_equals_brute_force(tmp_path, monkeypatch):
    """Blocks, first sums, tables of common tokens, equal texts of one and of several sources, sources in runs and mixed."""
    r = random.Random(11)
    for n in range(24):
        rows = [(r.choice("abcde"), " ".join(r.choices(WORDS[: r.choice((6, 23))], k=r.randint(1, 14)))) for _ in range(80)]
        rows += [(r.choice("abcdef"), r.choice(rows)[1]) for _ in range(60)]
        r.shuffle(rows)
        if n % 2:
            rows.sort(key=lambda x: x[0])
        monkeypatch.setattr(W, "SUMMED", (0, 9, 40, 10_000)[n % 4])
        monkeypatch.setattr(W, "DENSE", (0, 700, 10**6)[n % 3])
        monkeypatch.setattr(W, "READ", (13, 1000)[n // 2 % 2])
        got, want = best_of(tmp_path, rows, n % 6 < 4, k=(1, 4)[n // 3 % 2], held=(30, 1000)[n // 4 % 2])
        assert got["bs"] == want
        for a, (bs, sims) in enumerate(zip(got["bs"], got["sims"], strict=True)):
            assert sims == [W.token_set_ratio(rows[a][1], rows[b][1]) / 100 for b in bs]


def test_a_text_is_asked_once_and_pairs_are_compared_together(tmp_path, monkeypatch):
    """As many lists are made as there are texts that meet facts of other sources, and no pair is compared by itself."""
    r = random.Random(12)
    texts = [" ".join(r.sample(WORDS, 6)) for _ in range(20)]
    rows = sorted((s, t) for s in "abcd" for t in texts for _ in range(5))
    calls = []
    lexsort = np.lexsort
    monkeypatch.setattr(W.np, "lexsort", lambda *x: calls.append(1) or lexsort(*x))
    monkeypatch.setattr(W, "token_set_ratio", None)
    got, want = best_of(tmp_path, rows, True)
    assert got["bs"] == want
    assert len(calls) <= 3 * len(texts) + 5  # those of source a meet nothing


def test_ratios_of_many_pairs_are_those_of_each():
    r = random.Random(13)
    for letters, words, length in (("abc", 30, 5), ("abcdefghij\0éß漢😀", 12, 8), ("ab", 200, 9), ("abcdefgh", 120, 12), ("abcdefgh", 1, 3)):
        texts = [" ".join("".join(r.choices(letters, k=r.randint(1, length))) for _ in range(r.randint(0, words))) for _ in range(60)]
        a = [r.choice(texts) for _ in range(300)]
        b = [" ".join([*(w for w in x.split() if r.random() < 0.7), *r.choice(texts).split()[: r.randint(0, 9)]]) for x in a]
        assert W.token_set_ratios(a, b).tolist() == [W.token_set_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert W.token_set_ratios([], []).tolist() == []
