import random
import warnings

import numpy as np
import pytest

from factloom.llm import mixing as M


def brute_rates(t, p, have, aim, max_rate):
    """Bounded least squares with the pull to one, by plain projected gradient with momentum on the rates themselves, run until they stand still."""
    weight = np.divide(1.0, have, out=np.zeros_like(have), where=have > 0)
    r = y = np.minimum(np.ones(len(t)), max_rate)
    a = 1.0
    for _ in range(200_000):
        new = np.clip(y - (p @ (((t * y) @ p - aim) * weight) + M.RIDGE * (y - 1)) / (1 + M.RIDGE), 0, max_rate)
        if (t * (y - new) * (new - r)).sum() > 0:
            a, y = 1.0, r
            continue
        if np.abs(new - r).max() < 1e-13:
            break
        following = (1 + np.sqrt(1 + 4 * a * a)) / 2
        y, r, a = new + (a - 1) / following * (new - r), new, following
    return r


def corpus(n=400):
    r = random.Random(3)
    common = [f"c{k}" for k in range(30)]
    rows, labels = [], []
    for i in range(n):
        kind = r.choice(["good", "good", "good", "poor", "toxic"])
        words = [r.choice(common) for _ in range(r.randint(5, 60))] + [f"{kind}{r.randrange(3)}" for _ in range(4)]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return rows, labels


def test_rates_meet_targets_and_equal_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, None), (5, rows[5][1])], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    out = M.mix(docs, table, targets, max_rate=5.0).toPandas()
    assert len(out) == len(rows) + 2
    t, p = out.tokens.to_numpy(float), out[["p_good", "p_poor", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    have = t @ p
    aim = np.minimum(np.array([0.6, 0.3, 0.1]) * have[0] / 0.6, 5 * have)
    assert np.allclose(out.rate, brute_rates(t, p, have, aim, 5.0), atol=1e-4)
    assert np.abs((t * out.rate) @ p - aim).max() < 0.001 * aim.sum()
    assert ((out.copies == np.floor(out.rate)) | (out.copies == np.floor(out.rate) + 1)).all()
    truth = out.merge(__import__("pandas").DataFrame(labels, columns=["doc_id", "q", "x"]), on="doc_id")
    assert (truth.domain == np.where(truth.x == 1, "toxic", np.where(truth.q == 1, "good", "poor"))).mean() > 0.97


def test_rates_are_the_optimum_where_bounds_bind(spark):
    r = random.Random(6)
    rows = []
    for k in range(500):
        x = np.array([r.random() + 2 * (k % 3 == j) for j in range(3)]) ** 2
        rows.append((k, k, r.randint(0, 400), *map(float, x / x.sum())))
    table = spark.createDataFrame(rows, "doc_id long, seed long, tokens long, p_good double, p_poor double, p_toxic double").repartition(3)
    t, p = np.array([x[2] for x in rows], float), np.array([x[3:] for x in rows])
    have = t @ p
    for targets, most in ((M.TARGETS, 1.0), ({"good": 0.2, "poor": 0.7, "toxic": 0.1}, 1.0), ({"good": 0.98, "poor": 0.01, "toxic": 0.01}, 2.0), ({"good": 0.05, "poor": 0.05, "toxic": 0.9}, 3.0)):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            s = M.solve(table, targets, max_rate=most)
        aim = np.array(list(s.aim.values()))
        assert np.allclose(aim, np.minimum(np.array(list(targets.values())) * have[0] / targets["good"], most * have))
        best = brute_rates(t, p, have, aim, most)
        loss = lambda rate: (((t * rate) @ p - aim) ** 2 / have).sum() / 2 + M.RIDGE / 2 * (t * (rate - 1) ** 2).sum()  # noqa: B023, E731
        got = np.array([x.rate for x in s.rows.orderBy("doc_id").collect()])
        assert np.abs((t * (got - best)) @ p).max() < 2e-4 * aim.sum() and loss(got) <= loss(best) + 1e-6 * aim.sum()
        assert np.abs((t * got) @ p - np.array(list(s.got.values()))).max() < 1e-5 * aim.sum() + 1


def test_apply_repeats_rows_as_rates_say(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, rate string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    want = {r.doc_id: r.copies for r in M.mix(docs, table, targets, max_rate=5.0).collect()}
    got = M.apply_mix(docs, table, targets, max_rate=5.0)
    assert got.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in want.items() if n}


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.rate, r.copies, r.domain) for r in M.mix(docs, none).collect()} == {(1, 1.0, 1, "good"), (2, 1.0, 1, "good")}
    assert M.mix(docs.limit(0), none).count() == 0
    assert M.apply_mix(docs, none).count() == 2


def test_rows_that_share_an_id_keep_their_own_copies(spark):
    rows, labels = corpus(200)
    long = "c1 c2 poor1 " * 20_000
    rows = [(i, t) for i, t in rows] + [(7, "poor0 poor1 poor2 c1 " * 3), (7, "c1 c2 c3"), (7, "c1 c2 c3"), (None, "c4"), (None, None), (None, "c4"), (999, long)]
    names = ["doc_id", "text", "seed", "copies", "row", "a.b", "times"]
    docs = spark.createDataFrame([(*r, *"vwxyz") for r in rows], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    out = M.mix(docs.select("doc_id", "text"), table, targets, max_rate=5.0).collect()
    got = M.apply_mix(docs, table, targets, max_rate=5.0)
    assert got.columns == names and {tuple(r)[2:] for r in got.collect()} == {tuple("vwxyz")}
    assert got.count() == sum(r.copies for r in out)
    sizes = {(r.doc_id, len((r.text or "").split())): r["count"] for r in got.groupBy("doc_id", "text").count().collect() if r.doc_id in (None, 7, 999)}
    want = {}
    for r in out:
        if r.doc_id in (None, 7, 999) and r.copies:
            want[r.doc_id, r.tokens] = want.get((r.doc_id, r.tokens), 0) + r.copies
    assert sizes == want


def test_unmet_targets_are_told(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"good": 0.3, "poor": 0.4, "toxic": 0.3}
    with pytest.warns(UserWarning, match="miss of their targets"):
        told = {r.domain: r for r in M.achieved(docs, table, targets, max_rate=1.0).collect()}
    assert told["poor"].unmet > 0 and abs(told["poor"].wanted - 0.4 / 0.3 * told["good"].have) < 1e-6 and told["poor"].reachable == told["poor"].have
    assert abs(sum(r.unmet + r.got - r.wanted for r in told.values())) < 1e-6
    few = M.achieved(docs, table, {"good": 0.9, "poor": 0.05, "toxic": 0.05}).collect()
    assert all(abs(r.unmet) < 0.002 * sum(x.wanted for x in few) for r in few)
