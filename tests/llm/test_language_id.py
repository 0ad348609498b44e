import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import language_id as L

WORDS = {"en": "the and that with from ing tion wh".split(), "de": "der und nicht sch ung ße ä ö".split(), "fr": "le que pour é è eau ç".split()}


def rows(n, seed):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(WORDS[g]) for _ in range(r.randint(3, 60))), g) for k, g in ((k, r.choice(list(WORDS))) for k in range(n))]


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.createDataFrame(rows(600, 1), "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = L.fit(docs, ~held, max_rows=300)
    got = L.predict(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    assert got.score.between(0, 1).all() and abs(got.score.mean() - (got.lang_pred == got.lang).mean()) < 0.05
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "the and", "en"), (4, "the and", "en"), (None, "the and", None), (6, "the und " * 200_000, "de")],
        "doc_id long, text string, lang string",
    )
    model = L.fit(docs, F.lit(True))
    got = sorted(((r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == 7
    none = L.fit(docs.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, none).collect()} == {("und", 0.0)}
    assert L.predict(docs.limit(0), model).count() == 0
    one = L.fit(docs.where("doc_id = 4"), F.lit(True))
    assert one.predict("xyz") == ("en", 1.0)


def test_whole_text_is_counted_in_pieces(monkeypatch):
    text = "".join(random.Random(2).choice("abcé ß") for _ in range(997))
    whole = L.counts(text)
    monkeypatch.setattr(L, "PIECE", 10)
    assert (L.counts(text) == whole).all()


def plain_ftrl(rows, n_langs):
    """The same updates, one coordinate at a time in plain Python."""
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= L.L1 else (math.copysign(L.L1, v) - v) / ((L.BETA + math.sqrt(n.get(k, 0.0))) / L.ALPHA + L.L2)

    rng = np.random.default_rng(7)
    for _ in range(L.EPOCHS):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            told = [*zip(at.tolist(), x.tolist(), strict=True), (L.BUCKETS, 1.0)]
            w = {(a, c): weight((a, c)) for a, _ in told for c in range(n_langs)}
            score = [sum(v * w[a, c] for a, v in told) for c in range(n_langs)]
            top = max(score)
            e = [math.exp(s - top) for s in score]
            for a, v in told:
                for c in range(n_langs):
                    g = v * (e[c] / sum(e) - (c == y))
                    old = n.get((a, c), 0.0)
                    n[a, c] = old + g * g
                    z[a, c] = z.get((a, c), 0.0) + g - (math.sqrt(n[a, c]) - math.sqrt(old)) / L.ALPHA * w[a, c]
    return {k: weight(k) for k in z}


def test_training_equals_plain_updates():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        at = np.sort(r.choice(60, 12, replace=False))
        rows.append((at, r.random(12), int(r.integers(3))))
    got, want = L.ftrl(rows, 3), plain_ftrl(rows, 3)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and np.count_nonzero(got) == sum(v != 0 for v in want.values())


def test_extra_columns_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "the and with " * 100_000, "en", 1.0), (2, "der und nicht", "de", 2.0), (2, "der und nicht", "de", 2.0)], "doc_id long, text string, lang string, score double")
    out = L.predict(docs, L.fit(docs, F.lit(True)))
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == 3 and all(0 <= r.score <= 1 for r in out.collect())
