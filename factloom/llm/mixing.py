"""Mixing to target weights with soft memberships, in DataFrame operations only.

1. A Bernoulli naive Bayes classifier over hashed words is fitted on a bounded sample of the labelled table:
   a word's bucket tells for a domain when documents of that domain hold it much more or less often than
   those of the base domain. That a document lacks it counts as well. It gives every document posteriors.
2. Projected-gradient least squares finds rates per document, from 0 to ``max_rate``, so that the expected tokens per
   domain, the sum of rate * tokens * posterior, meet the targets. A domain's squared error is weighted by one over its
   tokens and the gradient is taken in the metric of tokens, so a step lowers a rate by posteriors times one number per
   domain. Projection is lazy: steps add up to ``mu``, one number per domain, and a rate is one less posteriors times ``mu``, projected onto
   its bounds. A slight pull of rates to one (``RIDGE``) makes the solution unique. A pass over the rows gives, for several step
   lengths at once, the totals and the curvature of the rates off their bounds, which scales the next step; the driver holds a
   few numbers per domain, the rows are never rewritten.
3. A rate becomes copies: its whole part, and one more with the probability of the rest, by a hash of doc_id and text.

Targets are shares; the anchor domain's tokens set the total. No target exceeds what ``max_rate`` times a
domain's tokens can give, so with ``MAX_RATE`` of 1 (the production value: nothing is repeated) a scarce domain stays below its
target; ``achieved`` tells by how much, and ``solve`` warns. Steps end when the gradient is down to ``TOLERANCE`` of all tokens, which is the optimum
whether or not it meets the targets: what is unmet then is due to the bounds and to posteriors that overlap. Without that
in ``PASSES`` passes ``solve`` raises.

Edge cases: null text has no tokens and the prior's posterior; without labels all belong to the anchor and
have rate 1; a null doc_id is rated like any other; repeated rows (equal doc_id and text) get equal rates and copies, rows
that share only a doc_id their own; labels with nulls or for unknown documents are ignored, of several labels of a document
the least domain counts; equal posteriors go to the domain named first; of very long texts nothing is cut; empty tables give no
rows; extra columns of any names are carried by ``apply_mix`` and ignored by ``mix``.
"""

from __future__ import annotations

import json
import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, packed, sized_join, unpacked, words

#: Labelled documents that the classifier is fitted on at most.
MAX_LABELS = 20_000
BUCKETS = 1 << 14
#: A bucket counts when so many sample documents hold it and its log odds are so large.
LEAST_DOCS, LEAST_ODDS = 20, 1.0
TARGETS = {"good": 0.92, "poor": 0.05, "toxic": 0.03}
ANCHOR, MAX_RATE = "good", 1.0
#: Gradient at the optimum as a share of all tokens, and passes over the rows at most; more than that is an error.
TOLERANCE, PASSES = 1e-6, 200
#: Weight of a rate's squared distance from one, against a domain's squared relative error; lengths of steps tried in one pass.
RIDGE, LENGTHS = 1e-5, (1.0, 0.25, 0.0625)
#: Share of all tokens from which an unmet target is warned of.
TOLD = 1e-3



def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels."""
    d = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min(d).alias("domain"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def fit(docs: DataFrame, labelled: DataFrame, names: list[str], anchor: str = ANCHOR) -> tuple[list[list[float]], list[float]]:
    """Per domain other than the anchor: weights by bucket; and the log prior odds. Bounded by buckets, not by rows."""
    sample = materialize(labelled.where(F.col("domain").isin(names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS), "mix-sample")
    held = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(sample), "doc_id")
    held = held.select("domain", F.array_distinct(F.transform(words(F.col("text")), _bucket)).alias("b"))
    counted = held.select("domain", F.explode(F.concat("b", F.array(F.lit(-1)))).alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n")).collect()
    n = {(r.domain, r.b): r.n for r in counted}
    docs_of = {d: n.get((d, -1), 0) for d in names}
    weights, priors = [], []
    for d in names:
        if d == anchor:
            continue
        row, absent = [0.0] * BUCKETS, 0.0
        for b in range(BUCKETS) if docs_of[d] and docs_of[anchor] else ():
            x, y = n.get((d, b), 0), n.get((anchor, b), 0)
            p, q = (x + 0.5) / (docs_of[d] + 1), (y + 0.5) / (docs_of[anchor] + 1)
            if x + y >= LEAST_DOCS and abs(math.log(p / q)) >= LEAST_ODDS:
                without = math.log((1 - p) / (1 - q))
                row[b], absent = round(math.log(p / q) - without, 3), absent + without
        weights.append(row)
        priors.append(absent + math.log((docs_of[d] + 1e-3) / (docs_of[anchor] + 1e-3)) if docs_of[anchor] else (-50.0 if not docs_of[d] else 50.0))
    return weights, priors


def _seed(doc_id: Column, text: Column) -> Column:
    """A hash of both; null differs from empty."""
    told = [x for c in (doc_id.cast("string"), text) for x in (F.coalesce(c, F.lit("")), c.isNull())]
    return F.xxhash64(*told, F.lit("mix"))


def posteriors(docs: DataFrame, names: list[str], weights: list[list[float]], priors: list[float], anchor: str = ANCHOR) -> DataFrame:
    """doc_id, tokens and p_<domain> per row, and seed, the hash that decides copies. One narrow projection."""
    table = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    telling = table([any(row[b] for row in weights) for b in range(BUCKETS)], "boolean")
    w = docs.select("doc_id", _seed(F.col("doc_id"), F.col("text")).alias("seed"), words(F.col("text")).alias("w"))
    told = w.select("doc_id", "seed", F.size("w").cast("long").alias("tokens"), F.array_distinct(F.filter(F.transform("w", _bucket), lambda b: F.get(telling, b))).alias("b"))

    def summed(row: list[float], prior: float) -> Column:
        return F.aggregate("b", F.lit(prior), lambda acc, b: acc + F.get(table(row, "double"), b))

    odds = [summed(row, prior) for row, prior in zip(weights, priors, strict=True)]
    others = [n for n in names if n != anchor]
    z = told.select("doc_id", "seed", "tokens", let(F.array(F.lit(0.0), *odds), lambda a: F.transform(a, lambda x: F.exp(F.greatest(F.lit(-700.0), x - F.array_max(a))))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    return z.select("doc_id", "seed", "tokens", *((F.get("e", F.lit(k)) / total).alias(f"p_{n}") for k, n in enumerate([anchor, *others])))


class Solution(NamedTuple):
    """``rows`` with the column ``rate``, and tokens by domain: all there are, wanted, within the bound, got."""

    rows: DataFrame
    have: dict[str, float]
    wanted: dict[str, float]
    aim: dict[str, float]
    got: dict[str, float]


class _State(NamedTuple):
    """What a pass tells of ``mu``: the dual value, gradient and curvature, and the domains' totals."""

    mu: np.ndarray
    value: float
    gradient: np.ndarray
    curvature: np.ndarray
    got: np.ndarray


def _passed(rows: DataFrame, names: list[str], mus: list[np.ndarray], have: np.ndarray, aim: np.ndarray, max_rate: float) -> list[_State]:
    """One pass over ``rows`` for all ``mus``."""
    t, p, k = F.col("tokens").cast("double"), [F.col(f"p_{n}") for n in names], len(names)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = []
    for mu in mus:
        s = sum((p[i] * F.lit(float(mu[i])) for i in range(k)), F.lit(0.0))
        r = F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), 1.0 - s))
        free = F.when((s < 1.0) & (1.0 - s < max_rate), t).otherwise(0.0)
        each = F.array(t * ((r - 1.0) * (r - 1.0) / 2 + r * s), *(t * r * x for x in p), *(free * p[i] * p[j] for i, j in upper))
        sums.append(each)
    width = 1 + k + len(upper)
    told = rows.select(F.concat(*sums).alias("x")).select(*(F.col("x")[i].alias(f"x{i}") for i in range(width * len(mus))))
    found = told.agg(*(F.sum(f"x{i}") for i in range(width * len(mus)))).first()
    out = []
    for n, mu in enumerate(mus):
        x = np.array([v or 0.0 for v in found[n * width : (n + 1) * width]])
        got, curvature = x[1 : 1 + k], np.zeros((k, k))
        for (i, j), v in zip(upper, x[1 + k :], strict=True):
            curvature[i, j] = curvature[j, i] = v
        out.append(_State(mu, x[0] - mu @ aim - RIDGE / 2 * have @ (mu * mu), got - aim - RIDGE * have * mu, curvature, got))
    return out


def solve(rows: DataFrame, targets: dict[str, float], anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> Solution:
    """Rates by lazily projected gradient steps; ``rows`` must be materialised."""
    names = list(targets)
    held = rows.agg(*(F.sum(F.col("tokens").cast("double") * F.col(f"p_{n}")) for n in names)).first()
    have = np.array([v or 0.0 for v in held])
    total = have[names.index(anchor)] / targets[anchor] if targets[anchor] else have.sum()
    wanted = np.array([targets[n] * total for n in names])
    aim = np.minimum(wanted, max_rate * have)
    scale = max(1.0, aim.sum())
    [now] = _passed(rows, names, [np.zeros(len(names))], have, aim, max_rate)
    passes = 1
    while np.abs(now.gradient).max() > TOLERANCE * scale:
        slope = now.curvature + np.diag(RIDGE * have + 1e-9)
        step, shrink = np.linalg.solve(slope, now.gradient), 1.0
        while True:
            if passes >= PASSES:
                raise RuntimeError(f"the rates do not settle in {PASSES} passes")
            tried = _passed(rows, names, [now.mu + a * shrink * step for a in LENGTHS], have, aim, max_rate)
            passes += 1
            better = [x for a, x in zip(LENGTHS, tried, strict=True) if x.value >= now.value + 1e-4 * a * shrink * (now.gradient @ step) or np.abs(x.gradient).max() <= TOLERANCE * scale]
            if better:
                now = max(better, key=lambda x: x.value)
                break
            shrink *= LENGTHS[-1] / 4
    if short := {n: round(w - g) for n, w, g in zip(names, wanted, now.got, strict=True) if abs(w - g) > max(1.0, TOLD * scale)}:
        warnings.warn(f"tokens that domains miss of their targets (negative: exceed them): {short}", stacklevel=2)
    s = sum((F.col(f"p_{n}") * F.lit(float(m)) for n, m in zip(names, now.mu, strict=True)), F.lit(0.0))
    rate = F.round(F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), 1.0 - s)), 6)
    told = [dict(zip(names, map(float, v), strict=True)) for v in (have, wanted, aim, now.got)]
    return Solution(rows.withColumn("rate", rate), *told)


def _solved(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, anchor: str, max_rate: float) -> Solution:
    targets = targets or TARGETS
    weights, priors = fit(docs, domains(labels), list(targets), anchor)
    rows = materialize(posteriors(docs, list(targets), weights, priors, anchor), "mix-posteriors")
    return solve(rows, targets, anchor, max_rate)


def achieved(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> DataFrame:
    """Per domain: expected tokens there are, wanted, reachable under ``max_rate`` and got, and what is unmet."""
    s = _solved(docs, labels, targets, anchor, max_rate)
    told = [(n, s.have[n], s.wanted[n], s.aim[n], s.got[n], s.wanted[n] - s.got[n]) for n in s.have]
    return docs.sparkSession.createDataFrame(told, "domain string, have double, wanted double, reachable double, got double, unmet double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>, domain, rate, copies."""
    rows = _solved(docs, labels, targets, anchor, max_rate).rows
    columns = [f"p_{n}" for n in targets or TARGETS]
    best = F.greatest(*columns)
    domain = F.coalesce(*(F.when(F.col(c) == best, F.lit(c[2:])) for c in columns))
    return rows.select("doc_id", "tokens", *columns, domain.alias("domain"), "rate", _copies(F.col("rate"), F.col("seed")).alias("copies"))


def _copies(rate: Column, seed: Column) -> Column:
    chance = F.pmod(seed, F.lit(1 << 52)).cast("double") / float(1 << 52)
    return F.floor(rate + chance).cast("long")


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with every row as often as its rate says, in its own columns.

    Only rows with another number of copies than one are looked up, by the hash of doc_id and text that decides copies.
    """
    rows = _solved(docs, labels, targets, anchor, max_rate).rows
    copies = rows.select("seed", _copies(F.col("rate"), F.col("seed")).alias("copies")).where("copies <> 1")
    odd = materialize(copies.groupBy("seed").agg(F.max("copies").alias("copies")), "mix-copies")
    tagged = packed(docs).withColumn("seed", _seed(F.col("row.doc_id"), F.col("row.text")))
    times = sized_join(tagged, odd, "seed", "left").select("row", F.coalesce("copies", F.lit(1)).alias("times")).where("times > 0")
    return unpacked(times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))))
