"""Personal data: fixed patterns, and boosted trees over candidate spans.

1. The fixed patterns (``base_spans``) find mail addresses, IP addresses, payment cards and phone numbers as such. These always stay.
2. Generators of high recall propose further spans, which may overlap: spelled-out or bracketed mail and IP addresses, runs of digits in
   any grouping and their parts. A candidate has a kind, features of its format and of its context.
3. Gradient-boosted trees score candidates. They learn from weak labels, as nobody labelled spans: what the fixed patterns find is
   personal, and stays so when it is respelled in its place (``respelled``); candidates elsewhere are not, nor is what was found once it is
   damaged (``damaged``: a wrong check digit, a part over 255, a date in its place). Scores are calibrated on documents set aside, and a
   kind's threshold lies below the least calibrated score at which ``PRECISION`` of these candidates were right; a kind without such a score, or
   without examples, selects nothing.
4. Of selected candidates that overlap the likeliest stays, and none that overlaps a fixed pattern's span. ``redact`` replaces all spans.

The model is fitted on at most ``MAX_DOCS`` distinct texts, ``MAX_SPANS`` candidates of each; every whole text is searched.

Edge cases: null text is empty and has no spans; a null doc_id is carried through and not learnt from; offsets are code points, ends
exclusive; time is in proportion to a text's length; repeated rows give repeated rows, copies of a text are learnt from once; of equally
likely candidates the longer, then the earlier stays; without rows to learn from there are no further spans; an empty table gives no rows;
extra columns are carried by ``redact`` and ignored by ``find_personal``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import columns, materialize, small_batches

BASE = ("email", "ip", "card", "phone")
LIKE = ("like_email", "like_ip", "like_card", "like_phone", "like_id")
KINDS = BASE + LIKE
Span = tuple[str, int, int]

#: Distinct texts, and candidates of each, that the trees are fitted on at most; a quarter of the texts is for thresholds.
MAX_DOCS, MAX_SPANS = 3000, 60
TREES, DEPTH, RATE, BINS, RIDGE = 40, 3, 0.3, 32, 1.0
PRECISION = 0.98
#: Characters of context on either side.
NEAR = 40

# Fixed patterns ----------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` backwards, so that long words cost no more than others."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and then start; a match that fails its check is dropped and not tried again."""
    found = list(_emails(text))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = only_digits(m[0]) if len(m[0]) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


# Candidates --------------------------------------------------------------------------------------------

_AT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)+", re.I)
_PARTS = re.compile(rf"(?<![0-9])[0-9]{{1,4}}(?:{_DOT}[0-9]{{1,4}}){{3,7}}(?![0-9])", re.I)
_HEXES = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_RUN = re.compile(r"[+(]?[0-9](?:[0-9\x20().,/_-]*[0-9])?")
_PIECE = re.compile(r"[^\x20]+")
_GROUP = re.compile(r"[0-9]+")
#: Digits that a candidate of a kind has.
DIGITS = {"like_card": (13, 19), "like_phone": (7, 15), "like_id": (9, 9)}
_ID = re.compile(r"[0-9]{3}[-./\x20][0-9]{2}[-./\x20][0-9]{4}")
HINT = re.compile(r"[0-9]|@|\b(?:at|dot)\b", re.I)


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal, overlapping ones among them."""
    for m in _SPELLED.finditer(text):
        yield "like_email", *m.span()
    for m in _PARTS.finditer(text):
        yield "like_ip", *m.span()
    for m in _HEXES.finditer(text):
        yield "like_ip", *m.span()
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m[0])]
        # Up to five pieces side by side, which are as many as a number's spelling has; all of a longer run are tried.
        for i, (a, _) in enumerate(pieces):
            n = 0
            for b0, b in pieces[i : i + 5]:
                n += sum(c in "0123456789" for c in text[b0:b]) if b - b0 <= 40 else 99
                if n > 19:
                    break
                for kind, (least, most) in DIGITS.items():
                    if least <= n <= most and (kind != "like_id" or _ID.fullmatch(text, a, b)):
                        yield kind, a, b


#: Words that tell of a kind when they stand before it.
TOLD = {
    "like_email": ("mail", "email", "e-mail", "contact", "write", "address"), "like_ip": ("ip", "host", "server", "address", "from"),
    "like_card": ("card", "visa", "credit", "payment", "account"), "like_phone": ("phone", "tel", "call", "fax", "mobile", "cell"), "like_id": ("ssn", "social", "id", "passport", "tax"),
}
FEATURES = 27


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, ``FEATURES`` numbers."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    low, near = s.lower(), before + after
    last = re.split(r"[^A-Za-z]+", s)[-1]
    edge = (before.rstrip()[-1:] or " ") + (after.lstrip()[:1] or " ")
    return [
        *(float(kind == k) for k in LIKE), float(len(s)), float(len(digits)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(len(set(s) - set("0123456789") - set(low) | set(" ().,/_-[]{}@") & set(s))),
        float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("(") + s.count(")")), float(sum(map(str.isalpha, s))), float(bool(digits) and luhn(digits)),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(s[0] == "+" or digits.startswith("00")), float(len(re.findall(r"\bat\b|\bdot\b|[\[{]", low))),
        float(2 <= len(last) <= 6 and low.endswith(last.lower())), float(any(w in before.lower() for w in TOLD[kind])), float(sum(c.isdigit() for c in edge)), float(before[-1:].isalnum()),
        float(after[:1].isalnum()), sum(map(str.isdigit, near)) / max(1, len(near)), float(len(set(digits))),
    ]


# Weak labels -------------------------------------------------------------------------------------------


def respelled(kind: str, s: str) -> list[str]:
    """Other spellings of what a fixed pattern found."""
    if kind == "email":
        name, _, host = s.partition("@")
        return [f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}", f"{name}(at){host}", f"{name} @ {host}"]
    if kind == "ip":
        return [s.replace(".", "[.]"), s.replace(".", " dot "), s.replace(".", "(.)")]
    digits = only_digits(s)
    if kind == "card":
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours), "_".join(fours), ".".join((digits[:4], digits[4:10], digits[10:]))]
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"00{digits[:-9]} {digits[-9:]}"]


def damaged(kind: str, s: str) -> list[str]:
    """Spellings that look alike and are not personal any more."""
    if kind == "email":
        name, _, host = s.partition("@")
        return [f"{name} at {host.split('.')[0]}. {host.split('.')[-1]}", f"{name}@{host.split('.')[0]}"]
    if kind == "ip":
        parts = s.split(".")
        return [".".join([*parts[:3], str(300 + int(parts[3]))]), "[.]".join([str(256 + int(parts[0])), *parts[1:]]), ".".join([*parts, "0", parts[0]])]
    digits = only_digits(s)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(digits[0]) % 8) % 10)
        return [wrong, *(x for x in respelled("card", wrong))]
    day, month, clock = 1 + int(digits[-2:]) % 28, 1 + int(digits[-3:]) % 12, f"{int(digits[-4:]) % 24:02d}:{int(digits[-3:]) % 60:02d}"
    dates = [f"20{digits[-2:]}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.19{digits[-2:]}", f"{month}/{day}/20{digits[-2:]}", f"20{digits[-2:]}-{month:02d}-{day:02d} {clock}", f"20{digits[-2:]}{month:02d}{day:02d}"]
    return [*dates, f"{digits[-9:-4]}.{digits[-4:]}", f"{digits[-8:]}", f"{digits[-7:-6]},{digits[-6:-3]},{digits[-3:]}"]


def examples(text: str) -> list[tuple[list[float], int]]:
    """Candidates of a text with weak labels, and those of respelled and damaged spans in their places."""
    base, out = base_spans(text), []
    taken = {(a, b) for _, a, b in base}
    for span in candidates(text):
        if span[1:] in taken:
            out.append((features(text, span), 1))
        elif not any(a < span[2] and span[1] < b for a, b in taken):
            out.append((features(text, span), 0))
        if len(out) >= MAX_SPANS // 2:
            break
    for kind, a, b in base:
        if len(out) >= MAX_SPANS:
            break
        before, after = text[max(0, a - NEAR) : a], text[b : b + NEAR]
        for label, forms in ((1, respelled(kind, text[a:b])), (0, damaged(kind, text[a:b]))):
            for form in forms:
                changed = before + form + after
                for span in candidates(changed):
                    whole = span[1] <= len(before) and span[2] >= len(before) + len(form) and span[2] - span[1] <= len(form) + 2
                    inside = len(before) <= span[1] and span[2] <= len(before) + len(form)
                    if whole and (label == 0 or span[0] == f"like_{kind}") or inside and label == 0:
                        out.append((features(changed, span), label))
    return out[:MAX_SPANS]


# Boosted trees -----------------------------------------------------------------------------------------


@dataclass
class Model:
    """Complete trees of ``DEPTH`` levels: split features and thresholds by node, values by leaf; calibration and thresholds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    slope: float
    shift: float
    least: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


NOTHING = Model(np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)), 0.0, 1.0, 0.0, {})


def boosted(x: np.ndarray, y: np.ndarray) -> Model:
    """Newton boosting of the logistic loss, splits from histograms over ``BINS`` quantiles."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    f, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                at = (node - first) * (BINS + 1) + binned[:, k]
                gs = np.bincount(at, g, n * (BINS + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(at, h, n * (BINS + 1)).reshape(n, -1).cumsum(1)
                left, right = gs**2 / (hs + RIDGE), (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + RIDGE)
                gain = (left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + RIDGE))[:, : len(c)]
                b = gain.argmax(1)
                better = gain[np.arange(n), b] > best
                best[better] = gain[np.arange(n), b][better]
                feature[first : first + n][better], threshold[first : first + n][better] = k, c[b][better]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        f += leaf[at]
        trees.append((feature, threshold, leaf))
    return Model(*(np.array(t) for t in zip(*trees, strict=True)), start, 1.0, 0.0, {})


def calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Slope and shift of the least log loss on rows set aside, by Newton steps, and each kind's threshold."""
    m, w = model.margin(x), np.array([1.0, 0.0])
    design = np.stack([m, np.ones(len(m))], 1)
    # Smoothed targets keep scores off 0 and 1 where examples are told apart without a fault.
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hessian, design.T @ (t - p) - 1e-3 * (w - [1.0, 0.0]))
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])
    p = model.probability(x)
    for k, kind in enumerate(LIKE):
        mine = np.flatnonzero(x[:, k] > 0)
        order = mine[np.argsort(-p[mine], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        # Equal scores are taken together.
        ends = np.append(p[order][:-1] != p[order][1:], True) if len(order) else np.zeros(0, bool)
        good = np.flatnonzero(ends & (right >= PRECISION) & (p[order] >= 0.5))
        if len(good):
            below = p[order][good[-1] + 1 :]
            model.least[kind] = max(0.5, float(p[order][good[-1]] + (below[0] if len(below) else 0.0)) / 2)
    return model


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from weak labels of at most ``MAX_DOCS`` distinct texts, those with the smallest hash."""
    small_batches(docs.sparkSession)
    hinted = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"@|[0-9][0-9 ().-]{5,}[0-9]|[0-9]\.[0-9]"))
    once = hinted.groupBy(F.xxhash64("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    chosen = materialize(once.orderBy("hash", "doc_id").limit(MAX_DOCS), "pii-sample")
    rows = hinted.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), ["hash", "doc_id"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [examples(t) for t in b.column(1).to_pylist()]
            x = [[v for f, _ in e for v in f] for e in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32())), pa.array([[y for _, y in e] for e in found], pa.list_(pa.int8()))], ["hash", "x", "y"])

    told = rows.select("hash", "text").mapInArrow(learn, "hash long, x array<float>, y array<byte>").dropDuplicates(["hash"]).orderBy("hash").limit(MAX_DOCS).toArrow()
    x = [np.asarray(v.values, np.float64).reshape(-1, FEATURES) for v in told["x"]]
    y = [np.asarray(v.values, np.float64) for v in told["y"]]
    learnt, aside = [k for k in range(len(x)) if k % 4], list(range(0, len(x), 4))
    if not learnt or not sum(len(y[k]) for k in learnt) or not sum(len(y[k]) for k in aside):
        return NOTHING
    at = lambda ks: (np.concatenate([x[k] for k in ks]), np.concatenate([y[k] for k in ks]))
    return calibrated(boosted(*at(learnt)), *at(aside))


# The operator ------------------------------------------------------------------------------------------


def selected(texts: list[str | None], model: Model) -> list[list[Span]]:
    """All spans of each text by kind as listed, then start: those of the fixed patterns, and the candidates that the model selects."""
    out, asked, owner = [], [], []
    for k, text in enumerate(texts):
        if not text or not HINT.search(text):
            out.append([])
            continue
        base = base_spans(text)
        out.append(base)
        if model.least:
            taken = sorted((a, b) for _, a, b in base)
            starts = [a for a, _ in taken]
            for span in candidates(text):
                if span[0] in model.least and not _hit(taken, starts, span):
                    asked.append((k, span))
                    owner.append(features(text, span))
    if asked:
        p = model.probability(np.array(owner))
        chosen: dict[int, list[tuple[float, int, int, str, int]]] = {}
        for (k, (kind, a, b)), score in zip(asked, p, strict=True):
            if score >= model.least[kind]:
                chosen.setdefault(k, []).append((-float(score), a - b, a, kind, b))
        for k, found in chosen.items():
            kept: list[tuple[int, int, str]] = []
            for _, _, a, kind, b in sorted(found):
                at = bisect_left(kept, (a,))
                if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                    kept.insert(at, (a, b, kind))
            out[k] = out[k] + sorted(((kind, a, b) for a, b, kind in kept), key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def _hit(taken: list[tuple[int, int]], starts: list[int], span: Span) -> bool:
    """Whether a fixed pattern's span overlaps; those that begin before the candidate's end are looked at backwards, at most one a kind."""
    at = bisect_left(starts, span[2])
    return any(b > span[1] for _, b in taken[max(0, at - 2 * len(BASE)) : at])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans, and the number of those that the model added."""
    data = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(data)
        for b in batches:
            found = selected(b.column(1).to_pylist(), trees)
            counts = [[sum(s[0] == k for s in spans) for spans in found] for k in BASE]
            base = [hashlib.sha256(joined([s for s in spans if s[0] in BASE]).encode()).hexdigest() for spans in found]
            added = [sum(s[0] in LIKE for s in spans) for spans in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(map(joined, found), pa.string()), pa.array(added, pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span as its kind in brackets; spans that overlap become one of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"[{kind.removeprefix('like_').upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` in its own columns with all spans of the text replaced."""
    data = pickle.dumps(model)

    @F.pandas_udf(StringType())
    def clean(text: pd.Series) -> pd.Series:
        found = selected(list(text), pickle.loads(data))
        return pd.Series([redacted(t, s) if t is not None else None for t, s in zip(text, found, strict=True)], dtype=object)

    return docs.select(*(clean("text").alias("text") if name == "text" else c for name, c in zip(docs.columns, columns(docs), strict=True)))
