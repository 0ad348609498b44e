"""Secret scans: fixed patterns, and guess cost of the values in credential contexts.

Values after credential words are cut into words, dates, repeats, keyboard walks and brute-force spans by
dynamic programming over positions: the cheapest sequence of spans (a sum of log10 guesses plus a small
price per span) is the number of guesses that an informed attacker needs. A value that costs at least
``MIN_LOG_GUESSES`` is a secret; "changeme2024" is not. Such values become spans of kind ``guess``; spans of the
fixed patterns always stay.

Edge cases: null text is empty and has no spans; a null doc_id is carried through; offsets are code points, ends
exclusive; very long values are searched whole, in time in proportion to their length; repeated rows give
repeated rows, each judged by itself, so ties do not matter; an empty table gives no rows; extra columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Fixed patterns; letters of the credential words in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of fewer than 24 characters would be dropped, so they are not matched.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Contexts whose values are judged by guess cost: an identifier that holds a credential word, a sign and a value. It
#: is tried from its first character only, so time stays linear for identifiers of any length.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?:pass|pwd|secret|token|credential|(?:api|access|private)[_-]?key|auth))([A-Za-z0-9_-]++)["']?\x20*+(?::=|=>|[:=])\x20*+["'`]?([^\s"'`,;]+)""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth")

MIN_LOG_GUESSES = 10.0
SPAN_PRICE = 0.3
#: Longest unit of a repeat.
LONGEST_UNIT = 4
#: Values that a worker remembers the cost of, and the longest of them; they bound memory only.
REMEMBERED, SHORT = 20_000, 64

#: Common parts of weak passwords, by rank.
WORDS = (
    "password pass admin root user test guest login welcome secret qwerty letmein changeme default monkey dragon master hello sunshine "
    "princess football baseball shadow superman batman trustno iloveyou love summer winter spring autumn access token key value example "
    "sample dummy null none true false your here insert placeholder xxxx todo config server prod dev staging data base database account "
    "company system public private string number change this that with from the and for you not are abc"
).split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
#: Rows of the usual keyboards and ordered alphabets.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {a + b for r in ROWS for a, b in zip(r, r[1:], strict=False)} | {b + a for r in ROWS for a, b in zip(r, r[1:], strict=False)}
LEET = str.maketrans("4301$5@7", "aeoissat")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def brute(c: str) -> float:
    """log10 of the choices for one character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 3.0


def runs(same: list[bool]) -> list[int]:
    """For each place the number of true values from there on without a gap."""
    out = [0] * (len(same) + 1)
    for i in range(len(same) - 1, -1, -1):
        out[i] = out[i + 1] + 1 if same[i] else 0
    return out


class Spans:
    """The structured spans of a value, as (end, log10 guesses) by their begin.

    Walks and repeats end where their run ends; run lengths are counted once from behind, so all spans of a value of any
    length are found in time in proportion to it.
    """

    def __init__(self, value: str):
        self.value = value
        self.lower = value.lower() if len(value.lower()) == len(value) else value
        self.plain = self.lower.translate(LEET)
        self.walk = runs([a + b in NEXT for a, b in zip(self.lower, self.lower[1:], strict=False)])
        self.again = [runs([a == b for a, b in zip(value, value[n:], strict=False)]) for n in range(1, LONGEST_UNIT + 1)]

    def at(self, i: int) -> Iterator[tuple[int, float]]:
        value = self.value
        for n in range(3, min(LONGEST_WORD, len(value) - i) + 1):
            for form, extra in ((self.lower, 0.0), (self.plain, 0.5)):
                if rank := RANK.get(form[i : i + n]):
                    part = value[i : i + n]
                    case = 0.0 if part.islower() else 0.3 if part[1:].islower() or part.isupper() else n * math.log10(2)
                    yield i + n, math.log10(rank) + case + extra
                    break
        if m := DATE.match(value, i):
            yield m.end(), math.log10(365 * 80) if m.end() - i > 4 else math.log10(120)
        walked = self.walk[i] + 1
        if walked >= 3:
            yield i + walked, math.log10(40) + math.log10(walked)
        for n, again in enumerate(self.again, 1):
            times = 1 + again[i] // n if i < len(again) else 1
            if n * times >= max(3, 2 * n):
                yield i + n * times, sum(map(brute, value[i : i + n])) + math.log10(times)


def log_guesses(value: str) -> float:
    """Least total of log10 guesses over all segmentations of the whole ``value``, of any length."""
    return _remembered(value) if len(value) <= SHORT else _log_guesses(value)


def _log_guesses(value: str) -> float:
    spans = Spans(value)
    best = [0.0] + [math.inf] * len(value)
    for i in range(len(value)):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute(value[i]))
        for j, cost in spans.at(i):
            best[j] = min(best[j], here + cost + SPAN_PRICE)
    return best[-1]


_remembered = lru_cache(REMEMBERED)(_log_guesses)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind; base kinds first of equal starts."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        taken = {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
        found += [("guess", *m.span(2)) for m in CONTEXT.finditer(text) if m.span(2) not in taken and log_guesses(m[2]) >= MIN_LOG_GUESSES]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans and the number of method spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for x in b.column(1):
                spans = scan(x.as_py())
                base = [s for s in spans if s[0] != "guess"]
                kinds = [s[0] for s in spans]
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count("guess"))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
