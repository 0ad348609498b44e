import hashlib
import random
import re
import time

import numpy as np
import pytest

from factloom.llm import pii as M

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    total = sum(int(c) if k % 2 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and check_digit(d[:-1]) == d[-1]
    return kind == "email" or 9 <= len(d) <= 15


def plain_base(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])]


def corpus(n=700, seed=2):
    r = random.Random(seed)
    words = [f"word{chr(97 + k)}" for k in range(26)]
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + digits(14)
        return d + check_digit(d)

    def piece():
        return r.choice([
            lambda: f"{r.choice('abc')}{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)), card,
            lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: digits(3), lambda: f"20{digits(2)}-0{r.randrange(1, 9)}-1{r.randrange(9)}", lambda: digits(8),
        ])()

    return [(k, " ".join(piece() if r.random() < 0.06 else r.choice(words) for _ in range(r.randint(5, 80)))) for k in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return M.fit(spark.createDataFrame(corpus(), "doc_id long, text string"))


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    bits = ["a", "b.c", "@", ".", "example", "1", "25", "255", "256", "4111111111111111", "4111", " ", "-", "+", "(", ")", "_", "%", "é", "\n", "٣", "0" * 30, "a@b.c", "1.2.3.4", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert M.base_spans(text) == plain_base(text), text


def test_query_rows(spark, model):
    rows = [*corpus(60, 9), (None, None), (1, ""), (1, "x@y.zz " * 30_000), (3, "call +1 (017) 555-7713"), (3, "call +1 (017) 555-7713")]
    docs = spark.createDataFrame([(*x, "k", 0) for x in rows], "doc_id long, text string, `spans.x` string, n_ip int")
    got = M.find_personal(docs, model).collect()
    want = [(i, *(sum(s[0] == k for s in b) for k in M.BASE), hashlib.sha256(M.joined(b).encode()).hexdigest()) for i, t in rows for b in [plain_base(t or "")]]
    assert sorted((tuple(g)[:6] for g in got), key=repr) == sorted(want, key=repr)
    assert all(g.spans.split(",")[: g.n_email + g.n_ip + g.n_card + g.n_phone] == M.joined(plain_base(t or "")).split(",")[: g.n_email + g.n_ip + g.n_card + g.n_phone] for g, (_, t) in zip(got, rows, strict=True))
    assert M.find_personal(docs.limit(0), model).count() == 0


def test_model_adds_respelled_spans_and_leaves_others(model):
    r = random.Random(8)
    number = "4" + "".join(r.choice("0123456789") for _ in range(14))
    fours = number + check_digit(number)
    wrong = number + str((int(check_digit(number)) + 3) % 10)
    dots = lambda d: ".".join(d[k : k + 4] for k in range(0, 16, 4))
    for text, kind, found in (
        ("worda wordb joe.x12 [at] mail7 [dot] example [dot] com wordc", "like_email", "joe.x12 [at] mail7 [dot] example [dot] com"),
        ("worda 10[.]20[.]33[.]44 wordb", "like_ip", "10[.]20[.]33[.]44"), (f"worda {dots(fours)} wordb", "like_card", dots(fours)), ("worda (743) 555-3824 wordb", "like_phone", "(743) 555-3824"),
    ):
        [(k, a, b)] = M.selected([text], model)[0]
        assert (k, text[a:b]) == (kind, found)
        assert M.redacted(text, [(k, a, b)]) == text[:a] + f"[{kind[5:].upper()}]" + text[b:]
    for clean in (f"worda {dots(wrong)} wordb", "worda 2024-05-06 wordb", "worda 1 2 3 wordb 4.5", "we met at noon. dot and so on", f"worda {wrong} wordb", "worda 300[.]20[.]33[.]44 wordb"):
        assert M.selected([clean], model)[0] == [], clean


def test_held_out_candidates(model):
    told = [e for _, t in corpus(300, 77) for e in M.examples(t)]
    x, y = np.array([f for f, _ in told]), np.array([label for _, label in told])
    p = model.probability(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97
    bins = [(p[m].mean(), y[m].mean()) for k in range(5) if (m := (p >= k / 5) & (p < (k + 1) / 5 + (k == 4))).sum() > 200]
    assert all(abs(a - b) < 0.12 for a, b in bins)


def test_spans_of_a_text_do_not_overlap(model):
    for _, text in corpus(200, 5):
        spans = M.selected([text + " (743) 555-3824 10[.]2[.]3[.]4"], model)[0]
        for kind, a, b in spans:
            assert kind in M.BASE or not any((c, d) != (a, b) and c < b and a < d for _, c, d in spans)


def test_time_is_in_proportion(model):
    for text in ("a" * 300_000, "1" * 300_000, "+" + "(" * 300_000, "1 " * 50_000, "a@" * 100_000, "1." * 50_000, "a at " * 50_000, "a at b" + " dot c" * 40_000, "1[.]" * 50_000, "ab:" * 60_000):
        start = time.perf_counter()
        M.selected([text], model)
        assert time.perf_counter() - start < 10, text[:10]


def test_redact_keeps_columns_and_nothing_to_learn_from(spark, model):
    docs = spark.createDataFrame([(1, "x", "mail a@b.cc now", 2), (2, "y", None, 3)], "doc_id long, `a.b` string, text string, found int")
    out = M.redact(docs, model)
    assert out.columns == docs.columns and [r.text for r in out.orderBy("doc_id").collect()] == ["mail [EMAIL] now", None]
    none = M.fit(docs.where("doc_id > 9"))
    assert none.least == {} and M.selected(["a@b.cc (743) 555-3824"], none) == [[("email", 0, 6)]]
