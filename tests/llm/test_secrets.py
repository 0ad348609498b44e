import hashlib
import itertools
import math
import random
import re

from factloom.llm import secrets as S


def plain_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_base_spans_equal_plain_patterns(spark):
    r = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", ":", "=", " ", "  ", '"', "'", "abc123", "AKIA", "ABCD0123456789EFGH", "deadbeef" * 3, "0a" * 11, "é", "\n", "x", "pwd=", "Zq8#kL2!vN9@"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for k in range(400)] + [(900, None), (901, ""), (901, "")]
    got = S.find_secrets(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n_hex int")).collect()
    assert len(got) == len(rows)
    want = sorted((i, S.joined(b := plain_base(t or "")), hashlib.sha256(S.joined(b).encode()).hexdigest(), len([x for x in b if x[0] == "hex"])) for i, t in rows)
    assert sorted((g.doc_id, ",".join(x for x in g.spans.split(",") if x and not x.startswith("guess")), g.base_sha256, g.n_hex) for g in got) == want


def test_guess_cost_decides_in_contexts():
    strong, weak = 'db_password_main = "vX9#qT2$Lm7!"', 'my_auth: "password2024"'
    assert [k for k, *_ in S.scan(strong)] == ["guess"]
    assert S.scan(weak) == [] and S.scan("pwd: qwertyuiop") == [] and S.scan("credential=zzzzzzzzzzzzzzzzzzzzzzzz") == []
    a, b = S.scan(strong)[0][1:]
    assert strong[a:b] == "vX9#qT2$Lm7!"


def brute_cost(value):
    """Minimum over all segmentations, by enumeration of cut sets."""
    spans = S.Spans(value)
    edges = {}
    for i in range(len(value)):
        edges[i, i + 1] = S.brute(value[i])
        for j, c in spans.at(i):
            edges[i, j] = min(edges.get((i, j), math.inf), c + S.SPAN_PRICE)
    best = math.inf
    for n in range(len(value)):
        for cuts in itertools.combinations(range(1, len(value)), n):
            ends = [0, *cuts, len(value)]
            best = min(best, sum(edges.get(e, math.inf) for e in zip(ends, ends[1:], strict=False)))
    return best


def test_dynamic_programme_is_the_least_segmentation():
    for value in ("pass1999", "abcabcabc", "qwer2020aa", "Adm1nXz", "x9$kpass", "20240131z"):
        assert math.isclose(S.log_guesses(value), brute_cost(value))


def plain_spans(value):
    """Walks and repeats by plain loops."""
    lower, out = value.lower(), set()
    for i in range(len(value)):
        j = i + 1
        while j < len(value) and lower[j - 1] + lower[j] in S.NEXT:
            j += 1
        if j - i >= 3:
            out.add((i, j, round(math.log10(40) + math.log10(j - i), 9)))
        for n in (1, 2, 3, 4):
            unit, j = value[i : i + n], i + n
            while len(unit) == n and value.startswith(unit, j):
                j += n
            if j - i >= max(3, 2 * n):
                out.add((i, j, round(sum(map(S.brute, unit)) + math.log10((j - i) // n), 9)))
    return out


def test_runs_end_where_plain_loops_end(monkeypatch):
    monkeypatch.setattr(S, "RANK", {})
    r = random.Random(1)
    for _ in range(200):
        value = "".join(r.choice(["a", "b$", "qwe", "xyxy", "77777", "abcabc", "9"]) for _ in range(r.randint(1, 30)))
        spans = S.Spans(value)
        assert {(i, j, round(c, 9)) for i in range(len(value)) for j, c in spans.at(i) if not S.DATE.match(value, i)} >= {x for x in plain_spans(value) if not S.DATE.match(value, x[0])}


def test_long_values_are_costed_whole_and_empty_tables_work(spark):
    for value, cost in (("ab1!" * 128, 7.7557), ("xY7$" * 200, 7.9495)):  # a repeat is one span however long it is
        assert math.isclose(S.log_guesses(value), cost, abs_tol=1e-3) and S.scan(f"pwd={value}") == []
    assert S.scan("SECRET_KEY_BASE_PRODUCTION_ENV=vX9#qT2$Lm7! DB_PASSWORD_2=Zx81-kQp_77vB api-key: q8Zt!!4kLw0pX") == [("guess", 31, 43), ("guess", 58, 71), ("guess", 81, 94)]
    assert [k for k, *_ in S.scan("url=https://host?token=Zx81$kQp%77vB&x")] == ["guess"]
    assert S.scan("pass" * 50_000) == []
    assert S.log_guesses("a" * 10_000) < S.log_guesses("".join(random.Random(1).choices("abcdefghij0123456789", k=300)))
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "token=abc123xyz", 1)], "doc_id long, text string, spans int")
    assert [(r.doc_id, r.n_assign) for r in S.find_secrets(odd).collect()] == [(None, 1)]
