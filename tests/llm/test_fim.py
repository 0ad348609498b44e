import hashlib
import random
import re

import numpy as np

from factloom.llm import fim as M

NAMES = "doc_id long, text string, n string, form string, `a.b` int, chars int, sha string"


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return (doc_id, n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}")


def texts():
    r = random.Random(5)
    bits = ["a", "é", "\n", "\n\n", "<", "P>", "<S", ">", "<M>", "word ", "\r\n", "\U0001f600", "\0", "  "]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for k in range(300)]
    copies = [(1000 + k, "one\ntwo\nthree\nfour") for k in range(200)]
    return rows + copies + [(None, None), (None, "x\ny"), (7, rows[7][1]), (7, "other\ntext"), (2000, ""), (2001, "\n" * 5000), (2002, "long line " * 30_000 + "\nend"), (2003, "l\n" * 100_000)]


def test_equals_brute_force_and_comes_back(spark):
    rows = texts()
    docs = spark.createDataFrame([(*x, "u", "v", 1, 2, "w") for x in rows], NAMES)
    made = M.fill_in_middle(docs)
    want = sorted((plain(*x) for x in rows), key=repr)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == want
    told = M.digests(made).select("output_sha256", "restored_sha256").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(tuple(r) for r in told) == sorted((digest(w[-1]), digest(x[1] or "")) for w, x in zip([plain(*x) for x in rows], rows, strict=True))


def test_index_has_one_list_per_text(spark):
    rows = texts()
    index = M.distinct_index(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {bytes(r.sha): r for r in index}
    distinct = {t or "" for _, t in rows}
    assert len(index) == len(by) == len(distinct)
    for t in distinct:
        r = by[hashlib.sha256(t.encode()).digest()]
        ends = M.line_ends(t)
        assert r.n == len(ends) and r.chars == len(t) and M.encoded(ends) == bytes(r.ends)
        assert len(r.ends) <= 8 + r.n * (3 + np.log2(max(1, len(t) / max(1, r.n)))) / 8


def test_elias_fano_lists():
    r = random.Random(1)
    for n, top in ((1, 1), (1, 10**9), (2, 5), (64, 64), (1000, 1000), (1000, 10**7), (777, 123_456)):
        ends = np.array(sorted(r.sample(range(1, top + 1), n)), np.int64)
        data = M.encoded(ends)
        assert [M.selected(data, k) for k in range(n + 1)] == [0, *ends.tolist()]
    assert M.selected(M.encoded(np.array([], np.int64)), 0) == 0


def test_rates_and_empty_table(spark):
    docs = spark.createDataFrame([(k, f"a{k}\nb\nc") for k in range(300)], "doc_id long, text string")
    forms = {r.form: r["count"] for r in M.fill_in_middle(docs, rate=40, spm_rate=100).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 80 < forms["spm"] < 160
    empty = M.digests(M.fill_in_middle(docs.limit(0)))
    assert empty.count() == 0 and "restored_sha256" in empty.columns
