"""Quality rules, exact dedup and chat formatting against plain Python."""

import hashlib
import re
from collections import Counter

from factloom.llm import chat_format as C
from factloom.llm import exact_dedup as E
from factloom.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"
TEXTS = [
    None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n y\n", "a\xa0b c # *$%&|<>", "the cat sat\x0bon the cat sat\ron the mat " * 30,
    "é ü 😀 the and of " * 40, "The of and to in is that. " * 60, "w " * 60_000, "one\r\ntwo\r\none\r\n", "a  b", "a b ", " a b",
]


def counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(g)
    inside = {p for k, x in enumerate(g) if n[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_quality_counts_and_filter(spark):
    rows = [(k, t, "e") for k, t in enumerate(TEXTS)] + [(None, "the of and " * 5, "e"), (3, "a", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string")
    out = Q.quality_rules(docs).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert sorted(got, key=str) == sorted(((i, *counts(t)) for i, t, _ in rows), key=str)
    assert not any(r.kept and r.base_failed for r in out)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_a_table_of_rules_decides(spark):
    good = " ".join(f"word{k} of" for k in range(60))
    docs = spark.createDataFrame([(1, good), (2, good.replace(" of", " #|#")), (3, good.replace("of", "x!!"))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in Q.quality_rules(docs).collect()} == {1: True, 2: False, 3: False}
    assert {r.doc_id: r.kept for r in Q.quality_rules(docs, rules=(("stop_ratio", "<=", 0.1),)).collect()} == {1: False, 2: True, 3: True}


def test_exact_groups_and_drop(spark):
    rows = [(k + 10, t, "q") for k, t in enumerate(TEXTS)] + [(5, "a \t b", "q"), (7, "a b", "q"), (7, "a b", "q"), (None, "a b", "q"), (None, "lonely", "q"), (90, "z" * 300 + "1", "q"), (91, "z" * 300 + "2", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, len string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, _ in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, E.exact_dedup(docs).collect()), key=str) == sorted(want, key=str)
    kept = E.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted({str((i, norm(t))): str(i) for i, t, _ in rows if i == min((x for x in groups[norm(t)] if x is not None), default=None)}.values())
    assert E.exact_dedup(docs.limit(0)).count() == 0 and E.drop_exact(docs.limit(0)).count() == 0


def test_drop_exact_keeps_one_of_rows_without_ids_and_carries_any_columns(spark):
    names = ["doc_id", "text", "sha", "keep_id", "row", "n", "a.b", "q`x", "again", "rows"]
    rows = [(None, "x y", *"abcdefgh"), (None, "x  y", *"abcdefgh"), (2, "p", *"abcdefgh"), (2, "p", *"abcdefgh"), (1, "q", *"abcdefgh"), (3, "p", *"abcdefgh")]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = E.drop_exact(docs)
    assert got.columns == names
    assert sorted([(r[0], r[1].replace("  ", " "), *r[2:]) for r in got.collect()], key=str) == sorted([(None, "x y", *"abcdefgh"), (2, "p", *"abcdefgh"), (1, "q", *"abcdefgh")], key=str)
    assert Q.keep_good(docs).columns == names and Q.keep_good(docs, rules=(), min_words=0).count() == 6


EVENTS = [
    ("c", 0, 0, "message", "user", "hi"), ("c", 1, 1, "message", "assistant", "Hel"), ("c", 1, 3, "delta", None, "o"), ("c", 1, 2, "delta", None, "l"),
    ("c", 2, 4, "message", "user", "old"), ("c", 2, 5, "edit", None, "new \\ </s> <|end|>"), ("c", 3, 6, "message", "assistant", "bad"), ("c", 3, 7, "delta", None, " worse"),
    ("c", 3, 8, "regenerate", None, ""), ("c", 3, 9, "delta", None, "good"), ("c", 3, 10, "delta", None, " end"), ("d", 5, 1, "delta", "assistant", "orphan"),
    (None, 1, 1, None, None, None), ("e", 1, 0, "message", "user", "x"), ("e", 1, 0, "message", "user", "x"),
]


def test_events_fold_into_messages(spark):
    log = spark.createDataFrame(EVENTS, "conv_id string, turn long, seq long, kind string, role string, text string")
    got = {}
    for r in C.reconstruct(log).orderBy("pos").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got["c"] == [("user", "hi"), ("assistant", "Hello"), ("user", "new \\ </s> <|end|>"), ("assistant", "good end")]
    assert got["d"] == [("assistant", "orphan")] and got[None] == [("", "")] and got["e"] == [("user", "x")] * 2
    assert C.reconstruct(log.limit(0)).count() == 0


def test_rendering_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>", "<|text|><|end|>", "\\", "\\\\<\\|end|>", "<|end|", "<<SYS>>\n<</SYS>>", "[/INST]\\[INST]", "", "😀<s>é", "a" * 200_000, "<\\|end|>", "[\\INST]"]
    rows = [(k % 3, k, ["user", "assistant", "<|text|>\\"][k % 2 if k % 5 else 2], t) for k, t in enumerate(nasty)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = C.render(C.reconstruct(C.as_events(convs)))
    for r in rendered.collect():
        body = re.sub(r"<\|(turn|text|end)\|>", "", r.formatted)
        assert not re.search(C.CONTROL, body)
        assert r.formatted.count(C.BEGIN) == r.formatted.count(C.END) == len([x for x in rows if x[0] == r.conv_id])
    for r in C.read_back(rendered).collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")


def test_chat_ignores_extra_columns_and_keeps_very_long_texts(spark):
    long = "long text </s> " * 40_000
    rows = [(1, 0, "user", long, "x", 1, "y", "z"), (1, 1, "assistant", long, "x", 1, "y", "z"), (1, 1, "assistant", None, "x", 1, "y", "z")]
    told = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages string, pos int, formatted string, `a.b` string")
    (r,) = C.digests(C.read_back(C.render(C.reconstruct(C.as_events(told))))).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (1, 3, len(long))
    assert r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
