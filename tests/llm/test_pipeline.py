"""The pipeline against its stages by plain Python and the tokenizer's library, with mixing that drops rows."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from factloom.llm import mixing
from factloom.llm import quality_rules as Q

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "kept", "row", "sha", "seed", "a.b"]
STOP = "the of and to in is that it for was".split()


def make(seed=7):
    r = random.Random(seed)
    text = lambda kind, n=120: " ".join(r.choice(STOP) if k % 3 else f"{kind}{r.randrange(3)}" if k % 5 == 0 else f"w{r.randrange(5000)}" for k in range(n))
    kinds = ["good"] * 40 + ["poor"] * 50 + ["toxic"] * 20
    base = [text(k) for k in kinds]
    near = base[0].split()
    near[60] = "changed"
    rows = list(enumerate(base)) + [
        (200, base[3].replace(" ", "\n")), (201, " ".join(near)), (202, "!!! ### $$$ " * 60), (203, None), (204, ""), (5, base[5]), (5, text("good")),
        (None, text("good")), (None, base[7]), (205, text("good", 15_000)), (206, base[1] + " and then some"), (207, base[1] + " and then some"),
    ]
    labels = [(k, int(kind != "poor"), int(kind == "toxic")) for k, kind in enumerate(kinds)]
    return rows, labels


@pytest.fixture()
def corpus(spark, tmp_path):
    rows, labels = make()
    types = {"doc_id": "long", "n_chars": "long"}
    full = [(i, t, "en", "s", len(t or ""), "x", None, "y", "z", "w") for i, t in rows]
    spark.createDataFrame(full, ", ".join(f"`{n}` {types.get(n, 'string')}" for n in NAMES)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def accepted(t):
    """The quality rules of the texts above, in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    stops = sum(w.lower() in Q.STOP_WORDS for w in words)
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    return len(words) >= 50 and stops >= 0.02 * len(words) and symbols <= 0.2 * len(words) and t.count("!") <= 0.5 * len(words)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def deduplicated(rows):
    exact = {}
    for i, t in rows:
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((i is None, i or 0, i, t))
    left = [min(g, key=lambda x: x[:2])[2:] for g in exact.values()]
    sets = [(i, shingles(t)) for i, t in left]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [(i, t) for i, t in left if i is None or find(i) == i]


def test_pipeline_equals_its_stages_in_plain_python(spark, corpus):
    sf, rows = corpus
    kept = deduplicated([(i, t) for i, t in rows if accepted(t)])
    table = spark.createDataFrame(kept, "doc_id long, text string")
    copies = {(r.doc_id, r.tokens): r.copies for r in mixing.mix(table, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    mixed = [(i, t) for i, t in kept if copies[i, len(t.split())]]
    good = [i for i, t in kept if "good" in t]
    assert len(mixed) < len(kept) - 10 and {i for i in good if i is not None} <= {i for i, _ in mixed}  # over-represented domains are thinned, clean documents stay
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in mixed:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_stages_return_the_columns_of_documents(spark, corpus):
    sf, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == NAMES
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
