import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def texts(n=120):
    r = random.Random(4)
    pieces = ["the", "Cat", "I'll", "won't", "é", "é", "́x", "\xa0", "　", "\x85", "\x1c", "\t", "\n", " ", "  ", "12", "3.5", "<|endoftext|>", "<|startoftext|>x", "Σς", "ΑΣ", "İ", "世界", "😀", "!!!", "a" * 80, "J̌", "ÀB", "ß", "×9", "l'été", "x²", "<|ENDOFTEXT|>", "¡Sí,"]
    return [(k, " ".join(r.choice(pieces) + r.choice(["", *pieces]) for _ in range(r.randint(0, 60)))) for k in range(n)]


def test_files_hold_what_the_library_gives(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_MB", 0.002)
    rows = texts() + [(1000, None), (1001, ""), (1002, "word " * 30_000), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, start int")
    uri, digest, manifest = T.write_store(docs)
    assert manifest.count() > 1 and digest
    got = sorted(map(tuple, T.read_store(uri, manifest).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    shards = {r.first_id: r.shard for r in manifest.collect()}
    for i, start, n, crc in got[1:60]:
        shard = shards[max(f for f in shards if f <= i)]
        ids = T.read_document(uri, shard, i)
        assert len(ids) == 4 * n and zlib.crc32(ids) == crc
    assert T.read_document(uri, next(iter(shards.values())), 10**9) is None


def test_few_rows_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (0, "b c")], "doc_id long, text string")
    uri, digest, manifest = T.write_store(docs)
    assert digest == ""
    assert sorted(r.start for r in T.read_store(uri, manifest).collect()) == [0, 3, 5]
    uri, _, manifest = T.write_store(docs.limit(0))
    assert T.read_store(uri, manifest).count() == 0


def test_the_library_is_asked_once_for_a_part():
    class Recorder:
        def __init__(self, lean):
            self.lean, self.asked = lean, []

        def encode_batch_fast(self, texts, **options):
            self.asked += texts[0].split()
            return self.lean.encode_batch_fast(texts, **options)

    t = T.WordTokenizer(PATH)
    t.lean = r = Recorder(t.lean)
    t.encode_all([b"stone word, \xc3\xa9t\xc3\xa9", b""])
    t.encode_all([b"(word) Stone. stone's \xc3\xa9t\xc3\xa9!", b"word2 2"])
    assert sorted(r.asked) == sorted(set(r.asked)) and len(r.asked) > 8


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 40)
    monkeypatch.setattr(T, "CACHE_BYTES", 4)
    monkeypatch.setattr(T, "TOGETHER", 7)
    library, t = Tokenizer.from_file(PATH), T.WordTokenizer(PATH)
    some = [x for _, x in texts()] + ["", " \t\n", "é" * 50, "世" * 50, "\x00 \x7f\x1c", "a\x0bb\x0cc\r\nd"]
    for k in range(0, len(some), 10):
        got = t.encode_all([x.encode() for x in some[k : k + 10]])
        assert got == [struct.pack(f"<{len(i)}I", *i) for i in (library.encode(x, add_special_tokens=False).ids for x in some[k : k + 10])]
        assert all(len(x.as_py().encode()) <= 4 for c in (t.words, t.parts) for x in c.texts)
    assert t.encode_all([]) == [] and t.encode_all([b""]) == [b""]
