"""Token-ID files: shared zstandard dictionary, one frame per document, offset index.

A shard file is ``frames | index | footer``. The index has, per document in ascending doc_id order,
(doc_id, frame offset, frame length, number of ids) as little-endian signed 64-bit integers; the footer is
(index offset, documents, first 8 bytes of the dictionary's SHA-256, magic). The dictionary itself lies
beside the shards as ``dict-<hash>.zdict``, so any document is one footer read, one index search and one
frame read away (``read_document``).

The dictionary is trained on serialized id arrays of a bounded sample (``SAMPLE_DOCS`` documents, at most
``SAMPLE_IDS`` ids each; it affects sizes only). All documents are encoded whole.

Files go to the shared folder under names unique to the task attempt; only shards named in the manifest
written by Spark count, so lost executors and repeated attempts leave no trace in the result.

Edge cases: null text is empty and gets the end id alone; a null doc_id sorts first and is stored as
-2^63; equal doc_ids are kept as they are, ordered by the hash of their frames; very long texts are one frame; an empty
table gives no shard; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, file_system, fresh_dir, materialize, small_batches

MAGIC = b"TOKZ0001"
END_ID = 2
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 2000, 4096, 65536
#: Words (and as many parts of words) that a Python worker remembers, and the bytes of the longest such word; they bound memory only.
CACHE_WORDS, CACHE_BYTES = 500_000, 64
#: Words or parts that the library encodes in one call.
TOGETHER = 2000
#: Printable ASCII and precomposed Latin letters: NFC leaves them as they are, and case folds letter by letter.
PLAIN = r"^[!-~À-ÖØ-öø-ÿ]*$"
PLAIN_TEXT = re.compile(r"[\x20\x09-\x0D!-~À-ÖØ-öø-ÿ]*").fullmatch
#: Fixed value: the pattern of the vocabulary's file, for lower-case words of plain characters.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n").findall
NULL_ID = -(1 << 63)
#: Documents per batch that a worker returns.
SLICE = 2048
#: Compressed frames gathered before they are written.
SHARD_MB = 64


class Known:
    """Distinct strings and their ids (little-endian unsigned 32-bit integers), as Arrow columns; ``learn`` gives the ids of new ones."""

    def __init__(self, learn: Callable[[pa.StringArray], pa.LargeBinaryArray]):
        self.learn, self.texts, self.ids = learn, pa.array([], pa.string()), pa.array([], pa.large_binary())

    def ids_of(self, asked: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct strings; what this call used stays when there are too many."""
        at = pc.index_in(asked, value_set=self.texts)
        if not at.null_count:
            return self.ids.take(at)
        new = asked.filter(at.is_null())
        texts, ids = pa.concat_arrays([self.texts, new]), pa.concat_arrays([self.ids, self.learn(new)])
        at = pc.replace_with_mask(at, at.is_null(), pa.array(np.arange(len(self.texts), len(texts)), pa.int32()))
        found = ids.take(at)
        if len(texts) > CACHE_WORDS:
            texts, ids = asked, found
        short = pc.less_equal(pc.binary_length(texts), CACHE_BYTES)
        if not pc.all(short).as_py():
            texts, ids = texts.filter(short), ids.filter(short)
        self.texts, self.ids = texts, ids
        return found


class WordTokenizer:
    """The tokenizers library behind a cache of words: its normaliser and pattern never join text across ASCII white space.

    A word of ``PLAIN`` characters is unchanged by the normaliser but for case, so it is cut by ``CUT`` here, many words in one
    pass; ids of cut parts are kept too, as new words are mostly made of known parts. Only the library's BPE model runs on new
    parts, many in one call; it marks the last id of every part, which tells where a part's ids end. Words of other characters
    go through the whole library and are told apart by offsets. Texts of plain characters without "<|" are lower-cased first,
    as the library would do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        self.t, self.words, self.parts = Tokenizer.from_file(path), Known(self._learn), Known(self._learn_parts)
        with open(path) as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lean = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = [(c, as_bytes.pre_tokenize_str(c)[0][0]) for c in map(chr, range(0xDF, 0x100))]
        self.ends = np.zeros(max(self.t.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in model["vocab"].items() if w.endswith(model["end_of_word_suffix"])]] = True

    def _learn(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words, none of which holds ASCII white space."""
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        if pc.all(plain).as_py():
            return self._learn_plain(words)
        other = pc.invert(plain)
        ids = pa.concat_arrays([self._learn_plain(words.filter(plain)), self._learn_other(words.filter(other).to_pylist())])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(other)])
        return ids.take(pa.array(np.argsort(order)))

    def _learn_plain(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        parts = pa.array(CUT(joined(words, "\n").lower() + "\n"), pa.string()).dictionary_encode()
        is_end = pc.equal(parts.dictionary, "\n")
        known = self.parts.ids_of(parts.dictionary.filter(pc.invert(is_end)))
        known = pc.replace_with_mask(pa.array([b""] * len(is_end), pa.large_binary()), pc.invert(is_end), known)
        last = np.flatnonzero(np.asarray(is_end.take(parts.indices)))
        return regrouped(known.take(parts.indices), np.append(0, last[: len(words)] + 1))

    def _learn_parts(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of lower-case parts of plain characters."""
        out = []
        for k in range(0, len(parts), TOGETHER):
            some = parts.slice(k, TOGETHER)
            text = joined(some, " ")
            for letter, written in [] if text.isascii() else self.as_bytes:  # none is written with letters of this range
                text = text.replace(letter, written)
            ids = np.array(self.lean.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            out.append(spans(ids, np.append(0, np.flatnonzero(self.ends[ids]) + 1), len(some)))
        return pa.concat_arrays(out)

    def _learn_other(self, words: list[str]) -> pa.LargeBinaryArray:
        out = []
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            e = self.t.encode(" ".join(some), add_special_tokens=False)
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            starts = np.cumsum([0, *(len(x) + 1 for x in some)])
            out.append(spans(np.array(e.ids, "<u4"), np.searchsorted(at, starts), len(some)))
        return pa.concat_arrays(out)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = pc.ascii_split_whitespace(pa.array([lowered(x) for x in texts], pa.string()))
        words = cut.flatten().dictionary_encode()
        ids = self.words.ids_of(words.dictionary).take(words.indices)
        return regrouped(ids, cut.offsets).to_pylist()


def joined(texts: pa.StringArray, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), by)[0].as_py()


def spans(ids: np.ndarray, edges, n: int) -> pa.LargeBinaryArray:
    """``n`` runs of ids between ``edges``."""
    if len(edges) != n + 1 or edges[-1] != len(ids):
        raise ValueError("ids and the strings they come from do not match")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * np.asarray(edges, np.int64)), pa.py_buffer(ids)])


def regrouped(ids: pa.LargeBinaryArray, edges) -> pa.LargeBinaryArray:
    """Neighbours between ``edges`` become one."""
    _, at, data = ids.buffers()
    offsets = np.frombuffer(at, np.int64)[ids.offset : ids.offset + len(ids) + 1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets[np.asarray(edges)]), data or pa.py_buffer(b"")])


def lowered(text: bytes) -> bytes:
    """``text`` in lower case where that is certain to be what the library makes of it."""
    if b"<|" in text:
        return text
    if text.isascii():
        return text.lower()
    s = text.decode()
    return s.lower().encode() if PLAIN_TEXT(s) else text


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(4)
def _dictionary(uri: str, digest: str) -> zstandard.ZstdCompressionDict:
    fs, path = file_system(f"{uri}/dict-{digest}.zdict")
    with fs.open_input_file(path) as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest()[:16] != digest:
        raise ValueError("the dictionary's hash differs")
    return zstandard.ZstdCompressionDict(data)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the end id appended; ids as bytes."""
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            ids = [x + end for x in t.encode_all(_texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def train_dictionary(docs: DataFrame, uri: str, path: str) -> str:
    """Trains on the bounded sample, stores the dictionary, returns its hash ('' when the sample is too small)."""
    sample = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id", "left_semi")
    cut = _encoded(chosen, path).select(F.substring("ids", 1, 4 * SAMPLE_IDS).alias("ids")).limit(SAMPLE_DOCS)
    samples = [bytes(r.ids) for r in cut.collect()]
    try:
        data = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return ""
    digest = hashlib.sha256(data).hexdigest()[:16]
    fs, target = file_system(f"{uri}/dict-{digest}.zdict")
    fs.create_dir(posixpath.dirname(target), recursive=True)
    with fs.open_output_stream(target) as f:
        f.write(data)
    return digest


def write_store(docs: DataFrame, path: str | None = None, uri: str | None = None) -> tuple[str, str, DataFrame]:
    """Writes the shards; returns their folder, the dictionary's hash and the manifest (first_id, shard, n_docs, n_ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    uri = uri or fresh_dir(spark, "tokens")
    digest = train_dictionary(docs, uri, path)

    end = struct.pack("<I", END_ID)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, z = tokenizer(path), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(uri, digest) if digest else None)
        for whole in batches:
            for b in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):
                ids = [x + end for x in t.encode_all(_texts(b.column(1)))]
                columns = [b.column(0), pa.array(map(z.compress, ids), pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "frame", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frames = materialize(rows.mapInArrow(compress, "doc_id long, frame binary, n long"), "frames")
    mb = (frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0) / 1e6
    shards = max(1, round(mb / SHARD_MB), min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(mb)))
    ordered = frames.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(uri)
        fs.create_dir(base, recursive=True)
        name, out, at, index, total = f"shard-{uuid.uuid4().hex}.tokz", None, 0, [], 0
        for b in batches:
            for i, frame, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                out = out or fs.open_output_stream(f"{base}/{name}")
                out.write(data := frame.as_buffer())
                index.append((NULL_ID if i is None else i, at, data.size, n))
                at, total = at + data.size, total + n
        if out is None:
            return
        out.write(b"".join(struct.pack("<4q", *x) for x in index))
        out.write(struct.pack("<2q8s8s", at, len(index), bytes.fromhex(digest or "0" * 16), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pylist([{"first_id": index[0][0], "shard": name, "n_docs": len(index), "n_ids": total, "n_bytes": at}])

    manifest = materialize(ordered.mapInArrow(write, "first_id long, shard string, n_docs long, n_ids long, n_bytes long"), "token-manifest")
    discard(frames)
    return uri, digest, manifest


def open_shard(uri: str, shard: str):
    """(file, index as rows of four numbers, dictionary hash); reads the footer and the index only."""
    fs, base = file_system(uri)
    f = fs.open_input_file(f"{base}/{shard}")
    at, n, digest, magic = struct.unpack("<2q8s8s", f.read_at(32, f.size() - 32))
    if magic != MAGIC:
        raise ValueError(f"{shard} is no token shard")
    return f, list(struct.iter_unpack("<4q", f.read_at(32 * n, at))), digest.hex()


def _decompressor(uri: str, digest: str) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_dictionary(uri, digest) if digest.strip("0") else None)


def read_document(uri: str, shard: str, doc_id: int) -> bytes | None:
    """Ids of one document by binary search in the index and one range read."""
    from bisect import bisect_left

    f, index, digest = open_shard(uri, shard)
    k = bisect_left(index, (doc_id,))
    if k == len(index) or index[k][0] != doc_id:
        return None
    _, at, size, _ = index[k]
    return _decompressor(uri, digest).decompress(f.read_at(size, at))


def read_store(uri: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the shard's running total (the manifest has a row per shard) plus the place in the shard.
    """
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("first_id", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", before.alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f, index, digest = open_shard(uri, shard)
                z = _decompressor(uri, digest)
                rows = []
                for doc_id, at, size, _ in index:
                    ids = z.decompress(f.read_at(size, at))
                    rows.append((None if doc_id == NULL_ID else doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])
