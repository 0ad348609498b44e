"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the tables keep the one token that ends the BPE encoding of that
prefix. A token may follow another when merging the two tokens' joined bytes gives back just these two;
of the tokens that are suffixes of a prefix exactly one may follow the last token of the prefix before
it. Encoding walks the table backwards. Because a prefix's entry depends on earlier entries only,
appending bytes extends the table (``PrefixTable.append``) and an edit recomputes entries from the edit
on, stopping where they agree with the old ones again (``PrefixTable.replace``).

A text is cut by the tokenizer's pattern, and each match is encoded by itself, without special tokens.

Texts are encoded some hundred at a time: their distinct pieces are sorted, so each extends the table of a
prefix that it shares with the one before.

Edge cases: null encodes as empty (no tokens); a null doc_id is carried through; unpaired surrogates cannot
occur in Spark strings; very long matches cost time in proportion to their length; repeated rows give
repeated results, each by itself, so ties do not matter; an empty table gives no rows; extra columns are
ignored whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import small_batches, trim

#: Characters that count as white space for the pattern (Unicode White_Space).
WHITE = "\t-\r \x85\xa0  -     　"

#: Cuts at some of the places where the pattern cuts: an optional space and what follows it up to white space.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Chunks and pairs of tokens that a Python worker remembers, and the characters of the longest such chunk; they bound memory only.
CACHE_CHUNKS, CACHE_PAIRS, CACHE_CHARS = 150_000, 200_000, 64
#: Texts that are encoded together.
SLICE = 768


class Vocabulary:
    """Ranks of a tiktoken file with the relation "may follow"."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.never = 1 << 60
        self.spine = functools.lru_cache(20_000)(self._spine)
        self.pairs: dict[int, bool] = {}
        # Every end of a token, with the id if it is itself a token that merging can reach, else -1.
        self.ends = {t[k:]: -1 for t in self.ranks for k in range(len(t))}
        self.ends.update((t, i) for t, i in self.ranks.items() if self._reachable(t))

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; used on single tokens and joined pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, self.never), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _reachable(self, token: bytes) -> bool:
        return self.merged(token) == [self.ranks[token]]

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """The pieces at one end of ``token`` (0: left, 1: right) while it is merged, each with the rank of
        the merge that takes it up (a number above all ranks for the whole token). None if those don't rise."""
        parts = [token[i : i + 1] for i in range(len(token))]
        seen, last = [parts[-side]], -1
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, self.never), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.never or rank < last:
                return None
            last = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts[-side] != seen[-1]:
                seen.append(parts[-side])
        return [(p, self.never if q is None else self.ranks[q]) for p, q in zip(seen, [*seen[1:], None], strict=True)]

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may come right after ``before``; remembered."""
        key = before << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._follows(self.bytes_of[before], self.bytes_of[token])
        return found

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether no merge across the border comes before those inside the two tokens.

        At each moment one end piece of ``before`` touches one of ``token``; they merge if that has a lower
        rank than the merges that take them up, where of equal ranks the left one goes first.
        """
        left, right = self.spine(before, 1), self.spine(token, 0)
        if left is None or right is None:
            return self.merged(before + token) == [self.ranks[before], self.ranks[token]]
        i = j = 0
        rank = self.ranks.get
        while True:
            (p, up), (q, down) = left[i], right[j]
            across = rank(p + q)
            if across is not None and across < up and across <= down:
                return False
            if up == down == self.never:
                return True
            if up <= down:
                i += 1
            else:
                j += 1


class PrefixTable:
    """For every prefix ``data[:i]``: ``token[i]``, the last token of its encoding, and ``start[i]``, where that begins."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.token, self.start = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def become(self, data: bytes) -> None:
        """The table of another string: entries of the common prefix stay, the rest is appended."""
        same = 0
        for a, b in zip(self.data, data, strict=False):
            if a != b:
                break
            same += 1
        self.data = data
        del self.token[same + 1 :], self.start[same + 1 :]
        self._fill(len(data))

    def _fill(self, end: int) -> None:
        """Entries up to ``end``: of the tokens that end there, shortest first, the one that may follow the token before it."""
        data, token, start, ends, pairs = self.data, self.token, self.start, self.v.ends, self.v.pairs
        for i in range(len(token), end + 1):
            j = i - 1
            while True:
                t = ends[data[j:i]]
                if t >= 0:
                    if not j:
                        break
                    ok = pairs.get(token[j] << 32 | t)
                    if ok or ok is None and self.v.follows(token[j], t):
                        break
                j -= 1
            token.append(t)
            start.append(j)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many table entries had to be computed.

        Entries before the edit stay. Behind it, an entry looks back at most the longest token plus the
        token before; once that many entries in a row equal the old ones the rest is taken over.
        """
        old, begins, shift = self.token, self.start, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.token, self.start = old[: start + 1], begins[: start + 1]
        same, done = 0, 0
        for i in range(start + 1, len(self.data) + 1):
            self._fill(i)
            done += 1
            behind = i - shift
            same = same + 1 if i > start + len(new) and self.token[i] == old[behind] else 0
            if same >= 2 * self.v.longest:
                self.token += old[behind + 1 :]
                self.start += [x + shift for x in begins[behind + 1 :]]
                break
        return done

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.token[i])
            i = self.start[i]
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import regex

        self.v = Vocabulary(path)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.cache: dict[str, bytes] = {}
        self.bytes_of = np.array([self.v.bytes_of.get(i) for i in range(max(self.v.bytes_of) + 1)], object)

    def _pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece. In sorted order neighbours share a prefix, whose table entries stay."""
        out, table, whole = {}, PrefixTable(self.v), self.v.ends.get
        for data in sorted(pieces):
            if (i := whole(data, -1)) >= 0:
                out[data] = i.to_bytes(4, "little")
            else:
                table.become(data)
                out[data] = array("I", table.tokens()).tobytes()
        return out

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text. Chunks that are not remembered are cut into pieces, and each distinct piece is encoded once."""
        cut = [CHUNK.findall(t or "") for t in texts]
        distinct = set(chain.from_iterable(cut))
        missing = distinct.difference(self.cache)
        pieces = {c: [p.encode() for p in self.pattern.findall(c)] for c in missing}
        ids = self._pieces(set(chain.from_iterable(pieces.values())))
        known = self.cache
        known.update((c, b"".join(map(ids.__getitem__, p))) for c, p in pieces.items())
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        if len(known) > CACHE_CHUNKS:  # what this call used stays
            self.cache = known = {c: known[c] for c in distinct}
        for c in distinct:
            if len(c) > CACHE_CHARS:
                del known[c]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.bytes_of[np.frombuffer(ids, "<u4")].tolist())


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One per Python worker, kept between tasks."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids and of the bytes decoded from them, and the ids if asked for."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            texts = b.column(1)
            for ids in chain.from_iterable(c.encode_all(texts.slice(k, SLICE).to_pylist()) for k in range(0, len(texts), SLICE)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
