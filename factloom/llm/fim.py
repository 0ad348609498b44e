"""Fill-in-middle: texts with a span moved to the end, cut at seeded line boundaries.

1. Identical texts are grouped by verified content: their length and SHA-256, never a short hash alone.
2. Each distinct text has one entry in an index: the code-point offsets of its line ends as an Elias-Fano list (low bits packed, high
   bits in unary), some 2 + log2(characters a line) bits a line. Tasks make the lists of the distinct texts of a batch, an aggregate
   keeps one per text; copies are merged before they are shuffled.
3. The index is joined back to the documents by the verified key. The index has one row per key, so a hot group of copies is a long
   run of documents on one side only, which Spark's skew join splits.
4. Two boundaries are selected from the list by the seeded numbers of a document; texts are cut and put together on the JVM.

``restored`` takes an output apart by its control strings alone: a text that holds one of them is left plain.

Edge cases: null and empty texts are plain and have no lines; a null doc_id is seeded like an empty string; repeated rows give repeated
rows with equal cuts, and rows that share a doc_id but no text their own; lines of any length and number are whole; ties of the two
cuts leave the middle empty; an empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from .common import materialize, small_batches

#: Control strings of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of these so many have the suffix first.
RATE, SPM_RATE = 100, 50
SEED = "7"


# Elias-Fano lists --------------------------------------------------------------------------------------


def encoded(ends: np.ndarray) -> bytes:
    """A rising list of positive numbers: 5 bytes of count, a byte of the low bits' width, low bits, high bits in unary."""
    n = len(ends)
    if not n:
        return b"\0" * 6
    width = max(0, (int(ends[-1]) // n).bit_length() - 1)
    low = (ends[:, None] >> np.arange(width)) & 1
    high = np.zeros(int(ends[-1] >> width) + n, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return n.to_bytes(5, "little") + bytes([width]) + np.packbits(low.astype(np.uint8), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def selected(data: bytes, k: int) -> int:
    """The ``k``-th number of a list, from 1; 0 is the begin of the text. Reads its low bits and counts ones up to it."""
    if k == 0:
        return 0
    n, width = int.from_bytes(data[:5], "little"), data[5]
    at = 6 + (n * width + 7) // 8
    ones = np.bitwise_count(np.frombuffer(data, np.uint8, offset=at)).cumsum()
    byte = int(np.searchsorted(ones, k))
    left = k - (int(ones[byte - 1]) if byte else 0)
    bit = [b for b in range(8) if data[at + byte] >> b & 1][left - 1]
    first = (k - 1) * width
    low = int.from_bytes(data[6 + first // 8 : 6 + (first + width + 7) // 8], "little") >> first % 8 & (1 << width) - 1
    return (8 * byte + bit - (k - 1)) << width | low


def line_ends(text: str) -> np.ndarray:
    """Code-point offsets after each line ``[^\\n]*\\n|[^\\n]+``."""
    ends, at = [], text.find("\n") + 1
    while at:
        ends.append(at)
        at = text.find("\n", at) + 1
    if text and text[-1] != "\n":
        ends.append(len(text))
    return np.array(ends, np.int64)


@F.pandas_udf(StructType().add("n", LongType()).add("ends", BinaryType()))
def listed(text: pd.Series) -> pd.DataFrame:
    """Number of lines and their ends; a batch's copies of a text share one list."""
    known: dict[str, tuple[int, bytes]] = {}
    for t in text:
        if t not in known:
            ends = line_ends(t)
            known[t] = len(ends), encoded(ends)
    return pd.DataFrame([known[t] for t in text], columns=["n", "ends"])


@F.pandas_udf(StructType().add("prefix", LongType()).add("middle", LongType()))
def cut(ends: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Characters of prefix and middle that end after the given numbers of lines."""
    at = [(selected(e, int(a)), selected(e, int(b))) for e, a, b in zip(ends, first, last, strict=True)]
    return pd.DataFrame({"prefix": [a for a, _ in at], "middle": [b - a for a, b in at]}, dtype="int64")


# The operator ------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"chars": F.length("text"), "sha": F.unhex(F.sha2("text", 256))})


def distinct_index(docs: DataFrame) -> DataFrame:
    """(chars, sha, n, ends) of each distinct text of ``docs``, written."""
    made = _keyed(docs).select("chars", "sha", listed("text").alias("lines"))
    one = made.groupBy("chars", "sha").agg(F.first("lines").alias("lines"))
    return materialize(one.select("chars", "sha", "lines.n", "lines.ends"), "fim-index")


def _number(doc_id: Column, k: int, seed: str) -> Column:
    """The ``k``-th group of eight hex digits of the seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Per row: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    small_batches(docs.sparkSession)
    index = distinct_index(docs)
    h = [_number(F.col("doc_id"), k, seed) for k in (1, 2, 3, 4)]
    joined = _keyed(docs).join(index.hint("shuffle_hash"), ["chars", "sha"])
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("chars") == 0) | held | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    rows = joined.select("doc_id", "text", "n", form.alias("form"), cut("ends", F.least(a, b), F.greatest(a, b)).alias("c"))
    p, m = F.col("c.prefix").cast("int"), F.col("c.middle").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m), F.substring("text", p + m + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    )
    told = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return rows.select("doc_id", "n", "form", told("c.prefix").alias("prefix_chars"), told("c.middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from its control strings."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    tail = part(output, MIDDLE, 1)
    middle = part(output, MIDDLE, 2)
    psm = F.concat(F.substring(part(tail, SUFFIX, 1), len(PREFIX) + 1, 1 << 30), middle, part(tail, SUFFIX, 2))
    spm = F.concat(part(tail, PREFIX, 2), middle, F.substring(part(tail, PREFIX, 1), len(SUFFIX) + 1, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """Outputs and the texts restored from them as SHA-256."""
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
