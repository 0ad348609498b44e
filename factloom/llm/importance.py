"""Target-distribution importance resampling over hashed word n-grams, counted by DuckDB in every partition.

1. In each task DuckDB cuts texts into words, unnests them, takes runs of one to three words by window functions and hashes them with
   a registered zlib CRC function. Bucket numbers by document and the partition's sums by bucket go to Parquet in the shared folder,
   through Spark's own writer, so that lost tasks leave nothing behind.
2. Spark merges the sums of the corpus and of the target texts. A bucket's gain is the logarithm of the ratio of its smoothed shares.
   There are ``BUCKETS`` gains, whatever the input.
3. A document's weight, the sum of its features' gains, is read off its stored bucket numbers; texts are read once. A seeded Gumbel
   number is added, and the highest scores are drawn: scores are range-partitioned and sorted, and only the sizes of the parts are
   gathered to tell every row its rank.

Edge cases: null and empty texts have no features and weight 0; a null doc_id is seeded like an empty string and comes last of equal
scores; repeated rows are scored and ranked each by itself, of rows alike in score and doc_id any comes first; texts of any length are counted whole, a
slice of about ``SLICE`` bytes at a time holds at least one; an empty corpus gives no rows; without target texts all gains are computed
from zero counts; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, trim

BUCKETS = 10_000
#: Documents with fewer words are not drawn; of 100 others so many are.
LEAST_WORDS, PERCENT = 20, 5
SEED = "42"
#: Bytes of text that DuckDB takes at a time, and its memory in a worker; beyond it spills to the task's own folder.
SLICE, MEMORY = 1 << 19, "300MB"
#: Rows that a part of the ranking holds about.
PART_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: One thread keeps the order of rows, so the windows run over words as they stand; a run ends where the next word is another text's.
HASHED = f"""
    CREATE OR REPLACE TEMP TABLE hashed AS
    WITH cut AS (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM texts),
    word AS (SELECT r, unnest(words) AS w FROM cut),
    near AS (SELECT r, w, lead(w) OVER () AS w2, lead(w, 2) OVER () AS w3, lead(r) OVER () AS r2, lead(r, 2) OVER () AS r3 FROM word),
    feature AS (SELECT r, unnest([w, CASE WHEN r2 = r THEN w || ' ' || w2 END, CASE WHEN r3 = r THEN w || ' ' || w2 || ' ' || w3 END]) AS f, unnest([1, 0, 0]) AS words FROM near)
    SELECT r, words, (zlib_crc32(f) % {BUCKETS})::INTEGER AS bucket FROM feature WHERE f IS NOT NULL"""
BY_TEXT = """
    SELECT t.r, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(len(buckets), 0)::BIGINT AS n_features, coalesce(buckets, []) AS buckets
    FROM texts t LEFT JOIN (SELECT r, sum(words) AS n_words, list(bucket) AS buckets FROM hashed GROUP BY r) h USING (r) ORDER BY t.r"""


def crc32(features: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return pa.array(np.fromiter(map(zlib.crc32, features.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint32, len(features)))


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
    con.create_function("zlib_crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    con.execute("CREATE TEMP TABLE totals (bucket INTEGER, times BIGINT)")
    return con


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text) in slices of about ``SLICE`` bytes."""
    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += n or 0
        if held >= SLICE:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """Written rows of ``texts`` (doc_id, text): doc_id, n_words, n_features, buckets; a row per task has ``times`` of the buckets."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, doc_ids = connection(), None
        for batch in batches:
            doc_ids = batch.column(0).type
            for part in slices(batch):
                n = part.num_rows
                con.register("texts", pa.table({"r": pa.array(range(n), pa.int32()), "text": part.column(1)}))
                con.execute(HASHED)
                con.execute("INSERT INTO totals SELECT bucket, count(*) FROM hashed GROUP BY bucket")
                made = con.sql(BY_TEXT).to_arrow_table()
                columns = [pa.concat_arrays(made[c].chunks) for c in ("n_words", "n_features", "buckets")]
                con.unregister("texts")
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.nulls(n, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_features", "buckets", "times"])
        if doc_ids is not None:
            sums = con.execute("SELECT bucket, sum(times)::BIGINT FROM totals GROUP BY bucket ORDER BY bucket").fetchall()
            lists = pa.array([[b for b, _ in sums]], pa.list_(pa.int32())), pa.array([[n for _, n in sums]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_ids), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *lists], ["doc_id", "n_words", "n_features", "buckets", "times"])
        con.close()
        trim()

    small_batches(texts.sparkSession)
    schema = f"doc_id {kind}, n_words long, n_features long, buckets array<int>, times array<long>"
    return materialize(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema), name)


def totals(counts: DataFrame) -> list[int]:
    """Features of all texts by bucket: sums of the tasks' sums."""
    each = counts.where("times IS NOT NULL").select(F.explode(F.arrays_zip("buckets", "times")).alias("x"))
    out = [0] * BUCKETS
    for r in each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias("n")).collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares) by bucket."""
    s_all, t_all = sum(corpus) + BUCKETS, sum(target) + BUCKETS
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all) / (float(s + 1) * float(t_all)))) for s, t in zip(corpus, target, strict=True)]


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(1000 times a Gumbel number) of the first eight hex digits of the seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``, written: doc_id, n_words, n_features, weight, score."""
    counts = bucket_counts(docs.select("doc_id", "text"), "resample-corpus")
    wanted = bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), "resample-target")
    gain = F.from_json(F.lit(json.dumps(gains(totals(counts), totals(wanted)))), "array<long>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(gain, b))
    rows = counts.where("times IS NULL").select("doc_id", "n_words", "n_features", weight.alias("weight"))
    return materialize(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, and rank, from 1, of the ``percent`` of 100 documents with enough words that are drawn."""
    rows = scored(docs, target, seed)
    spark, able = docs.sparkSession, F.col("n_words") >= least_words
    n = rows.where(able).count()
    drawn = percent * n // 100
    # The written rows' numbers tell repeated rows apart, so that no value is too frequent for a range.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = rows.where(able).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(8, math.ceil(n / PART_ROWS)), *order).sortWithinPartitions(*order)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "part", "place"])
            at += b.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "n_features", "weight", "score")
    ordered = materialize(ranged.select(*names).mapInArrow(placed, f"doc_id {kind}, n_features long, weight long, score long, part int, place long"), "resample-ranks")
    sizes = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per part
    before = [(part, sum_ - n) for (part, n), sum_ in zip(sizes, accumulate(n for _, n in sizes), strict=True)]
    offsets = spark.createDataFrame(before, "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    told = ordered.join(F.broadcast(offsets), "part").select(*names, F.when(rank <= drawn, rank).alias("rank"))
    return told.union(rows.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))

