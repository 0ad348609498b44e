"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of ASCII white space became one space. Each step looks only at
what the step before left in groups of two or more: prefixes are hashed of texts whose length occurs again, and
the full hash is taken of texts whose length and prefix both do. Groups are counted with partial aggregation, so a
hot group (a third of all rows with one text) is summed before it is shuffled, and per-group results are small rows.

Edge cases: null counts as empty; a null doc_id is never the row that stays unless the whole group has
none; repeated rows (same doc_id, same text) and rows without ids are flagged alike, and ``drop_exact`` keeps one of
them; of very long texts nothing is cut; an empty table gives no rows; extra columns of any names are carried by
``drop_exact`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, single_spaced, sized_join, unpacked

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return single_spaced(F.coalesce(text, F.lit("")))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _lengths(rows: DataFrame, text: Column) -> DataFrame:
    """Adds n, the normalised text, and its length in bytes."""
    n = rows.withColumn("n", normalised(text))
    return n.withColumn("len", F.octet_length("n"))


def _prefixed(lengths: DataFrame) -> DataFrame:
    return lengths.withColumn("prefix", F.xxhash64(F.substring("n", 1, PREFIX_CHARS)))


def exact_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(len, prefix) that survive the first two steps, and the groups of two or more equal texts.

    Groups: len, prefix, sha, keep_id (smallest doc_id), repeats (rows that have it), group_size.
    """
    texts = _lengths(docs.select("doc_id", "text"), F.col("text")).drop("text")
    crowded = materialize(texts.groupBy("len").agg(F.count("*").alias("rows")).where("rows > 1").select("len"), "exact-lengths")
    second = _prefixed(sized_join(texts, crowded, "len", "left_semi"))
    surviving = materialize(second.groupBy("len", "prefix").agg(F.count("*").alias("rows")).where("rows > 1").select("len", "prefix"), "exact-prefixes")
    third = sized_join(_prefixed(texts), surviving, ["len", "prefix"], "left_semi")
    full = third.select("doc_id", "len", "prefix", _hash(F.col("n")).alias("sha"))
    ids = full.groupBy("len", "prefix", "sha", "doc_id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows"))
    groups = ids.groupBy("len", "prefix", "sha").agg(first.alias("first"), F.sum("rows").alias("group_size")).where("group_size > 1")
    return surviving, materialize(groups.select("len", "prefix", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.rows").alias("repeats"), "group_size"), "exact-groups")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (so here every text is hashed)."""
    groups = exact_groups(docs)[1].select("sha", "keep_id", "group_size")
    hashed = docs.select("doc_id", _hash(normalised(F.col("text"))).alias("sha"))
    joined = sized_join(hashed, groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text stays elsewhere; of repeated rows of the one that stays, one.

    Only texts whose length and prefix occur again are hashed. The groups are small rows, so a text is shuffled only
    when the groups themselves are too many to broadcast.
    """
    surviving, groups = exact_groups(docs)
    rows = _prefixed(_lengths(packed(docs), F.col("row.text")))
    again = sized_join(rows, surviving.withColumn("again", F.lit(True)), ["len", "prefix"], "left")
    hashed = again.select("row", F.when(F.col("again"), _hash(F.col("n"))).alias("sha"))
    joined = sized_join(hashed, groups.select("sha", "keep_id", "repeats"), "sha", "left")
    kept = joined.where(F.col("repeats").isNull() | F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    if groups.where("repeats > 1").isEmpty():
        return unpacked(kept)
    one = kept.where("repeats > 1").dropDuplicates(["sha"])
    return unpacked(kept.where("coalesce(repeats, 1) = 1").union(one))
