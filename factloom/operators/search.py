"""Full-text search over documents, chunks or facts: every term must occur, best BM25 first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import firewall


def terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): the distinct terms of each query and how many there are."""
    each = queries.select(key, F.array_distinct(F.regexp_extract_all(T.fold(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))).alias("ts"))
    return each.select(key, F.explode("ts").alias("token"), F.size("ts").alias("n"))


def search(texts: DataFrame, queries: DataFrame, limit: int = 20, key: str = "id", text: str = "text", probe: str = "query_id", asked: str = "query") -> DataFrame:
    """(probe, key, score, rank) of the best ``limit`` texts per query; ties go by key. Only postings of asked terms are shuffled and scored."""
    wanted = firewall._checkpoint(terms(queries, probe, asked))
    each = texts.select(key, firewall.tokens(text).alias("ts")).where("size(ts) > 0")
    sizes = each.select(key, F.size("ts").alias("dl")).distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    named = wanted.select("token").distinct()
    # The tokens of a task's texts are compared with the asked ones before anything is grouped.
    few = F.broadcast(named) if named.count() <= firewall.SENT else named
    found = each.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("token")).join(few, "token", "left_semi")
    index = firewall.bm25_weights(found.groupBy(key, "token", "dl").agg(F.count("*").alias("tf")), key, (sizes.n, sizes.tokens))
    hits = index.join(wanted, "token").groupBy(probe, key, "n").agg(F.count("*").alias("held"), (-F.sum("w")).alias("score")).where("held = n")
    best = W.partitionBy(probe).orderBy(F.round("score", 9), key)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(probe, key, "score", "rank")
