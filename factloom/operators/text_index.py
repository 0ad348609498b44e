"""A stored inverted index: immutable sorted segments of postings, with statistics, tombstones and merges.

``add`` tokenises the new rows alone and writes them as a segment, sorted by token, so that a reader's filter on tokens skips what it did not
ask for. ``remove`` writes which rows of which segments are gone. Both return the new state, a small dict that names what is current; it becomes
current when its owner commits it (``StoredIndex``, or the engine together with its tables). Counts of rows and tokens are part of the
state; how many rows hold a token is counted from the postings that are read anyway, so statistics are those of the rows that live.

Edge cases: texts without a token are left out; of new rows with one key one is taken, a key that lives already is left as it is; rows
with a null key or text are left out; removing an unknown key changes nothing; a removed key may be added again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import commits, firewall

#: Segments from which the smallest are merged.
FANOUT = 8
#: Distinct asked tokens up to which a filter names them; beyond they are joined.
NAMED = 2000
#: Rows of tombstones and keys that are sent to every task; beyond they are shuffled.
SENT = 100_000

POSTINGS, DOCS, GONE = "key string, token string, tf long, dl int", "key string, dl int", "segment string, key string, dl int"


class TextIndex:
    """The index in ``folder`` as of ``state``; methods that change it return another state."""

    def __init__(self, spark: SparkSession, folder: str, state: dict | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = state or {"segments": [], "gone": []}

    def with_state(self, state: dict) -> TextIndex:
        return TextIndex(self.spark, self.folder, state)

    # Reading --------------------------------------------------------------------------------------

    def size(self) -> tuple[int, int]:
        """Living rows, and their tokens."""
        held, lost = self.state["segments"], self.state["gone"]
        return sum(s["n"] for s in held) - sum(g["n"] for g in lost), sum(s["tokens"] for s in held) - sum(g["tokens"] for g in lost)

    def _read(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{n}/{kind}").withColumn("segment", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment string")

    def _living(self, kind: str, schema: str, names: list[str] | None = None) -> DataFrame:
        names = [s["name"] for s in self.state["segments"]] if names is None else names
        rows, gone = self._read(kind, schema, names), [g for g in self.state["gone"] if set(g["of"]) & set(names)]
        if not gone:
            return rows
        lost = self.spark.read.schema(GONE).parquet(*(f"{self.folder}/{g['name']}/gone" for g in gone)).select("segment", "key")
        return rows.join(F.broadcast(lost) if sum(g["n"] for g in gone) <= SENT else lost, ["segment", "key"], "left_anti")

    def docs(self) -> DataFrame:
        """(key, dl) of the living rows."""
        return self._living("docs", DOCS).select("key", "dl")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(key, token, tf, dl), of the ``tokens`` (token) alone if given."""
        rows = self._living("postings", POSTINGS)
        if tokens is not None:
            asked = tokens.select("token").distinct()
            few = [r.token for r in asked.limit(NAMED + 1).collect()]  # at most NAMED and one
            rows = rows.where(F.col("token").isin(few)) if len(few) <= NAMED else rows.join(asked, "token", "left_semi")
        return rows.select("key", "token", "tf", "dl")

    def weights(self, tokens: DataFrame) -> DataFrame:
        """(key, token, w) of the postings of ``tokens``: what a token adds to its row's score."""
        return firewall.bm25_weights(self.postings(tokens), "key", self.size())

    def search(self, queries: DataFrame, limit: int = 20, probe: str = "query_id", asked: str = "query") -> DataFrame:
        """(probe, key, score, rank) of the best ``limit`` rows that hold every term; ties go by key."""
        from factloom.operators.search import terms

        wanted = terms(queries, probe, asked)
        hits = self.weights(wanted).join(wanted, "token").groupBy(probe, "key", "n").agg(F.count("*").alias("held"), (-F.sum("w")).alias("score")).where("held = n")
        best = W.partitionBy(probe).orderBy(F.round("score", 9), "key")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(probe, "key", "score", "rank")

    # Writing --------------------------------------------------------------------------------------

    def _segment(self, postings: DataFrame, docs: DataFrame) -> dict | None:
        """Writes a segment; None if it would be empty."""
        name = uuid.uuid4().hex
        docs.select("key", "dl").write.parquet(f"{self.folder}/{name}/docs")
        told = self.spark.read.schema(DOCS).parquet(f"{self.folder}/{name}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        if not told.n:
            return None
        postings.select("key", "token", "tf", "dl").repartitionByRange("token").sortWithinPartitions("token", "key").write.parquet(f"{self.folder}/{name}/postings")
        return {"name": name, "n": told.n, "tokens": told.tokens}

    def _fresh(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, text) once a key, without keys that live. Keys alone are shuffled; of texts only those whose keys repeat."""
        marked = rows.groupBy("key").agg((F.count("*") > 1).alias("repeats"))
        if self.state["segments"]:
            marked = marked.join(self.docs().select("key", F.lit(True).alias("lives")), "key", "left")
        else:
            marked = marked.withColumn("lives", F.lit(None).cast("boolean"))
        marked = firewall._checkpoint(marked.where("repeats OR lives"))
        n = marked.count()
        if not n:
            return rows
        told = rows.join(F.broadcast(marked) if n <= SENT else marked, "key", "left")
        again = told.where("repeats AND lives IS NULL").groupBy("key").agg(F.min("text").alias("text"))
        return told.where("repeats IS NULL").select("key", "text").unionByName(again)

    def add(self, rows: DataFrame, key: str = "id", text: str = "text") -> dict:
        """The state with the rows (key, text) whose keys do not live yet. ``rows`` are read several times and must be the same each time."""
        new = self._fresh(rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL"))
        sized = new.select("key", firewall.tokens("text").alias("ts")).where("size(ts) > 0")
        made = self._segment(firewall.own_postings(sized), sized.select("key", F.size("ts").alias("dl")))
        state = {"segments": [*self.state["segments"], *([made] if made else [])], "gone": self.state["gone"]}
        return self.with_state(state).merged()

    def remove(self, keys: DataFrame, key: str = "id") -> dict:
        """The state without the rows of ``keys``."""
        names = [s["name"] for s in self.state["segments"]]
        if not names:
            return self.state
        name = uuid.uuid4().hex
        hit = self._living("docs", DOCS).join(keys.select(F.col(key).cast("string").alias("key")).distinct(), "key", "left_semi")
        hit.select("segment", "key", "dl").write.parquet(f"{self.folder}/{name}/gone")
        told = self.spark.read.schema(GONE).parquet(f"{self.folder}/{name}/gone").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        lost = [{"name": name, "n": told.n, "tokens": told.tokens, "of": names}] if told.n else []
        return {"segments": self.state["segments"], "gone": [*self.state["gone"], *lost]}

    def merged(self, fanout: int | None = None) -> dict:
        """The state with the smallest segments merged into one where there are more than ``fanout``; their dead rows go."""
        fanout, held = fanout or FANOUT, sorted(self.state["segments"], key=lambda s: (s["n"], s["name"]))
        if len(held) <= fanout:
            return self.state
        chosen = [s["name"] for s in held[: len(held) - fanout // 2]]
        made = self._segment(self._living("postings", POSTINGS, chosen), self._living("docs", DOCS, chosen))
        gone = []
        for g in self.state["gone"]:
            of = [n for n in g["of"] if n not in chosen]
            if of:
                left = self.spark.read.schema(GONE).parquet(f"{self.folder}/{g['name']}/gone").where(F.col("segment").isin(of))
                told = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
                gone += [{**g, "of": of, "n": told.n, "tokens": told.tokens}] if told.n else []
        return {"segments": [s for s in self.state["segments"] if s["name"] not in chosen] + ([made] if made else []), "gone": gone}


class StoredIndex:
    """An index with a log of its own; a change that meets another writer's is made again on top of it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, commits.Log(spark, f"{folder.rstrip('/')}/_log")

    def now(self) -> TextIndex:
        return TextIndex(self.spark, self.folder, self.log.latest()[1] or None)

    def change(self, how, tries: int = 20) -> TextIndex:
        """``how`` maps the current index to its new state."""
        for _ in range(tries):
            n, state = self.log.latest()
            new = how(TextIndex(self.spark, self.folder, state or None))
            if new == state or self.log.put(n + 1, new):
                return TextIndex(self.spark, self.folder, new)
        raise commits.Conflict(f"no commit to {self.folder} in {tries} tries")

    def add(self, rows: DataFrame, key: str = "id", text: str = "text") -> TextIndex:
        return self.change(lambda index: index.add(rows, key, text))

    def remove(self, keys: DataFrame, key: str = "id") -> TextIndex:
        return self.change(lambda index: index.remove(keys, key))
