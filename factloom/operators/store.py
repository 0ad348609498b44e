"""Table transitions: insert-if-absent, upsert, cascades, probes, sessions and queues. DataFrames in, DataFrames out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ts(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def insert_absent(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` to append: keys not there yet, once each."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The table after overwriting by key; of several rows of a key the one latest by ``newest`` stays, new before old."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(newest))
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def append_numbered(new: DataFrame, kind: str, run: str, order: list[str]) -> DataFrame:
    """Adds seq, the place within a run, and the id made of both."""
    from factloom.functions.text import det_id

    seq = F.row_number().over(W.partitionBy(run).orderBy(*order))
    return new.withColumn("seq", seq).withColumn("id", det_id(kind, F.col(run), F.col("seq").cast("string")))


def coalesce_update(existing: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Non-null values of ``patch`` (at most one row per key) replace those of ``existing``."""
    p = patch.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in patch.columns if c != key))
    joined = existing.join(p, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in existing.columns))


def remove_source(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Cascade: ``gone`` (id) leaves sources, evidence, pulses, and what hangs on those pulses' cards and atoms."""
    lost = tables["pulses"].join(gone.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    cards, atoms = lost.select("card_id").distinct(), lost.select("atom_id").distinct()
    drop = lambda df, ids, on, name: df.join(ids.select(F.col(name).alias(on)), on, "left_anti").select(*df.columns)
    plan = {
        "sources": (gone, "id", "id"), "evidence": (gone, "source_id", "id"), "pulses": (gone, "source_id", "id"),
        "exposures": (cards, "card_id", "card_id"), "session_cards": (cards, "card_id", "card_id"), "cards": (cards, "id", "card_id"), "atoms": (atoms, "id", "atom_id"),
    }
    return {t: drop(df, *plan[t]) if t in plan else df for t, df in tables.items()}


def eligible(pulses: DataFrame, stage_keys: DataFrame) -> DataFrame:
    """Pulses of the document and stage that are current for their source."""
    return pulses.join(stage_keys.select("source_id", "document_id", "stage_key"), ["source_id", "document_id", "stage_key"])


def latest(df: DataFrame, by: str, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")


def recent_exposures(exposures: DataFrame, pulses: DataFrame, index: DataFrame, now: datetime, hours: float = 6.0, most: int = 5000) -> DataFrame:
    """Exposures within the window, newest first, with their facts; ``most`` is the feature's bound."""
    since = ts(now) - F.make_dt_interval(secs=F.lit(hours * 3600))
    seen = exposures.where(F.col("exposed_at") >= since).join(pulses.select("card_id", F.col("id").alias("pulse_id"), "topics"), "card_id")
    joined = seen.join(index.select("pulse_id", "fingerprint", "fact_text"), "pulse_id", "left")
    return joined.withColumn("topic", F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("general"))).orderBy(F.desc("exposed_at"), F.desc("id")).limit(most)


def pool(pulses: DataFrame, suppressed: DataFrame, recent_fingerprints: DataFrame, queued: DataFrame) -> DataFrame:
    """Without suppressed ids, fingerprints shown recently, and queued cards."""
    return pulses.join(suppressed, "pulse_id", "left_anti").join(recent_fingerprints, "fingerprint", "left_anti").join(queued, "card_id", "left_anti")


def conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` whose locator or identity is there already: two semi joins, one row each."""
    by = lambda key: new.join(existing.select(key), key, "left_semi").select(*new.columns)
    return by("canonical_locator").union(by("identity_key")).distinct()


def fact_exists(probe: DataFrame, index: DataFrame) -> DataFrame:
    """Probes (fingerprint, exclude_pulse_id, exclude_source_id) that another fact matches; nulls exclude nothing."""
    hit = (F.col("p.fingerprint") == F.col("i.fingerprint")) & ~F.col("i.pulse_id").eqNullSafe(F.col("p.exclude_pulse_id")) & ~F.col("i.source_id").eqNullSafe(F.col("p.exclude_source_id"))
    return probe.alias("p").join(index.alias("i"), hit, "left_semi")


def active_sessions(sessions: DataFrame) -> DataFrame:
    """Each profile's latest active session."""
    return latest(sessions.where("status = 'active'"), "profile_id", F.desc("started_at"), F.desc("id"))


def pending(sessions: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards still to be shown in the latest active sessions."""
    s = active_sessions(sessions).select(F.col("id").alias("session_id"), "profile_id", "position")
    return cards.join(s, "session_id").where(F.col("ordinal") >= F.col("position"))


def current_card(sessions: DataFrame, cards: DataFrame, pulses: DataFrame) -> DataFrame:
    """Per profile the first pending card whose pulse still exists; invalidated ones are skipped."""
    known = pending(sessions, cards).join(pulses.select("card_id", F.col("id").alias("pulse_id")), "card_id", "left").where("pulse_id IS NOT NULL")
    return latest(known, "profile_id", F.asc("ordinal"))


def queue_low(sessions: DataFrame, cards: DataFrame, watermark: int = 3) -> DataFrame:
    """Profiles whose pending cards have fallen to the watermark: they are to be refilled."""
    left = pending(sessions, cards).groupBy("profile_id").agg(F.count("*").alias("remaining"))
    return active_sessions(sessions).select("profile_id", F.col("id").alias("session_id")).join(left, "profile_id", "left").select("profile_id", "session_id", F.coalesce("remaining", F.lit(0)).alias("remaining")).where(F.col("remaining") <= watermark)


def append_cards(cards: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (session_id, card_id, reason, fingerprint, seq) numbered on after each session's last ordinal; cards queued already are left out."""
    fresh = new.join(cards.select("session_id", "card_id"), ["session_id", "card_id"], "left_anti")
    last = cards.groupBy("session_id").agg(F.max("ordinal").alias("last"))
    place = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
    return fresh.join(last, "session_id", "left").select("session_id", "card_id", (F.coalesce("last", F.lit(-1)) + place).cast("int").alias("ordinal"), "reason", "fingerprint")


def acknowledge(sessions: DataFrame, shown: DataFrame, cards: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """After showing ``shown`` (profile_id, card_id): sessions moved on and exposures to append.

    Counts only when the card is the one at the session's place; the exposure's id is made of session and place, so a repeat adds nothing.
    """
    from factloom.functions.text import det_id

    s = active_sessions(sessions)
    hit = s.join(shown, "profile_id").join(cards.select(F.col("session_id").alias("id"), "card_id", "ordinal"), ["id", "card_id"]).where(F.col("ordinal") >= F.col("position"))
    exposures = hit.select(det_id("exposure", F.col("id"), F.col("ordinal").cast("string")).alias("id"), "profile_id", "card_id", ts(now).alias("exposed_at"), F.lit("shown").alias("outcome"))
    last = cards.groupBy(F.col("session_id").alias("id")).agg(F.max("ordinal").alias("__last"))
    moved = sessions.join(hit.select("id", F.col("ordinal").alias("__at")), "id", "left").join(last, "id", "left")
    place = F.when(F.col("__at").isNotNull(), F.col("__at") + 1).otherwise(F.col("position")).cast("int")
    done = F.col("__at").isNotNull() & (F.col("__at") >= F.col("__last"))
    out = moved.withColumns({"position": place, "status": F.when(done, "completed").otherwise(F.col("status")), "ended_at": F.when(done, ts(now)).otherwise(F.col("ended_at"))})
    return out.select(*sessions.columns), exposures


def stage_actions(current: DataFrame, stage_keys: DataFrame, on: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """skip or build per current (``on``, document_id, stage_key): unchanged branches are skipped."""
    known = stage_keys.select(*on, F.col("document_id").alias("__d"), F.col("stage_key").alias("__k"))
    same = F.col("__d").eqNullSafe(F.col("document_id")) & F.col("__k").eqNullSafe(F.col("stage_key"))
    return current.join(known, list(on), "left").select(*current.columns, F.when(same, "skip").otherwise("build").alias("action"))


def fetch_actions(responses: DataFrame, caches: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """reuse, reparse, fetch or error per response (cache_key, status, parser_version, body)."""
    c = caches.select("cache_key", F.col("parser_version").alias("__p"), F.col("raw_bytes").alias("__b"))
    joined = responses.join(c, "cache_key", "left")
    action = (
        F.when((F.col("status") == 304) & F.col("__p").isNull(), "error").when((F.col("status") == 304) & (F.col("__p") == F.col("parser_version")), "reuse")
        .when((F.col("status") == 304) & F.col("__b").isNotNull(), "reparse").when(F.col("status") != 200, "error").when(F.octet_length("body") > max_bytes, "error").otherwise("fetch")
    )
    return joined.select(*responses.columns, action.alias("action"))


def request_headers(requests: DataFrame, caches: DataFrame) -> DataFrame:
    """Requests (cache_key, ...) with the conditional headers that their cached answers allow."""
    c = caches.select("cache_key", "etag", "last_modified")
    told = F.map_filter(F.create_map(F.lit("If-None-Match"), F.col("etag"), F.lit("If-Modified-Since"), F.col("last_modified")), lambda _, v: v.isNotNull())
    return requests.join(c, "cache_key", "left").select(*requests.columns, told.alias("headers"))


def reloaded(actions: DataFrame, caches: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with ordered chunks of the answers to reuse: the cached document, else the latest one of the same content."""
    hit = actions.where("action = 'reuse'").select("cache_key").join(caches.select("cache_key", F.col("document_id").alias("cached"), "content_sha256"), "cache_key")
    newest = latest(documents, "content_sha256", F.desc("captured_at"), F.desc("id")).select("content_sha256", F.col("id").alias("same"))
    known = documents.select(F.col("id").alias("cached"), F.lit(True).alias("there"))
    chosen = hit.join(known, "cached", "left").join(newest, "content_sha256", "left").select("cache_key", F.when(F.col("there"), F.col("cached")).otherwise(F.col("same")).alias("document_id"))
    parts = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("id").alias("chunk_id"), "text"))).alias("chunks"))
    return chosen.where("document_id IS NOT NULL").join(parts, "document_id", "left")


def cache_updates(responses: DataFrame, now: datetime) -> DataFrame:
    """Cache rows of fetched answers (cache_key, action, body, etag, last_modified, parser_version, document_id)."""
    rows = responses.where("action IN ('fetch', 'reparse')")
    return rows.select("cache_key", F.sha2("body", 256).alias("content_sha256"), "etag", "last_modified", ts(now).alias("fetched_at"), "parser_version", "document_id", F.col("body").alias("raw_bytes"))


def rate_limited(adapter_state: DataFrame, now: datetime) -> DataFrame:
    """Adapters that must not be asked before their ``retry_after``."""
    return adapter_state.where(F.col("retry_after") > ts(now))


def create_jobs(jobs: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Jobs to append for ``new`` (idempotency_key, stage): a key that is there already, in any status, is not made again."""
    from factloom.functions.text import det_id

    fresh = new.dropDuplicates(["idempotency_key"]).join(jobs.select("idempotency_key"), "idempotency_key", "left_anti")
    return fresh.select(det_id("job", F.col("idempotency_key")).alias("id"), "idempotency_key", "stage", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), ts(now).alias("created_at"))


# Job leases ---------------------------------------------------------------------------------------


def claimable(jobs: DataFrame, now: datetime) -> DataFrame:
    return jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= ts(now)))).orderBy("created_at", "id").limit(1)


def claim(jobs: DataFrame, job_ids: DataFrame, worker: str, now: datetime, seconds: int = 60) -> DataFrame:
    """``jobs`` with the pending or lapsed ones among ``job_ids`` leased to ``worker``."""
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_expires_at") <= ts(now)))
    hit = F.col("__hit").isNotNull() & free
    marked = jobs.join(job_ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    changes = {"status": F.lit("running"), "lease_owner": F.lit(worker), "lease_expires_at": ts(now) + F.make_dt_interval(secs=F.lit(seconds)), "attempts": F.col("attempts") + 1}
    return _changed(jobs, marked, hit, changes)


def complete(jobs: DataFrame, job_id: str, worker: str, now: datetime) -> DataFrame:
    hit = (F.col("id") == job_id) & (F.col("lease_owner") == worker) & (F.col("status") == "running") & (F.col("lease_expires_at") > ts(now))
    return _changed(jobs, jobs, hit, {"status": F.lit("succeeded"), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})


def fail(jobs: DataFrame, job_id: str, worker: str, error_class: str, detail: str, retry_at: datetime) -> DataFrame:
    hit = (F.col("id") == job_id) & (F.col("lease_owner") == worker)
    return _changed(jobs, jobs, hit, {"status": F.lit("pending"), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "error_class": F.lit(error_class), "error_detail": F.lit(detail), "next_attempt_at": ts(retry_at)})


def recover(jobs: DataFrame, now: datetime) -> DataFrame:
    hit = (F.col("status") == "running") & (F.col("lease_expires_at") <= ts(now))
    return _changed(jobs, jobs, hit, {"status": F.lit("pending"), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})


def _changed(like: DataFrame, df: DataFrame, hit: Column, changes: dict[str, Column]) -> DataFrame:
    return df.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in like.columns))
