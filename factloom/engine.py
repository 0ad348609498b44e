"""The engine's verbs over Parquet tables in one folder. ``now`` is given, never read from a clock."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text as T
from factloom.operators import commits, firewall, ledger, ranking, store
from factloom.operators.text_index import TextIndex
from factloom.plans import facts as P
from factloom.plans import quality_lane
from factloom.settings import Settings, capabilities
from factloom.sources import model, web
from factloom.streaming import ambient

#: Folders that a table is spread over at most.
FOLDERS = 30
#: Times that a verb is tried while other writers change what it read.
TRIES = 10
#: Readers of discovery answers by provider.
PROVIDERS = {"github": web.repositories, "papers": web.papers, "youtube": web.videos, "feed": web.feed_items}
#: Stored text indexes: table, key and text.
INDEXED = {"documents": ("id", "raw_text"), "chunks": ("id", "text"), "fact_index": ("pulse_id", "fact_text")}


class _Transaction:
    """What one verb read and changed on top of commit ``n``: folders by table, states by text index."""

    def __init__(self, n: int, state: dict):
        self.n, self.state, self.read, self.changes = n, state, set(), {}

    def get(self, name: str):
        self.read.add(name)
        return self.changes.get(name, self.state.get(name))


def transaction(verb):
    """All that the verb writes becomes current in one commit, or nothing does. It is done again if another writer changed what it read."""

    @wraps(verb)
    def run(self, *args, **kwargs):
        if self._open is not None:
            return verb(self, *args, **kwargs)
        for _ in range(TRIES):
            self._open = _Transaction(*self.log.latest())
            try:
                out = verb(self, *args, **kwargs)
                if self._commit(self._open):
                    return out
            finally:
                self._open = None
        raise commits.Conflict(f"{verb.__name__}: others changed its tables {TRIES} times")

    return run


class Engine:
    """Each table is a set of folders; one log names those that are current for all tables. Appends add a folder, other writes replace them."""

    def __init__(self, spark: SparkSession, path: str, now: datetime, settings: Settings | None = None, endpoint: quality_lane.Endpoint | None = None):
        """Escalated candidates pass the model lane if the settings turn it on and there is an endpoint, given or named by the settings."""
        self.spark, self.path, self.now, self.settings = spark, path.rstrip("/"), now, settings or Settings()
        self.endpoint = (endpoint or model.endpoint(self.settings)) if self.settings.quality_lane else None
        self.log, self._open = commits.Log(spark, f"{self.path}/_log"), None

    def _commit(self, t: _Transaction) -> bool:
        """Puts the next commit. What others committed in between is kept, unless it touches a table that the verb read or wrote."""
        n, state = t.n, t.state
        while t.changes and not self.log.put(n + 1, {**state, **t.changes}):
            n, state = self.log.latest()
            if any(state.get(name) != t.state.get(name) for name in t.read | set(t.changes)):
                return False
        return True

    def _current(self, name: str):
        """The folders of a table or the state of an index, as of the verb's own writes; None if never written."""
        return self._open.get(name) if self._open is not None else self.log.latest()[1].get(name)

    def table(self, name: str) -> DataFrame:
        """The current rows of a table, in its schema."""
        folders = self._current(name)
        schema = schemas.fields(name)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{v}" for v in folders))

    @transaction
    def write(self, name: str, rows: DataFrame, beside: list[str] | None = None) -> None:
        """Makes ``rows`` the table, or adds them to the folders ``beside``."""
        self._open.get(name)
        version = uuid.uuid4().hex
        schemas.migrate(rows, name).write.parquet(f"{self.path}/{name}/{version}")
        self._open.changes[name] = [*(beside or ()), version]

    @transaction
    def _append(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Adds the rows whose keys are new. Only they are written, until a table has ``FOLDERS`` folders; then it is written as one."""
        folders, known = self._current(name), self.table(name)
        new = schemas.migrate(rows, name)
        new = store.insert_absent(known, new, key) if folders else new.dropDuplicates([key])
        full = folders is not None and len(folders) >= FOLDERS
        self.write(name, known.unionByName(new) if full else new, None if full else folders)

    # The stored text indexes ------------------------------------------------------------------------

    def index(self, table: str) -> TextIndex:
        """The stored index of a table's texts."""
        return TextIndex(self.spark, f"{self.path}/{table}/_index", self._current(f"index {table}"))

    @transaction
    def _indexed(self, table: str, rows: DataFrame) -> None:
        """Adds new rows of a table to its index; older rows are not read."""
        self._open.changes[f"index {table}"] = self.index(table).add(rows, *INDEXED[table])

    @transaction
    def add_sources(self, urls: DataFrame) -> DataFrame:
        """Adds seeds (url, title) that conflict with no source; returns the added ones."""
        known = self.table("sources")
        new = web.deduplicated(web.explicit(urls), known).withColumns({"provenance": F.lit("user"), "retrieved_at": store.ts(self.now)})
        self._append("sources", firewall._checkpoint(new))
        return self.list_sources().join(new.select("id"), "id", "left_semi")

    def list_sources(self) -> DataFrame:
        return self.table("sources").orderBy("canonical_locator")

    @transaction
    def remove_sources(self, ids: DataFrame) -> None:
        names = ["sources", "evidence", "pulses", "exposures", "session_cards", "cards", "atoms"]
        for name, rows in store.remove_source({n: self.table(n) for n in names}, ids).items():
            self.write(name, rows)

    def dry_run(self, docs: DataFrame) -> DataFrame:
        """Numbers of documents (doc_id, source, lang, text) that a refresh would skip and build."""
        return self._actions(docs).groupBy("action").agg(F.count("*").alias("n"))

    def _stage_key(self) -> Column:
        lane = self.endpoint is not None
        return P.stage_key(F.col("document_id"), (self.settings.model_id or "model") if lane else None, lane)

    def _lane(self, staged: DataFrame, run: str) -> DataFrame:
        """Facts that the model lane made of escalated candidates, as staged rows; its cache and usage are stored."""
        s = self.settings
        pos = F.concat_ws("|", "source_id", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
        asked = staged.where("escalation IS NOT NULL").select(F.col("atom_id").alias("key"), pos.alias("pos"), "statement", F.col("text").alias("evidence"), "escalation", "required")
        prices = quality_lane.Prices(s.input_price, s.output_price) if s.model_cost is not None else None
        got = quality_lane.run_lane(asked, self.table("model_cache"), self.endpoint, s.model_calls, s.model_cost, prices, bool(s.strong_model_id) or not s.model_id, s.model_id or "model", P.QUALITY)
        self._append("model_cache", got["cache"], "cache_key")
        usage = got["usage"].withColumn("id", T.det_id("usage", F.lit(run), F.col("pos"), F.col("stage").cast("string")))
        tier = F.when(F.col("tier") == "strong", s.strong_model_id or s.model_id).otherwise(s.model_id)
        self._append("model_usage", usage.withColumns({"run_id": F.lit(run), "task_type": F.col("task"), "model_id": tier}))
        made = staged.join(got["outcomes"].where("fact IS NOT NULL").select(F.col("key").alias("atom_id"), F.col("outcome").alias("__how"), "fact"), "atom_id")
        own = F.col("__how") == "verified_original"
        again = made.withColumn("statement", F.col("fact")).withColumn("claim_hash", T.fingerprint(F.col("statement")))
        return again.withColumns({
            "evidence_id": F.when(own, F.col("evidence_id")).otherwise(T.det_id("evidence", F.col("source_id"), F.col("document_id"), F.col("chunk_id"), F.col("claim_hash"))),
            "atom_id": F.when(own, F.col("atom_id")).otherwise(T.det_id("atom", F.col("chunk_id"), P.derived_contract(P.EXTRACTOR, s.model_id or "model", True), F.col("claim_hash"))),
            "status": F.lit("verified"), "playable": F.lit(True), "reason": F.when(own, F.col("reason")).otherwise("model_verified"), "escalation": F.lit(None).cast("string"),
        }).select(*staged.columns)

    def _actions(self, docs: DataFrame) -> DataFrame:
        current = P.parsed(docs).select("doc_id", "source_id", "document_id").withColumn("stage_key", self._stage_key())
        return store.stage_actions(current.withColumn("doc_id", F.col("doc_id").cast("string")), self.table("stage_keys"), ("source_id", "doc_id"))

    @transaction
    def refresh(self, docs: DataFrame, more: dict[str, int] | None = None) -> DataFrame:
        """Builds changed documents and keeps what that makes; returns the new pulses.

        Evidence and atoms of all candidates stay, playable or not. Facts pass the firewall against the stored index and each
        other, in build order; what is kept becomes a card, a pulse and a row of the index. The run's counters are stored, with ``more`` beside them.
        """
        start, before = self._started("refresh"), self.table("pulses").select("id")
        actions = firewall._checkpoint(self._actions(docs))
        todo = actions.where("action = 'build'")
        changed = docs.join(todo.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi") if dict(docs.dtypes)["doc_id"] != "string" else docs.join(todo.select("doc_id"), "doc_id", "left_semi")
        parsed, chunked = P.parsed(changed), P.chunks(changed)
        staged = firewall._checkpoint(P.classify(P.verify(P.claims(chunked))))
        fast, every = staged.where("escalation IS NULL"), staged
        if self.endpoint is not None:
            made = firewall._checkpoint(self._lane(staged, start))
            fast, every = fast.unionByName(made), staged.unionByName(made).dropDuplicates(["atom_id"])
        composed = firewall._checkpoint(self._firewalled(P.compose(fast).dropDuplicates(["pulse_id"])))
        kept = composed.where("outcome = 'kept'")
        now, one = store.ts(self.now), lambda c: F.array(F.col(c))
        verification = F.struct("status", F.array("reason").alias("reason_codes"), "risk_flags", (F.col("reason") == "model_verified").alias("provider_used"))
        made = {
            "documents": parsed.select(F.col("document_id").alias("id"), "source_id", F.sha2("body", 256).alias("content_sha256"), F.col("body").alias("raw_text"), now.alias("captured_at")),
            "chunks": chunked.select(F.col("chunk_id").alias("id"), "document_id", "ordinal", "text", "char_start", "char_end"),
            "fact_index": kept.select("pulse_id", "card_id", "source_id", F.col("fact_fingerprint").alias("fingerprint"), F.col("display_fact").alias("fact_text"), now.alias("created_at")),
        }
        for name, rows in made.items():
            self._append(name, rows, INDEXED[name][0])
            self._indexed(name, rows)
        self._append("evidence", every.select(F.col("evidence_id").alias("id"), "source_id", "document_id", "chunk_id", F.substring("text", 1, 500).alias("quote"), F.col("reason").alias("support")))
        self._append("atoms", every.select(F.col("atom_id").alias("id"), "statement", F.col("status").alias("claim_status"), one("evidence_id").alias("evidence_ids"), now.alias("created_at")))
        self._append("cards", kept.select(F.col("card_id").alias("id"), F.lit("question").alias("card_type"), F.col("display_fact").alias("prompt"), one("atom_id").alias("atom_ids"), one("evidence_id").alias("evidence_ids"), now.alias("created_at")))
        self._append("pulses", kept.select(
            F.col("pulse_id").alias("id"), "card_id", "atom_id", "display_fact", F.array(F.coalesce("lang", F.lit("general"))).alias("topics"), "source_id", "document_id", one("evidence_id").alias("evidence_ids"),
            now.alias("verified_at"), verification.alias("verification"), self._stage_key().alias("stage_key"), "fact_fingerprint",
        ))
        stamps = todo.select("source_id", "doc_id", "document_id", F.lit(P.PARSER).alias("parser_version"), "stage_key", now.alias("built_at"))
        self.write("stage_keys", store.upsert(self.table("stage_keys"), schemas.migrate(stamps, "stage_keys"), ["source_id", "doc_id"], "built_at"))
        self._finished(start, ledger.build_counters(actions, chunked, staged, composed).withColumns({k: F.lit(v) for k, v in (more or {}).items()}))
        return self.table("pulses").join(before, "id", "left_anti")

    @transaction
    def refresh_sources(self, opener=None, pause: float = 0.0) -> DataFrame:
        """Asks the addresses of all sources, conditionally where an answer is cached, and builds what changed; returns the new pulses.

        Answers 304 are read from the cache: as they were parsed, or parsed anew if the parser is another one by now. What cannot be read changes
        nothing. The run's counters tell fetched, reused, reparsed and failed answers. A host is asked by one task, request after request.
        """
        caches = self.table("caches")
        wanted = self.table("sources").select(T.det_id("cache", F.col("canonical_locator")).alias("cache_key"), F.col("canonical_locator").alias("url"), F.col("id").alias("source_id"))
        asked = store.request_headers(wanted, caches).withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)))
        answers = firewall._checkpoint(web.fetched(asked, opener, pause))
        held = caches.select("cache_key", F.col("parser_version").alias("held"))
        known = sorted({v for versions in web.PARSERS.values() for v in versions})
        now_by = F.when(F.col("held").isin(known), F.col("held")).otherwise(F.lit("another"))
        typed = answers.join(held, "cache_key", "left").withColumn("parser_version", now_by).drop("held")
        acted = firewall._checkpoint(store.fetch_actions(typed, caches))
        raw = caches.select("cache_key", "raw_bytes", F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"))
        both = acted.where("action IN ('fetch', 'reparse')").join(raw, "cache_key", "left")
        again = F.col("action") == "reparse"
        bodies = both.withColumns({
            "body": F.when(again, F.col("raw_bytes")).otherwise(F.col("body")), "etag": F.when(again, F.col("old_etag")).otherwise(F.col("etag")), "last_modified": F.when(again, F.col("old_modified")).otherwise(F.col("last_modified")),
            "mime_type": F.when(again, F.when(F.startswith(F.decode("raw_bytes", "ISO-8859-1"), F.lit("%PDF-")), "application/pdf").when(F.decode("raw_bytes", "ISO-8859-1").rlike("(?i)<(html|body|p|div)[ >]"), "text/html").otherwise("text/plain")).otherwise(F.col("mime_type")),
        })
        parsed = firewall._checkpoint(web.parse_documents(bodies))
        new = parsed.where("error IS NULL").select(F.col("cache_key").alias("doc_id"), "text", F.col("source_id").alias("source"), F.lit(None).cast("string").alias("lang"))
        same = store.reloaded(acted, caches, self.table("documents"), self.table("chunks")).join(self.table("documents").select(F.col("id").alias("document_id"), "raw_text", "source_id"), "document_id")
        docs = firewall._checkpoint(new.unionByName(same.select(F.col("cache_key").alias("doc_id"), F.col("raw_text").alias("text"), F.col("source_id").alias("source"), F.lit(None).cast("string").alias("lang"))))
        told = {r.action: r.n for r in acted.groupBy("action").agg(F.count("*").alias("n")).collect()}  # four actions at most
        unread = parsed.where("error IS NOT NULL").count()
        fetching = {"fetched": told.get("fetch", 0), "reused": told.get("reuse", 0), "reparsed": told.get("reparse", 0), "fetch_errors": told.get("error", 0) + unread}
        pulses = self.refresh(docs, fetching)
        ids = P.parsed(docs).select(F.col("doc_id").alias("cache_key"), "document_id")
        kept = parsed.where("error IS NULL").withColumn("parser_version", F.col("parser")).join(ids, "cache_key", "left")
        self.write("caches", store.upsert(caches, schemas.migrate(store.cache_updates(kept, self.now), "caches"), ["cache_key"], "fetched_at"))
        return pulses

    def _firewalled(self, composed: DataFrame) -> DataFrame:
        """``composed`` with outcome: exact and near repeats of stored or earlier facts of other sources are suppressed."""
        pos = F.concat_ws("|", F.lit("1"), "source_id", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
        new = composed.select("pulse_id", "source_id", F.col("display_fact").alias("fact_text"), F.col("fact_fingerprint").alias("fingerprint"), pos.alias("pos"), F.lit(False).alias("settled"))
        held = self.table("fact_index").join(composed.select("pulse_id"), "pulse_id", "left_anti")
        old = held.select("pulse_id", "source_id", "fact_text", "fingerprint", F.concat_ws("|", F.lit("0"), F.date_format("created_at", "yyyyMMddHHmmss"), "pulse_id").alias("pos"), F.lit(True).alias("settled"))
        decided = firewall.first_wins(firewall._checkpoint(old.union(new)), self.settings.shortlist, self.settings.near, self.index("fact_index"))
        return composed.join(decided.select("pulse_id", "outcome"), "pulse_id")

    # Runs -----------------------------------------------------------------------------------------

    def _started(self, kind: str) -> str:
        run = f"{kind}-{self.table('runs').count()}-{self.now:%Y%m%d%H%M%S}"
        row = self.spark.createDataFrame([(run, "running")], "run_id string, status string").withColumn("started_at", store.ts(self.now))
        self._append("runs", row, "run_id")
        return run

    def _finished(self, run: str, counters: DataFrame, status: str = "succeeded", detail: str = "") -> None:
        told = {k: int(v or 0) for k, v in counters.first().asDict().items()}
        row = self.table("runs").where(F.col("run_id") == run).withColumns({
            "status": F.lit(status), "finished_at": store.ts(self.now), "detail": F.lit(detail),
            "counters": F.create_map(*(x for k, v in told.items() for x in (F.lit(k), F.lit(v).cast("long")))),
        })
        self.write("runs", store.upsert(self.table("runs"), row, ["run_id"], "started_at"))

    def runs(self) -> DataFrame:
        return self.table("runs").orderBy(F.desc("started_at"), F.desc("run_id"))

    def last_run(self) -> DataFrame:
        return ledger.last_run(self.table("runs"))

    # Profiles -------------------------------------------------------------------------------------

    @transaction
    def set_profile(self, profile_id: str, weights: str, excluded: str = "", unexpected: float = 0.1) -> None:
        """``weights``: "topic=weight, ..."; a topic without a number weighs 1."""
        told = [x.strip().partition("=") for x in weights.split(",") if x.strip()]
        row = [(profile_id, profile_id, {t.strip(): float(w or 1) for t, _, w in told}, [x.strip() for x in excluded.split(",") if x.strip()], unexpected, self.settings.max_streak)]
        self.write("profiles", store.upsert(self.table("profiles"), self.spark.createDataFrame(row, schemas.TABLES["profiles"]), ["id"], "id"))

    def profile(self, profile_id: str) -> DataFrame:
        return self.table("profiles").where(F.col("id") == profile_id)

    @transaction
    def reset_profile(self, profile_id: str) -> None:
        self.write("profiles", self.table("profiles").where(F.col("id") != profile_id))

    # Serving --------------------------------------------------------------------------------------

    def ranked_pool(self, profile_id: str) -> DataFrame:
        """Current pulses that a profile may be shown, ranked: nothing shown lately in these or like words, nothing queued."""
        pulses, exposures = self.table("pulses"), self.table("exposures").where(F.col("profile_id") == profile_id)
        index = self.table("fact_index")
        current = store.eligible(pulses, self.table("stage_keys"))
        facts = current.withColumnRenamed("id", "pulse_id").join(index.select("pulse_id", "fingerprint", "fact_text"), "pulse_id")
        recent = store.recent_exposures(exposures, pulses, index, self.now, self.settings.recent_hours)
        seen = recent.select(F.col("id").alias("probe_id"), F.col("fact_text").alias("probe_text"), "fingerprint").where("probe_text IS NOT NULL")
        queued = store.pending(self.table("sessions").where(F.col("profile_id") == profile_id), self.table("session_cards")).select("card_id")
        left = store.pool(facts, firewall.suppressed_pool(facts.select("pulse_id", "source_id", "fact_text", "fingerprint"), seen, stored=self.index("fact_index")), seen.select("fingerprint").distinct(), queued.distinct())
        sources = self.table("sources").select(F.col("id").alias("source_id"), "trust")
        age = (F.unix_micros(store.ts(self.now)) - F.unix_micros("verified_at")) / 1e6
        last = ledger.least_age(exposures.join(facts.select("card_id", "fingerprint"), "card_id"), store.ts(self.now))
        v = F.col("verification")
        made = left.join(sources, "source_id", "left").join(last, "fingerprint", "left").select(
            F.col("pulse_id").alias("id"), "card_id", "source_id", "fact_text", "fingerprint", F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("general")).alias("topic"),
            (v["status"] == "verified").alias("verified"), ranking.quality_class(v["status"], v["risk_flags"], v["reason_codes"], v["provider_used"])["quality"].alias("quality"),
            ranking.source_quality(F.coalesce("trust", F.lit("remote_untrusted"))).alias("source_quality"), F.lit(0.5).alias("usefulness"), F.lit(0.5).alias("appeal"),
            ranking.freshness(age).alias("freshness"), F.coalesce(ranking.novelty_from_age(F.col("age_seconds")), F.lit(1.0)).alias("novelty"),
        )
        p = self.profile(profile_id).first()
        weights = F.create_map(*(x for t, w in p.topic_weights.items() for x in (F.lit(t), F.lit(float(w))))) if p and p.topic_weights else F.create_map(F.lit("general"), F.lit(1.0))
        excluded = F.array(*map(F.lit, p.excluded_topics)).cast("array<string>") if p else F.array().cast("array<string>")
        ranked = ranking.rank(made, weights, excluded, p.unexpected_discovery_weight if p else 0.1)
        known = list(p.topic_weights) if p and p.topic_weights else []
        return ranked.select(F.lit(profile_id).alias("profile_id"), "card_id", "topic", "score", F.col("fact_text").alias("text"), "fingerprint", (~F.col("topic").isin(known) if known else F.lit(False)).alias("unexpected"))

    def _planned(self, profile_id: str, generation: int) -> DataFrame:
        s, pool = self.settings, firewall._checkpoint(self.ranked_pool(profile_id))
        queue = ranking.plan_queues(pool, s.queue_size, s.max_streak, s.diversity, s.unexpected_share, generation)
        return firewall._checkpoint(queue.join(pool.select("card_id", "fingerprint"), "card_id"))

    @transaction
    def prepare(self, profile_id: str) -> DataFrame:
        """The cards to show: those of the active session, else of a new one."""
        sessions = self.table("sessions")
        mine = sessions.where(F.col("profile_id") == profile_id)
        if store.active_sessions(mine).isEmpty():
            queue = self._planned(profile_id, 0)
            cards = [r.card_id for r in queue.orderBy("ordinal").collect()]  # a queue's few ids
            if cards:
                made = self.spark.range(1).select(T.det_id("session", F.lit(profile_id), F.lit(str(mine.count())), *map(F.lit, cards)).alias("id"), F.lit(profile_id).alias("profile_id"), F.lit("active").alias("status"), store.ts(self.now).alias("started_at"), F.lit(0).alias("position"), F.lit(0).alias("generation"))
                made = firewall._checkpoint(made)
                self._append("sessions", made)
                rows = queue.crossJoin(F.broadcast(made.select(F.col("id").alias("session_id")))).select("session_id", "card_id", "ordinal", "reason", "fingerprint")  # one session
                self.write("session_cards", self.table("session_cards").unionByName(schemas.migrate(rows, "session_cards")))
        return self.pending_cards(profile_id)

    def pending_cards(self, profile_id: str) -> DataFrame:
        return store.pending(self.table("sessions").where(F.col("profile_id") == profile_id), self.table("session_cards")).orderBy("ordinal")

    @transaction
    def refill(self, profile_id: str) -> int:
        """Appends a planned batch when few cards are left; returns how many."""
        mine, cards = self.table("sessions").where(F.col("profile_id") == profile_id), self.table("session_cards")
        low = store.queue_low(mine, cards, self.settings.watermark).first()
        if low is None:
            return 0
        generation = (mine.where(F.col("id") == low.session_id).first().generation or 0) + 1
        batch = self._planned(profile_id, generation).select(F.lit(low.session_id).alias("session_id"), "card_id", "reason", "fingerprint", F.col("ordinal").alias("seq"))
        new = firewall._checkpoint(store.append_cards(cards, batch))
        added = new.count()
        if added:
            self.write("session_cards", cards.unionByName(schemas.migrate(new, "session_cards")))
            self.write("sessions", store.coalesce_update(self.table("sessions"), self.spark.createDataFrame([(low.session_id, generation)], "id string, generation int")))
        return added

    @transaction
    def acknowledge(self, profile_id: str, card_id: str) -> None:
        """Counts a card as shown if it is the one at the session's place; a repeat adds nothing."""
        sessions, cards = self.table("sessions"), self.table("session_cards")
        at = self.current_cards().where((F.col("profile_id") == profile_id) & (F.col("card_id") == card_id)).select("profile_id", "card_id")
        moved, shown = store.acknowledge(sessions, firewall._checkpoint(at), cards, self.now)
        moved, shown = firewall._checkpoint(moved), firewall._checkpoint(shown)
        self._append("exposures", shown)
        self.write("sessions", moved)

    # Discovery ------------------------------------------------------------------------------------

    @transaction
    def discover(self, provider: str, answers: DataFrame, limit: int = 10) -> dict[str, int]:
        """Keeps what a provider's answers name and nobody has yet as candidates, at most ``limit``; returns counters.

        An adapter that was told to wait is not asked.
        """
        if not store.rate_limited(self.table("adapter_state"), self.now).where(F.col("adapter") == provider).isEmpty():
            return {"rate_limited": 1, "results": 0, "deduplicated": 0, "candidates": 0}
        read = PROVIDERS[provider]
        found = firewall._checkpoint((read(answers) if provider == "feed" else read(answers, limit)).limit(limit))
        fresh = web.deduplicated(found, self.table("sources"), self.table("discovery_candidates"))
        rows = fresh.withColumns({"provider": F.lit(provider), "discovered_at": store.ts(self.now)})
        known = self.table("discovery_candidates").count()
        self._append("discovery_candidates", rows)
        kept = self.table("discovery_candidates").count() - known
        return {"rate_limited": 0, "results": found.count(), "deduplicated": found.count() - kept, "candidates": kept}

    def candidates(self) -> DataFrame:
        return self.table("discovery_candidates").orderBy("discovered_at", "id")

    @transaction
    def register(self, ids: DataFrame) -> DataFrame:
        """Candidates (id) become sources, unless one has their locator or identity, and leave the candidates."""
        chosen = firewall._checkpoint(self.table("discovery_candidates").join(ids.select("id"), "id", "left_semi"))
        new = web.deduplicated(chosen, self.table("sources")).withColumns({"source_type": F.col("provider"), "trust": F.lit("remote_untrusted"), "provenance": F.lit("discovered"), "retrieved_at": store.ts(self.now)})
        new = firewall._checkpoint(schemas.migrate(new, "sources"))
        self._append("sources", new)
        self.drop_candidates(chosen.select("id"))
        return new

    @transaction
    def drop_candidates(self, ids: DataFrame) -> None:
        self.write("discovery_candidates", self.table("discovery_candidates").join(ids.select("id"), "id", "left_anti"))

    @transaction
    def wait_for(self, adapter: str, until: datetime, detail: str = "") -> None:
        """An adapter answered that it must not be asked before ``until``."""
        row = self.spark.createDataFrame([(adapter, until, detail, self.now)], schemas.TABLES["adapter_state"])
        self.write("adapter_state", store.upsert(self.table("adapter_state"), row, ["adapter"], "updated_at"))

    # Harness, search, checks ----------------------------------------------------------------------

    @transaction
    def emit(self, adapter: str, event_type: str) -> bool:
        """Records an event that the adapter's capabilities support."""
        row = self.spark.createDataFrame([(f"{adapter}-{self.table('harness_events').count()}", adapter, event_type, self.now)], "id string, adapter string, event_type string, occurred_at timestamp")
        fit = firewall._checkpoint(ambient.normalize(row))
        self._append("harness_events", fit)
        return not fit.isEmpty()

    def ambient_state(self) -> DataFrame:
        events = self.table("harness_events").select(F.col("adapter").alias("session_id"), F.col("occurred_at").alias("ts"), "event_type")
        return ambient.current(ambient.changes(events), store.ts(self.now))

    def search(self, query: str, what: str = "documents", limit: int = 20) -> DataFrame:
        """Documents, chunks or facts that hold all words of ``query``, best first."""
        q = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        key = INDEXED[what][0]
        hits = self.index(what).search(q, limit).withColumnRenamed("key", key)
        return self.table(what).join(F.broadcast(hits), key).orderBy("rank")  # at most ``limit`` rows

    def doctor(self) -> DataFrame:
        """(check, value): capabilities, broken references, invalid rows, jobs to recover, whether a queue is ready, the last run."""
        t = self.table
        links = (("chunks", "document_id", "documents", "id"), ("pulses", "atom_id", "atoms", "id"), ("pulses", "card_id", "cards", "id"), ("fact_index", "pulse_id", "pulses", "id"), ("exposures", "card_id", "cards", "id"), ("session_cards", "session_id", "sessions", "id"))
        told = {f"capability {k}": int(v) for k, v in capabilities(self.settings).items()}
        told |= {f"orphans {c}.{k}": ledger.orphans(t(c), k, t(p), pk).first().orphans for c, k, p, pk in links}
        told |= {f"invalid {n}": schemas.validate(t(n), n).where("size(violations) > 0").count() for n in schemas.RULES}
        told["jobs to recover"] = t("jobs").where((F.col("status") == "running") & (F.col("lease_expires_at") <= store.ts(self.now))).count()
        told["queue ready"] = int(not store.pending(t("sessions"), t("session_cards")).isEmpty())
        told["last run succeeded"] = int(not self.last_run().where("status = 'succeeded'").isEmpty())
        return self.spark.createDataFrame(sorted(told.items()), "check string, value long")

    def inspect(self, pulse_id: str) -> DataFrame:
        """A pulse with its source, atom, card and evidence."""
        named = lambda table, key, *columns: self.table(table).select(F.col("id").alias(key), *columns)
        pulse = self.table("pulses").where(F.col("id") == pulse_id)
        quotes = pulse.select(F.explode("evidence_ids").alias("evidence_id")).join(named("evidence", "evidence_id", "quote", "support", "chunk_id"), "evidence_id")
        quotes = quotes.agg(F.collect_list(F.struct("evidence_id", "chunk_id", "quote", "support")).alias("evidence")).withColumn("id", F.lit(pulse_id))
        joined = pulse.join(named("sources", "source_id", "canonical_locator", "title", "trust"), "source_id", "left").join(named("atoms", "atom_id", "statement", "claim_status"), "atom_id", "left")
        return joined.join(named("cards", "card_id", "card_type", "prompt"), "card_id", "left").join(quotes, "id", "left")

    def stats(self) -> DataFrame:
        return ledger.feed_stats(self.table("exposures"), self.table("pulses"), self.table("sessions"))

    def current_cards(self) -> DataFrame:
        return store.current_card(self.table("sessions"), self.table("session_cards"), self.table("pulses"))
