"""Ledgers and counters: model usage, feed statistics, run summaries, diagnostics, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def usage_rollup(usage: DataFrame) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return usage.groupBy("task_type", "model_id", "tier").agg(
        F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"), total("cached_tokens"), F.sum("latency_ms").alias("latency_ms"), total("cache_hit"), total("failed"),
    )


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Price of tokens, per million; NULL without prices."""
    return input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price


def feed_stats(exposures: DataFrame, pulses: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: shown, distinct cards and facts, repetitions, topics explored, sessions completed, positions."""
    seen = exposures.join(pulses.select("card_id", "fact_fingerprint", "topics"), "card_id", "left")
    shown = exposures.agg(F.count("*").alias("shown"), F.countDistinct("card_id").alias("distinct_cards"))
    facts = seen.agg(F.countDistinct("fact_fingerprint").alias("distinct_facts"), F.count("fact_fingerprint").alias("with_facts"))
    topics = seen.select(F.explode("topics").alias("t")).agg(F.countDistinct("t").alias("topics_explored"))
    done = sessions.agg(F.coalesce(F.sum((F.col("status") == "completed").cast("int")), F.lit(0)).alias("sessions_completed"), F.coalesce(F.sum("position"), F.lit(0)).alias("positions"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    joined = one(shown).join(one(facts), "__one").join(one(topics), "__one").join(one(done), "__one").drop("__one")
    return joined.withColumn("repetitions", F.col("with_facts") - F.col("distinct_facts")).drop("with_facts")


def least_age(exposures: DataFrame, now: Column) -> DataFrame:
    """Seconds since a fingerprint was last shown."""
    return exposures.groupBy("fingerprint").agg((F.unix_micros(now) - F.max(F.unix_micros("exposed_at"))).alias("us")).select("fingerprint", (F.col("us") / 1e6).alias("age_seconds"))


def exposure_distance(exposures: DataFrame) -> DataFrame:
    """Place of a fingerprint's latest exposure in its profile's list, newest first, from 0."""
    order = W.partitionBy("profile_id").orderBy(F.desc("exposed_at"), F.desc("id"))
    placed = exposures.withColumn("place", F.row_number().over(order) - 1)
    return placed.groupBy("profile_id", "fingerprint").agg(F.min("place").alias("distance"))


def run_counters(staged: DataFrame) -> DataFrame:
    """Build counters per run of staged candidates (run_id, status, escalation, required, outcome)."""
    n = lambda c: F.count_if(c)
    return staged.groupBy("run_id").agg(
        F.count("*").alias("candidates"), n(F.col("status") == "verified").alias("verified"), n(F.col("status") == "uncertain").alias("uncertain"),
        n(F.col("status") == "rejected").alias("rejected"), n(F.col("escalation").isNotNull()).alias("escalated"), n(F.coalesce("required", F.lit(False))).alias("required"),
        n(F.col("outcome") == "kept").alias("kept"), n(F.col("outcome") == "suppressed").alias("suppressed"),
    )


def build_counters(actions: DataFrame, chunked: DataFrame, staged: DataFrame, composed: DataFrame) -> DataFrame:
    """One row of what a build did: documents (action), chunks, candidates by status and escalation, facts by outcome."""
    n, is_ = F.count_if, lambda c, v: F.col(c).eqNullSafe(F.lit(v))
    docs = actions.agg(F.count("*").alias("documents"), n(is_("action", "build")).alias("documents_built"), n(is_("action", "skip")).alias("documents_skipped"))
    parts = chunked.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents_with_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    named = ("non_english", "policy_ambiguity", "multi_claim", "fidelity_rewrite", "weak_direct_support")
    claims = staged.agg(
        F.count("*").alias("candidates"), *(n(is_("status", v)).alias(v) for v in ("verified", "uncertain", "rejected")), n(F.size("risk_flags") > 0).alias("risk_flagged"), n("playable").alias("playable"),
        n(F.col("escalation").isNotNull()).alias("escalated"), n("required").alias("required"), *(n(is_("escalation", v)).alias(v) for v in named),
    )
    made = composed.agg(F.count("*").alias("composed"), n(is_("outcome", "kept")).alias("kept"), n(is_("outcome", "suppressed")).alias("suppressed"))
    return docs.crossJoin(parts).crossJoin(claims).crossJoin(made)  # one row each


def within_budget(calls: DataFrame, max_calls: int = 10, max_cost: float | None = None) -> DataFrame:
    """Adds ``used`` to calls (pos, cache_hit, cost): hits are free; the call that exhausts the budget is made, but its result is not used."""
    order = W.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    charged = calls.withColumns({"__k": F.sum((~F.col("cache_hit")).cast("int")).over(order), "__c": F.sum(F.when(~F.col("cache_hit"), F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).over(order)})
    fits = F.col("__k") <= max_calls
    if max_cost is not None:
        fits = fits & (F.col("__c") < max_cost)
    return charged.withColumn("used", F.col("cache_hit") | fits).drop("__k", "__c")


def finish_run(runs: DataFrame, counters: DataFrame, status: str, at: Column, detail: str = "") -> DataFrame:
    """Run rows with their counters, status, end and detail."""
    extra = [c for c in counters.columns if c not in runs.columns]
    return runs.join(counters.select("run_id", *extra), "run_id", "left").withColumns({"status": F.lit(status), "finished_at": at, "detail": F.lit(detail)})


def last_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def invalid_json(tables: dict[str, DataFrame], column: str = "payload_json") -> DataFrame:
    """Per table the number of rows whose payload is no JSON."""
    counted = [df.agg(F.count_if(F.expr(f"try_parse_json({column}) IS NULL")).alias("invalid")).select(F.lit(t).alias("table_name"), "invalid") for t, df in tables.items()]
    out = counted[0]
    for x in counted[1:]:
        out = out.union(x)
    return out


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Number of child rows whose parent is missing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count("*").alias("orphans"))
