"""From documents to verified facts: chunk, extract, verify, classify, compose. One narrow native DAG per step.

Documents come with (doc_id, source, text); everything up to first-claim-wins is a projection or generator, so
no row is shuffled before claims, which are small, are compared within their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import text as T
from factloom.operators.firewall import _checkpoint as checkpointed

EXTRACTOR = "extract-no-llm-v1"
VERIFIER = "verify-deterministic-v1"
COMPOSER = "compose-question-v1"
QUALITY = "quality-lane-v1"
FACT = "fact-fidelity-v1"
PARSER = "plain-1"
CEILING = 1200


def derived_contract(extractor: str = EXTRACTOR, model_id: str | None = None, quality: bool = False) -> str:
    return "|".join([extractor, QUALITY, FACT, model_id or "no-model", "quality" if quality else "fast"])


def stage_key(document_id: Column, model_id: str | None = None, quality: bool = False) -> Column:
    return T.det_id("stage", "build-v2", document_id, derived_contract(EXTRACTOR, model_id, quality), VERIFIER, COMPOSER)


def document_key(content_sha256: Column, parser: Column | str) -> Column:
    return F.sha2(F.concat(content_sha256, F.lit("\x1f"), parser if isinstance(parser, Column) else F.lit(parser)), 256)


def model_cache_key(task: Column | str, evidence: Column, contract: str, model_id: str) -> Column:
    return T.det_id("modelcache", task, contract, model_id, F.sha2(F.substring(evidence, 1, 2000), 256))


def parsed(docs: DataFrame) -> DataFrame:
    """Normalised texts with their document ids; empty texts go."""
    base = docs.select("doc_id", F.col("source").alias("source_id"), "lang", T.norm_text(F.col("text")).alias("body")).where("body <> ''")
    return base.withColumn("document_id", T.det_id("document", F.col("source_id"), F.col("doc_id").cast("string"), F.sha2("body", 256)))


def packed(body: Column, ceiling: int = CEILING) -> Column:
    """Sentences packed greedily into chunks of at most ``ceiling`` characters; a longer sentence stays whole."""
    if ceiling < 100:
        raise ValueError("chunk ceiling must be at least 100 characters")
    units = F.filter(F.transform(F.split(body, rf"(?U)(?<=[.!?]){T.SPACE}+|\n{{2,}}"), lambda u: F.trim(u)), lambda u: u != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, unit: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(unit) > ceiling)
        longer = F.when(acc["cur"] == "", unit).otherwise(F.concat(acc["cur"], F.lit(" "), unit))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, unit).otherwise(longer).alias("cur"))

    return F.aggregate(units, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def chunks(docs: DataFrame, ceiling: int = CEILING, parser: str = PARSER) -> DataFrame:
    """doc_id, source_id, document_id, ordinal, text, char_start, char_end, chunk_id."""
    each = parsed(docs).select("doc_id", "source_id", "lang", "document_id", packed(F.col("body"), ceiling).alias("all"))
    placed = each.select(
        "doc_id", "source_id", "lang", "document_id", "all",
        F.aggregate(
            "all", F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next")),
            lambda acc, c: F.struct(F.concat(acc["at"], F.array(acc["next"])).alias("at"), (acc["next"] + F.length(c) + 1).alias("next")),
            lambda acc: acc["at"],
        ).alias("starts"),
    )
    rows = placed.select("doc_id", "source_id", "lang", "document_id", F.posexplode(F.arrays_zip("all", "starts")).alias("ordinal", "c"))
    rows = rows.select("doc_id", "source_id", "lang", "document_id", "ordinal", F.col("c.all").alias("text"), F.col("c.starts").alias("char_start"))
    identity = T.det_id("chunk", F.col("document_id"), parser, F.col("ordinal").cast("string"), F.sha2("text", 256))
    return rows.withColumn("char_end", F.col("char_start") + F.length("text")).withColumn("chunk_id", identity)


def claims(chunked: DataFrame, contract: str | None = None) -> DataFrame:
    """The first sentence of every usable chunk; equal claims of a document count once, the earliest chunk's."""
    contract = contract or derived_contract()
    found = chunked.where(T.chunk_usable(F.col("text"))).withColumn("statement", F.trim(T.first_sentence(F.col("text"))))
    found = found.where(T.sentence_usable(F.col("statement"))).withColumn("claim_hash", T.fingerprint(F.col("statement")))
    first = W.partitionBy("document_id", "claim_hash").orderBy("ordinal")
    kept = found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumns({
        "evidence_id": T.det_id("evidence", F.col("source_id"), F.col("document_id"), F.col("chunk_id"), F.col("claim_hash")),
        "atom_id": T.det_id("atom", F.col("chunk_id"), contract, F.col("claim_hash")),
    })


def verify(candidates: DataFrame, judged: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Adds status, reason, risk_flags and playable. ``judged``: (atom_id, verdict, confidence, reason) of an optional verifier.

    Candidates without a chunk are rejected; the evidence is the chunk's first 500 characters.
    """
    excerpt, statement = F.substring("text", 1, 500), F.col("statement")
    if judged is not None:
        candidates = candidates.join(judged.select("atom_id", "verdict", "confidence", F.col("reason").alias("judge_reason")), "atom_id", "left")
    else:
        candidates = candidates.withColumns({"verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "judge_reason": F.lit(None).cast("string")})
    missing = F.size(F.array_except(T.plain_numbers(statement), T.plain_numbers(excerpt))) > 0
    direct = F.contains(T.fold(excerpt), F.regexp_replace(T.fold(statement), r"\.+$", ""))
    status = (
        F.when(F.col("chunk_id").isNull() | F.col("text").isNull(), "rejected").when(missing, "uncertain").when(direct, "verified")
        .when((F.col("verdict") == "supported") & (F.col("confidence") >= threshold), "verified").when(F.col("verdict") == "contradicted", "rejected").otherwise("uncertain")
    )
    reason = (
        F.when(F.col("chunk_id").isNull() | F.col("text").isNull(), "orphaned_or_stale_evidence").when(missing, "unsupported_numeric_anchor")
        .when(direct, "direct_textual_support").otherwise(F.coalesce("judge_reason", F.lit("deterministic_support_ambiguous")))
    )
    out = candidates.withColumns({"status": status, "reason": reason, "risk_flags": T.risk_flags(statement)}).drop("verdict", "confidence", "judge_reason")
    return out.withColumn("playable", (F.col("status") == "verified") & (F.size("risk_flags") == 0))


def word_count(statement: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(statement, r"\.+$", ""), rf"(?U){T.SPACE}+"), lambda w: w != ""))


def periods(statement: Column) -> Column:
    return F.length(statement) - F.length(F.replace(statement, F.lit("."), F.lit("")))


def classify(verified: DataFrame) -> DataFrame:
    """Adds escalation (NULL for the fast lane) and whether it is required."""
    s = F.col("statement")
    words, clickbait = word_count(s), T.has_word(s, T.CLICKBAIT_CLASSIFY)
    reason = (
        F.when(~T.is_english(s), "non_english").when((F.size("risk_flags") > 0) & ~F.col("playable"), "policy_ambiguity")
        .when(F.contains(s, F.lit(":")) | F.contains(s, F.lit(";")) | (periods(s) != 1), "multi_claim")
        .when((F.length(s) > 240) | (words > 40) | clickbait, "fidelity_rewrite")
        .when(F.col("status") == "uncertain", "weak_direct_support").when(words > 24, "fidelity_rewrite_optional")
    )
    return verified.withColumn("__r", reason).select(
        *verified.columns, F.when(F.col("__r") == "fidelity_rewrite_optional", "fidelity_rewrite").otherwise(F.col("__r")).alias("escalation"),
        (F.col("__r").isNotNull() & (F.col("__r") != "fidelity_rewrite_optional")).alias("required"),
    )


def compose(classified: DataFrame, card_type: str = "question") -> DataFrame:
    """Playable facts in the concise grammar: adds display_fact, fact_fingerprint, card_id, pulse_id."""
    body = F.when(F.endswith("statement", F.lit(".")), F.col("statement")).otherwise(F.concat("statement", F.lit(".")))
    out = classified.where("playable").withColumn("display_fact", body)
    words = word_count(F.col("display_fact"))
    out = out.where((F.length("display_fact") <= 240) & words.between(3, 40) & (periods(F.col("display_fact")) == 1) & ~T.has_word(F.col("display_fact"), T.CLICKBAIT_COMPOSE))
    card = T.det_id("card", F.col("atom_id"), card_type, "deterministic-v1")
    return out.withColumn("fact_fingerprint", T.fingerprint(F.col("display_fact"))).withColumn("card_id", card).withColumn("pulse_id", T.det_id("pulse", F.col("card_id")))


#: Fixed values.
RELATIONSHIPS = ("same_concept", "prerequisite", "mechanism", "contrast", "chronology", "connection")


def compose_sequences(cards: DataFrame, maximum: int = 6) -> DataFrame:
    """Groups (sequence_id, relationship, position, card_id) into ordered sequences; ``valid`` tells whether 2 to ``maximum`` cards in one known relationship came."""
    out = cards.groupBy("sequence_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "card_id"))), lambda x: x["card_id"]).alias("card_ids"),
        F.min("relationship").alias("relationship"), F.countDistinct("relationship").alias("__k"),
    )
    valid = F.size("card_ids").between(2, maximum) & (F.col("__k") == 1) & F.col("relationship").isin(*RELATIONSHIPS)
    return out.select("sequence_id", "relationship", "card_ids", valid.alias("valid"))


def exact_first(facts: DataFrame) -> DataFrame:
    """First-wins among equal fingerprints of different sources, in build order (source, doc_id, ordinal).

    The earliest fact of a fingerprint is kept, and so are facts of the same source as it: a source's own facts never suppress each
    other. The first source of a fingerprint is an aggregate, so a fact that very many tell is summed before it is shuffled. ``facts``
    is read twice and had better be written.
    """
    first = facts.groupBy("fact_fingerprint").agg(F.min("source_id").alias("__first"), F.count_if(F.col("source_id").isNull()).alias("__none"))
    first = first.select("fact_fingerprint", F.when(F.col("__none") == 0, F.col("__first")).alias("__first"))  # nulls come first, as in an order
    return facts.join(first, "fact_fingerprint").where("source_id = __first").select(*facts.columns)


def facts(docs: DataFrame) -> DataFrame:
    """The flagship: verified, playable, exactly deduplicated facts of the fast lane with their provenance."""
    staged = classify(verify(claims(chunks(docs))))
    return exact_first(checkpointed(compose(staged.where("escalation IS NULL"))))
