from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import firewall as W
from factloom.operators import ledger, ranking, store

A = "Mars has 2 small moons that orbit the planet."


@pytest.mark.parametrize(("a", "b", "want"), [
    (A, "Mars possesses two small moons orbiting it.", 63.64), (A, "Ocean currents transport heat around the planet.", 55.91),
    ("Sunlight increases the rate of photosynthesis in plants.", "Sunlight decreases the rate of photosynthesis in plants.", 96.43), ("a b c", "d e f", 40.0),
    ("Observation number 1 confirms a repeatable result.", "Observation number 2 confirms a repeatable result.", 98.0), ("a b", "a b c", 100.0), ("", "a", 0.0),
])
def test_token_set_ratio(a, b, want):
    assert round(W.token_set_ratio(a, b), 2) == want


def fact_rows(spark, texts):
    rows = [(f"p{k:02d}", s, t, f"{k:03d}") for k, (s, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "pulse_id string, source_id string, fact_text string, pos string")
    return df.withColumn("fingerprint", F.sha2("fact_text", 256))


def test_firewall_keeps_contradictions_and_own_source(spark):
    df = fact_rows(spark, [
        ("a", A), ("b", "Mars possesses two small moons orbiting it."), ("c", "Ocean currents transport heat around the planet."), ("d", A), ("a", A),
        ("e", "Sunlight increases the rate of photosynthesis in plants."), ("f", "Sunlight decreases the rate of photosynthesis in plants."),
    ])
    got = {r.pulse_id: r.outcome for r in W.first_wins(df).collect()}
    assert got == {"p00": "kept", "p01": "suppressed", "p02": "kept", "p03": "suppressed", "p04": "kept", "p05": "kept", "p06": "kept"}
    tiers = {r.pulse_id: r.tier for r in W.decisions(df).collect()}
    assert tiers["p00"] == "duplicate" and tiers["p01"] == "same_claim" and tiers["p06"] in ("related_concept", "distinct")


def test_pool_suppression(spark):
    df = fact_rows(spark, [("a", A), ("b", "Rivers carry sediment to the sea."), ("c", "Mars possesses two small moons orbiting it.")])
    recent = spark.createDataFrame([("r", A)], "probe_id string, probe_text string").withColumn("fingerprint", F.sha2("probe_text", 256))
    assert {r.pulse_id for r in W.suppressed_pool(df, recent).collect()} == {"p00", "p02"}


def test_signals(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(ranking.freshness(F.lit(0.0))) == 1.0 and 0 < one(ranking.freshness(F.lit(90 * 86400.0))) < 0.5
    assert [one(ranking.novelty_from_distance(F.lit(x).cast("int"))) for x in (None, 10, 30)] == [1.0, 0.0, 1.0]
    assert one(ranking.normalized_weights(F.create_map(F.lit("a"), F.lit(-1.0)), F.array().cast("array<string>"))) == {"general": 1.0}
    assert one(ranking.normalized_weights(F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(1.0), F.lit("c"), F.lit(9.0)), F.array(F.lit("c")))) == {"a": 0.75, "b": 0.25}


def test_rank_order(spark):
    rows = [("a", "science", "s", True), ("b", "art", "s", True), ("c", "science", "s", False)]
    c = spark.createDataFrame(rows, "id string, topic string, source_id string, verified boolean").withColumns({k: F.lit(1.0) for k in ("quality", "source_quality", "usefulness", "freshness", "novelty", "appeal")})
    out = ranking.rank(c, F.create_map(F.lit("science"), F.lit(3.0), F.lit("art"), F.lit(1.0)), F.array().cast("array<string>"), 0.1, recent_ids=F.array(F.lit("a"))).orderBy(F.desc("score"), "id").collect()
    assert [r.id for r in out] == ["b", "a"] and out[1].reasons["repetition_penalty"] == -1


def queue(spark, rows, size, odd=(), **how):
    """rows: (profile, card, topic, score, text)."""
    ranked = spark.createDataFrame([(*r, r[2] in odd) for r in rows], "profile_id string, card_id string, topic string, score double, text string, unexpected boolean")
    return ranking.plan_queues(ranked, size, **how).orderBy("profile_id", "ordinal").collect()


def test_planner(spark):
    rows = [("p", "a", "t1", 1.0, "x y z w"), ("p", "b", "t2", 0.9, "x y z w"), ("p", "c", "t3", 0.8, "q r s"), ("q", "z", "t", 0.1, None)]
    assert [(r.profile_id, r.card_id) for r in queue(spark, rows, 2)] == [("p", "a"), ("p", "c"), ("q", "z")]
    rows = [("p", "a", "sci", 3.0, "a"), ("p", "b", "sci", 2.0, "b"), ("p", "c", "art", 1.0, "c"), ("p", "d", "art", 0.0, "d")]
    topics = [r.topic for r in queue(spark, rows, 4)]
    assert len(topics) == 4 and all(len(set(topics[k : k + 3])) > 1 for k in range(2))
    rows = [("p", f"p{k}", "poetry", 5.0 - k, f"p{k}") for k in range(3)] + [("p", f"s{k}", ("sci", "art")[k % 2], 1.0 - k / 10, f"s{k}") for k in range(4)]
    got = queue(spark, rows, 4, odd={"poetry"})
    assert sum(r.topic == "poetry" for r in got) <= 1 and len(got) == 4 and got[0].reason == "unexpected_discovery"
    tied = [("p", str(k), str(k % 5), 0.5, "same") for k in range(50)]
    assert queue(spark, tied, 6, generation=3) == queue(spark, tied, 6, generation=3)


NOW = datetime(2024, 1, 1)


def test_leases(spark):
    from factloom.schemas import TABLES

    jobs = spark.createDataFrame([("j", "k", "build", "pending", 0, None, None, None, None, None, NOW)], TABLES["jobs"])
    ids = store.claimable(jobs, NOW).select("id")
    a = store.claim(jobs, ids, "a", NOW)
    assert a.first().lease_owner == "a" and store.claimable(a, NOW).count() == 0
    later = NOW + timedelta(seconds=61)
    b = store.claim(a, ids, "b", later)
    assert store.complete(b, "j", "a", later).first().status == "running" and store.complete(b, "j", "b", later).first().status == "succeeded"
    assert store.recover(a, later).first().status == "pending"
    assert store.fail(a, "j", "a", "x", "y", later).first().next_attempt_at == later


def test_acknowledgement_is_idempotent(spark):
    sessions = spark.createDataFrame([("s", "p", "active", NOW, None, 0, 0)], "id string, profile_id string, status string, started_at timestamp, ended_at timestamp, position int, generation int")
    cards = spark.createDataFrame([("s", "c0", 0), ("s", "c1", 1)], "session_id string, card_id string, ordinal int")
    shown = lambda c: spark.createDataFrame([("p", c)], "profile_id string, card_id string")
    one, e1 = store.acknowledge(sessions, shown("c0"), cards, NOW)
    assert one.first().position == 1 and e1.count() == 1
    again, e2 = store.acknowledge(one, shown("c0"), cards, NOW)
    assert again.first().position == 1 and e2.count() == 0
    two, _ = store.acknowledge(one, shown("c1"), cards, NOW)
    assert two.first().status == "completed"


def test_insert_upsert_and_update(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "id string, v int, t int")
    new = spark.createDataFrame([("b", 3, 2), ("b", 3, 2), ("c", 4, 1)], "id string, v int, t int")
    assert {r.id for r in store.insert_absent(old, new).collect()} == {"c"}
    assert sorted((r.id, r.v) for r in store.upsert(old, new, ["id"], "t").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    patch = spark.createDataFrame([("a", None), ("b", 9)], "id string, v int")
    assert sorted((r.id, r.v) for r in store.coalesce_update(old, patch).collect()) == [("a", 1), ("b", 9)]


def test_budget_discards_the_exhausting_call(spark):
    calls = spark.createDataFrame([(k, k == 1, 0.1) for k in range(5)], "pos int, cache_hit boolean, cost double")
    assert [r.used for r in ledger.within_budget(calls, 2).orderBy("pos").collect()] == [True, True, True, False, False]


def test_validation_and_migration(spark):
    from factloom.schemas import migrate, payload, validate

    chunks = spark.createDataFrame([("c", 5, 3, 0), ("d", 0, 3, 0)], "id string, char_start int, char_end int, ordinal int")
    assert [r.violations for r in validate(chunks, "chunks").orderBy("id").collect()] == [["end_after_start"], []]
    assert migrate(chunks, "chunks", {"text": F.lit("t")}).first().text == "t" and '"id":"c"' in payload(chunks).orderBy("id").first().payload_json
