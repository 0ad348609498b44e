from pyspark.sql import functions as F

from factloom.plans import facts as P

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, f"s{k}", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")


def test_funnel_of_the_small_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = P.chunks(d)
    staged = P.classify(P.verify(P.claims(chunks))).cache()
    assert (chunks.count(), staged.count()) == (522, 457)
    assert {r[0]: r[1] for r in staged.groupBy("reason").count().collect()} == {"direct_textual_support": 442, "deterministic_support_ambiguous": 14, "unsupported_numeric_anchor": 1}
    kinds = {(r[0], r[1]): r[2] for r in staged.groupBy("escalation", "required").count().collect()}
    assert kinds == {("non_english", True): 162, ("multi_claim", True): 9, ("fidelity_rewrite", True): 39, ("fidelity_rewrite", False): 59, (None, False): 188}
    composed = P.compose(staged.where("escalation IS NULL"))
    assert (composed.count(), composed.select("fact_fingerprint").distinct().count()) == (188, 149)


def test_chunks_pack_sentences(spark):
    text = "A b c. " * 300 + "x" * 1500 + ". End!"
    rows = P.chunks(docs(spark, text, None, " ")).orderBy("ordinal").collect()
    assert " ".join(r.text for r in rows) == " ".join(text.split())
    assert all(r.char_end - r.char_start == len(r.text) for r in rows) and [r.char_start for r in rows[1:]] == [r.char_end + 1 for r in rows[:-1]]
    assert max(len(r.text) for r in rows) == 1501 and all(len(r.text) <= 1200 for r in rows[:-2])


def status(spark, statement, evidence, judged=None):
    c = spark.createDataFrame([("a", "c", evidence, statement)], "atom_id string, chunk_id string, text string, statement string")
    return P.verify(c, judged).first()


def test_verification(spark):
    assert status(spark, "Mars has 3 small moons.", "Mars has two small moons. They orbit.").reason == "unsupported_numeric_anchor"
    assert status(spark, "Anything.", None).status == "rejected"
    r = status(spark, "Medical treatment always works.", "Medical treatment always works.")
    assert r.status == "verified" and not r.playable and "high_risk_actionable_domain" in r.risk_flags
    judged = lambda v, c: spark.createDataFrame([("a", v, c, "why")], "atom_id string, verdict string, confidence double, reason string")
    assert status(spark, "Water is wet.", "Rain.", judged("supported", 0.9)).status == "verified"
    assert status(spark, "Water is wet.", "Rain.", judged("supported", 0.7)).status == "uncertain"
    assert status(spark, "Water is wet.", "Rain.", judged("contradicted", 0.9)).status == "rejected"


def test_policy_and_extraction(spark):
    d = docs(spark, "Medical treatment always cures patients quickly.", "Subscribe now for exclusive offers and buy now.", "Ocean currents transport heat around the planet. This affects climate.")
    staged = P.classify(P.verify(P.claims(P.chunks(d)))).collect()
    assert {r.doc_id: r.escalation for r in staged} == {0: "policy_ambiguity", 2: None}


def test_first_source_wins_and_rebuild_is_stable(spark):
    same = "Ocean currents transport heat around the planet."
    d = docs(spark, same, same, "Rivers carry sediment to the sea over time.")
    first, again = P.facts(d), P.facts(d)
    assert sorted(r.doc_id for r in first.collect()) == [0, 2]
    assert first.select("pulse_id").exceptAll(again.select("pulse_id")).count() == 0


def test_sequences(spark):
    rows = [("a", "contrast", 2, "y"), ("a", "contrast", 1, "x"), ("b", "other", 1, "x"), ("b", "other", 2, "y"), ("c", "contrast", 1, "x")]
    got = P.compose_sequences(spark.createDataFrame(rows, "sequence_id string, relationship string, position int, card_id string")).orderBy("sequence_id").collect()
    assert [(r.card_ids, r.valid) for r in got] == [(["x", "y"], True), (["x", "y"], False), (["x"], False)]


def test_first_source_of_a_fact_keeps_all_of_its_own(spark):
    rows = [("f", "b", 1, 0), ("f", "a", 9, 1), ("f", "a", 2, 0), ("g", "c", 1, 0), ("h", None, 1, 0), ("h", "a", 1, 0)]
    got = P.exact_first(spark.createDataFrame(rows, "fact_fingerprint string, source_id string, doc_id long, ordinal int")).collect()
    assert sorted((r.fact_fingerprint, r.source_id, r.doc_id) for r in got) == [("f", "a", 2), ("f", "a", 9), ("g", "c", 1)]


def test_no_python_in_the_plan(spark):
    composed = P.compose(P.classify(P.verify(P.claims(P.chunks(docs(spark, "A b."))))))
    for df in (composed, P.exact_first(composed)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert F is not None
