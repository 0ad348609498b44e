from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom import settings
from factloom.engine import Engine, transaction

NOW = datetime(2024, 1, 1)


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path), NOW)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_sources_and_inspection(spark, engine):
    seeds = spark.createDataFrame([("https://a.test/x", "A"), ("https://a.test/x?utm_source=q", "B"), ("nope", "C")], "url string, title string")
    assert engine.add_sources(seeds).count() == 1 and engine.add_sources(seeds).count() == 0
    assert engine.refresh(docs(spark, [(1, "Ocean currents transport heat around the planet.", "s", "en"), (2, "Rivers carry sediment to the sea over time.", "t", "en")])).count() == 2
    pulse = engine.table("pulses").where("source_id = 's'").first()
    told = engine.inspect(pulse.id).first()
    assert told.statement + told.prompt == pulse.display_fact * 2 and told.evidence[0].quote == pulse.display_fact and engine.stats().first().shown == 0
    engine.remove_sources(spark.createDataFrame([("s",)], "id string"))
    assert engine.table("pulses").count() == 1 and engine.table("atoms").count() == 1 and engine.table("fact_index").count() == 2


def test_a_build_keeps_what_it_made_and_compares_with_the_stored_index(spark, engine):
    first = [(1, "Ocean currents transport heat around the planet.", "s", "en"), (2, "Invest now: this will certainly double your money within days.", "s", "en")]
    assert engine.refresh(docs(spark, first)).count() == 1
    assert engine.table("atoms").count() == engine.table("evidence").count() == 2  # playable or not
    again = [*first, (3, "Ocean currents transport heat around the planet.", "t", "en"), (4, "Ocean currents transport heat around the whole planet.", "u", "en"), (5, "Glaciers carve deep valleys as they move downhill.", "u", "en")]
    assert {r.action: r.n for r in engine.dry_run(docs(spark, again)).collect()} == {"skip": 2, "build": 3}
    new = engine.refresh(docs(spark, again))
    assert [r.display_fact for r in new.collect()] == ["Glaciers carve deep valleys as they move downhill."]
    run = engine.last_run().first()
    assert run.status == "succeeded" and engine.runs().count() == 2
    assert {k: run.counters[k] for k in ("documents", "documents_built", "documents_skipped", "candidates", "composed", "kept", "suppressed")} == {"documents": 5, "documents_built": 3, "documents_skipped": 2, "candidates": 3, "composed": 3, "kept": 1, "suppressed": 2}
    assert engine.refresh(docs(spark, again)).count() == 0
    assert [r.rank for r in engine.search("ocean heat").collect()] == [1, 2, 3] and engine.search("glaciers ocean").count() == 0
    assert engine.search("valleys", "chunks").count() == engine.search("valleys", "fact_index").count() == 1
    checks = {r.check: r.value for r in engine.doctor().collect()}
    assert checks["last run succeeded"] == 1 and not any(v for k, v in checks.items() if k.startswith(("orphans", "invalid", "jobs", "queue")))


SUBJECTS = ["Copper", "Granite", "Basalt", "Willow", "Heron", "Lichen", "Comet", "Harbor", "Lantern", "Violin"]
ENDS = ["conducts warmth along thin wires", "resists weather for many ages", "cools from lava near ridges", "bends in strong autumn gales", "hunts small fish at dawn", "grows upon bare northern rocks", "returns after many quiet decades", "shelters boats from winter storms", "guides sailors past hidden reefs", "sings through carved maple wood"]


def test_queues_are_prepared_shown_and_refilled(spark, engine):
    engine.refresh(docs(spark, [(k, f"{a} {b}.", f"s{k}", ("en", "de")[k % 2]) for k, (a, b) in enumerate(zip(SUBJECTS, ENDS))]))
    engine.set_profile("p", "en=3, de", excluded="fr")
    assert engine.profile("p").first().topic_weights == {"en": 3.0, "de": 1.0}
    queue = [r.card_id for r in engine.prepare("p").collect()]
    assert len(queue) == 6 == len(set(queue)) and [r.card_id for r in engine.prepare("p").collect()] == queue
    assert engine.refill("p") == 0
    for _ in range(3):
        card = engine.current_cards().first().card_id
        engine.acknowledge("p", card)
        engine.acknowledge("p", card)  # a repeat adds nothing
    assert engine.table("exposures").count() == 3 and engine.stats().first().shown == 3
    assert engine.refill("p") == 4  # all that is left: three were shown lately, three are queued
    pending = [r.card_id for r in engine.pending_cards("p").collect()]
    assert pending[:3] == queue[3:] and len(set(pending)) == 7
    engine.reset_profile("p")
    assert engine.profile("p").isEmpty()


def test_discovery_registers_candidates_once(spark, engine):
    answer = spark.createDataFrame([("<rss><channel><item><title>A</title><link>https://a.test/1</link></item><item><title>B</title><link>https://a.test/2</link></item></channel></rss>", "f")], "xml string, feed_url string")
    assert engine.discover("feed", answer, 5) == {"rate_limited": 0, "results": 2, "deduplicated": 0, "candidates": 2}
    assert engine.discover("feed", answer, 5)["candidates"] == 0
    ids = engine.candidates().select("id").limit(1)
    assert engine.register(ids).count() == 1 and engine.candidates().count() == 1 and engine.list_sources().count() == 1
    engine.drop_candidates(engine.candidates().select("id"))
    assert engine.candidates().isEmpty() and engine.discover("feed", answer, 5)["candidates"] == 1
    engine.wait_for("feed", NOW + timedelta(minutes=5), "429")
    assert engine.discover("feed", answer, 5)["rate_limited"] == 1
    engine.now = NOW + timedelta(minutes=6)
    assert engine.discover("feed", answer, 5)["rate_limited"] == 0


def test_harness_events(spark, engine):
    assert engine.emit("opencode", "working") and not engine.emit("manual", "working")
    assert [r.state for r in engine.ambient_state().collect()] == ["active_work"]


def test_settings_layers(tmp_path):
    (tmp_path / "s.toml").write_text('queue_size = 9\nnear = 0.7\nquality_lane = "yes"\n')
    s = settings.load(str(tmp_path / "s.toml"), {"FACTLOOM_QUEUE_SIZE": "4", "FACTLOOM_API_KEY": "k", "OTHER": "x"}, near=0.6)
    assert (s.queue_size, s.near, s.quality_lane, s.watermark) == (4, 0.6, True, 3)
    assert settings.shown(s)["api_key"] == "***" and not settings.capabilities(s)["model"]
    with pytest.raises(ValueError, match="neither true nor false"):
        settings.load(env={"FACTLOOM_QUALITY_LANE": "maybe"})
    with pytest.raises(ValueError, match="unknown"):
        settings.load(env={}, colour="red")


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path), NOW), Engine(spark, str(tmp_path), NOW)
    seeds = lambda n: spark.createDataFrame([(f"https://a.test/{n}", n)], "url string, title string")
    tried = []

    @transaction
    def both(engine):
        tried.append(1)
        engine.add_sources(seeds("one"))
        if len(tried) == 1:
            b.add_sources(seeds("two"))
            b.emit("opencode", "working")

    both(a)
    assert len(tried) == 2 and [r.title for r in a.list_sources().collect()] == ["one", "two"]

    @transaction
    def apart(engine):
        tried.append(1)
        engine.set_profile("p", "en")
        b.emit("opencode", "idle")  # touches no table of this one: no second try

    apart(a)
    assert len(tried) == 3 and a.profile("p").count() == 1 and a.table("harness_events").select("id").distinct().count() == 2


def test_a_build_that_dies_shows_nothing(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path), NOW)
    rows = docs(spark, [(1, "Ocean currents transport heat around the planet.", "s", "en")])
    whole = Engine._finished

    def dies(self, *told):
        raise KeyboardInterrupt

    monkeypatch.setattr(Engine, "_finished", dies)
    with pytest.raises(KeyboardInterrupt):
        engine.refresh(rows)
    monkeypatch.setattr(Engine, "_finished", whole)
    other = Engine(spark, str(tmp_path), NOW)
    assert all(other.table(name).isEmpty() for name in ("documents", "chunks", "pulses", "cards", "fact_index", "stage_keys", "runs")) and other.search("ocean").count() == 0
    assert other.refresh(rows).count() == 1 and other.search("ocean").count() == 1 and engine.runs().count() == 1


def test_appends_are_written_as_one_folder_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("factloom.engine.FOLDERS", 3)
    engine = Engine(spark, str(tmp_path), NOW)
    for n in range(5):
        engine.add_sources(spark.createDataFrame([(f"https://a.test/{n}", str(n))], "url string, title string"))
    assert engine.table("sources").count() == 5 and len(engine.log.latest()[1]["sources"]) <= 3


def lane_endpoint(calls):
    def endpoint(task, tier, prompts):
        with open(calls, "a") as f:
            f.write(f"{task}\n" * len(prompts))
        told = {"translate": "Mars has 2 small moons.", "fidelity": '{"faithful": true}', "verify": '{"verdict": "supported", "confidence": 0.95, "reason": "r"}'}
        return [(told.get(task), 7, 3) for _ in prompts]

    return endpoint


def test_the_model_lane_in_a_build(spark, tmp_path):
    calls = tmp_path / "calls"
    options = settings.load(env={}, quality_lane=True, model_id="m")
    rows = docs(spark, [(1, "火星には2個の小さな衛星があり、地球の月よりもずっと小さい。", "s", "ja"), (2, "Ocean currents transport heat around the planet.", "t", "en")])
    engine = Engine(spark, str(tmp_path / "e"), NOW, options, lane_endpoint(str(calls)))
    assert sorted(r.display_fact for r in engine.refresh(rows).collect()) == ["Mars has 2 small moons.", "Ocean currents transport heat around the planet."]
    assert sorted(calls.read_text().split()) == ["fidelity", "translate", "verify"]
    pulse = engine.table("pulses").where("source_id = 's'").first()
    assert pulse.verification.provider_used and engine.inspect(pulse.id).first().statement == "Mars has 2 small moons."
    assert engine.table("model_usage").where("NOT cache_hit").count() == 3 and engine.table("model_cache").count() == 3
    assert engine.refresh(rows).count() == 0  # unchanged branches are skipped
    # Another contract builds anew, from the cache.
    engine.write("stage_keys", engine.table("stage_keys").withColumn("stage_key", F.lit("old")))
    engine.refresh(rows)
    assert len(calls.read_text().split()) == 3 and engine.table("model_usage").where("cache_hit").count() == 3
    assert Engine(spark, str(tmp_path / "f"), NOW, None, lane_endpoint(str(calls))).refresh(rows).count() == 1  # not turned on


PAGE = "<html><body><p>{}</p></body></html>"


def serve(folder):
    """An opener that answers from files by address and knows their tags; it notes every request."""

    def opener(request, timeout):
        import io
        import urllib.error
        from email.message import Message
        from pathlib import Path

        name = request.full_url.rsplit("/", 1)[1]
        tag = request.headers.get("If-none-match")
        body = (Path(folder) / name).read_bytes() if (Path(folder) / name).exists() else None
        with open(f"{folder}/asked", "a") as f:
            f.write(f"{name} {tag}\n")
        if body is None or tag == f'"{len(body)}"':
            raise urllib.error.HTTPError(request.full_url, 404 if body is None else 304, "", Message(), None)
        answer = io.BytesIO(body)
        answer.status, answer.headers = 200, {"Content-Type": "text/html; charset=utf-8" if name.startswith("page") else "text/plain", "ETag": f'"{len(body)}"'}
        return answer

    return opener


def test_refresh_from_addresses(spark, tmp_path):
    long = "The Nile is the longest river of Africa and flows north into the sea. " * 8
    (tmp_path / "page1").write_text(PAGE.format(long))
    (tmp_path / "note").write_text("Ocean currents transport heat around the planet.")
    engine, opener = Engine(spark, str(tmp_path / "e"), NOW), serve(str(tmp_path))
    engine.add_sources(spark.createDataFrame([(f"https://a.test/{n}", n) for n in ("page1", "note", "gone")], "url string, title string"))
    assert engine.refresh_sources(opener).count() == 2
    told = lambda: {k: engine.last_run().first().counters[k] for k in ("fetched", "reused", "reparsed", "fetch_errors", "documents_built", "candidates")}
    assert told() == {"fetched": 2, "reused": 0, "reparsed": 0, "fetch_errors": 1, "documents_built": 2, "candidates": 2}
    assert engine.refresh_sources(opener).count() == 0  # nothing parsed, nothing built
    assert told() == {"fetched": 0, "reused": 2, "reparsed": 0, "fetch_errors": 1, "documents_built": 0, "candidates": 0}
    assert (tmp_path / "asked").read_text().count("None") == 4
    engine.write("caches", engine.table("caches").withColumn("parser_version", F.when(F.col("parser_version") == "plain-1", "plain-0").otherwise(F.col("parser_version"))))
    (tmp_path / "page1").write_text(PAGE.format("Glaciers carve deep valleys as they move downhill. " * 9))
    assert [r.display_fact for r in engine.refresh_sources(opener).collect()] == ["Glaciers carve deep valleys as they move downhill."]
    assert told() == {"fetched": 1, "reused": 0, "reparsed": 1, "fetch_errors": 1, "documents_built": 1, "candidates": 1}
    assert {r.parser_version for r in engine.table("caches").collect()} == {"plain-1", "html-fallback-1"}
