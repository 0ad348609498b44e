import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import commits, firewall, search
from factloom.operators.text_index import StoredIndex


def rows(n, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Straße", "été", "the"]
    return [(f"k{seed}-{i:03d}", " ".join(r.choice(words[: r.choice([4, 43])]) for _ in range(r.randint(0, 12)))) for i in range(n)]


def same(spark, index, texts):
    """Search, top lists and statistics equal those of a fresh index over all texts."""
    table = spark.createDataFrame(texts, "id string, text string")
    queries = spark.createDataFrame([(1, "w1"), (2, "w2 w3"), (3, "strasse w1"), (4, "nowhere"), (5, "")], "query_id int, query string")
    told = lambda df: sorted((r.query_id, r[1], round(r.score, 9), r["rank"]) for r in df.collect())
    assert told(index.search(queries, 7)) == told(search.search(table, queries, 7))
    assert sorted(map(tuple, index.postings().select("key", "token", "tf", "dl").collect())) == sorted(map(tuple, firewall.postings(table, "id", "text").select("id", "token", "tf", "dl").collect()))
    kept = [t for t in texts if t[1] and any(c.isalnum() for c in t[1])]
    assert index.size()[0] == len(kept)


def test_segments_tombstones_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("factloom.operators.text_index.FANOUT", 3)
    stored, texts = StoredIndex(spark, str(tmp_path)), {}
    frame = lambda x: spark.createDataFrame(x, "id string, text string")
    for step in range(5):
        new = rows(25, step + 1)
        texts |= dict(new)
        stored.add(frame([*new, new[0], (None, "w1"), ("n", None)]))
        if step in (1, 3):
            gone = list(texts)[step :: 5]
            stored.remove(frame([(k, "") for k in gone] + [("unknown", "")]))
            texts = {k: t for k, t in texts.items() if k not in gone}
    index = stored.now()
    assert len(index.state["segments"]) <= 3
    same(spark, index, list(texts.items()))
    back = gone[0]
    stored.add(frame([(back, "w1 w1 again")]))  # a removed key may come back, a living one stays as it is
    stored.add(frame([(next(iter(texts)), "other words")]))
    same(spark, stored.now(), [*texts.items(), (back, "w1 w1 again")])
    whole = stored.change(lambda i: i.merged(1))
    assert len(whole.state["segments"]) == 1 and not whole.state["gone"]
    same(spark, whole, [*texts.items(), (back, "w1 w1 again")])


def test_an_append_reads_no_older_text(spark, tmp_path):
    stored = StoredIndex(spark, str(tmp_path))
    first = stored.add(spark.createDataFrame(rows(20), "id string, text string"))
    before = first.state["segments"][0]
    second = stored.add(spark.createDataFrame(rows(5, 2), "id string, text string"))
    assert second.state["segments"][0] == before and second.state["segments"][1]["n"] <= 5
    plan = second.postings(spark.createDataFrame([("w1",)], "token string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,w1)]" in plan or "In(token" in plan


def test_empty_index(spark, tmp_path):
    stored = StoredIndex(spark, str(tmp_path))
    none = spark.createDataFrame([], "id string, text string")
    assert stored.add(none).state == stored.remove(none).state == {"segments": [], "gone": []}
    assert stored.now().search(spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0


def test_firewall_with_stored_facts_decides_alike(spark, tmp_path):
    r = random.Random(4)
    words = [f"word{chr(97 + k)}" for k in range(26)]
    texts = [" ".join(r.sample(words, 7)) for _ in range(30)]
    facts = []
    for k in range(90):
        t = texts[r.randrange(30)].split()
        t[r.randrange(7)] = r.choice(words)
        facts.append((f"p{k:02d}", f"s{r.randrange(6)}", " ".join(t), " ".join(sorted(t)), f"{k:03d}", k < 50))
    table = firewall._checkpoint(spark.createDataFrame(facts, "pulse_id string, source_id string, fact_text string, fingerprint string, pos string, settled boolean"))
    stored = StoredIndex(spark, str(tmp_path)).add(table.where("settled"), "pulse_id", "fact_text")
    told = lambda df: sorted((x.pulse_id, x.outcome) for x in df.collect())
    assert told(firewall.first_wins(table, 5, stored=stored)) == told(firewall.first_wins(table, 5))


def test_log_gives_a_number_once(spark, tmp_path):
    log, other = commits.Log(spark, str(tmp_path / "log")), commits.Log(spark, str(tmp_path / "log"))
    assert log.latest() == (-1, {}) and log.put(0, {"a": 1}) and not other.put(0, {"a": 2}) and other.latest() == (0, {"a": 1})
    for n in range(1, 60):
        assert other.put(n, {"a": n})
    assert log.latest() == (59, {"a": 59}) and len(log.numbers()) == commits.KEPT + 1


def test_index_changes_of_two_writers_are_both_kept(spark, tmp_path):
    a, b = StoredIndex(spark, str(tmp_path)), StoredIndex(spark, str(tmp_path))
    frame = lambda x: spark.createDataFrame(x, "id string, text string")
    tries = []

    def slow(index):
        tries.append(1)
        new = index.add(frame([("x", "alpha")]))
        if len(tries) == 1:
            b.add(frame([("y", "beta")]))  # another writer comes first
        return new

    assert sorted(r.key for r in a.change(slow).docs().collect()) == ["x", "y"] and len(tries) == 2
    with pytest.raises(commits.Conflict):
        a.change(lambda i: (b.add(frame([(f"z{len(b.now().state['segments'])}", "t")])), i.add(frame([("q", "q")])))[1], tries=2)


def test_search_groups_postings_of_asked_terms_alone(spark):
    """What nobody asked for is left out before anything is shuffled by token; statistics stay those of all texts."""
    texts = spark.createDataFrame([(k, f"w{k % 3} common t{k}" + " other" * (k % 4)) for k in range(40)] + [(98, "!"), (99, None)], "id long, text string")
    queries = spark.createDataFrame([("q", "common W1"), ("none", "absent common"), ("empty", "?")], "query_id string, query string")
    got = search.search(texts, queries, 5)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    want = firewall.bm25_weights(firewall.postings(texts, "id", "text"), "id").where("token IN ('common', 'w1')").groupBy("id").agg((-F.sum("w")).alias("s"), F.count("*").alias("n")).where("n = 2")
    want = sorted((round(r.s, 9), r.id) for r in want.collect())[:5]
    assert sorted((round(r.score, 9), r.id) for r in got.collect()) == want and len(want) == 5


def test_postings_of_unique_keys_are_not_shuffled(spark):
    """Tokens are counted within their row; sorted runs, single tokens and all-equal tokens come out as in a grouping."""
    texts = spark.createDataFrame([*rows(40), ("one", "x"), ("same", "b b b"), ("mixed", "b a B c a")], "id string, text string")
    made = firewall.own_postings(texts.select(F.col("id").alias("key"), firewall.tokens("text").alias("ts")).where("size(ts) > 0"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = firewall.postings(texts.withColumnRenamed("id", "key"), "key", "text")
    assert sorted(map(tuple, made.select("key", "token", "tf", "dl").collect())) == sorted(map(tuple, want.select("key", "token", "tf", "dl").collect()))
