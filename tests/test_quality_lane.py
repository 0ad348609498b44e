import json
import re
import zlib

import pytest

from factloom.plans import quality_lane as L


def make():
    def endpoint(task, tier, prompts):
        out = []
        for p in prompts:
            text = p.split("\n\n", 1)[1]
            if task == "translate":
                out.append(("Mars has 2 small moons.", 5, 5))
            elif task == "rewrite":
                out.append((text.replace("very ", "") if tier == "strong" else text + " Because.", 5, 5))
            elif task == "verify":
                out.append((json.dumps({"verdict": "supported", "confidence": 0.9, "reason": "r"}), 1, 1))
            elif task == "fidelity":
                out.append((json.dumps({"faithful": True, "reason": "r"}), 1, 1))
            else:
                out.append((None, 0, 0))
        return out

    return endpoint


endpoint = make()


ROWS = [
    ("a", 1, "火星有2顆小衛星。", "火星有2顆小衛星。", "non_english", True), ("b", 2, "A very old river flows.", "A very old river flows.", "fidelity_rewrite", True),
    ("c", 3, "Medical treatment always works.", "x", "policy_ambiguity", True), ("d", 4, "One: two.", "One: two.", "multi_claim", True),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, pos int, statement string, evidence string, escalation string, required boolean")


def test_lane_and_cache(spark):
    empty = spark.createDataFrame([], "cache_key string, result string")
    got = L.run_lane(frame(spark, ROWS), empty, endpoint, 50)
    assert {r.key: (r.outcome, r.fact) for r in got["outcomes"].collect()} == {
        "a": ("verified", "Mars has 2 small moons."), "b": ("verified", "A old river flows."), "c": ("rejected_policy", None), "d": ("rejected", None),
    }
    assert {(r.task, r.tier): r["count"] for r in got["usage"].groupBy("task", "tier").count().collect()} == {
        ("translate", "cheap"): 1, ("rewrite", "cheap"): 1, ("rewrite", "strong"): 1, ("extract", "cheap"): 1, ("fidelity", "cheap"): 1, ("verify", "cheap"): 2,
    }
    again = L.run_lane(frame(spark, ROWS[:2]), got["cache"], endpoint, 0)
    assert {r.key: r.outcome for r in again["outcomes"].collect()} == {"a": "verified", "b": "verified"}
    assert again["usage"].where("NOT cache_hit").count() == 0 and again["usage"].count() == 6


def test_budget(spark):
    empty = spark.createDataFrame([], "cache_key string, result string")
    got = L.run_lane(frame(spark, ROWS[:1]), empty, endpoint, 1)
    assert got["outcomes"].first().outcome == "rejected" and got["cache"].count() == 1


def test_an_uncertain_judgement_is_asked_again_in_the_strong_tier(spark):
    def judge(task, tier, prompts):
        return [(json.dumps({"verdict": "supported" if tier == "strong" and "first" in p else "uncertain", "confidence": 0.9, "reason": "r"}), 1, 1) for p in prompts]

    rows = [("a", 1, "The first holds.", "x", "weak_direct_support", True), ("b", 2, "The other holds.", "y", "weak_direct_support", True)]
    empty = spark.createDataFrame([], "cache_key string, result string")
    got = L.run_lane(frame(spark, rows), empty, judge, 50)
    assert {r.key: r.outcome for r in got["outcomes"].collect()} == {"a": "verified", "b": "rejected"}
    assert {r.tier: r["count"] for r in got["usage"].groupBy("tier").count().collect()} == {"cheap": 2, "strong": 2}
    spent = L.run_lane(frame(spark, rows[:1]), empty, judge, 2)  # the call that exhausts the budget is not used
    assert spent["outcomes"].first().outcome == "rejected"


# One candidate after the other -------------------------------------------------------------------------


def rules():
    """Functions that workers get by value."""

    def chance(*parts):
        return zlib.crc32("|".join(parts).encode()) % 100

    def answer(task, tier, text):
        """By hash: some calls fail, some answers break an anchor, some verdicts are uncertain, malformed or against."""
        c = chance(task, tier, text)
        if c < 12:
            return None, 0, 0
        if task == "fidelity":
            return ("no json" if c > 95 else json.dumps({"faithful": c < 85})), len(text), 7
        if task == "verify":
            verdict = "supported" if c < 45 else "uncertain" if c < 80 else "contradicted"
            return ("{" if c > 95 else json.dumps({"verdict": verdict, "confidence": 0.5 if c < 20 else 0.9})), len(text), 9
        return (text.split(" ")[0] + " holds 999 stones." if c < 45 else "The " + text if c < 75 else text), len(text), 11

    return chance, answer


chance, answer = rules()


def by_rule():
    answer = rules()[1]

    def endpoint(task, tier, prompts):
        return [answer(task, tier, p.split("\n\n", 1)[1]) for p in prompts]

    return endpoint


def candidates(n=14):
    rows = []
    for k in range(n):
        kind = ("non_english", "multi_claim", "fidelity_rewrite", "weak_direct_support", "policy_ambiguity", "fidelity_rewrite")[chance("kind", str(k)) % 6]
        same = k % 5 if k % 3 else k
        statement = f"River{same} holds {same + 2} grey stones."
        evidence = statement if chance("e", str(same)) < 40 else f"There are {same + 2} grey stones that River{same} holds."
        rows.append((f"k{k:02d}", k, statement, evidence, kind, not (kind == "fidelity_rewrite" and k % 2)))
    return rows


def sequential(rows, cache, calls, money=None, prices=None):
    """The same rules for one candidate at a time."""
    spent, used, paid, ledger, out, known = False, 0, 0.0, [], {}, dict(cache)

    def call(key, task, tier, evidence, text):
        nonlocal used, paid
        at = (task, tier, evidence)
        if at in known:
            ledger.append((key, task, tier, 0, 0, True, False))
            return known[at]
        if used >= calls or money is not None and paid >= money:
            return None
        used += 1
        result, i, o = answer(task, tier, text)
        ledger.append((key, task, tier, i, o, False, result is None))
        if result is None:
            return None
        paid += (i * prices.input + o * prices.output) / 1e6 if prices else 0.0
        known[at] = result
        return None if used >= calls or money is not None and paid >= money else result

    numbers = lambda s: set(re.findall(r"\d+", s))

    def holds(key, text, evidence, ask=True):
        if not numbers(text) <= numbers(evidence):
            return False
        if text.lower().rstrip(".") in evidence.lower():
            return True
        for tier in ("cheap", "strong") if ask else ():
            told = call(key, "verify", tier, evidence, f"{text}\n{evidence}")
            try:
                j = json.loads(told or "")
            except ValueError:
                j = {"verdict": "uncertain", "confidence": 0}
            if j["verdict"] != "uncertain":
                return j["verdict"] == "supported" and j["confidence"] >= 0.8
        return False

    for key, _, statement, evidence, kind, required in rows:
        task = L.TASK_OF.get(kind)
        origin = evidence if task == "translate" else statement
        text = statement if task == "verify" else None
        if task not in (None, "verify"):
            text = call(key, task, "cheap", origin, origin)
            if text is not None and not numbers(text) <= numbers(origin):
                text = call(key, task, "strong", origin, origin)
                text = None if text is not None and not numbers(text) <= numbers(origin) else text
            if text is not None and task == "translate":
                told = call(key, "fidelity", "cheap", origin, f"{origin}\n{text}")
                try:
                    text = text if json.loads(told or "")["faithful"] else None
                except ValueError:
                    text = None
        if text is not None and holds(key, text, evidence):
            out[key] = ("verified", text)
        elif task is None:
            out[key] = ("rejected_policy", None)
        elif not required and holds(key, statement, evidence, False):
            out[key] = ("verified_original", statement)
        else:
            out[key] = ("rejected", None)
    return out, ledger, {k: v for k, v in known.items() if k not in cache}


def compare(spark, rows, cache, calls, money=None, prices=None):
    want, ledger, learned = sequential(rows, cache, calls, money, prices)
    from factloom.plans import facts as P

    keys = {}
    if cache or learned:
        each = spark.createDataFrame([(*k, v) for k, v in {**cache, **learned}.items()], "task string, tier string, evidence string, result string")
        keyed = each.select("task", "tier", "evidence", "result", P.model_cache_key(L.F.col("task"), L.F.col("evidence"), "c", "x").alias("_"), *(P.model_cache_key(L.F.col("task"), L.F.col("evidence"), "c", f"m:{t}").alias(t) for t in ("cheap", "strong"))).collect()
        keys = {(r.task, r.tier, r.evidence): r[r.tier] for r in keyed}
    held = spark.createDataFrame([(keys[k], v) for k, v in cache.items()], "cache_key string, result string")
    got = L.run_lane(frame(spark, rows), held, by_rule(), calls, money, prices)
    assert {r.key: (r.outcome, r.fact) for r in got["outcomes"].collect()} == want, calls
    usage = got["usage"].orderBy("pos", "stage").select("key", "task", "tier", "input_tokens", "output_tokens", "cache_hit", "failed").collect()
    assert [tuple(r) for r in usage] == ledger, calls
    assert sorted(map(tuple, got["cache"].collect())) == sorted((keys[k], v) for k, v in learned.items()), calls
    return learned


@pytest.mark.parametrize("calls", [0, 2, 7, 40])
def test_equals_one_after_the_other(spark, calls):
    compare(spark, candidates(9), {}, calls)


def test_half_a_cache_and_a_cost_budget(spark):
    rows, prices = candidates(9), L.Prices(1000.0, 2000.0, 10)
    cache = sequential(rows[::2], {}, 100)[2]
    compare(spark, rows, cache, 30, 0.25, prices)
    with pytest.raises(ValueError, match="prices"):
        L.run_lane(frame(spark, rows), spark.createDataFrame([], "cache_key string, result string"), by_rule(), 3, 1.0)


def test_edges(spark):
    none = spark.createDataFrame([], "cache_key string, result string")
    got = L.run_lane(frame(spark, []), none, by_rule(), 5)
    assert got["outcomes"].count() == got["usage"].count() == got["cache"].count() == 0
    alone = L.run_lane(frame(spark, candidates(5)), none, by_rule(), 40, strong=False)
    assert alone["usage"].where("tier = 'strong'").count() == 0 and alone["outcomes"].count() == 5


def test_later_rounds_walk_only_what_new_answers_change(spark, monkeypatch):
    """All rows walk once on the cache; a row that asks what another one was told walks again, the others do not."""
    names = "abcdefghijkl"
    rows = [(f"k{n}", n, f"A very old river flows to {c}.", f"A very old river flows to {c}.", "fidelity_rewrite", True) for n, c in enumerate(names)]
    rows.append(("same", 99, rows[0][2], rows[0][3], "fidelity_rewrite", True))
    probed, walk = [], L.walk
    monkeypatch.setattr(L, "walk", lambda work, cache, lane, budget: (budget is None and probed.append(sorted(r.key for r in work.select("key").collect())), walk(work, cache, lane, budget))[1])
    compared = L.run_lane(frame(spark, rows), spark.createDataFrame([], "cache_key string, result string"), endpoint, 7)
    assert len(probed[0]) == 13 and all(p == ["same"] for p in probed[1:]) and len(probed) > 1
    assert {r.key for r in compared["outcomes"].collect()} == {r[0] for r in rows} and compared["outcomes"].count() == 13
