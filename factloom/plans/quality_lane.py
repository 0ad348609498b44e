"""The model lane for escalated candidates: cached calls within a budget, checked by anchors and judges, charged candidate by candidate.

An endpoint is any picklable callable ``(task, tier, prompts) -> list of (result, input_tokens, output_tokens)`` with results of None for
failures. A candidate passes up to five stages: translate, rewrite or extract in the cheap tier; the same in the strong tier if anchors
broke; a judgement of fidelity for translations; a verdict on what came out against the evidence, unless the text itself decides; a
second verdict in the strong tier where the first is uncertain. Equal requests are answered from the cache.

Outcomes, usage and cache equal those of one candidate after the other in the order of ``pos``, while the stages run for many at a time:

1. All walk through the stages on the cache alone; in later rounds only those again that missed a request which was answered meanwhile. Those
   that miss nothing are final, wherever they stand.
2. Of the others the longest prefix is taken whose worst-case calls, and their worst-case cost, leave something of the budget. These
   walk with calls: in a stage all requests go out together, of equal ones the first in order and another only after a failure.
3. What they did not use is left for the next round. A candidate that does not fit by the worst case walks alone, checked before and after every
   call: the call that exhausts the budget is made, charged and cached, but its result is not used.
4. When the budget is spent, the rest is final by the cache alone.

Each round but the last few shrinks the budget by what its candidates really used, so rounds grow with its logarithm. Only the rows of the next
prefix, no more than calls are left, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import ledger
from factloom.operators.firewall import SENT
from factloom.operators.firewall import _checkpoint as checkpointed
from factloom.plans import facts as P

Endpoint = Callable[[str, str, list[str]], list[tuple[str | None, int, int]]]

#: What a pass asks for.
KEEP = "Numbers, dates, names, negations and the direction of comparisons stay as they are; add nothing that is not there. Answer with the sentence alone."
PROMPTS = {
    "translate": f"Say this in one short English statement. {KEEP}",
    "rewrite": f"Shorten this to one plain English statement of 8 to 24 words. {KEEP}",
    "extract": f"Pick the one claim that this text itself supports best and state it in one short English sentence. {KEEP}",
    "verify": "Judge whether the evidence supports the claim. Answer as JSON with verdict, confidence and reason.",
    "fidelity": "Judge whether the rewrite keeps the meaning of the original. Answer as JSON with faithful and reason.",
}
TASK_OF = {"non_english": "translate", "multi_claim": "extract", "fidelity_rewrite": "rewrite", "weak_direct_support": "verify"}
#: Characters of a request that a prompt holds, and of evidence that a verdict is based on.
ASKED, EXCERPT = 1500, 500
#: Calls that a candidate of a task makes at most, with a strong tier and without.
MOST = {"translate": (5, 3), "extract": (4, 2), "rewrite": (4, 2), "verify": (2, 1)}
VERDICTS = ("supported", "contradicted", "uncertain")

REQUEST = "key string, cache_key string, hit boolean, result string, called boolean, input_tokens long, output_tokens long"


@dataclass
class Prices:
    """Per million tokens; an answer has at most ``most_output`` tokens, a prompt no more tokens than bytes."""

    input: float
    output: float
    most_output: int = 1024

    def worst(self) -> float:
        return ((4 * (2 * ASKED + EXCERPT) + 400) * self.input + self.most_output * self.output) / 1e6


@dataclass
class Budget:
    """What is left: calls, and money if it is bounded."""

    calls: int
    money: float | None = None

    @property
    def spent(self) -> bool:
        return self.calls <= 0 or self.money is not None and self.money <= 0


@dataclass
class Lane:
    """An endpoint with what a walk needs beside it."""

    endpoint: Endpoint
    prices: Prices | None = None
    strong: bool = True
    model_id: str = "m"
    contract: str = "c"

    @cached_property
    def broken(self) -> tuple[Column, Column]:
        """Whether the answers of the first two stages break anchors; long expressions, made once a run."""
        each = lambda r: F.size(T.anchor_violations(F.col("origin"), F.col(r), F.col("task") == "translate")) > 0
        return each("s1.used"), each("s2.used")

    def fits(self, wanted: list[tuple], budget: Budget) -> int:
        """How many of the first (pos, task) leave calls and money whatever they need."""
        calls, money = 0, 0.0
        for n, (_, task) in enumerate(wanted):
            calls += MOST[task][not self.strong]
            money += MOST[task][not self.strong] * (self.prices.worst() if self.prices else 0.0)
            if calls >= budget.calls or budget.money is not None and money >= budget.money:
                return n
        return len(wanted)


def _answers(lane: Lane, tier: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Calls for groups of equal requests (cache_key, task, rows in order): the first asks, the next ones only after failures."""
    endpoint = lane.endpoint

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for task, groups in frame.groupby("task"):
                waiting = [(k, list(rows)) for k, rows in zip(groups.cache_key, groups.rows, strict=True)]
                while waiting:
                    got = endpoint(str(task), tier, [rows[0]["prompt"] for _, rows in waiting])
                    left = []
                    for (k, rows), (result, n_in, n_out) in zip(waiting, got, strict=True):
                        told.append((rows[0]["key"], k, False, result, True, n_in if result is not None else 0, n_out if result is not None else 0))
                        if result is not None:
                            told += [(r["key"], k, True, result, False, 0, 0) for r in rows[1:]]
                        elif rows[1:]:
                            left.append((k, rows[1:]))
                    waiting = left
            yield pd.DataFrame(told, columns=["key", "cache_key", "hit", "result", "called", "input_tokens", "output_tokens"])

    return run


def ask(rows: DataFrame, n: int, wanted: Column, task: Column | str, tier: str, evidence: Column, prompt: Column, cache: DataFrame, lane: Lane, budget: Budget | None) -> DataFrame:
    """``rows`` with the answers of stage ``n`` to those that want one: r (result), hit, called, tokens in and out, cache_key, task and tier.

    What the cache holds is a hit. The rest is asked and charged to ``budget``, unless it is None or spent; then it has no result. Nor has,
    for the lane, a call that spends the budget: ``used`` is the result to go on with.
    """
    named = task if isinstance(task, Column) else F.lit(task)
    wanted, evidence = F.coalesce(wanted, F.lit(False)), F.substring(evidence, 1, ASKED)
    cache_key = F.when(wanted, P.model_cache_key(named, evidence, lane.contract, f"{lane.model_id}:{tier}"))
    known = rows.withColumn("__key", cache_key).join(cache.select(F.col("cache_key").alias("__key"), F.col("result").alias("__cached")), "__key", "left")
    can = budget is not None and not budget.spent
    asked = None
    if can:
        known = checkpointed(known)
        misses = known.where("__key IS NOT NULL AND __cached IS NULL")
        if not misses.isEmpty():
            told = F.concat(*(F.when(named == t, F.lit(p)).otherwise(F.lit("")) for t, p in PROMPTS.items()), F.lit("\n\n"), prompt)
            # No more rows than calls are left ask in a round, so a group of equal requests is as bounded as the budget.
            groups = misses.select(F.col("__key").alias("cache_key"), named.alias("task"), F.struct("pos", "key", told.alias("prompt")).alias("row")).groupBy("cache_key", "task").agg(F.array_sort(F.collect_list("row")).alias("rows"))
            answered = groups.select("cache_key", "task", F.transform("rows", lambda r: F.struct(r["key"].alias("key"), r["prompt"].alias("prompt"))).alias("rows")).mapInPandas(_answers(lane, tier), REQUEST)
            asked = checkpointed(answered)
            used = asked.agg(F.count_if("called").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")).first()
            budget.calls -= used.n
            if budget.money is not None and lane.prices:
                budget.money -= ((used.i or 0) * lane.prices.input + (used.o or 0) * lane.prices.output) / 1e6
    none = {"hit": F.lit(False), "called": F.lit(False), "result": F.lit(None).cast("string"), "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long")}
    if asked is None:
        known = known.withColumns({f"__{k}": v for k, v in none.items()})
    else:
        known = known.join(asked.select("key", *(F.col(k).alias(f"__{k}") for k in none)), "key", "left")
    hit = F.col("__cached").isNotNull()
    result = F.coalesce("__cached", "__result")
    wasted = F.coalesce("__called", F.lit(False)) & F.lit(budget is not None and budget.spent)
    answer = F.struct(
        named.alias("task"), F.lit(tier).alias("tier"), F.col("__key").alias("cache_key"), result.alias("result"), (hit | F.coalesce("__hit", F.lit(False))).alias("hit"), F.coalesce("__called", F.lit(False)).alias("called"),
        F.coalesce("__input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("__output_tokens", F.lit(0)).alias("output_tokens"), F.when(~wasted, F.trim(result)).alias("used"),
    )
    return known.select(*rows.columns, F.when(F.col("__key").isNotNull(), answer).alias(f"s{n}"))


def _parsed(result: Column) -> Column:
    return F.from_json(result, "struct<verdict:string,confidence:double,reason:string,faithful:boolean>", {"mode": "PERMISSIVE"})


def _verdict(result: Column) -> Column:
    j = _parsed(result)
    sound = F.coalesce(j["verdict"].isin(*VERDICTS) & j["confidence"].isNotNull(), F.lit(False))
    unsure = F.struct(F.lit("uncertain").alias("verdict"), F.lit(0.0).alias("confidence"))
    return F.when(sound, F.struct(j["verdict"].alias("verdict"), j["confidence"].alias("confidence"))).otherwise(unsure)


#: Stages of a walk: translate, rewrite or extract; again in the strong tier; fidelity; verdict; strong verdict.
STAGES = (1, 2, 3, 4, 5)


def walk(work: DataFrame, cache: DataFrame, lane: Lane, budget: Budget | None) -> DataFrame:
    """``work`` after its stages: outcome, detail, fact, missed (a request had no answer for want of a call), s1 to s5 with what was asked; written."""
    how = {"cache": cache, "lane": lane, "budget": budget}
    start = F.substring("origin", 1, ASKED)
    rows = ask(work, 1, F.col("task") != "verify", F.col("task"), "cheap", F.col("origin"), start, **how)
    first, second = lane.broken
    rows = rows.withColumn("again", F.coalesce(first, F.lit(False)))
    rows = ask(rows, 2, F.col("again") & F.lit(lane.strong), F.col("task"), "strong", F.col("origin"), start, **how)
    made = F.when(F.col("task") == "verify", F.col("statement")).when(~F.col("again"), F.col("s1.used")).when(F.col("again") & ~second, F.col("s2.used"))
    rows = rows.withColumn("made", made)
    rows = ask(rows, 3, (F.col("task") == "translate") & F.col("made").isNotNull(), "fidelity", "cheap", F.col("origin"), F.concat(start, F.lit("\n"), "made"), **how)
    faithful = (F.col("task") != "translate") | F.coalesce(_parsed(F.col("s3.used"))["faithful"], F.lit(False))
    rows = rows.withColumns({"lost": F.col("made").isNotNull() & ~faithful, "made": F.when(faithful, F.col("made"))})
    # The text decides where it can; verdicts are asked for where it leaves doubt.
    names = [c for c in rows.columns if c != "statement"]
    told = P.verify(rows.select(*names, F.col("statement").alias("first"), F.coalesce("made", F.lit("")).alias("statement"), F.col("evidence").alias("text"), F.lit("chunk").alias("chunk_id")))
    doubt = F.col("made").isNotNull() & (F.col("reason") == "deterministic_support_ambiguous")
    rows = told.select(*names, F.col("first").alias("statement"), doubt.alias("doubt"), (F.col("made").isNotNull() & (F.col("status") == "verified")).alias("plain"), (F.size("risk_flags") == 0).alias("safe"))
    excerpt = F.substring("evidence", 1, EXCERPT)
    claim = F.concat("made", F.lit("\n"), excerpt)
    rows = ask(rows, 4, F.col("doubt"), "verify", "cheap", excerpt, claim, **how)
    unsure = _verdict(F.col("s4.used"))["verdict"] == "uncertain"
    rows = ask(rows, 5, F.col("doubt") & unsure & F.lit(lane.strong), "verify", "strong", excerpt, claim, **how)
    v = F.when(F.col("s5").isNotNull(), _verdict(F.col("s5.used"))).otherwise(_verdict(F.col("s4.used")))
    supported = F.col("doubt") & (v["verdict"] == "supported") & (v["confidence"] >= 0.8)
    rows = rows.withColumn("holds", F.coalesce((F.col("plain") | supported) & F.col("safe"), F.lit(False)))
    policy, spare = F.col("task").isNull(), ~F.col("required") & F.col("own")
    outcome = F.when(F.col("holds"), "verified").when(policy, "rejected_policy").when(spare, "verified_original").otherwise("rejected")
    detail = (
        F.when(F.col("holds"), "model_verified").when(policy, "policy_ambiguity").when(spare, "kept_original").when(F.col("s1").isNotNull() & F.col("s1.used").isNull(), "no_answer")
        .when(F.col("again") & F.col("made").isNull() & ~F.col("lost"), "anchors_broken").when(F.col("lost"), "not_faithful").otherwise("not_verified")
    )
    fact = F.when(F.col("holds"), F.col("made")).when(~policy & spare, F.col("statement"))
    missed = F.greatest(*(F.coalesce(~F.col(f"s{n}.hit") & ~F.col(f"s{n}.called"), F.lit(False)) for n in STAGES))
    return checkpointed(rows.select("key", "pos", "task", "escalation", outcome.alias("outcome"), detail.alias("detail"), fact.alias("fact"), missed.alias("missed"), *(f"s{n}" for n in STAGES)))


def asked_of(walked: DataFrame) -> DataFrame:
    """(key, pos, stage, task, tier, ...) of all requests of a walk that were hits or calls."""
    each = walked.select("key", "pos", F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(f"s{n}").alias("s")) for n in STAGES))).alias("x"))
    return each.select("key", "pos", "x.stage", "x.s.*").where("hit OR called")


def usage_of(walked: DataFrame) -> DataFrame:
    """Ledger rows of calls and hits; pos and stage give their order."""
    return asked_of(walked).select("key", "pos", "stage", "task", "tier", "input_tokens", "output_tokens", F.col("hit").alias("cache_hit"), (F.col("called") & F.col("result").isNull()).alias("failed"))


def prepared(escalated: DataFrame) -> DataFrame:
    """``escalated`` with task, origin (what is to be said anew) and whether the statement holds by itself (own), written."""
    task = F.lit(None).cast("string")
    for reason, name in TASK_OF.items():
        task = F.when(F.col("escalation") == reason, name).otherwise(task)
    named = escalated.select("key", "pos", "statement", "evidence", "escalation", F.coalesce("required", F.lit(True)).alias("required"), task.alias("task"))
    origin = F.when(F.col("task") == "translate", F.col("evidence")).otherwise(F.col("statement"))
    own = P.verify(named.withColumns({"origin": origin, "text": F.col("evidence"), "chunk_id": F.lit("chunk")}))
    return checkpointed(own.select("key", "pos", "statement", "evidence", "escalation", "required", "task", "origin", F.col("playable").alias("own")))


def _sent(rows: DataFrame) -> DataFrame:
    """``rows`` written, and sent to every task where they are few."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= SENT else rows


def answered(probe: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of a walk's rows that missed a request which ``new`` (cache_key) answers; a walk of the others on the longer cache ends as before."""
    missed = F.array(*(F.when(~F.col(f"s{n}.hit") & ~F.col(f"s{n}.called"), F.col(f"s{n}.cache_key")) for n in STAGES))
    asked = probe.where("missed").select("key", F.explode(F.array_compact(missed)).alias("cache_key"))
    return asked.join(F.broadcast(new.select("cache_key")), "cache_key", "left_semi").select("key").distinct()  # no more than calls of one round


def run_lane(escalated: DataFrame, cache: DataFrame, endpoint: Endpoint, budget: int = 10, max_cost: float | None = None, prices: Prices | None = None, strong: bool = True, model_id: str = "m", contract: str = "c") -> dict[str, DataFrame]:
    """``escalated``: key, pos, statement, evidence (the chunk), escalation, required. Returns outcomes, new cache rows, usage.

    Keys and positions are unique. Policy cases are rejected without a call. Optional rewrites that fail leave the original where it holds by itself.
    ``max_cost`` needs ``prices``.
    """
    if max_cost is not None and prices is None:
        raise ValueError("a cost budget needs prices")
    lane, left, work = Lane(endpoint, prices, strong, model_id, contract), Budget(budget, max_cost), prepared(escalated)
    known, new, final = _sent(cache.select("cache_key", "result")), [], []
    probe = walk(work, known, lane, None)
    while True:
        wanted = [] if left.spent else [(r.pos, r.task) for r in probe.where("missed").select("pos", "task").orderBy("pos").limit(left.calls + 1).collect()]
        if not wanted:
            final.append(probe)
            break
        n = max(1, lane.fits(wanted, left))
        last, rest = F.lit(wanted[n - 1][0]), F.lit(wanted[n][0]) if n < len(wanted) else None
        # No more rows than calls are left, so they are sent to the others.
        taken = work.join(F.broadcast(probe.where(F.col("missed") & (F.col("pos") <= last)).select("key")), "key", "left_semi")
        done = walk(taken, known, lane, left)
        free = ~F.col("missed") if rest is None else ~F.col("missed") & (F.col("pos") < rest)
        final += [probe.where(free), done]
        new.append(checkpointed(asked_of(done).where("called AND result IS NOT NULL").select("cache_key", "result")))
        known = _sent(cache.select("cache_key", "result").unionByName(reduce(DataFrame.unionByName, new)))
        if rest is None:
            break
        work, probe = work.where(F.col("pos") >= rest), probe.where(F.col("pos") >= rest)
        changed = _sent(answered(probe, new[-1]))
        if not changed.isEmpty():
            probe = probe.join(changed, "key", "left_anti").unionByName(walk(work.join(changed, "key", "left_semi"), known, lane, None))
    learned = reduce(DataFrame.unionByName, new) if new else cache.select("cache_key", "result").limit(0)
    walked = reduce(DataFrame.unionByName, final)
    usage = usage_of(walked)
    if prices:
        usage = usage.withColumn("cost", ledger.cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(prices.input), F.lit(prices.output)))
    return {"outcomes": walked.select("key", "escalation", "outcome", "detail", "fact"), "cache": learned, "usage": usage}
