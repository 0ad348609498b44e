"""A fold over the events of each key as a parallel scan, so that a key may hold any share of all rows.

The fold: an event counts if it is the first of its key, or of another kind than the event that counted last, or comes more than ``limit``
microseconds after it. Events are range-partitioned by key, time and kind into parts of like size; a part is a function of what counted
last before it:

* Once the kind or key changes within a part, what comes before no longer matters: the function is constant.
* In a part of one key and kind the time that counted last decides which event counts next, and from there on all is settled. Only events
  within ``limit`` of the part's begin can be that next one, so the function is a short table of steps.

Such functions are closed under composition. They are composed by doubling, in as many rounds as the number of parts has binary digits,
one row per part; then every part runs its own fold from what counted last before it. No key is collected, and nothing but numbers of
parts reaches the driver.

Edge cases: a null kind equals none, so it always counts, as often as it occurs; events of equal key, time and kind are one otherwise; events
without a time are left out; a null key is a key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.firewall import _checkpoint as checkpointed

STEP = "part int, owner string, kind string, fixed boolean, upto array<long>, next array<long>, fresh long"


def applied(f: dict, owner: str | None, kind: str | None, at: int | None) -> int:
    """What counts last after ``f``, which has one key and kind, where (owner, kind, at) counted last before."""
    if at is None or (owner, kind) != (f["owner"], f["kind"]) or kind is None:
        return f["fresh"]
    k = bisect_right(f["upto"], at)
    return f["next"][k] if k < len(f["next"]) else at


def composed(f: dict, g: dict) -> dict:
    """First ``f``, then ``g``. ``upto[k]`` is the first time from which on the ``k``-th step no longer holds."""
    if g["fixed"]:
        return g
    out = {"owner": g["owner"], "kind": g["kind"], "upto": [], "next": [], "fresh": applied(g, f["owner"], f["kind"], f["fresh"]), "fixed": True}
    if f["fixed"] or (f["owner"], f["kind"]) != (g["owner"], g["kind"]) or g["kind"] is None:
        return out
    # Times that pass through f unchanged meet the steps of g.
    end = f["upto"][-1] if len(f["upto"]) else -(1 << 62)
    steps = [(u, applied(g, f["owner"], f["kind"], n)) for u, n in zip(f["upto"], f["next"], strict=True)]
    steps += [(u, n) for u, n in zip(g["upto"], g["next"], strict=True) if u > end]
    return {**out, "fixed": False, "upto": [u for u, _ in steps], "next": [n for _, n in steps]}


def summary(owner: str | None, kind: str | None, times: np.ndarray, limit: int) -> tuple[list[int], list[int], int]:
    """Steps and outcome of a part of one key and kind with these rising times."""
    following = np.searchsorted(times, times + limit, side="right")
    last = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    # Event i is next for what counted in [its predecessor - limit, its own time - limit).
    most = int(np.searchsorted(times, times[0] + limit, side="right")) + 1
    return (times[:most] - limit).tolist(), last[:most].tolist(), int(last[0])


def counted(events: DataFrame, key: str, limit: int, parts: int | None = None) -> DataFrame:
    """(key, at, kind) of the events (key, at timestamp, kind string) that count."""
    once = events.where("at IS NOT NULL").groupBy(key, "at", "kind").agg(F.count("*").alias("times"))
    columns = [F.col(key), F.col("at"), F.col("kind")]
    ranged = once.repartitionByRange(*([parts] if parts else []), *columns).sortWithinPartitions(*columns)
    told = ranged.select(key, F.col(key).cast("string").alias("owner"), F.unix_micros("at").alias("us"), "kind", F.when(F.col("kind").isNull(), F.col("times")).otherwise(1).alias("times"), F.spark_partition_id().alias("part"))
    rows = checkpointed(told)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, one, held = None, None, True, []
        for frame in frames:
            if part is None and len(frame):
                part = int(frame.part.iloc[0])
            for owner, us, kind in zip(_plain(frame.owner), frame.us.tolist(), _plain(frame.kind), strict=True):
                if last is None or last[:2] != (owner, kind) or kind is None or us - last[2] > limit:
                    one = one and (last is None or last[:2] == (owner, kind) and kind is not None)
                    last = (owner, kind, us)
                if one:
                    held.append(us)
                elif held:
                    held = []
        if part is not None:
            if one and last[1] is not None:
                upto, following, fresh = summary(*last[:2], np.array(held, np.int64), limit)
                yield pd.DataFrame([(part, *last[:2], False, upto, following, fresh)], columns=_NAMES)
            else:
                yield pd.DataFrame([(part, *last[:2], True, [], [], last[2])], columns=_NAMES)

    steps = checkpointed(rows.select("owner", "us", "kind", "part").mapInPandas(summed, STEP))
    numbers = sorted(r.part for r in steps.select("part").collect())  # a number per part
    places = rows.sparkSession.createDataFrame(list(enumerate(numbers)), "i int, part int")
    steps = steps.join(F.broadcast(places), "part")

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                g = {k: r[k] for k in ("owner", "kind", "fixed", "upto", "next", "fresh")}
                if r["f_fixed"] is not None and r["f_fixed"] == r["f_fixed"]:
                    g = composed({k: r[f"f_{k}"] for k in g}, g)
                out.append((r["part"], g["owner"], g["kind"], bool(g["fixed"]), list(g["upto"]), list(g["next"]), int(g["fresh"]), r["i"]))
            yield pd.DataFrame(out, columns=[*_NAMES, "i"])

    far = 1
    while far < len(numbers):
        before = steps.select((F.col("i") + far).alias("i"), *(F.col(c).alias(f"f_{c}") for c in _NAMES[1:]))
        steps = checkpointed(steps.join(before, "i", "left").mapInPandas(compose, f"{STEP}, i int"))
        far *= 2
    # Nothing counted before the first part, so its successors start with what is fresh there.
    shifted = steps.select((F.col("i") + 1).alias("i"), F.col("owner").alias("b_owner"), F.col("kind").alias("b_kind"), F.col("fresh").alias("b_us"))
    entries = shifted.join(places, "i").select("part", "b_owner", "b_kind", "b_us")  # a row per part

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, started = None, False
        for frame in frames:
            if not started and len(frame):
                started = True
                if frame.b_us.iloc[0] == frame.b_us.iloc[0]:
                    last = (_plain(frame.b_owner.iloc[:1])[0], _plain(frame.b_kind.iloc[:1])[0], int(frame.b_us.iloc[0]))
            keep = []
            for owner, us, kind, times in zip(_plain(frame.owner), frame.us.tolist(), _plain(frame.kind), frame.times.tolist(), strict=True):
                new = last is None or last[:2] != (owner, kind) or kind is None or us - last[2] > limit
                if new:
                    last = (owner, kind, us)
                keep.append(int(times) if new else 0)
            made = frame[[key, "us", "kind"]]
            yield made.loc[made.index.repeat(keep)]

    kind = events.schema[key].dataType.simpleString()
    out = rows.join(F.broadcast(entries), "part", "left").mapInPandas(fold, f"`{key}` {kind}, us long, kind string")
    return out.select(key, F.timestamp_micros("us").alias("at"), "kind")


_NAMES = ["part", "owner", "kind", "fixed", "upto", "next", "fresh"]


def _plain(values: pd.Series) -> list:
    return [None if v is None or v != v else v for v in values]
