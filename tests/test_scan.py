import random
from datetime import datetime, timedelta

from factloom.streaming import scan

T0 = datetime(2024, 1, 1)


def plain(rows, limit):
    """The fold, one event after the other."""
    last, out = {}, []
    for key, at, kind in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "")):
        before = last.get(key)
        if before is None or before[1] != kind or kind is None or (at - before[0]) / timedelta(microseconds=1) > limit:
            last[key] = (at, kind)
            out.append((key, at, kind))
    return out


def told(rows):
    return sorted(rows, key=repr)


def check(spark, rows, limit, parts):
    frame = spark.createDataFrame(rows, "k long, at timestamp, kind string").repartition(3)
    assert told(map(tuple, scan.counted(frame, "k", limit, parts).collect())) == told(plain(rows, limit))


def test_equals_the_fold_with_a_key_of_half_the_rows(spark):
    r = random.Random(7)
    rows = []
    for n in range(1200):
        key = 1 if n % 2 else r.choice([2, 3, 4, None])
        rows.append((key, T0 + timedelta(seconds=r.choice([r.randrange(40_000), r.randrange(2000)]), microseconds=r.choice([0, 1])), "a" if key == 1 and r.random() < 0.97 else r.choice(["a", "b", None])))
    rows += rows[:40] + [(5, None, "a")]
    for limit in (600_000_000, 5_000_000 - 1):
        check(spark, rows, limit, 13)


def test_one_key_of_one_kind_over_many_parts(spark):
    """Every part is a step function of the one before it; gaps are just below and above the limit."""
    r = random.Random(9)
    at, rows = 0, []
    for _ in range(400):
        at += r.choice([1, 3, 90, 99, 100, 101])
        rows.append((1, T0 + timedelta(seconds=at), "a"))
    check(spark, rows, 100_000_000, 31)
    check(spark, rows, 4_000_000_000, 31)


def test_steps_compose_like_folds():
    r = random.Random(2)
    for _ in range(300):
        limit, at, parts = 20, 0, []
        for _ in range(r.randint(2, 5)):
            times = []
            for _ in range(r.randint(1, 6)):
                at += r.randint(1, 25)
                times.append(at)
            parts.append(times)
        functions = []
        for times in parts:
            upto, following, fresh = scan.summary("k", "a", scan.np.array(times), limit)
            functions.append({"owner": "k", "kind": "a", "fixed": False, "upto": upto, "next": following, "fresh": fresh})
        whole = functions[0]
        for g in functions[1:]:
            whole = scan.composed(whole, g)
        for start in [None, *range(parts[0][0] - 30, parts[0][0])]:
            last = start
            for t in [t for times in parts for t in times]:
                last = t if last is None or t - last > limit else last
            assert scan.applied(whole, "k", "a", start) == last, (parts, start)


def test_empty_and_single(spark):
    check(spark, [(None, None, "a")], 5, 4)
    check(spark, [(1, T0, None), (1, T0, None), (1, T0, "a"), (1, T0, "a")], 5, 4)
