"""Failures and plans over long chains of transactions, against one ordered scan."""

import random

from txweave.operators import apply, closure
from txweave.plans import commit

SCOPE = "tx_id long, cache string, key long"
HEADS = "tx_id long, reader_id string, in_progress boolean, lost boolean, orphan boolean"


def scan(scope, start):
    """tx_id of `start` and what depends on it: one pass in order, a reached transaction marks its keys."""
    keys = {}
    for t, c, k in scope:
        keys.setdefault(t, set()).add((c, k))
    marked, out = set(), set(start)
    for t in sorted(keys):
        if t in out or keys[t] & marked:
            out.add(t)
            marked |= keys[t]
    return out


def test_one_failure_before_a_long_key(spark):
    # Key 0 has a third of all rows, far more transactions after the failure than there are rounds.
    rows = [(t, "c", 0 if t % 3 == 0 else t) for t in range(6000)]
    scope = spark.createDataFrame(rows, SCOPE)
    failed = spark.createDataFrame([(3,)], "tx_id long")
    left = sorted(r.tx_id for r in apply.surviving(scope, failed).collect())
    assert left == [t for t in range(6000) if t % 3 or t == 0]
    heads = spark.createDataFrame([(t, "A", t == 3, False, False) for t in range(6000)], HEADS)
    assert sorted(r.tx_id for r in commit.plan(scope, heads).collect()) == left


def test_closure_equals_the_scan(spark):
    rng = random.Random(7)
    for keys, most in ((40, 3), (400, 2)):
        rows = sorted({(t, rng.choice("ab"), rng.randrange(keys)) for t in range(600) for _ in range(rng.randint(1, most))})
        start = rng.sample(range(600), 6) + [10_000]
        got = closure.closure(spark.createDataFrame([(t,) for t in start], "tx_id long"), spark.createDataFrame(rows, SCOPE))
        assert sorted(r.tx_id for r in got.collect()) == sorted(scan(rows, start))
    nothing = spark.createDataFrame([], "tx_id long")
    assert closure.closure(nothing, spark.createDataFrame(rows, SCOPE)).count() == 0


def test_rounds_count_ranges_not_changes_of_key(spark, monkeypatch):
    # Each transaction hands on to the next by another key: 300 rounds for a closure that goes from key to key.
    rows = [(t, "c", k) for t in range(300) for k in (t, t + 1)] + [(t, "d", t) for t in range(300, 400)]
    cuts = []
    monkeypatch.setattr(closure, "cut", lambda df, real=closure.cut: cuts.append(1) or real(df))
    got = closure.closure(spark.createDataFrame([(7,)], "tx_id long"), spark.createDataFrame(rows, SCOPE))
    assert sorted(r.tx_id for r in got.collect()) == list(range(7, 300))
    assert len(cuts) < 10


def test_closure_over_many_ranges_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(closure, "ROWS", 90, raising=False)
    rng = random.Random(3)
    rows = [(t, rng.choice(("a", "b", None)), rng.choice((None, rng.randrange(150)))) for t in range(0, 1200, 2) for _ in range(2)]
    start = [*rng.sample(range(0, 600, 2), 4), 301, 5000]
    want = set(scan([r for r in rows if None not in r], start))
    frames = spark.createDataFrame([(t,) for t in start], "tx_id long"), spark.createDataFrame(rows, SCOPE)
    got = closure.reach(*frames).collect()
    assert sorted(r.tx_id for r in got if r.reached) == sorted(want)
    assert sorted(r.tx_id for r in got if r.in_scope) == list(range(0, 1200, 2))


def test_surviving_comes_with_the_pass(spark):
    # No join back to the scope: what is left is listed with what is reached.
    scope = spark.createDataFrame([(0, "c", 1), (1, "c", 1), (2, "c", 2)], SCOPE)
    left = apply.surviving(scope, spark.createDataFrame([(0,), (9,)], "tx_id long"))
    assert sorted(r.tx_id for r in left.collect()) == [2]
    assert "LeftAnti" not in left._jdf.queryExecution().toString()
