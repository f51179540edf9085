"""Planner, frontier, failure and reader rules on hand-written cases and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from txweave.operators import apply, conflict, frontier
from txweave.plans import commit, readers

#: reader id: keys of each transaction; committed; in progress; planned.
CASES = {
    "simple sequence": ({0: "A x1", 1: "A x1"}, [], [], [0, 1]),
    "parallel, one cache": ({0: "A x1", 1: "A x1", 2: "A x2", 3: "A x2"}, [], [], [0, 1, 2, 3]),
    "parallel, two caches": ({0: "A x1", 1: "A x1", 2: "A y2", 3: "A y2"}, [], [], [0, 1, 2, 3]),
    "fork": ({0: "A x1", 1: "A x1 x2", 2: "A x2", 3: "A x2"}, [], [], [0, 1, 2, 3]),
    "join": ({0: "A x1", 1: "A x1", 2: "A y2", 3: "A x2 y1"}, [], [], [0, 1, 2, 3]),
    "element blocked": ({0: "A x1", 1: "A x1", 2: "B x1"}, [], [], [0, 1]),
    "sequence blocked": ({0: "B x1", 1: "A x1", 2: "A x1"}, [], [], [0]),
    "blocked element": ({0: "A x1", 1: "A x1", 2: "B x2", 3: "A x1 x2"}, [], [], [0, 1, 2]),
    "blocked fork": ({0: "A x1", 1: "A x1 x2", 2: "A x1", 3: "B y1", 4: "A x2 y1"}, [], [], [0, 1, 2, 3]),
    "blocked join": ({0: "A x1", 1: "A x1 x2", 2: "A y1", 3: "A y1", 4: "B y2", 5: "A x1 y1 y2"}, [], [], [0, 1, 2, 3, 4]),
    "outside committed": ({0: "A y1", 1: "B y2", 2: "A y1 y2"}, [0], [], [1]),
    "outside committed and in progress": ({0: "A y1", 1: "B y2", 2: "A y1 y2"}, [2], [0, 1], []),
}


def tables(spark, txs, done=(), busy=()):
    live = {t: v.split() for t, v in txs.items() if t not in done}
    scope = [(t, k[0], int(k[1:])) for t, (_, *keys) in live.items() for k in keys]
    heads = [(t, r, t in busy, False, False) for t, (r, *_) in live.items()]
    return spark.createDataFrame(scope, "tx_id long, cache string, key long"), spark.createDataFrame(heads, "tx_id long, reader_id string, in_progress boolean, lost boolean, orphan boolean")


@pytest.mark.parametrize("name", CASES)
def test_plans(spark, name):
    txs, done, busy, planned = CASES[name]
    assert sorted(r.tx_id for r in commit.plan(*tables(spark, txs, done, busy)).collect()) == planned


def by_scan(txs, bad):
    """The rule as one ordered scan."""
    blocked, claimed, out = set(), {}, []
    for t, (reader, keys) in sorted(txs.items()):
        others = set().union(*(k for r, k in claimed.items() if r != reader)) if claimed else set()
        if t in bad or keys & blocked or keys & others:
            blocked |= keys
        else:
            claimed.setdefault(reader, set()).update(keys)
            out.append(t)
    return out


def test_single_key_plan_and_multi_key_plan_equal_the_scan(spark):
    rng = random.Random(5)
    for most in (1, 3):
        txs = {t: (rng.choice("AB"), {("c", rng.randrange(40)) for _ in range(rng.randint(1, most))}) for t in range(160)}
        bad = {t for t in txs if rng.random() < 0.05}
        scope = spark.createDataFrame([(t, c, k) for t, (_, keys) in txs.items() for c, k in keys], "tx_id long, cache string, key long")
        heads = spark.createDataFrame([(t, r, t in bad, False, False) for t, (r, _) in txs.items()], "tx_id long, reader_id string, in_progress boolean, lost boolean, orphan boolean")
        assert sorted(r.tx_id for r in commit.plan(scope, heads).collect()) == by_scan(txs, bad)
        if most == 1:
            rows = scope.join(heads, "tx_id")
            assert sorted(r.tx_id for r in commit.plan_single_key(rows, F.col("in_progress")).collect()) == by_scan(txs, bad)


def test_first_conflict_of_a_key_stands_for_the_later_ones(spark):
    rng = random.Random(2)
    readers_of = {t: rng.choice(("A", "B", "C", None)) for t in range(200)}
    rows = [(t, "c", rng.randrange(30), readers_of[t]) for t in range(200)] + [(t, "d", 1, "A") for t in range(50)] + [(t, "e", 2, None if t < 9 else "B" if t % 10 else "A") for t in range(40)]
    scope = spark.createDataFrame(rows, "tx_id long, cache string, key long, reader_id string")
    want = set()
    for at in {r[1:3] for r in rows}:
        mine = sorted((t, r) for t, c, k, r in rows if (c, k) == at and r)
        want |= {next((t for t, r in mine if r != mine[0][1]), None)} if mine else set()
    assert {r.tx_id for r in conflict.first_conflicts(scope).collect()} == want - {None}


def test_prefixes_cross_segments(spark):
    from txweave.operators.prefix import prefixes

    rng = random.Random(1)
    rows = [(k, t, rng.randrange(100)) for k in "ab" for t in sorted(rng.sample(range(300), 60))]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    out = prefixes(df, ["k"], "t", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, width=7)
    for r in out.collect():
        before = [v for k, t, v in rows if k == r.k and t < r.t]
        assert (r.n, r.s, r.lo, r.hi) == (len(before), sum(before), min(before, default=None), max(before, default=None))


@pytest.mark.parametrize(
    ("to", "new", "dense", "left", "at"),
    [
        ([2, 3, 4], [], 0, [2, 3, 4], 0), ([1, 2, 4], [], 0, [4], 2), ([2, 3, 4], [5], 0, [2, 3, 4, 5], 0), ([1, 4], [2], 0, [4], 2), ([2, 4], [1], 0, [4], 2),
        ([2, 3, 4], [1], 0, [], 4), ([2, 3, 4], [1, 4, 5, 7], 0, [7], 5), ([2, 4, 5], [1, 4, 5, 7], 0, [4, 5, 7], 2), ([6, 8], [4, 5], 4, [8], 6),
    ],
)
def test_merge_with_compaction(spark, to, new, dense, left, at):
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "tx_id long")
    where, rest = frontier.merge_compact(ids(to), ids(new), dense)
    assert (where, sorted(r.tx_id for r in rest.collect())) == (at, left)


def test_frontier_gaps_and_empty_sets(spark):
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "tx_id long")
    assert frontier.frontier_value(ids([0, 6, 5, 7, 1, 2, 100, 101, 3, 4])) == 7
    assert frontier.frontier_value(ids([])) == -1
    assert sorted(r.tx_id for r in frontier.gaps(ids([0, 1, 3, 5, 6])).collect()) == [2, 4]
    assert frontier.gaps(ids([])).count() == 0
    assert frontier.dense_read(ids([0, 1, 2, 3, 4, 6, 9, 11, 12]), -1).count() == 5


def test_offsets_wait_for_the_earliest_open_one(spark):
    rows = lambda done: spark.createDataFrame([(0, o, tx in done) for o, tx in enumerate([4, 5, 6, 7, 0, 2, 1, 3])], "topic_partition int, offset long, committed boolean")
    assert frontier.offset_frontier(rows({0, 1, 2})).collect() == []
    assert frontier.offset_frontier(rows(set(range(8)))).first().frontier == 7


FAILURES = [("A,B,A", -1, [0, 1, 2]), ("AB,BC,A,C,AB,BC", -1, [0, 1, 2, 3, 4, 5]), ("AB,BC,A,C,AB,BC", 0, []), ("AB,BC,A,C,AB,BC", 1, [0, 2]), ("AB,BC,A,C,AB,BC", 2, [0, 1, 3]), ("AB,BC,A,C,AB,BC", 3, [0, 1, 2, 4]), ("AB,BC,A,C,AB,BC", 4, [0, 1, 2, 3]), ("AB,BC,A,C,AB,BC", 5, [0, 1, 2, 3, 4])]


@pytest.mark.parametrize(("keys", "dead", "left"), FAILURES)
def test_failures_take_their_dependents(spark, keys, dead, left):
    scope = spark.createDataFrame([(t, k, 0) for t, ks in enumerate(keys.split(",")) for k in ks], "tx_id long, cache string, key long")
    failed = spark.createDataFrame([(dead,)] if dead >= 0 else [], "tx_id long")
    assert sorted(r.tx_id for r in apply.surviving(scope, failed).collect()) == left


def test_waves_are_longest_chains(spark):
    scope = spark.createDataFrame([(t, k, 0) for t, ks in enumerate("AB,BC,A,C,AB,BC,D".split(",")) for k in ks], "tx_id long, cache string, key long")
    assert {r.tx_id: r.wave for r in conflict.waves(scope).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 0}
    assert sorted(r.tx_id for r in conflict.ready(scope).collect()) == [0, 6]


def test_last_write_wins_with_deletes(spark):
    rows = [(0, "c", 1, "1", False), (1, "c", 2, "1", False), (2, "c", 2, None, True)]
    df = spark.createDataFrame([(t, 0, c, k, v, d) for t, c, k, v, d in rows], "tx_id long, seq long, cache string, key long, value string, is_delete boolean")
    assert [(r.key, r.value) for r in apply.live(df).collect()] == [(1, "1")]
    assert apply.latest(df).where("is_delete").count() == 1


def test_readers_die_when_their_records_are_read_again(spark):
    schema = "tx_id long, reader_id string, arrival long, in_progress boolean, orphan boolean"
    reads = spark.createDataFrame([(0, "A", 0, False, False), (2, "A", 1, False, False), (1, "B", 2, False, False)], schema)
    again = spark.createDataFrame([(0, "B", 3, False, False)], schema)
    lost = spark.createDataFrame([("A",)], "reader_id string")
    dead = readers.dead_readers(reads, again, lost)
    assert [r.reader_id for r in dead.collect()] == ["A"]
    after = {(r.tx_id, r.reader_id): r.orphan for r in readers.orphaned(reads.unionByName(again), dead).collect()}
    assert after == {(0, "A"): True, (2, "A"): True, (1, "B"): False, (0, "B"): False}
