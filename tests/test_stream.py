"""Streams end in the state that one batch over the whole log gives."""

import time

import pandas as pd
from pyspark.sql import functions as F

from txweave import queries
from txweave.operators import apply, frontier
from txweave.sources import log, model
from txweave.streaming.apply import LogApplier
from txweave.streaming.heartbeats import beat, liveness


def changes(spark, ids):
    rows = [(t, n, "c", (t * 3 + n) % 7, None if t % 5 == 0 else f"{t}.{n}", t % 5 == 0) for t in ids for n in range(t % 3 + 1)]
    return spark.createDataFrame(rows, model.CHANGES)


def test_micro_batches_equal_one_batch(spark, tmp_path):
    order = [4, 5, 6, 7, 0, 2, 1, 3, 9, 8, 12, 11]  # 10 never comes
    for n, t in enumerate(order):
        nested = model.nested(changes(spark, [t])).withColumn("offset", F.lit(n).cast("long"))
        log.append_log(nested.coalesce(1), f"{tmp_path}/log", 1)
    applier = LogApplier(spark, f"{tmp_path}/state")
    query = applier.start(log.stream_log(spark, f"{tmp_path}/log", 5), f"{tmp_path}/check", available_now=True)
    assert query.awaitTermination(60)
    assert query.exception() is None and applier.last()[1] == 9
    expected = apply.live(changes(spark, range(10))).select("cache", "key", "tx_id", "value")
    assert sorted(applier.table().select("cache", "key", "tx_id", "value").collect()) == sorted(expected.collect())
    before = applier.last()
    applier.apply(log.read_log(spark, f"{tmp_path}/log"), before[0])  # a repeated batch changes nothing
    assert applier.last() == before


def test_what_is_blocked_waits_with_its_dependents(spark, tmp_path):
    busy = {3}
    applier = LogApplier(spark, f"{tmp_path}/state", lambda scope: scope.where(F.col("tx_id").isin(list(busy) or [-1])).select("tx_id"), compact=2)
    rows = lambda ids: model.nested(spark.createDataFrame([(t, 0, "c", t % 2, f"v{t}", False) for t in ids], model.CHANGES))
    table = lambda: {r.key: r.tx_id for r in applier.table().collect()}
    applier.apply(rows([0, 1, 2]), 0)
    assert table() == {0: 2, 1: 1} and applier.last() == (0, 2)
    applier.apply(rows([3, 4, 5, 6]), 1)  # 3 is in progress, 5 depends on it
    assert table() == {0: 6, 1: 1} and applier.last() == (1, 2)
    applier.apply(rows([8]), 2)  # 7 is missing
    assert table() == {0: 6, 1: 1}
    busy.clear()
    applier.apply(rows([4]), 3)  # late and known
    assert table() == {0: 6, 1: 5} and applier.last() == (3, 6)
    applier.apply(rows([7]), 4)
    assert table() == {0: 8, 1: 7} and applier.last() == (4, 8)


class State:
    """A reader's state as the stream would hand it over."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_readers_are_found_lost_and_found_again():
    state, rows = State(), pd.DataFrame({"reader_id": ["a", "a"], "ts": [1, 2]})
    step = lambda: beat(("a",), iter([rows]), state, 60).iloc[0].tolist()
    assert step() == ["a", "found", 2] and state.timeout == 60_000
    assert step() == ["a", "alive", 4]
    state.hasTimedOut = True
    assert beat(("a",), iter([]), state, 60).iloc[0].tolist() == ["a", "lost", 4] and not state.exists
    state.hasTimedOut = False
    assert step() == ["a", "found", 2]


def test_heartbeats_as_a_stream(spark, tmp_path):
    beats = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "reader_id string, ts long")
    beats.coalesce(1).write.parquet(f"{tmp_path}/beats")
    stream = spark.readStream.schema("reader_id string, ts long").parquet(f"{tmp_path}/beats")
    query = liveness(stream, 60).writeStream.format("memory").queryName("beats_seen").outputMode("update").start()
    try:  # timeouts keep such a stream busy, so it is stopped once it has said something
        end = time.monotonic() + 90
        while not (seen := spark.table("beats_seen").collect()) and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in seen) == [("a", "found", 2), ("b", "found", 1)]


def test_a_turn_takes_several_files(spark, tmp_path, monkeypatch):
    # One task would write, and one read, all of a turn, however large the log is.
    monkeypatch.setattr(queries, "_FILE", 50, raising=False)
    monkeypatch.setattr(queries, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    got = queries.log_planned(spark, "/root/testdata/sf0.001").collect()
    assert len(list(tmp_path.glob("stream/log/part-*"))) > 3
    assert len(list(tmp_path.glob("stream/check/commits/[0-9]*"))) == 3
    monkeypatch.undo()
    assert sorted(got) == sorted(queries.log_planned(spark, "/root/testdata/sf0.001").collect())


def test_rows_without_entries_are_known_row_by_row(spark):
    scopes = [None, [], [("c", None)], [("c", [])], [("c", [1])], [("c", [1, 2])], [("c", []), ("d", [3])], [None]]
    values = [None, [], [None], [[]], [["v"]], [[None]], [[], ["w"]]]
    rows = [(t, s, v) for t, (s, v) in enumerate((s, v) for s in scopes for v in values)]
    rows = spark.createDataFrame(rows, f"tx_id long, scope {model.SCOPE}, `values` array<array<string>>")
    held = {r.tx_id for r in model.unnested(rows).collect()}
    assert sorted(r.tx_id for r in model.bare(rows).collect()) == [t for t in range(len(scopes) * len(values)) if t not in held]
    assert 0 < len(held) < len(scopes) * len(values)


def test_frontier_over_segments(spark, monkeypatch):
    monkeypatch.setattr(frontier, "SEGMENT", 4)
    # Nothing; a hole in the first segment, at its end, in a later one; no hole; an id read twice in a segment with a hole.
    for ids, start, end in (([], -1, -1), ([0, 1, 3], -1, 1), ([*range(3, 7), 8], 2, 6), ([*range(11), 14], -1, 10), (range(9), -1, 8), ([0, 1, 2, 2, 4], -1, 2)):
        assert frontier.frontier_value(spark.createDataFrame([(t,) for t in ids], "tx_id long"), start) == end
