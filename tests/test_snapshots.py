"""Snapshot trees, overlay reads, merge, rollback, backup, metrics, names and the log."""

import pytest
from pyspark.sql import functions as F

from txweave.functions import ids
from txweave.operators import backup, frontier, metrics, reconcile, snapshots, workload
from txweave.sources import log, model, store

KV = "cache string, snapshot_id long, key string, seq long, value string, is_delete boolean"


def versions(spark, script):
    rows = [("c", s, k, n, v, v is None) for s, changes in script.items() for n, (k, v) in enumerate(changes.items())]
    return spark.createDataFrame(rows, KV)


def tree(spark, *edges):
    return spark.createDataFrame(edges, model.TREE)


def read(spark, kv, nodes, head):
    return {r.key: r.value for r in snapshots.overlay(kv, snapshots.path(nodes, head)).collect()}


def test_overlay_and_rollback(spark):
    kv = versions(spark, {1: {"a": "1", "b": "2", "c": "3"}, 2: {"c": "4", "d": "5", "e": "6"}, 3: {"a": "7", "e": "8", "f": "9"}})
    nodes = tree(spark, (1, None), (2, 1), (3, 2))
    assert read(spark, kv, nodes, 3) == {"a": "7", "b": "2", "c": "4", "d": "5", "e": "8", "f": "9"}
    back = snapshots.rollback(nodes, 1, 4)
    assert read(spark, kv, back, 4) == {"a": "1", "b": "2", "c": "3"}
    stale = snapshots.changed_keys(kv, snapshots.sub_path(nodes, 1, 3))
    assert sorted(r.key for r in stale.collect()) == ["a", "c", "d", "e", "f"]


def test_deletes_end_the_search(spark):
    kv = versions(spark, {1: {"a": "1", "b": "2"}, 2: {"a": None}})
    assert read(spark, kv, tree(spark, (1, None), (2, 1)), 2) == {"b": "2"}


def test_merge_moves_children_and_labels(spark):
    kv = versions(spark, {1: {"a": "1", "b": "2"}, 2: {"b": "3", "c": "4"}})
    nodes = tree(spark, (1, None), (2, 1), (3, 2))
    labels = spark.createDataFrame([("1", 1), ("something", 2)], "label string, id long")
    none = spark.createDataFrame([], "id long, replacement_id long")
    line = snapshots.line_path(nodes, 1, 2)
    after, merged, moved = snapshots.merge(nodes, none, labels, 1, 2, 12, 3)
    whole = kv.where("snapshot_id > 2").unionByName(snapshots.merge_versions(kv, line, 12))
    assert read(spark, whole, after, 3) == {"a": "1", "b": "3", "c": "4"}
    assert {r.id for r in moved.collect()} == {12} and {r.id for r in merged.collect()} == {1, 2}
    assert snapshots.newer_than(after, merged, 12).collect()[0].id in (3, 12)
    with pytest.raises(ValueError, match="head"):
        snapshots.merge(nodes, none, labels, 1, 3, 12, 3)
    with pytest.raises(ValueError, match="child"):
        snapshots.line_path(tree(spark, (1, None), (2, 1), (3, 1), (4, 2)), 1, 4)
    with pytest.raises(ValueError, match="ancestor"):
        snapshots.sub_path(nodes, 3, 2)


def test_labels(spark):
    labels = snapshots.add_label(spark.createDataFrame([("a", 1)], "label string, id long"), "b", 1)
    assert snapshots.find(labels, "b") == 1
    assert snapshots.labels_of(labels).first().labels == ["a", "b"]
    with pytest.raises(ValueError, match="taken"):
        snapshots.add_label(labels, "a", 2)
    with pytest.raises(NotImplementedError):
        snapshots.rollforward("a")


def test_backup_is_verified(spark, tmp_path):
    kv = versions(spark, {1: {"a": "1", "b": None}, 2: {"a": "3"}})
    nodes = tree(spark, (1, None), (2, 1))
    backup.export(kv, nodes, f"{tmp_path}/b")
    rows, back = backup.restore(spark, f"{tmp_path}/b", KV)
    assert sorted(map(tuple, rows.select(*kv.columns).collect()), key=repr) == sorted(map(tuple, kv.collect()), key=repr) and back.count() == 2
    changed = kv.withColumn("value", F.lit("9"))
    backup.manifest(changed).write.mode("overwrite").parquet(f"{tmp_path}/b/manifest")
    with pytest.raises(backup.ChecksumError):
        backup.restore(spark, f"{tmp_path}/b", KV)
    current = versions(spark, {2: {"a": "555"}, 3: {"b": "666"}})
    assert {(r.snapshot_id, r.value) for r in backup.restored(current, kv).collect()} == {(1, "1"), (1, None), (2, "3"), (3, "666")}


def test_names_and_codecs(spark):
    v = [0, 5, 2**31, 2**32 + 7, -1, -(2**40)]
    df = spark.createDataFrame([(x,) for x in v], "x long")

    def expected(x):
        h = (x ^ ((x & (1 << 64) - 1) >> 32)) & 0xFFFFFFFF
        h -= (h >> 31) << 32
        return int(abs(h) % 4) * (1 if h >= 0 else -1)

    assert [r[0] for r in df.select(ids.partition_of(F.col("x"), 4)).collect()] == [expected(x) for x in v]
    names = spark.createDataFrame([("data\\c\\17",), ("data/c",), ("meta/c/1",)], "n string")
    assert [r[0] and tuple(r[0]) for r in names.select(ids.parse_resource(F.col("n"))).collect()] == [("c", 17), None, None]
    one = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.array(F.lit("x")).alias("b")).alias("v"))
    assert one.select(ids.decode(ids.encode(F.col("v")), "a int, b array<string>").alias("d")).first().d.b == ["x"]


def test_scopes_and_log(spark, tmp_path):
    rows = [(1, 0, "c", 5, "x", False), (1, 1, "c", 6, "y", False), (1, 2, "d", 5, "z", False), (2, 0, "c", 5, None, True)]
    changes = spark.createDataFrame(rows, model.CHANGES)
    nested = model.nested(changes)
    first = nested.where("tx_id = 1").first()
    assert [(s.cache, s["keys"]) for s in first.scope] == [("c", [5, 6]), ("d", [5])] and first["values"] == [["x", "y"], ["z"]]
    out = {(r.tx_id, r.cache, r.key, r.value) for r in model.unnested(nested).collect()}
    assert out == {(1, "c", 5, "x"), (1, "c", 6, "y"), (1, "d", 5, "z"), (2, "c", 5, None)}
    log.append_log(nested.withColumn("offset", F.col("tx_id")), f"{tmp_path}/log", 4)
    assert {r.topic_partition for r in log.read_log(spark, f"{tmp_path}/log").collect()} == {1, 2}
    assert model.needs_serialization(model.table_schema({"a": "bytes"})["a"].dataType) and not model.needs_serialization(model.table_schema({"a": "int"})["a"].dataType)
    assert [r.tx_id for r in log.numbered(spark.range(5, 50, 9), "id", 3).orderBy("id").collect()] == [3, 4, 5, 6, 7]


def test_fan_out_suspends_a_failing_sink(spark, tmp_path):
    seen, suspensions = [], log.Suspensions(spark, f"{tmp_path}/suspended")

    def broken(batch, batch_id):
        raise OSError("gone")

    write = log.fan_out({"a": lambda b, i: seen.append((i, b.count())), "b": broken}, suspensions)
    write(spark.range(3), 0)
    write(spark.range(4), 1)
    assert seen == [(0, 3), (1, 4)] and log.Suspensions(spark, f"{tmp_path}/suspended").now() == {"b": 0}  # a restart knows
    suspensions.resume("b")
    assert suspensions.now() == {}


def test_upsert_into_a_database(spark):
    url, options = "jdbc:derby:memory:upserts;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    store.write_jdbc(first, url, "people", options)
    batch = spark.createDataFrame([(2, "B", False), (3, None, True), (4, "d", False), (9, None, True)], "id long, name string, deleted boolean")
    for _ in range(2):  # a repeated batch changes nothing
        store.upsert_jdbc(batch, url, "people", "id", "deleted", options)
    rows = spark.read.jdbc(url, "people", properties=options)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a"), (2, "B"), (4, "d")]
    assert store.read_jdbc(spark, url, "people", "id", 1, 4, 2).count() == 3


def test_restore_and_rollback_refuse_while_transactions_run(spark, tmp_path):
    kv = spark.createDataFrame([("c", 0, 5, 0, "x", False), ("c", 1, 5, 1, "y", False)], model.VERSIONS)
    tree = spark.createDataFrame([(0, None), (1, 0)], model.TREE)
    after = backup.full_backup(kv, tree, 1, 2, f"{tmp_path}/backup")
    assert sorted((r.id, r.parent_id or 0) for r in after.collect()) == [(0, 0), (1, 0), (2, 1)]
    with pytest.raises(RuntimeError, match="running"):
        backup.restore_all(kv, after, f"{tmp_path}/backup", model.VERSIONS, spark.range(1))
    with pytest.raises(RuntimeError, match="running"):
        snapshots.rollback(tree, 0, 9, spark.range(1))
    later = kv.unionByName(spark.createDataFrame([("c", 2, 7, 2, "z", False)], model.VERSIONS))
    rows, restored_tree, stale = backup.restore_all(later, after, f"{tmp_path}/backup", model.VERSIONS, spark.range(0))
    assert rows.count() == 3 and restored_tree.count() == 2 and [tuple(r) for r in stale.collect()] == [("c", 7)]
    with pytest.raises(Exception, match="EXISTS"):
        backup.export(kv, tree, f"{tmp_path}/backup")


def test_gaps_are_listed_in_pieces(spark):
    ids = spark.createDataFrame([(0,), (1,), (5,), (300,)], "tx_id long")
    expected = [2, 3, 4, *range(6, 300)]
    assert sorted(r.tx_id for r in frontier.gaps(ids, piece=7).collect()) == expected
    assert sorted(tuple(r) for r in frontier.gap_ranges(ids).collect()) == [(2, 4), (6, 299)]
    assert [r.tx_id for r in reconcile.missed(ids, ids.where("tx_id < 2"), 1).orderBy("tx_id").collect()] == expected
    assert reconcile.missed(ids, ids.where("tx_id < 1"), 1).count() == 0  # what is dense is not committed yet
    assert sorted(tuple(r) for r in reconcile.reconciliation(ids, 400).collect()) == [(2, 4), (6, 299), (301, 400)]


def test_moving_rates_go_through_ticks(spark):
    import math

    counts = [3, 0, 0, 7, 1, 0, 4]
    rows = [("a", k * 5 + 1) for k, n in enumerate(counts) for _ in range(n)]
    frame = spark.createDataFrame(rows, "g string, s long").selectExpr("g", "timestamp_seconds(s) AS ts")
    (row,) = metrics.moving_rates(frame, ["g"], "ts").collect()
    for m in (1, 5, 15):
        rate = counts[0] / 5
        for n in counts[1:]:
            rate += (1 - math.exp(-5 / 60 / m)) * (n / 5 - rate)
        assert row[f"m{m}"] == pytest.approx(rate)


def test_repair_and_metrics(spark):
    scope = "array<struct<cache:string,keys:array<bigint>>>"
    records = spark.createDataFrame([(2, [("c", [1])])], f"tx_id long, scope {scope}")
    missing = spark.createDataFrame([(2,), (4,)], "tx_id long")
    out = {r.tx_id: (r.found, len(r.scope)) for r in reconcile.repair(missing, records).collect()}
    assert out == {2: (True, 1), 4: (False, 0)}
    assert reconcile.gap_suspected(5, 5, 5, 3) and not reconcile.gap_suspected(5, 5, 4, 3)
    pairs = spark.createDataFrame([(1, 30, "END"), (1, 10, "START"), (2, 5, "START")], "operation_id long, time long, type string")
    assert [tuple(r) for r in metrics.pair(pairs).collect()] == [(1, 20)]
    reports = spark.createDataFrame([(0, r, float(v)) for r, v in enumerate([50, 90, 120, 130, 140])], "stage int, report int, latency double")
    assert metrics.overload(reports).first().overloaded
    moves = spark.createDataFrame([(1, 2, 10), (2, 3, 4)], "from_account long, to_account long, amount long")
    assert {r.account: r.balance for r in workload.balances(moves).collect()} == {1: -10, 2: 6, 3: 4}
    assert workload.retry_delay(3) == 3000


def test_version_store(spark):
    name = "versions_of_tests"
    store.drop(spark, name)
    store.create(spark, name)
    rows = spark.createDataFrame([("c", 1, 5, 0, "x", False), ("c", 2, 6, 0, "y", False)], model.VERSIONS)
    store.append(rows, name)
    assert [tuple(r) for r in store.key_values(spark, name, "c", 1).collect()] == [(5, 0, "x", False)]
    assert [r.key for r in store.keys(spark, name, "c", 2).collect()] == [6]
    store.truncate(spark, name)
    assert spark.table(name).count() == 0
    store.drop(spark, name)
