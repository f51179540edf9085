"""Trees of snapshots over versioned tables: paths, overlay reads, merge, rollback, differences.

tree: id, parent_id (null for the root). merged: id, replacement_id. labels: label, id. kv: cache, snapshot_id, key,
seq (order within a snapshot), value, is_delete. Trees are metadata; their paths are found by pointer jumping, which
takes as many joins as the depth has binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txweave.operators.state import cut


def path(tree: DataFrame, head: int) -> DataFrame:
    """snapshot_id, depth from the head (depth 0) to the root."""
    jump = tree.where("parent_id is not null").select("id", F.col("parent_id").alias("to"))
    found = tree.where(F.col("id") == head).select(F.col("id").alias("snapshot_id"), F.lit(0).cast("long").alias("depth"))
    step = 1
    while True:
        more = found.join(jump, F.col("snapshot_id") == F.col("id")).select(F.col("to").alias("snapshot_id"), (F.col("depth") + step).alias("depth"))
        more = cut(more)
        if more.isEmpty():
            return found
        found = cut(found.union(more))
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"))
        step *= 2


def sub_path(tree: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """The path from `to_id` up to, but without, `from_id`; an error if that is no ancestor."""
    whole = path(tree, to_id)
    at = whole.where(F.col("snapshot_id") == from_id).select("depth").first()
    if at is None:
        raise ValueError(f"snapshot {from_id} is no ancestor of {to_id}")
    return whole.where(F.col("depth") < at[0])


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))


def line_path(tree: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """The path from `to_id` to `from_id`, that included; an error if a snapshot above `to_id` has other children."""
    whole = path(tree, to_id)
    at = whole.where(F.col("snapshot_id") == from_id).select("depth").first()
    if at is None:
        raise ValueError(f"snapshot {from_id} is no ancestor of {to_id}")
    line = whole.where(F.col("depth") <= at[0])
    forks = line.where("depth > 0").join(child_counts(tree).where("children > 1"), F.col("snapshot_id") == F.col("id"))
    fork = forks.select("snapshot_id").first()
    if fork is not None:
        raise ValueError(f"snapshot {fork[0]} has more than one child")
    return line


def create(tree: DataFrame, head: int | None, new_id: int) -> DataFrame:
    """The tree with a new child of the head, its root if there is none."""
    row = tree.sparkSession.range(1).select(F.lit(new_id).cast("long").alias("id"), F.lit(head).cast("long").alias("parent_id"))
    return tree.unionByName(row)


def add_label(labels: DataFrame, label: str, snapshot_id: int) -> DataFrame:
    if not labels.where(F.col("label") == label).isEmpty():
        raise ValueError(f"label {label} is taken")
    row = labels.sparkSession.range(1).select(F.lit(label).alias("label"), F.lit(snapshot_id).cast("long").alias("id"))
    return labels.unionByName(row)


def drop_label(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col("label") != label)


def find(labels: DataFrame, label: str) -> int:
    row = labels.where(F.col("label") == label).select("id").first()
    if row is None:
        raise KeyError(label)
    return row[0]


def labels_of(labels: DataFrame) -> DataFrame:
    """id, labels in order."""
    return labels.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def newest(kv: DataFrame, on_path: DataFrame) -> DataFrame:
    """cache, key, snapshot_id, value, is_delete: each key's version nearest to the path's head, deletes included."""
    rows = kv.join(on_path, "snapshot_id")
    top = F.min_by(F.struct("snapshot_id", "value", "is_delete"), F.struct("depth", -F.col("seq")))
    return rows.groupBy("cache", "key").agg(top.alias("_top")).select("cache", "key", "_top.*")


def overlay(kv: DataFrame, on_path: DataFrame) -> DataFrame:
    """cache, key, snapshot_id, value as read through a path; a delete ends the search."""
    return newest(kv, on_path).where("not is_delete").drop("is_delete")


def overlay_of_keys(kv: DataFrame, on_path: DataFrame, keys: DataFrame) -> DataFrame:
    """The same for the wanted (cache, key), filtered before anything is grouped; deleted and unknown ones are left out."""
    return overlay(kv.join(keys.select("cache", "key").distinct(), ["cache", "key"], "left_semi"), on_path)


def merge_versions(kv: DataFrame, line: DataFrame, new_id: int) -> DataFrame:
    """The rows of a merged snapshot: the newest of the line's versions; deletes are kept, they hide older ones."""
    rows = newest(kv, line)
    return rows.select("cache", F.lit(new_id).cast("long").alias("snapshot_id"), "key", F.lit(0).cast("long").alias("seq"), "value", "is_delete")


def merge(tree: DataFrame, merged: DataFrame, labels: DataFrame, from_id: int, to_id: int, new_id: int, head: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tree, merged and labels after the line from..to is replaced by a new snapshot; the head cannot be merged."""
    if head in (from_id, to_id):
        raise ValueError("the head cannot be merged")
    line = cut(line_path(tree, from_id, to_id).select(F.col("snapshot_id").alias("id")))
    above = tree.where(F.col("id") == from_id).select("parent_id").first()[0]
    rest = tree.join(line, "id", "left_anti")
    moved = rest.withColumn("parent_id", F.when(F.col("parent_id") == to_id, F.lit(new_id)).otherwise(F.col("parent_id")))
    gone = merged.unionByName(line.select("id", F.lit(new_id).cast("long").alias("replacement_id")))
    inside = line.select("id", F.lit(True).alias("_in"))
    relabelled = labels.join(inside, "id", "left").select("label", F.when(F.col("_in"), F.lit(new_id)).otherwise(F.col("id")).alias("id"))
    return create(moved, above, new_id), gone, relabelled


def rollback(tree: DataFrame, target: int, new_id: int, running: DataFrame | None = None) -> DataFrame:
    """The tree with a new head under the target; refused while transactions are running (a table of them)."""
    if running is not None and not running.isEmpty():
        raise RuntimeError("transactions are running")
    if tree.where(F.col("id") == target).isEmpty():
        raise ValueError(f"unknown snapshot {target}")
    return create(tree, target, new_id)


def changed_keys(kv: DataFrame, snapshots: DataFrame) -> DataFrame:
    """cache, key written in any of the snapshots: what a rollback or restore makes stale."""
    return kv.join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi").select("cache", "key").distinct()


def every_node(tree: DataFrame, merged: DataFrame) -> DataFrame:
    """id, parent_id of live and merged snapshots; a merged one leads to its replacement."""
    return tree.select("id", "parent_id").union(merged.select("id", "replacement_id"))


def newer_than(tree: DataFrame, merged: DataFrame, base: int) -> DataFrame:
    """id of snapshots newer than the base, or than the oldest older one that leads to it by way of merges."""
    nodes = cut(every_node(tree, merged))
    reached = fresh = cut(nodes.where(F.col("id") == base).select("id"))
    while True:
        fresh = cut(nodes.join(fresh.select(F.col("id").alias("parent_id")), "parent_id").select("id").join(reached, "id", "left_anti").distinct())
        if fresh.isEmpty():
            break
        reached = cut(reached.union(fresh))
    oldest = reached.agg(F.min("id")).first()[0]
    return tree.where(F.col("id") > (base if oldest is None else min(base, oldest))).select("id")


def catalog(kv: DataFrame, on_path: DataFrame) -> DataFrame:
    """cache, snapshot_id, depth of the versions that exist on a path."""
    return kv.select("cache", "snapshot_id").distinct().join(on_path, "snapshot_id").select("cache", "snapshot_id", "depth")


def tree_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """id of snapshots in one tree only."""
    a, b = old.select("id"), new.select("id")
    return a.subtract(b).union(b.subtract(a))


def rollforward(*_: object) -> None:
    raise NotImplementedError("rolling forward is not supported")
