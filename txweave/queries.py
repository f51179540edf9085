"""The operators as queries over the driver's tables, each with the SQL of the same result.

The tables stand in for a transaction log: an order is a transaction on its customer, a line item one on its part, an
event a change of its user's entry in the cache of its type. Readers are ids modulo 4.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txweave.functions import ids
from txweave.operators import apply, backup, closure, conflict, frontier, metrics, reconcile, snapshots, workload
from txweave.operators.state import checkpoint_dir
from txweave.plans import commit, readers
from txweave.sources import log, model
from txweave.streaming.apply import LogApplier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- views ------------------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx_id"), (F.col("o_orderkey") % 4).alias("reader_id"), F.lit("customer").alias("cache"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.lit("part").alias("cache"), F.col("l_partkey").alias("key"), (F.col("l_orderkey") % 4).alias("reader_id"))


def _line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.distinct_ids(_lines(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("tx_id"), F.lit(0).cast("long").alias("seq"), F.col("event_type").alias("cache"), F.col("user_id").alias("key"), F.col("value"), (F.col("event_type") == "error").alias("is_delete"), "ts"
    )


#: Days are snapshots; a week's first day branches off the one a week earlier, other days follow the day before.
_DAY = "CAST(ts AS DATE) - DATE '2024-01-01'"
_FIRST, _LAST = 0, 29


def _day() -> F.Column:
    return F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "events").select(_day().alias("id")).distinct()
    parent = F.when(F.col("id") == 0, None).when(F.col("id") % 7 == 0, F.col("id") - 7).otherwise(F.col("id") - 1)
    return days.select("id", parent.alias("parent_id"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches by whether users' ids are even; an error deletes the entry."""
    e = _table(spark, sf_dir, "events")
    cache = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return e.select(cache.alias("cache"), _day().alias("snapshot_id"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value"), (F.col("event_type") == "error").alias("is_delete"))


_KV = "cache string, snapshot_id bigint, key bigint, seq bigint, value double, is_delete boolean"
_TREE = f"""tree AS (SELECT DISTINCT {_DAY} AS id,
  CASE WHEN {_DAY} = 0 THEN NULL WHEN ({_DAY}) % 7 = 0 THEN {_DAY} - 7 ELSE {_DAY} - 1 END AS parent_id FROM events)"""
_VERSIONS = f"""kv AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS cache, {_DAY} AS snapshot_id, user_id AS key,
  event_id AS seq, value, event_type = 'error' AS is_delete FROM events)"""


def _path_sql(head: int) -> str:
    return f"""path AS (SELECT id AS snapshot_id, CAST(0 AS BIGINT) AS depth FROM tree WHERE id = {head}
  UNION ALL SELECT t.parent_id, p.depth + 1 FROM path p JOIN tree t ON t.id = p.snapshot_id WHERE t.parent_id IS NOT NULL)"""


def _newest_sql(path: str = "path") -> str:
    return f"""newest AS (SELECT cache, key, snapshot_id, value, is_delete FROM (SELECT kv.*, row_number() OVER (PARTITION BY cache, key ORDER BY depth, seq DESC) AS n
  FROM kv JOIN {path} USING (snapshot_id)) WHERE n = 1)"""


# --- scopes, lookups, names -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_orderkey AS tx_id, 'part' AS cache, l_partkey AS key FROM lineitem")
def scope_long(spark, sf_dir):
    return model.scope_long(_lines(spark, sf_dir))


@query(
    """SELECT l_orderkey AS tx_id, 'part' AS cache, CAST(count(*) AS BIGINT) AS keys, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_key, max(l_partkey) AS largest_key
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) GROUP BY l_orderkey"""
)
def scope_nested(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.lit("part").alias("cache"), F.col("l_partkey").alias("key"), F.col("l_linenumber").cast("long").alias("seq")).distinct()
    nested = model.nested(li.withColumn("value", F.lit(None).cast("string")))
    return nested.select("tx_id", F.inline("scope")).select("tx_id", "cache", F.size("keys").cast("long").alias("keys"), F.get("keys", F.lit(0)).alias("first_key"), F.array_max("keys").alias("largest_key"))


@query("SELECT event_id AS tx_id, event_type AS cache, user_id AS key, CAST(0 AS BIGINT) AS seq, CAST(event_id * 3 AS VARCHAR) AS value FROM events")
def scope_round_trip(spark, sf_dir):
    changes = _events(spark, sf_dir).withColumn("value", (F.col("tx_id") * 3).cast("string"))
    return model.unnested(model.nested(changes))


@query("SELECT event_id AS tx_id, CAST(event_id % 4 AS INTEGER) AS topic_partition FROM events")
def partition_of_tx(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), ids.partition_of(F.col("event_id"), 4).alias("topic_partition"))


@query("SELECT event_id AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_value(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("props").alias("val"))
    return model.spread(rows, "key", "val", "k bigint")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT min(o_custkey) FROM orders UNION SELECT max(o_custkey) FROM orders UNION SELECT arg_max(o_custkey, (o_totalprice, o_custkey)) FROM orders)")
def key_lookup(spark, sf_dir):
    """The first and the last customer with orders and the one of the dearest order: point reads by literal keys."""
    o = _table(spark, sf_dir, "orders").agg(F.min("o_custkey"), F.max("o_custkey"), F.max_by("o_custkey", F.struct("o_totalprice", "o_custkey")))
    return model.lookup(_table(spark, sf_dir, "customer"), "c_custkey", list(o.first())).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def bulk_lookup(spark, sf_dir):
    wanted = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return model.bulk_lookup(_table(spark, sf_dir, "customer"), "c_custkey", wanted).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT DISTINCT 'events_' || strftime(date_trunc('day', ts), '%m_%d_%Y_%H_%M_%S_%g') AS table_name, 'data/events/' || CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS VARCHAR) AS resource,
    CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT) AS snapshot_id FROM events""")
def version_names(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("created"), _day().alias("id")).distinct()
    rows = rows.select(ids.version_table(F.lit("events"), F.col("created")).alias("table_name"), ids.resource_name(F.lit("events"), F.col("id")).alias("resource"))
    return rows.withColumn("snapshot_id", ids.parse_resource(F.col("resource"))["snapshot_id"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS ordinal, event_type AS name, right(event_type, 5) AS short FROM events")
def enum_codec(spark, sf_dir):
    names = ["click", "error", "purchase", "signup", "view"]
    rows = _table(spark, sf_dir, "events").select("event_id", ids.ordinal(F.col("event_type"), names).alias("ordinal"), ids.short_id(F.col("event_type")).alias("short"))
    return rows.withColumn("name", ids.enum_name(F.col("ordinal"), names))


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def described_rows(spark, sf_dir):
    registry = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cache"), F.col("n_name").alias("table_name"))
    rows = model.described(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cache"), "c_custkey"), registry)
    return rows.groupBy(F.col("table_name").alias("nation")).agg(F.count("c_custkey").alias("customers"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 + 1000 AS BIGINT) AS tx_id FROM events WHERE event_type = 'purchase'")
def dense_ids(spark, sf_dir):
    return log.numbered(_table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id"), "event_id", 1000)


@query("SELECT user_id AS session, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS entries, ok AS committed FROM (SELECT user_id, bool_and(event_type <> 'error') OVER (PARTITION BY user_id) AS ok FROM events) GROUP BY user_id, ok")
def session_publish(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("cache"))
    ok = e.groupBy("session").agg(F.bool_and(F.col("cache") != "error").alias("committed"))
    return log.sessions(e.join(ok, "session"))


@query("""SELECT coalesce(a.k, b.k) AS id, coalesce(b.v, a.v) AS address, CASE WHEN a.k IS NULL THEN 'open' WHEN b.k IS NULL THEN 'close' WHEN a.v = b.v THEN 'keep' ELSE 'reopen' END AS action
    FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 3 <> 0) a
    FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'new' ELSE s_name END AS v FROM supplier WHERE s_suppkey % 4 <> 0) b ON a.k = b.k""")
def reconfigured_sinks(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("address"))
    new = s.where("id % 4 <> 0").withColumn("address", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("address")))
    return log.reconfigured(s.where("id % 3 <> 0"), new)


@query("SELECT event_type AS cluster, arg_min(CAST(user_id AS VARCHAR), (ts, CAST(user_id AS VARCHAR))) AS address FROM events GROUP BY event_type")
def first_registered(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return log.elected(e.select(F.col("event_type").alias("cluster"), F.col("user_id").cast("string").alias("address"), F.col("ts").alias("registered_at")))


# --- frontiers and gaps -----------------------------------------------------------------------------------------------

_IDS = "ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)"
_FRONTIER = "f AS (SELECT coalesce(max(id), -1) AS frontier FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS d FROM ids) WHERE d = -1)"


@query(f"WITH {_IDS}, {_FRONTIER} SELECT frontier FROM f")
def dense_frontier(spark, sf_dir):
    return frontier.frontier(_line_ids(spark, sf_dir))


@query(f"WITH {_IDS} SELECT r AS tx_id FROM (SELECT unnest(generate_series(0, (SELECT max(id) FROM ids))) AS r) WHERE r NOT IN (SELECT id FROM ids)")
def gap_list(spark, sf_dir):
    return frontier.gaps(_line_ids(spark, sf_dir))


@query(f"WITH {_IDS}, {_FRONTIER} SELECT id AS tx_id FROM ids, f WHERE id > frontier")
def sparse_tail(spark, sf_dir):
    return frontier.sparse_tail(_line_ids(spark, sf_dir))


_MERGED = """ids AS (SELECT DISTINCT id FROM (SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') WHERE id > 9),
  f AS (SELECT coalesce(max(id), 9) AS frontier FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS d FROM ids) WHERE d = 9)"""


@query(f"WITH {_MERGED} SELECT id AS tx_id, frontier AS dense FROM ids, f WHERE id > frontier")
def merge_compact(spark, sf_dir):
    a = _table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("tx_id"))
    b = _table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("tx_id"))
    dense, rest = frontier.merge_compact(a, b, 9)
    return rest.withColumn("dense", F.lit(dense).cast("long"))


_OFFSETS = "o AS (SELECT event_id % 4 AS topic_partition, event_id AS \"offset\", event_type <> 'error' AS committed FROM events)"


def _offsets(spark, sf_dir, open_type="error"):
    return _table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("topic_partition"), F.col("event_id").alias("offset"), (F.col("event_type") != open_type).alias("committed"))


@query(f"""WITH {_OFFSETS}, b AS (SELECT topic_partition AS p, min("offset") AS x FROM o WHERE NOT committed GROUP BY 1)
    SELECT topic_partition, max("offset") AS frontier FROM o LEFT JOIN b ON p = topic_partition WHERE x IS NULL OR "offset" < x GROUP BY 1""")
def offset_frontier(spark, sf_dir):
    return frontier.offset_frontier(_offsets(spark, sf_dir))


@query("""WITH s AS (SELECT event_id % 4 AS p, event_id AS o, event_type AS t FROM events),
    a AS (SELECT p, max(o) AS f FROM s WHERE o < (SELECT min(o) FROM s z WHERE z.p = s.p AND z.t = 'signup') GROUP BY p),
    b AS (SELECT p, max(o) AS f FROM s WHERE o < (SELECT min(o) FROM s z WHERE z.p = s.p AND z.t = 'error') GROUP BY p)
    SELECT a.p AS topic_partition, a.f AS frontier FROM a LEFT JOIN b USING (p) WHERE b.f IS NULL OR a.f <> b.f""")
def changed_offsets(spark, sf_dir):
    return frontier.changed_offsets(frontier.offset_frontier(_offsets(spark, sf_dir, "signup")), frontier.offset_frontier(_offsets(spark, sf_dir)))


@query("SELECT l_orderkey AS tx_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def uncommitted(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), "l_linenumber")
    return frontier.uncommitted(li, _orders(spark, sf_dir).where("status = 'F'").select("tx_id"))


@query("SELECT l_orderkey AS tx_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def is_committed(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), "l_linenumber")
    return frontier.committed(li, _orders(spark, sf_dir).where("status = 'F'").select("tx_id"))


@query(f"WITH {_IDS}, {_FRONTIER} SELECT DISTINCT l_orderkey AS tx_id, l_partkey AS key FROM lineitem, f WHERE l_orderkey <= frontier")
def dense_reads(spark, sf_dir):
    return frontier.dense_read(_lines(spark, sf_dir), -1).select("tx_id", "key").distinct()


@query("SELECT o_orderkey AS tx_id FROM orders WHERE o_orderkey > 500 OR (o_orderstatus = 'P')")
def clean_buffer(spark, sf_dir):
    return frontier.clean_buffer(_orders(spark, sf_dir).withColumn("in_progress", F.col("status") == "P"), 500, keep_in_progress=True).select("tx_id")


# --- conflicts and plans ----------------------------------------------------------------------------------------------

_SCOPE = "t AS (SELECT DISTINCT l_orderkey AS tx_id, 'part' AS cache, l_partkey AS key, l_orderkey % 4 AS reader_id FROM lineitem)"
_EDGES = "e AS (SELECT cache, key, tx_id, lag(tx_id) OVER (PARTITION BY cache, key ORDER BY tx_id) AS prev_tx FROM t)"


@query(f"WITH {_SCOPE}, {_EDGES} SELECT cache, key, tx_id, prev_tx FROM e WHERE prev_tx IS NOT NULL")
def dependency_edges(spark, sf_dir):
    return conflict.dependency_edges(_lines(spark, sf_dir).distinct())


@query(f"WITH {_SCOPE}, {_EDGES} SELECT tx_id, CAST(count(DISTINCT prev_tx) AS BIGINT) AS blockers FROM e GROUP BY tx_id")
def blocker_count(spark, sf_dir):
    return conflict.blockers(_lines(spark, sf_dir).distinct())


@query(f"WITH {_SCOPE}, {_EDGES} SELECT tx_id FROM e GROUP BY tx_id HAVING count(prev_tx) = 0")
def ready_set(spark, sf_dir):
    return conflict.ready(_lines(spark, sf_dir).distinct())


@query("SELECT o_orderkey AS tx_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS wave FROM orders")
def dependency_waves(spark, sf_dir):
    return conflict.waves_of_single_keys(_orders(spark, sf_dir))


_MULTI = """t AS (SELECT DISTINCT o_orderkey AS tx_id, o_orderkey % 4 AS reader_id, cache, key FROM
    (SELECT o_orderkey, 'customer' AS cache, o_custkey AS key FROM orders WHERE o_orderstatus = 'P' UNION ALL
     SELECT o_orderkey, 'part', l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')),
  e AS (SELECT DISTINCT tx_id, prev_tx FROM (SELECT tx_id, lag(tx_id) OVER (PARTITION BY cache, key ORDER BY tx_id) AS prev_tx FROM t) WHERE prev_tx IS NOT NULL)"""


def _multi(spark, sf_dir):
    o = _orders(spark, sf_dir).where("status = 'P'").select("tx_id", "reader_id", "cache", "key")
    parts = _lines(spark, sf_dir).select("tx_id", "cache", "key").join(o.select("tx_id", "reader_id"), "tx_id")
    return o.unionByName(parts)


def _whole(spark, sf_dir):
    """All orders with all their line items; a key may come twice, which closures and plans do not mind."""
    o = _orders(spark, sf_dir).select("tx_id", "reader_id", "cache", "key")
    return o.unionByName(_lines(spark, sf_dir).join(o.select("tx_id"), "tx_id", "left_semi"))


@query(f"""WITH {_SCOPE} SELECT DISTINCT tx_id FROM (SELECT tx_id, reader_id, min(reader_id) OVER w AS lo, max(reader_id) OVER w AS hi FROM t
    WINDOW w AS (PARTITION BY cache, key ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE lo <> reader_id OR hi <> reader_id""")
def reader_conflicts(spark, sf_dir):
    return conflict.reader_conflicts(_lines(spark, sf_dir).distinct())


@query("SELECT DISTINCT o_orderkey AS tx_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def touching_transactions(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("cache"), F.col("c_custkey").alias("key"))
    return conflict.touching(_orders(spark, sf_dir), keys)


@query("SELECT l_orderkey AS tx_id FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20))")
def contained_transactions(spark, sf_dir):
    keys = _table(spark, sf_dir, "part").where("p_size > 20").select(F.lit("part").alias("cache"), F.col("p_partkey").alias("key"))
    return conflict.contained(_lines(spark, sf_dir).distinct(), keys)


_PLAN = """live AS (SELECT o_orderkey AS tx_id, o_orderkey % 4 AS reader_id, o_custkey AS key, o_orderstatus = 'P' AND o_orderkey % 10 = 0 AS busy FROM orders WHERE o_orderstatus <> 'F'),
  p AS (SELECT *, min(reader_id) OVER w AS lo, max(reader_id) OVER w AS hi, coalesce(max(CAST(busy AS INTEGER)) OVER w, 0) AS b FROM live
    WINDOW w AS (PARTITION BY key ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  planned AS (SELECT tx_id, reader_id FROM p WHERE NOT busy AND b = 0 AND coalesce(lo, reader_id) = reader_id AND coalesce(hi, reader_id) = reader_id)"""


@query(f"WITH {_PLAN} SELECT tx_id, reader_id FROM planned")
def plan_commit(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    live = frontier.uncommitted(orders, orders.where("status = 'F'").select("tx_id"))
    return commit.plan_single_key(live, (F.col("status") == "P") & (F.col("tx_id") % 10 == 0))


@query(f"WITH {_PLAN} SELECT reader_id, CAST(count(*) AS BIGINT) AS planned, min(tx_id) AS first_tx, max(tx_id) AS last_tx FROM planned GROUP BY reader_id")
def plan_by_reader(spark, sf_dir):
    lists = commit.by_reader(plan_commit(spark, sf_dir), 1000)
    each = lists.select("reader_id", F.size("tx_ids").cast("long").alias("n"), F.get("tx_ids", F.lit(0)).alias("a"), F.element_at("tx_ids", -1).alias("b"))
    return each.groupBy("reader_id").agg(F.sum("n").alias("planned"), F.min("a").alias("first_tx"), F.max("b").alias("last_tx"))


_LIVE = """t AS (SELECT DISTINCT o_orderkey AS tx_id, o_orderkey % 2 AS reader_id, cache, key FROM
    (SELECT o_orderkey, 'customer' AS cache, o_custkey AS key FROM orders WHERE o_orderstatus <> 'F' UNION ALL
     SELECT o_orderkey, 'supplier', l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND l_returnflag = 'R')),
  e AS (SELECT DISTINCT tx_id, prev_tx FROM (SELECT tx_id, lag(tx_id) OVER (PARTITION BY cache, key ORDER BY tx_id) AS prev_tx FROM t) WHERE prev_tx IS NOT NULL),
  bad AS (SELECT tx_id FROM (SELECT tx_id, reader_id, min(reader_id) OVER w AS lo, max(reader_id) OVER w AS hi FROM t
    WINDOW w AS (PARTITION BY cache, key ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE lo <> reader_id OR hi <> reader_id
    UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 10 = 0)"""


def _live(spark, sf_dir):
    o = _orders(spark, sf_dir).where("status <> 'F'").withColumn("reader_id", F.col("tx_id") % 2)
    li = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("tx_id"), F.lit("supplier").alias("cache"), F.col("l_partkey").alias("key"))
    scope = o.select("tx_id", "cache", "key").unionByName(li.join(o.select("tx_id"), "tx_id", "left_semi")).distinct()
    busy = (F.col("status") == "P") & (F.col("tx_id") % 10 == 0)
    return scope, o.select("tx_id", "reader_id", busy.alias("in_progress"), F.lit(False).alias("lost"), F.lit(False).alias("orphan"))


@query(f"""WITH RECURSIVE {_LIVE}, blocked AS (SELECT tx_id FROM bad UNION SELECT e.tx_id FROM blocked b JOIN e ON e.prev_tx = b.tx_id)
    SELECT DISTINCT tx_id, reader_id FROM t WHERE tx_id NOT IN (SELECT tx_id FROM blocked)""")
def plan_commit_multikey(spark, sf_dir):
    return commit.plan(*_live(spark, sf_dir))


@query()
def plan_commit_whole(spark, sf_dir):
    """The plan of all live orders with all their line items; no SQL of it is registered."""
    o = _orders(spark, sf_dir).where("status <> 'F'").withColumn("reader_id", F.col("tx_id") % 2)
    scope = _whole(spark, sf_dir).join(o.select("tx_id"), "tx_id", "left_semi").select("tx_id", "cache", "key")
    busy = (F.col("status") == "P") & (F.col("tx_id") % 10 == 0)
    return commit.plan(scope, o.select("tx_id", "reader_id", busy.alias("in_progress"), F.lit(False).alias("lost"), F.lit(False).alias("orphan")))


# --- readers ----------------------------------------------------------------------------------------------------------

#: Every event is read once, every third a second time; reader 2 is lost, some records are orphans.
_READS = """r AS (SELECT event_id AS tx_id, CAST(user_id % 3 AS BIGINT) AS reader_id, event_id AS arrival, event_type = 'view' AS in_progress, event_type = 'error' AS orphan FROM events
  UNION ALL SELECT event_id, CAST((user_id + 1) % 3 AS BIGINT), event_id + 1000000000, false, false FROM events WHERE event_id % 3 = 0)"""
_LEVEL = "CASE WHEN orphan THEN 1 WHEN reader_id = 2 THEN 2 ELSE 3 END"


def _reads(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("tx_id"), (F.col("user_id") % 3).alias("reader_id"), F.col("event_id").alias("arrival"), (F.col("event_type") == "view").alias("in_progress"), (F.col("event_type") == "error").alias("orphan"))
    return a, _again(e)


def _again(e):
    return e.where("event_id % 3 = 0").select(F.col("event_id").alias("tx_id"), ((F.col("user_id") + 1) % 3).alias("reader_id"), (F.col("event_id") + 1000000000).alias("arrival"), F.lit(False).alias("in_progress"), F.lit(False).alias("orphan"))


def _lost(spark):
    return spark.range(2, 3).select(F.col("id").alias("reader_id"))


@query(f"WITH {_READS} SELECT tx_id, reader_id, level FROM (SELECT tx_id, reader_id, {_LEVEL} AS level, max({_LEVEL}) OVER (PARTITION BY tx_id) AS best FROM r) WHERE level = best")
def dedup_by_liveness(spark, sf_dir):
    a, b = _reads(spark, sf_dir)
    return readers.best_copies(readers.levels(a.unionByName(b), _lost(spark))).select("tx_id", "reader_id", "level")


@query(f"WITH {_READS} SELECT tx_id, reader_id, level FROM (SELECT tx_id, reader_id, {_LEVEL} AS level, row_number() OVER (PARTITION BY tx_id ORDER BY {_LEVEL} DESC, arrival) AS n FROM r) WHERE n = 1")
def first_copies(spark, sf_dir):
    a, b = _reads(spark, sf_dir)
    return readers.first_copies(readers.levels(a.unionByName(b), _lost(spark)))


@query("SELECT DISTINCT CAST(user_id % 3 AS BIGINT) AS reader_id FROM events WHERE event_id % 3 = 0 AND user_id % 3 = 2")
def dead_readers(spark, sf_dir):
    return readers.dead_readers(*_reads(spark, sf_dir), _lost(spark))


@query(f"""WITH {_READS}, live AS (SELECT DISTINCT tx_id FROM r WHERE reader_id <> 2 AND NOT orphan)
    SELECT tx_id, reader_id, arrival, in_progress AND NOT (reader_id = 2 AND tx_id IN (SELECT tx_id FROM live)) AS in_progress, orphan OR reader_id = 2 AS orphan FROM r""")
def orphaned_reads(spark, sf_dir):
    a, b = _reads(spark, sf_dir)
    return readers.orphaned(a.unionByName(b), _lost(spark))


@query(f"WITH {_READS} SELECT tx_id, reader_id, arrival, in_progress, orphan FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY arrival DESC) AS n FROM r) WHERE n = 1")
def ownership_transfer(spark, sf_dir):
    return readers.take_over(*_reads(spark, sf_dir))


@query("SELECT CAST(user_id % 3 AS BIGINT) AS reader_id, event_id AS tx_id FROM events WHERE event_id % 3 = 0")
def removals_at_owner(spark, sf_dir):
    a, b = _reads(spark, sf_dir)
    return readers.mark_committed(a, b)[1]


@query("SELECT user_id AS reader_id, max(ts) AS last_beat FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def lost_readers(spark, sf_dir):
    return readers.lost_readers(_table(spark, sf_dir, "events").select(F.col("user_id").alias("reader_id"), "ts"), 12 * 3600)


@query("SELECT user_id AS reader_id, arg_max(event_type, event_id) = 'view' AS stale FROM events GROUP BY user_id")
def stale_readers(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return readers.stale_readers(e.select(F.col("user_id").alias("reader_id"), F.col("event_id").alias("ts"), (F.col("event_type") != "view").alias("has_data")))


# --- applying ---------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS cache, user_id AS key, max(event_id) AS tx_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def lww_state(spark, sf_dir):
    return apply.latest(_events(spark, sf_dir)).drop("is_delete")


@query("SELECT 'user' AS cache, user_id AS key, max(event_id) AS tx_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def lww_live(spark, sf_dir):
    return apply.live(_events(spark, sf_dir).withColumn("cache", F.lit("user")))


@query("""SELECT 'user' AS cache, key, tx_id, value FROM (SELECT user_id AS key, max(event_id) AS tx_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events
    WHERE NOT (event_type = 'error' AND event_id < 300) GROUP BY user_id) WHERE t <> 'error'""")
def upsert_table(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("cache", F.lit("user"))
    current = apply.live(e.where("tx_id < 300 and not is_delete"))
    return apply.upsert(current, e.where("tx_id >= 300"))


@query("SELECT event_id AS tx_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'signup' AND event_id > 50)")
def commit_prefix(spark, sf_dir):
    e = _events(spark, sf_dir)
    return apply.successful_prefix(e.select("tx_id"), e.where("cache = 'signup' and tx_id > 50"))


@query("""SELECT tx_id FROM (SELECT event_id AS tx_id, max(CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS dead FROM events) WHERE dead = 0""")
def failure_closure(spark, sf_dir):
    e = _events(spark, sf_dir).select("tx_id", F.lit("user").alias("cache"), "key", ((F.col("cache") == "signup") & (F.col("tx_id") % 5 == 0)).alias("failed"))
    return apply.surviving_single_keys(e)


@query(f"""WITH RECURSIVE {_MULTI}, dead AS (SELECT tx_id FROM t WHERE tx_id % 50 = 0 UNION SELECT e.tx_id FROM dead d JOIN e ON e.prev_tx = d.tx_id)
    SELECT DISTINCT tx_id FROM t WHERE tx_id NOT IN (SELECT tx_id FROM dead)""")
def failure_closure_multikey(spark, sf_dir):
    scope = _multi(spark, sf_dir)
    return apply.surviving(scope, scope.where("tx_id % 50 = 0").select("tx_id"))


@query(f"WITH RECURSIVE {_MULTI}, dead AS (SELECT tx_id FROM t WHERE tx_id % 50 = 0 UNION SELECT e.tx_id FROM dead d JOIN e ON e.prev_tx = d.tx_id) SELECT DISTINCT tx_id FROM dead")
def blocked_closure(spark, sf_dir):
    scope = _multi(spark, sf_dir)
    return closure.closure(scope.where("tx_id % 50 = 0").select("tx_id"), scope)


@query()
def failure_closure_whole(spark, sf_dir):
    """What survives failures over whole tables; no SQL of it is registered."""
    scope = _whole(spark, sf_dir)
    return apply.surviving(scope, scope.where("tx_id % 5000 = 0").select("tx_id"))


@query()
def blocked_closure_whole(spark, sf_dir):
    scope = _whole(spark, sf_dir)
    return closure.closure(scope.where("tx_id % 5000 = 0").select("tx_id"), scope)


@query("SELECT event_id AS tx_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 500 AS BIGINT) AS batch FROM events WHERE event_type = 'purchase'")
def write_batches(spark, sf_dir):
    return apply.batches(_events(spark, sf_dir).where("cache = 'purchase'").select("tx_id"), "tx_id", 500)


@query("SELECT event_id AS tx_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ttl_alive(spark, sf_dir):
    return apply.alive(_events(spark, sf_dir).select("tx_id", "ts"), 7 * 86400).select("tx_id")


# --- repair -----------------------------------------------------------------------------------------------------------

_GAPS = f"{_IDS}, g AS (SELECT r AS tx_id FROM (SELECT unnest(generate_series(0, (SELECT max(id) FROM ids))) AS r) WHERE r NOT IN (SELECT id FROM ids))"


@query(f"WITH {_GAPS} SELECT tx_id, o_orderkey IS NOT NULL AS found, CAST(CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS caches FROM g LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = tx_id")
def gaps_resend_or_empty(spark, sf_dir):
    scope = F.array(F.struct(F.col("cache"), F.array("key").alias("keys")))
    records = _orders(spark, sf_dir).where("status <> 'P'").select("tx_id", scope.alias("scope"))
    out = reconcile.repair(frontier.gaps(_line_ids(spark, sf_dir)), records)
    return out.select("tx_id", "found", F.size("scope").cast("long").alias("caches"))


@query(f"WITH {_GAPS} SELECT CAST(tx_id % 4 AS INTEGER) AS topic_partition, min(tx_id) AS first_tx, CAST(count(*) AS BIGINT) AS missing FROM g GROUP BY 1")
def gaps_by_partition(spark, sf_dir):
    return reconcile.by_partition(frontier.gaps(_line_ids(spark, sf_dir)), ids.partition_of(F.col("tx_id"), 4))


@query("SELECT event_id % 4 AS topic_partition, min(event_id // 4) AS \"offset\" FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def seek_offset(spark, sf_dir):
    records = _table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("topic_partition"), F.floor(F.col("event_id") / 4).cast("long").alias("offset"), "ts")
    return reconcile.seek(records, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id AS tx_id FROM events WHERE event_id > 700 AND event_type = 'purchase'")
def commit_log_replay(spark, sf_dir):
    return reconcile.replay(_events(spark, sf_dir).where("cache = 'purchase'"), 700)


# --- snapshots --------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_TREE}, {_path_sql(_LAST)} SELECT snapshot_id, depth FROM path")
def snapshot_path(spark, sf_dir):
    return snapshots.path(_tree(spark, sf_dir), _LAST)


@query(f"WITH RECURSIVE {_TREE}, {_path_sql(_LAST)} SELECT snapshot_id, depth FROM path WHERE depth < (SELECT depth FROM path WHERE snapshot_id = 14)")
def snapshot_subpath(spark, sf_dir):
    return snapshots.sub_path(_tree(spark, sf_dir), 14, _LAST)


@query(f"WITH {_TREE} SELECT parent_id AS id, CAST(count(*) AS BIGINT) AS children FROM tree WHERE parent_id IS NOT NULL GROUP BY parent_id")
def snapshot_children(spark, sf_dir):
    return snapshots.child_counts(_tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_TREE}, {_VERSIONS}, {_path_sql(_LAST)}, {_newest_sql()} SELECT cache, key, snapshot_id, value FROM newest WHERE NOT is_delete")
def overlay_read(spark, sf_dir):
    return snapshots.overlay(_versions(spark, sf_dir), snapshots.path(_tree(spark, sf_dir), _LAST))


@query(f"WITH RECURSIVE {_TREE}, {_VERSIONS}, {_path_sql(18)}, {_newest_sql()} SELECT cache, key, snapshot_id, value FROM newest WHERE NOT is_delete AND key IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def overlay_bulk(spark, sf_dir):
    wanted = _table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("cache"), F.col("c_custkey").alias("key"))
    return snapshots.overlay_of_keys(_versions(spark, sf_dir), snapshots.path(_tree(spark, sf_dir), 18), wanted)


@query(f"WITH RECURSIVE {_TREE}, {_VERSIONS}, line AS (SELECT id AS snapshot_id, 13 - id AS depth FROM tree WHERE id BETWEEN 9 AND 13), {_newest_sql('line')} SELECT cache, CAST(100 AS BIGINT) AS snapshot_id, key, CAST(0 AS BIGINT) AS seq, value, is_delete FROM newest")
def snapshot_merge(spark, sf_dir):
    return snapshots.merge_versions(_versions(spark, sf_dir), snapshots.line_path(_tree(spark, sf_dir), 9, 13), 100)


@query(f"""WITH {_TREE} SELECT id, CASE WHEN parent_id BETWEEN 9 AND 13 THEN 100 ELSE parent_id END AS parent_id FROM tree WHERE id NOT BETWEEN 9 AND 13
    UNION ALL SELECT 100, parent_id FROM tree WHERE id = 9""")
def snapshot_tree_after_merge(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    no_merges = tree.limit(0).select("id", F.col("id").alias("replacement_id"))
    labels = tree.select(F.concat(F.lit("day"), F.col("id").cast("string")).alias("label"), "id")
    return snapshots.merge(tree, no_merges, labels, 9, 13, 100, _LAST)[0]


@query(f"WITH RECURSIVE {_TREE}, {_VERSIONS}, {_path_sql(_LAST)} SELECT DISTINCT cache, snapshot_id, depth FROM kv JOIN path USING (snapshot_id)")
def snapshots_by_cache(spark, sf_dir):
    return snapshots.catalog(_versions(spark, sf_dir), snapshots.path(_tree(spark, sf_dir), _LAST))


@query(f"WITH RECURSIVE {_TREE}, {_VERSIONS}, {_path_sql(_LAST)} SELECT DISTINCT cache, key FROM kv JOIN path USING (snapshot_id) WHERE depth < (SELECT depth FROM path WHERE snapshot_id = 21)")
def rollback_invalidated_keys(spark, sf_dir):
    return snapshots.changed_keys(_versions(spark, sf_dir), snapshots.sub_path(_tree(spark, sf_dir), 21, _LAST))


#: Days 15 to 17 were merged into day 18.
_NEWER = f"""live AS (SELECT id, CASE WHEN id = 18 THEN 14 ELSE parent_id END AS parent_id FROM tree WHERE id NOT BETWEEN 15 AND 17)"""


def _after_merge(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    live = tree.where("id not between 15 and 17").withColumn("parent_id", F.when(F.col("id") == 18, 14).otherwise(F.col("parent_id")))
    return live, tree.where("id between 15 and 17").select("id", F.lit(18).cast("long").alias("replacement_id"))


@query(f"WITH {_TREE}, {_NEWER} SELECT id FROM live WHERE id > 15")
def newer_than(spark, sf_dir):
    return snapshots.newer_than(*_after_merge(spark, sf_dir), 18)


@query(f"WITH {_TREE}, {_VERSIONS}, {_NEWER} SELECT cache, snapshot_id, key, seq, value, is_delete FROM kv WHERE snapshot_id IN (SELECT id FROM live WHERE id > 15)")
def incremental_rows(spark, sf_dir):
    newer = snapshots.newer_than(*_after_merge(spark, sf_dir), 18)
    return _versions(spark, sf_dir).join(newer.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi").select("cache", "snapshot_id", "key", "seq", "value", "is_delete")


@query()
def backup_manifest(spark, sf_dir):
    return backup.manifest(_versions(spark, sf_dir))


@query(f"WITH {_TREE} SELECT id FROM tree WHERE id % 5 = 0 OR id > 25")
def tree_difference(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return snapshots.tree_difference(tree.where("id % 5 <> 0"), tree.where("id <= 25"))


@query(f"WITH RECURSIVE {_TREE}, line AS (SELECT id AS snapshot_id, 13 - id AS depth FROM tree WHERE id BETWEEN 9 AND 13) SELECT snapshot_id, depth FROM line")
def snapshot_line(spark, sf_dir):
    return snapshots.line_path(_tree(spark, sf_dir), 9, 13)


@query(f"WITH {_TREE} SELECT id, 'day' || CAST(id AS VARCHAR) AS first_label, CAST(CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS labels FROM tree")
def snapshot_labels(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    name = lambda w: F.concat(F.lit(w), F.col("id").cast("string"))
    labels = tree.select(name("day").alias("label"), "id").union(tree.where("id % 7 = 0").select(name("week").alias("label"), "id"))
    return snapshots.labels_of(labels).select("id", F.get("labels", F.lit(0)).alias("first_label"), F.size("labels").cast("long").alias("labels"))


@query(f"WITH {_TREE} SELECT id, parent_id FROM tree UNION ALL SELECT 100, max(id) FROM tree")
def snapshot_created(spark, sf_dir):
    """A new head under the latest day, labelled, found by its label."""
    tree = _tree(spark, sf_dir)
    head = tree.agg(F.max("id")).first()[0]
    labels = snapshots.add_label(tree.select(F.concat(F.lit("day"), F.col("id").cast("string")).alias("label"), "id"), "latest", head)
    return snapshots.create(tree, snapshots.find(labels, "latest"), 100)


@query(f"WITH {_VERSIONS} SELECT cache, snapshot_id, CAST(count(*) AS BIGINT) AS \"rows\", CAST(sum(seq) AS BIGINT) AS seqs, CAST(count(*) FILTER (WHERE is_delete) AS BIGINT) AS deletes FROM kv GROUP BY 1, 2")
def backup_restored(spark, sf_dir):
    """A full backup of all versions, restored over a table that lost every second day and checked by its manifest."""
    kv, tree = _versions(spark, sf_dir), _tree(spark, sf_dir)
    path = _folder(spark, "backup")
    after = backup.full_backup(kv, tree, _LAST, 100, path)
    rows, _, _ = backup.restore_all(kv.where("snapshot_id % 2 = 0"), after, path, _KV, spark.range(0))
    return rows.groupBy("cache", "snapshot_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("seq").alias("seqs"), F.count_if("is_delete").alias("deletes"))


@query(f"WITH {_TREE}, {_VERSIONS} SELECT DISTINCT cache, key FROM kv WHERE snapshot_id = (SELECT max(id) FROM tree)")
def restore_invalidated_keys(spark, sf_dir):
    """Restoring a backup of all days but the last makes the keys of the last one stale."""
    kv, tree = _versions(spark, sf_dir), _tree(spark, sf_dir)
    path = _folder(spark, "backup")
    days = tree.where(F.col("id") < tree.agg(F.max("id")).first()[0])
    backup.export(kv, days, path, days)
    return backup.restore_all(kv, tree, path, _KV, spark.range(0))[2]


# --- the log, written and read ----------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nested_events(spark, sf_dir):
    return model.nested(_events(spark, sf_dir).withColumn("value", F.when(~F.col("is_delete"), F.col("value").cast("string"))))


@query("SELECT event_id AS tx_id, CAST(event_id % 8 AS INTEGER) AS topic_partition, event_type AS cache, user_id AS key FROM events")
def log_round_trip(spark, sf_dir):
    path = _folder(spark, "log")
    log.append_log(_nested_events(spark, sf_dir), path, 8)
    return log.read_log(spark, path).select("tx_id", "topic_partition", F.inline("scope")).select("tx_id", "topic_partition", "cache", F.explode("keys").alias("key"))


@query("SELECT event_id AS tx_id, CAST(event_id % 4 AS INTEGER) AS topic_partition FROM events WHERE event_id BETWEEN (SELECT max(event_id) // 3 FROM events) AND (SELECT max(event_id) // 2 FROM events)")
def log_copied(spark, sf_dir):
    """A third to a half of the log, copied to a replica's with other partitions."""
    path = _folder(spark, "log")
    log.append_log(_nested_events(spark, sf_dir), f"{path}/main", 8)
    last = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    log.copied(spark, f"{path}/main", f"{path}/replica", last // 3, last // 2, 4)
    return log.read_log(spark, f"{path}/replica").select("tx_id", "topic_partition")


@query("""SELECT 'local' AS sink, event_id AS tx_id, event_id AS stamp FROM events UNION ALL SELECT 'remote', event_id, NULL FROM events""")
def log_published(spark, sf_dir):
    """Every event sent to the own log, stamped with its id, to a remote one, and to one that fails and is suspended."""
    path = _folder(spark, "sinks")

    def broken(batch, batch_id):
        raise OSError("no such cluster")

    suspensions = log.Suspensions(spark, f"{path}/suspended")
    write = log.fan_out(log.log_sinks(f"{path}/local", {"remote": f"{path}/remote"}, 4) | {"broken": broken}, suspensions)
    events = _nested_events(spark, sf_dir)
    for batch in range(2):
        write(events.where(F.col("tx_id") % 2 == batch), batch)
    assert suspensions.now() == {"broken": 0}
    read = lambda s: spark.read.parquet(f"{path}/{s}").select(F.lit(s).alias("sink"), "tx_id", (F.unix_millis("timestamp") if s == "local" else F.lit(None).cast("long")).alias("stamp"))
    return read("local").union(read("remote"))


@query("SELECT event_id AS tx_id, user_id AS key FROM events WHERE event_type = 'purchase'")
def commit_log_whole(spark, sf_dir):
    """The older commit log: whole transactions, here those that purchases committed."""
    path = _folder(spark, "commits")
    log.commit_transactions(_nested_events(spark, sf_dir), _events(spark, sf_dir).where("cache = 'purchase'"), path, 4)
    return log.read_log(spark, path).select("tx_id", F.inline("scope")).select("tx_id", F.explode("keys").alias("key"))


@query("SELECT user_id % 3 AS reader_id, event_id AS tx_id, event_type AS cache FROM events WHERE event_type <> 'purchase'")
def resent_scopes(spark, sf_dir):
    buffer = _nested_events(spark, sf_dir).join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), (F.col("user_id") % 3).alias("reader_id")), "tx_id")
    out = log.resent(buffer, _events(spark, sf_dir).where("cache = 'purchase'"))
    return out.select("reader_id", "tx_id", F.inline("scope")).select("reader_id", "tx_id", "cache")


_APPLIED = """ids AS (SELECT DISTINCT event_id AS id FROM events), f AS (SELECT coalesce(max(id), -1) AS frontier FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS d FROM ids) WHERE d = -1)"""


#: Transactions of one log file, about.
_FILE = 1 << 18


def _applied(spark, sf_dir, blocked=None):
    """The log of all events in three turns, each of as many files as it takes, through the stream."""
    path = _folder(spark, "stream")
    files = -(-_table(spark, sf_dir, "events").count() // (3 * _FILE)) or 1
    log.append_log(_nested_events(spark, sf_dir).repartition(3 * files, "tx_id"), f"{path}/log", 1)
    applier = LogApplier(spark, f"{path}/state", blocked, compact=2)
    query = applier.start(log.stream_log(spark, f"{path}/log", files), f"{path}/check", available_now=True)
    query.awaitTermination()
    return applier.table()


@query(f"""WITH {_APPLIED} SELECT event_type AS cache, user_id AS key, max(event_id) AS tx_id, CAST(arg_max(value, event_id) AS VARCHAR) IS NOT NULL AS known FROM events, f
    WHERE event_id <= frontier AND event_type <> 'error' GROUP BY 1, 2""")
def log_applied(spark, sf_dir):
    """The table after the stream has applied the whole log, out of order as its files come."""
    return _applied(spark, sf_dir).select("cache", "key", "tx_id", F.col("value").isNotNull().alias("known"))


@query(f"""WITH {_APPLIED}, b AS (SELECT event_id, event_type, user_id, value, max(CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS late FROM events, f WHERE event_id <= frontier)
    SELECT event_type AS cache, user_id AS key, max(event_id) AS tx_id, CAST(arg_max(value, event_id) AS VARCHAR) IS NOT NULL AS known FROM b WHERE late = 0 AND event_type <> 'error' GROUP BY 1, 2""")
def log_planned(spark, sf_dir):
    """The same where some views are in progress: they and what depends on them wait."""
    out = _applied(spark, sf_dir, lambda scope: scope.where("cache = 'view' and tx_id % 50 = 0").select("tx_id"))
    return out.select("cache", "key", "tx_id", F.col("value").isNotNull().alias("known"))


# --- small rules over whole tables ------------------------------------------------------------------------------------


@query(f"WITH {_IDS} SELECT prev + 1 AS first, id - 1 AS last FROM (SELECT id, coalesce(lag(id) OVER (ORDER BY id), -1) AS prev FROM ids) WHERE id - prev > 1")
def gap_ranges(spark, sf_dir):
    return frontier.gap_ranges(_line_ids(spark, sf_dir)).select("first", "last")


@query("SELECT DISTINCT topic_partition FROM (SELECT event_id % 4 AS topic_partition FROM events UNION ALL SELECT user_id % 6 FROM events)")
def topic_partitions(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return frontier.topic_partitions(e.select((F.col("event_id") % 4).alias("topic_partition")), e.select((F.col("user_id") % 6).alias("topic_partition")))


@query("SELECT event_id % 4 AS topic_partition, max(event_id) FILTER (WHERE event_type <> 'error') >= max(event_id) AS alive FROM events GROUP BY 1")
def caught_up(spark, sf_dir):
    ends = _offsets(spark, sf_dir).groupBy("topic_partition").agg((F.max("offset") + 1).alias("end_offset"))
    return frontier.caught_up(_offsets(spark, sf_dir).where("committed"), ends)


@query("SELECT l_orderkey AS tx_id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def merged_ids(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return frontier.merge_ids(_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("tx_id")), o.select("tx_id"), o.where("status = 'P'").select("tx_id"))


@query("""WITH d AS (SELECT count(*) = 0 AS disjoint FROM (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
    SELECT DISTINCT 'customer' AS cache, o_custkey AS key, disjoint FROM orders, d""")
def scope_union(spark, sf_dir):
    o = _orders(spark, sf_dir)
    union, disjoint = conflict.add_to_scope(o.where("status <> 'O'"), o.where("status = 'O'"))
    return union.withColumn("disjoint", F.lit(disjoint))


@query("SELECT DISTINCT o_custkey AS reader_id FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def finally_dead(spark, sf_dir):
    """Customers as readers: out of order with a pending order, their finished ones orphans."""
    o = _orders(spark, sf_dir).select(F.col("key").alias("reader_id"), "status")
    return readers.finally_dead(o.where("status = 'P'").select("reader_id").distinct(), o.where("status = 'F'"))


@query("SELECT topic_partition, \"offset\" FROM (SELECT event_id % 8 AS topic_partition, event_id AS \"offset\" FROM events) WHERE topic_partition IN (SELECT user_id % 5 FROM events)")
def retained_partitions(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return readers.retained(e.select((F.col("event_id") % 8).alias("topic_partition"), F.col("event_id").alias("offset")), e.select((F.col("user_id") % 5).alias("topic_partition")))


@query("""SELECT reader_id, tx_id // 1000 AS chunk, CAST(count(*) AS BIGINT) AS handed, arg_min(tx_id, (late, tx_id)) AS first_tx, arg_max(tx_id, (late, tx_id)) AS last_tx FROM
    (SELECT o_orderkey % 4 AS reader_id, o_orderkey AS tx_id, o_orderstatus = 'P' AS late FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2""")
def joined_responses(spark, sf_dir):
    """Open orders' answer with that of pending ones behind it, list by list."""
    o = _orders(spark, sf_dir)
    lists = lambda s: commit.by_reader(o.where(f"status = '{s}'").select("tx_id", "reader_id"), 1000)
    out = commit.joined_responses(lists("O"), lists("P"))
    return out.select("reader_id", "chunk", F.size("tx_ids").cast("long").alias("handed"), F.get("tx_ids", F.lit(0)).alias("first_tx"), F.element_at("tx_ids", -1).alias("last_tx"))


@query(f"WITH {_GAPS} SELECT tx_id FROM g WHERE tx_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def gap_fillers(spark, sf_dir):
    scope = F.array(F.struct(F.col("cache"), F.array("key").alias("keys")))
    records = _orders(spark, sf_dir).where("status <> 'P'").select("tx_id", scope.alias("scope"))
    out = reconcile.repair(frontier.gaps(_line_ids(spark, sf_dir)), records)
    return out.where(reconcile.is_filler(F.col("scope"))).select("tx_id")


@query("SELECT event_id AS tx_id, event_type = 'error' AS deleted FROM events")
def row_tombstones(spark, sf_dir):
    """Errors leave no value: rows whose fields are all null are deletes; a mark in the first field is one, too."""
    e = _table(spark, sf_dir, "events")
    mark = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "TOMBSTONE")
    value = F.when(F.col("event_type") != "error", F.coalesce(F.col("value").cast("string"), F.lit("")))
    rows = e.select(F.col("event_id").alias("tx_id"), mark.alias("a"), value.alias("b"))
    return rows.select("tx_id", apply.tombstone(["a", "b"], "TOMBSTONE").alias("deleted"))


@query("SELECT event_id AS tx_id FROM events WHERE user_id % 2 = 0")
def main_origin(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("origin", F.when(F.col("key") % 2 == 0, "main").otherwise("replica"))
    return apply.main_origin(e).select("tx_id")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def ordered_fields(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"))
    return model.ordered_columns(rows, {"name": 1, "region": 2, "key": 0})


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '{\"s_name\":\"' || s_name || '\"}' END AS value FROM supplier")
def rebuilt_values(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("val"))
    return rows.select("key", model.rebuilt(rows, ["s_name"]).alias("value"))


_TICKS = "t AS (SELECT event_type, floor(epoch_us(ts) / 5000000) AS tick, count(*) AS n FROM events GROUP BY 1, 2), z AS (SELECT event_type, min(tick) AS a, max(tick) AS b FROM t GROUP BY 1)"
_RATE = "round(sum(n * pow(exp(-5 / (60.0 * {0})), b - tick) * CASE WHEN tick = a THEN 1 ELSE 1 - exp(-5 / (60.0 * {0})) END) / 5, 9) AS m{0}"


@query(f"WITH {_TICKS} SELECT event_type, {', '.join(_RATE.format(m) for m in (1, 5, 15))} FROM t JOIN z USING (event_type) GROUP BY event_type")
def moving_rates(spark, sf_dir):
    out = metrics.moving_rates(_table(spark, sf_dir, "events"), ["event_type"], "ts")
    return out.select("event_type", *(F.round(f"m{m}", 9).alias(f"m{m}") for m in (1, 5, 15)))


# --- metrics and workloads --------------------------------------------------------------------------------------------


@query("""SELECT user_id AS operation_id, max(event_id) FILTER (WHERE event_type = 'purchase') - max(event_id) FILTER (WHERE event_type = 'view') AS duration FROM events
    GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0 AND count(*) FILTER (WHERE event_type = 'view') > 0""")
def op_pairing_latency(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "START").when(F.col("event_type") == "purchase", "END")
    return metrics.pair(_table(spark, sf_dir, "events").select(F.col("user_id").alias("operation_id"), F.col("event_id").alias("time"), kind.alias("type")))


@query("""SELECT event_type, CAST(count(value) AS BIGINT) AS "count", max(value) AS "max", round(avg(value), 6) AS mean, min(value) AS "min", round(stddev_samp(value), 6) AS stddev,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.98), 6) AS p98, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type""")
def latency_histogram(spark, sf_dir):
    out = metrics.histogram(_table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ["mean", "stddev", *metrics.QUANTILES]})


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS \"count\", round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0), 9) AS mean_rate FROM events GROUP BY event_type")
def throughput_meter(spark, sf_dir):
    return metrics.meter(_table(spark, sf_dir, "events"), ["event_type"], "ts").withColumn("mean_rate", F.round("mean_rate", 9))


@query("SELECT event_type, epoch(time_bucket(INTERVAL 15 MINUTE, ts))::BIGINT AS window_start, CAST(count(*) AS BIGINT) AS \"count\", round(count(*) / 900.0, 9) AS rate FROM events GROUP BY 1, 2")
def window_rate(spark, sf_dir):
    out = metrics.window_rate(_table(spark, sf_dir, "events"), ["event_type"], "ts", 15)
    return out.select("event_type", F.unix_seconds("window_start").alias("window_start"), "count", F.round("rate", 9).alias("rate"))


@query("""WITH r AS (SELECT user_id % 7 AS stage, CAST(ts AS DATE) - DATE '2024-01-01' AS report, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY p90) - 1 AS k, count(*) OVER (PARTITION BY stage) AS reports FROM r)
    SELECT stage, CAST(reports AS BIGINT) AS reports, round(p90, 6) AS median_p90, p90 > 100 AS overloaded FROM n WHERE k = reports // 2 AND reports >= 5""")
def overload_stage(spark, sf_dir):
    reports = _table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("stage"), _day().alias("report"), F.col("value").alias("latency"))
    return metrics.overload(reports).withColumn("median_p90", F.round("median_p90", 6))


@query("SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def gauge_last(spark, sf_dir):
    return metrics.gauge(_table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS \"count\" FROM events GROUP BY event_type")
def counter_sum(spark, sf_dir):
    return metrics.counter(_table(spark, sf_dir, "events"), ["event_type"], F.col("user_id"))


#: Every line item is a payment of its order's customer to its supplier, whose account has a negative number; in cents.
_MOVES = """m AS (SELECT l_orderkey AS tx_id, o_custkey AS a, -l_suppkey AS b, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _moves(spark, sf_dir):
    return workload.payments(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"))


@query(f"WITH {_MOVES} SELECT tx_id, a AS from_account, b AS to_account, amount, a % 128 AS account_partition FROM m")
def transfers(spark, sf_dir):
    return _moves(spark, sf_dir)


@query(f"WITH {_MOVES} SELECT account, CAST(sum(change) AS BIGINT) AS balance, CAST(count(*) AS BIGINT) AS transactions FROM (SELECT a AS account, -amount AS change FROM m UNION ALL SELECT b, amount FROM m) GROUP BY account")
def account_balance(spark, sf_dir):
    return workload.balances(_moves(spark, sf_dir))


@query("SELECT o_orderkey AS tx_id, o_custkey AS from_account FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = orders.o_custkey)")
def without_oldest(spark, sf_dir):
    return workload.without_oldest(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("from_account"))).select("tx_id", "from_account")


@query("SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS entries, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def last_wins_map(spark, sf_dir):
    out = apply.last_wins_map(_table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "event_id")
    return out.select("user_id", F.size("entries").cast("long").alias("entries"), F.try_element_at("entries", F.lit("view")).alias("view"))


@query("""SELECT 'independent' AS shape, o_orderkey AS tx_id, o_orderkey AS key FROM orders UNION ALL SELECT 'pairs', o_orderkey, o_orderkey FROM orders
    UNION ALL SELECT 'pairs', o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'total', o_orderkey, 0 FROM orders""")
def workload_scopes(spark, sf_dir):
    tx = F.col("o_orderkey")
    shapes = {"independent": workload.independent(tx), "pairs": workload.dependent_pairs(tx), "total": workload.totally_dependent(tx)}
    each = F.array(*(F.struct(F.lit(n).alias("shape"), k.alias("keys")) for n, k in shapes.items()))
    return _table(spark, sf_dir, "orders").select(tx.alias("tx_id"), F.inline(each)).select("shape", "tx_id", F.explode("keys").alias("key"))


@query("SELECT event_id AS position, CAST(list_extract([0, 1, 3, 2, 7], CAST(event_id % 5 AS INTEGER) + 1) + 20 * (event_id // 5) AS BIGINT) AS tx_id FROM events")
def patterned_ids(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), workload.patterned(F.col("event_id"), [0, 1, 3, 2, 7]).alias("tx_id"))
