"""Schemas of the tables, and the ways between nested scopes, long rows and typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGES = "tx_id bigint, seq bigint, cache string, key bigint, value string, is_delete boolean"
SCOPE = "array<struct<cache:string,keys:array<bigint>>>"
LOG = f"tx_id bigint, topic_partition int, offset bigint, scope {SCOPE}, `values` array<array<string>>"
VERSIONS = "cache string, snapshot_id bigint, key bigint, seq bigint, value string, is_delete boolean"
TREE = "id bigint, parent_id bigint"

#: Reserved columns of a table: the key, and the whole value where it is not spread over columns.
KEY, VALUE = "key", "val"

#: Value types of the source system -> column types; anything else is kept as bytes.
COLUMN_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "decimal": T.DecimalType(38, 18), "bytes": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "enum": T.IntegerType(), "uuid": T.StringType(),
}


def table_schema(fields: dict[str, str]) -> T.StructType:
    """A table's schema from field names and value types, with the reserved columns added where missing."""
    named = {KEY: "long", **fields} | ({} if VALUE in fields else {VALUE: "bytes"})
    return T.StructType([T.StructField(n, COLUMN_TYPES.get(t, T.BinaryType())) for n, t in named.items()])


def ordered_columns(rows: DataFrame, index: dict[str, int]) -> DataFrame:
    """`rows` with its fields in the order of their index, as a descriptor lists them."""
    return rows.select(*sorted(index, key=lambda name: index[name]))


def needs_serialization(kind: T.DataType) -> bool:
    """Is a value of this type stored as bytes? Numbers, strings and dates are not; booleans, as in the source, are."""
    return not isinstance(kind, T.NumericType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType | T.NullType)


def scope_long(changes: DataFrame) -> DataFrame:
    """tx_id, cache, key, once for each."""
    return changes.select("tx_id", "cache", "key").distinct()


def nested(changes: DataFrame) -> DataFrame:
    """tx_id, scope, values: caches in order, keys and values of a cache aligned by one sort."""
    row = F.struct("seq", "key", "value")
    changes = changes.repartition("tx_id")  # both groupings keep to it
    per_cache = changes.groupBy("tx_id", "cache").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    per_tx = per_cache.groupBy("tx_id").agg(F.sort_array(F.collect_list(F.struct("cache", "rows"))).alias("caches"))
    scope = F.transform("caches", lambda c: F.struct(c["cache"].alias("cache"), F.transform(c["rows"], lambda r: r["key"]).alias("keys")))
    values = F.transform("caches", lambda c: F.transform(c["rows"], lambda r: r["value"]))
    return per_tx.select("tx_id", scope.alias("scope"), values.alias("values"))


def unnested(log: DataFrame) -> DataFrame:
    """tx_id, cache, key, seq, value of each entry; keys without a value, and values without a key, end their list."""
    pairs = log.select("tx_id", F.inline(F.arrays_zip(F.col("scope").alias("s"), F.col("values").alias("v"))))
    pairs = pairs.where("s is not null and v is not null")
    n = F.least(F.size("s.keys"), F.size("v"))
    zipped = F.arrays_zip(F.slice("s.keys", F.lit(1), n).alias("key"), F.slice("v", F.lit(1), n).alias("value"))
    return pairs.select("tx_id", F.col("s.cache").alias("cache"), F.posexplode(zipped).alias("seq", "kv")).select("tx_id", "cache", "kv.key", F.col("seq").cast("long").alias("seq"), "kv.value")


def bare(log: DataFrame) -> DataFrame:
    """tx_id of the rows of a log that `unnested` takes no entry from."""
    pairs = F.arrays_zip(F.col("scope").alias("s"), F.col("values").alias("v"))
    held = F.exists(pairs, lambda p: F.coalesce((F.size(p["s"]["keys"]) > 0) & (F.size(p["v"]) > 0), F.lit(False)))
    return log.where(~F.coalesce(held, F.lit(False))).select("tx_id")


def spread(rows: DataFrame, key: str, value: str, schema: str) -> DataFrame:
    """The key and the fields of a JSON value as columns; all null where key or value is."""
    parsed = F.when(F.col(key).isNotNull(), F.from_json(value, schema))
    return rows.select(F.when(F.col(value).isNotNull(), F.col(key)).alias(key), parsed.alias("_v")).select(key, "_v.*")


def rebuilt(rows: DataFrame, fields: list[str]) -> Column:
    """The value of a row: `val` where present, else the fields as one."""
    return F.coalesce(F.col(VALUE).cast("string"), F.to_json(F.struct(*fields)))


def lookup(rows: DataFrame, column: str, keys: list) -> DataFrame:
    """Rows with one of a few literal keys; the filter reaches the scan."""
    return rows.where(F.col(column).isin(keys))


def bulk_lookup(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows with one of many keys, a table with a column of the same name."""
    return rows.join(keys.select(column).distinct(), column, "left_semi")


def described(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """`rows` joined with their cache's descriptor (cache, table_name); an unknown cache is an error."""
    out = rows.join(registry, "cache", "left")
    known = F.assert_true(F.col("table_name").isNotNull(), F.concat(F.lit("no descriptor of cache "), F.coalesce("cache", F.lit("null"))))
    return out.withColumn("_known", known).where("_known is null").drop("_known")
