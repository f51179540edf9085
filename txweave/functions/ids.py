"""Column functions: partitions of transactions, names of versions and resources, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_of(tx_id: Column, partitions: int) -> Column:
    """The log partition of a transaction id: the remainder of the exclusive or of its halves, as a signed 32-bit
    number, so it is negative for a negative hash."""
    half = tx_id.bitwiseXOR(F.shiftrightunsigned(tx_id, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    signed = F.when(half >= 1 << 31, half - (1 << 32)).otherwise(half)
    return (signed % partitions).cast("int")


def version_table(cache: Column, created: Column) -> Column:
    """cache_MM_dd_yyyy_HH_mm_ss_SSS in the session's time zone, UTC by convention."""
    return F.concat_ws("_", cache, F.date_format(created, "MM_dd_yyyy_HH_mm_ss_SSS"))


def resource_name(cache: Column, snapshot_id: Column) -> Column:
    return F.concat_ws("/", F.lit("data"), cache, snapshot_id.cast("string"))


def is_data_resource(name: Column) -> Column:
    return F.replace(name, F.lit("\\"), F.lit("/")).startswith("data/")


def parse_resource(name: Column) -> Column:
    """struct<cache, snapshot_id> of data/<cache>/<snapshot>; null for names of another form."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    fits = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "data")
    return F.when(fits, F.struct(F.get(parts, F.lit(1)).alias("cache"), F.get(parts, F.lit(2)).try_cast("long").alias("snapshot_id")))


def default_label(snapshot_id: Column) -> Column:
    return snapshot_id.cast("string")


def short_id(name: Column) -> Column:
    return F.right(name, F.lit(5))


def ordinal(value: Column, names: list[str]) -> Column:
    """Place of a name in an enumeration, from 0; null for unknown names."""
    at = F.array_position(F.array(*(F.lit(n) for n in names)), value)
    return F.when(at > 0, (at - 1).cast("int"))


def enum_name(place: Column, names: list[str]) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), place)


def encode(value: Column) -> Column:
    """A nested value as bytes of JSON."""
    return F.encode(F.to_json(value), "UTF-8")


def decode(data: Column, schema: str) -> Column:
    return F.from_json(F.decode(data, "UTF-8"), schema)


def checksum(data: Column) -> Column:
    return F.crc32(data)
