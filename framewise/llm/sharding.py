"""Sharding through fixed virtual slots.

Records are hashed into thousands of slots; bytes are summed per slot; a versioned table maps slots
to shards and is stored, and edited, not rebuilt, when shards must be rebalanced or added. Rows never
move between slots, so moving data means moving whole slots.

A record is an id with its text; of equal records each copy has its own number and so its own slot.
An id that a third of all rows have, or none at all, is spread by its texts, and a record that many
rows repeat by its copies: equal texts are not kept together. Equal records are counted before the
shuffle and become rows again behind it.

Everything is DataFrame expressions. What is gathered into one row is the slot table, whose size is
the number of slots, a constant. Rows of the input are shuffled without their texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import AT_ONCE, copies_of, hex_int, shared_dir, text_or_empty, written

N_SLOTS = 4096


def virtual_slot(record: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a record: from a hash of the string that names it."""
    return (hex_int(F.md5(record), 8) % n_slots).cast("int")


def record_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.octet_length(text_or_empty(text_col)) + 1).cast("long")


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0 of the map: slots dealt in turn. Columns version, vslot, shard."""
    return spark.range(n_slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard")
    )


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has rows, from columns vslot and size. Sums are partial before the shuffle."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The map's next version, in which the shards 0 to n_shards - 1 hold nearly equal bytes.

    Slots are looked at from the largest down. A slot stays where it is while its shard stays within
    the mean; otherwise it moves to the shard that holds least. Slots of shards that are no longer
    there move as well. The whole edit is one fold over the slot table (n_slots rows, a constant).
    Returns version, vslot, shard, moved, bytes, n_rows.
    """
    slots = slot_map.join(sizes, "vslot", "left").select(
        "version",
        F.struct(
            F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
            (-F.col("vslot")).alias("order"),
            "shard",
            F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        ).alias("s"),
    )
    one = slots.agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list("s"), asc=False).alias("slots"),
        (F.sum("s.bytes") / F.lit(n_shards)).alias("mean"),
    )
    init = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards")
    )

    def place(acc: Column, s: Column) -> Column:
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        home = F.when((s["shard"] >= 0) & (s["shard"] < n_shards), F.get(acc["loads"], s["shard"]))
        to = F.when(home + s["bytes"] <= F.col("mean"), s["shard"]).otherwise(least)
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == to, v + s["bytes"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.array_append(acc["shards"], to).alias("shards"))

    placed = one.select(
        (F.col("version") + 1).alias("version"),
        F.explode(F.arrays_zip("slots", F.aggregate("slots", init, place)["shards"].alias("to"))).alias("z"),
    )
    return placed.select(
        "version",
        (-F.col("z.slots.order")).cast("int").alias("vslot"),
        F.col("z.to").cast("int").alias("shard"),
        (F.col("z.to") != F.col("z.slots.shard")).alias("moved"),
        F.col("z.slots.bytes").alias("bytes"),
        F.col("z.slots.n_rows").alias("n_rows"),
    )


def latest_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The map of the highest version stored under path (version=1, version=2, …); None if there is none."""
    try:
        maps = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    top = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == top).select("version", "vslot", "shard")


def edited_map(spark: SparkSession, sizes: DataFrame, n_shards: int, path: str, n_slots: int = N_SLOTS) -> DataFrame:
    """The next version of the map stored under path, stored beside the others. A version is never written twice.

    It is written aside and gets its name when it is whole, so a writer that dies leaves nothing that
    stands in the way of the next; of two at once one ends in an error.
    """
    before = latest_map(spark, path)
    version = 1 if before is None else before.first()["version"] + 1
    new = rebalanced(first_map(spark, n_shards, n_slots) if before is None else before, sizes, n_shards)
    aside = f"{path}/_{uuid.uuid4().hex}"
    new.drop("version").coalesce(1).write.parquet(aside)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(f"{path}/version={version}")) or not files.rename(at(aside), at(f"{path}/version={version}")):
        raise RuntimeError(f"version {version} of the map was made by someone else")
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def sharded(
    docs: DataFrame, n_shards: int = 16, key_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None
) -> DataFrame:
    """Every row of docs with its shard and its place in that shard, under the law `bytes`.

    The map is the next version of the one stored under map_path; without map_path, a first one in a
    folder of its own. Returns key_col, size, text_crc32, shard, slot (place of the row in its shard,
    gapless from 0: the rows of lower virtual slots of that shard come first), virtual_slot and
    map_version. Null texts count as empty; null keys are a key; repeated rows are rows of their own,
    spread by number (which of them is which does not matter, as they are equal); equal texts of
    different keys are spread like others; very long texts count whole, and a text above a shard's
    share leaves shards unequal; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.encode(text_or_empty(text_col), "UTF-8"))
    records = docs.select(F.col(key_col).alias("key"), record_size(text_col).alias("size"), crc.alias("crc"))
    counted = written(records.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n")), "shard-records")
    name = F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), "crc", "size", "copy")
    rows = copies_of(counted, AT_ONCE).withColumn("vslot", virtual_slot(name, n_slots)).select("key", "size", "crc", "copy", "vslot")
    path = map_path or f"{shared_dir(spark)}/framewise-tables/slot-map-{uuid.uuid4().hex}"
    slot_map = edited_map(spark, slot_sizes(rows), n_shards, path, n_slots)
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.withColumn("start", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    placed = rows.withColumn("at", F.row_number().over(W.partitionBy("vslot").orderBy("key", "crc", "size", "copy")))
    # The map has n_slots rows whatever the input is.
    return placed.join(F.broadcast(starts.select("version", "vslot", "shard", "start")), "vslot").select(
        F.col("key").alias(key_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
        F.col("vslot").alias("virtual_slot"),
        F.col("version").alias("map_version"),
    )


#: DuckDB twin of sharded() over documents with 16 shards: CRC-32 by its table, the map as a recursion.
SQL = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
h AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, bits),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM h),
d AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32 || '|' || size || '|' || copy), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS vslot FROM n),
z AS (SELECT CAST(s.i AS INTEGER) AS vslot, coalesce(sum(size), 0)::BIGINT AS bytes, count(size) AS n_rows FROM range(4096) s(i) LEFT JOIN d ON d.vslot = s.i GROUP BY s.i),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, vslot) AS k, sum(bytes) OVER () / 16 AS mean FROM z),
f AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS vslot, CAST(NULL AS INTEGER) AS shard, list_transform(range(16), lambda i: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT k, vslot, shard, list_transform(loads, lambda v, i: CASE WHEN i = shard + 1 THEN v + bytes ELSE v END) FROM (
    SELECT o.k, o.vslot, o.bytes, f.loads, CAST(CASE WHEN f.loads[o.vslot % 16 + 1] + o.bytes <= o.mean THEN o.vslot % 16 ELSE list_position(f.loads, list_min(f.loads)) - 1 END AS INTEGER) AS shard
    FROM f JOIN o ON o.k = f.k + 1)),
m AS (SELECT vslot, shard, coalesce(sum(n_rows) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f JOIN z USING (vslot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(start + row_number() OVER (PARTITION BY d.vslot ORDER BY doc_id NULLS FIRST, text_crc32, size, copy) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, d.vslot AS virtual_slot, 1 AS map_version
FROM d JOIN m ON d.vslot = m.vslot
"""
