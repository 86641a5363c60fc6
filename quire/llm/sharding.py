"""Sharding by jump consistent hashing: a stable key and the shard count decide, no ring table is kept.

One more shard takes rows only into itself, and only about 1 / (n + 1) of them. Slots are gapless from 0 in each shard, in
order of doc_id, then text_crc32, then size. A null doc_id is the key 0 and sorts first; a null text has size 1 and the crc32 of nothing (0);
repeated rows get slots of their own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import mix, pick, width

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to shards - 1) of each uint64 key; all keys step together until each has jumped past the end."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keys = np.array(keys, np.uint64)
    out = np.zeros(len(keys), np.int64)
    nxt = np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(going):
            out[going] = nxt[going]
            keys[going] = keys[going] * np.uint64(2862933555777941757) + np.uint64(1)
            part = (keys[going] >> np.uint64(33)).astype(np.float64) + 1.0
            nxt[going] = ((out[going] + 1) * (float(1 << 31) / part)).astype(np.int64)
            going = going[nxt[going] < shards]
    return out.astype(np.int32)


#: A doc_id that so many of the quantiles are is hot: its rows are parted by the crc32 of their texts, into PARTS.
HOT, PARTS = 8, 256


def _placed(rows: DataFrame, shards: int, cuts: list[int], hot: list[int]) -> DataFrame:
    """rows (doc_id, text_crc32 among them) with shard, grown_shard and bucket. Buckets follow the order of doc_id and crc32: how many of the sorted cuts are at or
    below the key (null: none, in a bucket before all others), then for a bucket of one hot key the part of its crc32."""
    edges, single = np.array(cuts, np.int64), np.array(hot, np.int64)

    def place(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index("doc_id"))
            ids = pa.compute.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = mix(ids.view(np.uint64))
            null = column.is_null().to_numpy(zero_copy_only=False)
            bucket = np.where(null, 0, np.searchsorted(edges, ids, "right") + 1)
            part = np.where(null | np.isin(ids, single), b.column(b.schema.get_field_index("text_crc32")).to_numpy() // (2**32 // PARTS), 0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(jump(keys, shards)), pa.array(jump(keys, shards + 1)), pa.array((bucket * PARTS + part).astype(np.int32))],
                names=[*b.schema.names, "shard", "grown_shard", "bucket"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", shard int, grown_shard int, bucket int"
    return rows.mapInArrow(place, schema)


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots are ranks within a shard, so a plain window would put a sixteenth of all rows in one task. Instead the key's range is
    cut at approximate quantiles (and hot keys, and rows without one, by the crc32 of their texts); ranks are taken within (shard, bucket) and shifted by
    the counts of lower buckets, of which there are shards x (2 x cuts + PARTS x hot keys), at most two million.
    """
    base = pick(docs, key, text).select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keys = base.select("doc_id")
    n = min(4096, 2 * width(keys))
    found = [int(c) for c in keys.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)]
    hot = sorted(c for c, k in Counter(found).items() if k >= HOT)
    # a hot key has a bucket of its own
    cuts = sorted({*found, *(min(c, 2**63 - 2) + 1 for c in hot)})
    below = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        _placed(base.select("doc_id", "text_crc32"), shards, cuts, hot).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("shift"))
    )
    inner = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    ranked = _placed(base, shards, cuts, hot).withColumn("rank", F.row_number().over(inner) - 1)
    return ranked.join(F.broadcast(shift), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot"), "grown_shard",
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _jump_sql(shards: int, name: str) -> str:
    """Recursive steps of the jump for every row of keyed(r, key): name(r, shard)."""
    return f"""{name}_steps AS (
  SELECT r, key AS k, 0::BIGINT AS b, 0::BIGINT AS j FROM keyed
  UNION ALL
  SELECT r, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592::UHUGEINT) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, j, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k2 FROM {name}_steps WHERE j < {shards})
), {name} AS (SELECT r, max(b) AS shard FROM {name}_steps GROUP BY r)"""


def _crc_sql() -> str:
    """The 256 steps of a byte in crc32 (reversed polynomial 0xEDB88320), from its rule."""
    step = "SELECT i, i::UBIGINT AS x FROM range(256) r(i)"
    for _ in range(8):
        step = f"SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, {0xEDB88320}::UBIGINT) ELSE x >> 1 END AS x FROM ({step})"
    return f"SELECT list(x ORDER BY i) AS steps_ FROM ({step})"


_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::UBIGINT)),
  lambda c, b: xor(c >> 8, list_extract(steps_, (xor(c, b) & 255)::BIGINT + 1))), 4294967295::UBIGINT)::BIGINT"""

ORACLE_SQL = f"""WITH RECURSIVE byte_steps AS MATERIALIZED ({_crc_sql()}),
texts AS (SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
rows_ AS MATERIALIZED (SELECT r, doc_id, size, {_CRC} AS text_crc32 FROM texts, byte_steps),
m0 AS (
  SELECT r, (CASE WHEN doc_id < 0 THEN 18446744073709551616::UHUGEINT - CAST(-doc_id AS UHUGEINT) ELSE CAST(coalesce(doc_id, 0) AS UHUGEINT) END
             + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM rows_
), m1 AS (SELECT r, xor(x, x // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS x FROM m0),
m2 AS (SELECT r, xor(x, x // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS x FROM m1),
keyed AS (SELECT r, xor(x, x // 2147483648::UHUGEINT) AS key FROM m2),
{_jump_sql(16, "now")}, {_jump_sql(17, "then_")}
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM (SELECT doc_id, size, 'key' AS law, CAST(now.shard AS INTEGER) AS shard, CAST(then_.shard AS INTEGER) AS grown_shard, text_crc32
      FROM rows_ JOIN now USING (r) JOIN then_ USING (r))"""
