"""Shards by weighted rendezvous hashing of stable record keys, with gapless places in every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows that one ordering task numbers, about; a shard with more is numbered by several tasks.
ROWS_PER_TASK = 500_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score -weight / ln(u) is highest, u being a hash of key and shard in (0, 1).

    One more shard changes no score of the others, so keys move only into it, and each shard
    gets keys in proportion to its weight. Equal weights compare the hashes themselves, which
    order alike. Ties go to the smaller shard. A null key is hashed as the word "null".
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and one at least")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    even = len(set(weights)) == 1

    def score(i: int) -> Column:
        raw = F.xxhash64(name, F.lit(i))
        if even:
            return raw
        unit = (F.shiftrightunsigned(raw, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.lit(-float(weights[i])) / F.log(unit)

    return -F.greatest(*[F.struct(score(i).alias("score"), F.lit(-i).alias("back")) for i in range(len(weights))])["back"] if len(weights) > 1 else F.lit(0)


def sharded(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """Shard, place in it, and the shard under one more shard of the first's weight, for every row.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot (from 0 without gaps in
    each shard) and grown_shard; the law is ``key``: doc_id and the number of shards decide.

    Places come in two steps, so that no task orders a whole shard: rows are cut into cells by
    a hash of their key, as many as the row count asks for, the cells' counts give each one its
    first place, and rows are numbered inside cells.

    Cases: a null text has no bytes and crc32 0; null doc_ids are one key; rows that repeat a
    doc_id share its shard and have places of their own; an empty table gives no rows.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    key = F.col("doc_id")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(key.cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")).select(
        "*", rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"), rendezvous(F.col("doc_id"), [*weights, weights[0]]).cast("int").alias("grown_shard")
    )
    rows = materialize(rows, "shard-rows")
    cells = max(1, -(-rows.count() // (shards * ROWS_PER_TASK)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", F.lit("cell")), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").count()
    before = F.expr("sum(count) over (partition by shard order by cell rows between unbounded preceding and 1 preceding)")
    first = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.expr("row_number() over (partition by shard, cell order by doc_id, text_crc32, size)")
    return rows.withColumn("place", place).join(first, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, weights: Sequence[float] | None = None) -> None:
    """Write all rows as Parquet, one folder ``shard=N`` for each shard; a row's folder follows from its key alone."""
    weights = list(weights or [1.0] * shards)
    docs.withColumn("shard", rendezvous(F.col("doc_id"), weights).cast("int")).write.partitionBy("shard").parquet(path)
