"""Importance resampling towards a target distribution: hashed features, log-ratio weights, Gumbel keys, exact distributed selection.

Every document gets the mean log ratio of its features' shares in the target and in the corpus,
and a Gumbel term from its id, so that the highest scores are a draw without replacement in
proportion to the weights. Which rows are drawn is found by radix selection: histograms of one
digit of the key at a time narrow down the last drawn key; no pass sorts or moves rows. Only the
drawn rows are sorted by range and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, binary_offsets, discard, free_name, lean_memory, map_arrow, materialize, small_batches
from .decontaminate import words_of

#: Bits of a digit of the selection: a pass brings at most that power of two of counts to the driver.
DIGIT_BITS = 12
SIGN = 1 << 63
_COUNTED = "bucket bigint, n bigint"
_WEIGHED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def feature_buckets(text: bytes, width: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text, and the bucket of each run of 1 to ``width`` of them: its bytes' crc32 modulo ``buckets``."""
    words = words_of(text)
    parts = []
    for n in range(1, min(width, len(words)) + 1):
        runs = words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n))))
        parts.append(np.fromiter(map(crc32, runs), np.int64, len(words) - n + 1) % buckets)
    return len(words), np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    lean_memory()
    for batch in batches:
        data, offsets = binary_offsets(batch.column(column))
        yield batch, (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def bucket_counts(rows: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks add up their own rows, so that at most ``buckets`` rows leave each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, 0):
            for text in texts:
                total += np.bincount(feature_buckets(text, width, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], schema=arrow_schema(_COUNTED))

    counted = map_arrow(small_batches(rows).select(F.col("text").cast("binary").alias("text")), count, _COUNTED)
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed share in the target and in the corpus, rounded down."""
    buckets, over, under = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    ratios = ((int(target[b]) + 1) * over / ((int(corpus[b]) + 1) * under) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weighed(docs: DataFrame, gains: np.ndarray, width: int) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 1):
            words, features, weights = [], [], []
            for text in texts:
                n, found = feature_buckets(text, width, len(gains))
                words.append(n)
                features.append(len(found))
                weights.append(int(gains[found].sum()) // len(found) if len(found) else 0)
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], schema=arrow_schema(_WEIGHED))

    return map_arrow(small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), weigh, _WEIGHED)


def gumbel(seed: int, key: Column) -> Column:
    """1000 times a standard Gumbel value, rounded down, from the first 32 bits of sha256(seed:key). A null key is the word "null"."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.floor(-1000 * F.log(-F.log(unit))).cast("bigint")


def kth_key(rows: DataFrame, parts: list[Column], k: int) -> list[int]:
    """The k-th smallest (from 1) of the keys that the ``parts`` (bigint, not null) make up, the first part weighing most.

    Radix selection: of the rows that agree with what is known of the key so far, the counts of
    the next ``DIGIT_BITS`` bits say which value the k-th row has there and how many rows come
    before. A part's common leading bits take no pass: its least and greatest value say them.
    """
    known: list[int] = []
    for part in parts:
        # with the sign bit turned over, the order of the bits is that of the numbers
        bits = part.bitwiseXOR(F.lit(-SIGN).cast("bigint"))
        low, high = (v + SIGN for v in rows.agg(F.min(part), F.max(part)).first())
        digits = -(-(low ^ high).bit_length() // DIGIT_BITS)
        value = low >> digits * DIGIT_BITS
        for d in reversed(range(digits)):
            digit = F.shiftrightunsigned(bits, d * DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("bigint"))
            for at, n in sorted(tuple(r) for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()):
                if k <= n:
                    break
                k -= n
            value = value << DIGIT_BITS | at
            rows = rows.where(digit == at)
        known.append(value - SIGN)
    return known


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, width: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """A draw of floor(percent * N / 100) of the N documents of at least ``least_words`` words, in proportion to how much more their features belong to the target.

    Words are runs of ASCII letters or digits and of all other characters, A-Z lower-cased; features
    are runs of 1 to ``width`` words, hashed into ``buckets``. Returns for every row of ``docs`` (doc_id,
    text; of ``target`` only the text is read) doc_id, n_features, weight (the mean gain of its
    features, rounded down), score (weight and a Gumbel term from seed and doc_id) and rank, from
    1 in order of descending score, then doc_id; null for rows that are not drawn.

    Texts are read twice, for the counts and for the weights; ``buckets`` numbers go to the driver
    and back. The weights are stored, four numbers a row, and selection reads those.

    Cases: null or empty texts have no features, weight 0 and are never drawn (unless ``least_words`` is 0);
    an empty target or corpus gives the gains of its smoothed counts; rows that repeat a doc_id are
    each a document, their order by n_features and then by their place in the stored table; null
    doc_ids share one Gumbel term and come last among equal scores; an empty table gives no rows.
    """
    gains = bucket_gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    scores = _weighed(docs, gains, width).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    scores = materialize(scores.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    parts = [-F.col("score"), F.col("doc_id").isNull().cast("bigint"), F.coalesce("doc_id", F.lit(0).cast("bigint")), F.col("n_features"), F.col("row")]
    able = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = percent * scores.where(able).count() // 100
    if drawn == 0:
        return scores.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    last = kth_key(scores.where(able), parts, drawn)
    key = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
    taken = able & (key <= F.struct(*[F.lit(v).cast("bigint").alias(f"k{i}") for i, v in enumerate(last)]))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(scores.where(taken).repartitionByRange(ranges, *parts).withColumn("part", F.spark_partition_id()), "resampling-drawn")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*parts))
    ranked = placed.join(F.broadcast(starts), "part").select(*columns, (F.col("before") + inside).cast("bigint").alias("rank"))
    ranked = materialize(ranked, "resampling-ranked")
    discard(placed)
    return ranked.unionByName(scores.where(~taken).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def sample(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents themselves, with all their columns and a column ``rank`` (a free name); options as in ``resampled``.

    Rows that repeat a doc_id are all kept if one of them is drawn; null doc_ids are not kept.
    """
    name = free_name(docs, "rank")
    chosen = resampled(docs, target, **options).where("rank is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__drawn")).agg(F.min("rank").alias(name))
    return docs.join(chosen, docs["doc_id"] == chosen["__drawn"]).drop("__drawn")
