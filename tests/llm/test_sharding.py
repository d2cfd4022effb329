import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.llm import sharding


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_places_have_no_gaps_and_growth_moves_only_into_the_new_shard(spark, monkeypatch, per_task):
    monkeypatch.setattr(sharding, "ROWS_PER_TASK", per_task)
    docs = [(k, f"text {k % 50} é") for k in range(3000)] + [(5000, None), (5001, ""), (None, "x"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"shard": F.lit("x"), "cell": F.lit(1), "size": F.lit(0)})
    rows = sharding.sharded(df).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"key"}
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and 60 < len(own) < 220
    assert all(r.grown_shard in (r.shard, 24) for r in rows) and 60 < sum(r.grown_shard == 24 for r in rows) < 220
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in rows) == want
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1


def test_weights_are_kept(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.sharded(df, 3, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert abs(counts[0] / 30_000 - 1 / 8) < 0.01 and abs(counts[2] / 30_000 - 5 / 8) < 0.01
    moved = sharding.sharded(df, 3, [1.0, 2.0, 5.0]).where("grown_shard <> shard and grown_shard <> 3").count()
    assert moved == 0


def test_empty_bad_weights_and_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.sharded(df).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(df, 2, [1.0])
    with pytest.raises(ValueError):
        sharding.sharded(df, 2, [1.0, 0.0])
    full = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(full, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    placed = sharding.sharded(full, 4)
    assert back.join(placed, ["doc_id", "shard"]).count() == 100
