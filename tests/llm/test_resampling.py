import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.llm import queries, resampling


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def features(text, width):
    w = words(text)
    return [crc32(b" ".join(w[i : i + n])) for n in range(1, width + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, width, buckets):
    s, t = (Counter(f % buckets for _, x in rows for f in features(x, width)) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, (key, text) in enumerate(docs):
        f = features(text, width)
        weight = sum(gain(x % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text)), i])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("seed", "width", "percent"), [(0, 1, 10), (1, 2, 35), (2, 3, 100)])
def test_equals_brute_force(spark, monkeypatch, seed, width, percent):
    monkeypatch.setattr(resampling, "DIGIT_BITS", 3)
    draw = random.Random(seed)
    vocabulary = ["la", "Tion", "Über", "x1", "ñandú", "of", "der", "1999", "ça"] + [f"w{k}" for k in range(40)]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, k=n))
    docs = [(i, text(draw.randrange(40))) for i in range(300)]
    docs += [(None, None), (None, text(30)), (400, ""), (401, "--- !!"), (-(2**63), text(25)), (2**63 - 1, text(25)), (402, text(20_000))]
    copy = text(30)
    docs += [(500, copy)] * 90 + [(500, text(21)) for _ in range(5)]  # rows that repeat id and text, and the id alone
    target = [(0, text(12) + " Über Über"), (1, None), (2, "ça ça")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"weight": F.lit("x"), "rank": F.lit(1), "row": F.lit(2), "part": F.lit(0)}).repartition(7)
    got = resampling.resampled(df, spark.createDataFrame(target, "item_id bigint, text string"), percent, 20, width, 97)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, percent, 20, width, 97)


def test_kth_key(spark):
    draw = random.Random(5)
    rows = [(draw.choice([-(2**63), -5, 0, 7, 2**63 - 1, draw.randrange(-(2**62), 2**62)]), draw.randrange(4), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    for k in (1, 2, 57, 399, 400):
        assert tuple(resampling.kth_key(df, [F.col("a"), F.col("b"), F.col("c")], k)) == sorted(rows)[k - 1]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resampled(none, docs).count() == 0
    assert [r["rank"] for r in resampling.resampled(docs, none).orderBy("doc_id").collect()] == [None, None]
    assert [r["rank"] for r in resampling.resampled(docs, none, percent=100).orderBy("doc_id").collect()] == [1, None]


def test_sample_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} " * 20, "x") for i in range(50)], "doc_id bigint, text string, Rank string")
    got = resampling.sample(docs, docs, percent=20)
    assert got.columns == ["doc_id", "text", "Rank", "rank_"] and sorted(r["rank_"] for r in got.collect()) == list(range(1, 11))


def test_equals_its_sql(spark):
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    want = con.execute(queries.OP13_SQL).fetchall()
    got = [tuple(r) for r in queries.op13_resample(spark, base).collect()]
    assert len(got) == len(want) and sorted(got, key=repr) == sorted(want, key=repr)
