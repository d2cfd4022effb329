import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import lexical, queries


def terms(text):
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())]


def brute(docs, asked, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    items = defaultdict(Counter)
    for item, text in asked:
        items[item].update(terms(text))
    out = []
    for item, wanted in items.items():
        found = []
        for doc_id, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in wanted.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, place + 1, f[3], -f[0]) for place, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "shard", "query"), [(0, 1 << 9, 1 << 20), (1, 1 << 12, 1 << 11), (2, 1, 1 << 20)])
def test_equals_brute_force(spark, seed, shard, query):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "the", "x-y", "ñ1"]
    weights = [1 / (1 + k) for k in range(len(vocabulary))]
    text = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    copy = text(12)
    docs = [(i, text(draw.randrange(1, 30))) for i in draw.sample(range(-300, 300), 300)] + [(1000 + i, copy) for i in range(60)]
    docs += [(None, copy), (None, text(5)), (7000, None), (7001, ""), (7002, "--"), (1003, copy), (-(2**63), text(9)), (2**63 - 1, text(9)), (7003, text(5000))]
    draw.shuffle(docs)
    asked = [(i, text(draw.randrange(1, 12))) for i in range(25)] + [(30, copy), (31, None), (32, "unknown"), (0, "the the Été"), (None, "w0 w1")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"term": F.lit("x"), "shard": F.lit(1)}).repartition(3)
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    index = lexical.materialize(lexical.shard_rows(df, shard), "test-index")
    got = lexical.search_index(index, items, 5, query_bytes=query)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, asked, 5)


def test_stored_index_and_plain_search_agree(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 5} " * (1 + i % 3)) for i in range(200)], "doc_id bigint, text string")
    asked = spark.createDataFrame([("q", "b3 c1 a"), ("r", "c4")], "name string, words string")
    lexical.build_index(docs, f"file://{tmp_path}/index", 1 << 10)
    index = lexical.open_index(spark, f"file://{tmp_path}/index")
    kept = sorted(tuple(r) for r in lexical.search_index(index, asked, 9, "name", "words").collect())
    assert kept == sorted(tuple(r) for r in lexical.ranked_search(docs, asked, 9, "name", "words").collect()) and len(kept) == 18


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    items, nothing = spark.createDataFrame([(1, "a")], "item_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    for d, q in ((none, items), (docs, nothing), (none, nothing), (spark.createDataFrame([(1, None)], docs.schema), items)):
        assert lexical.ranked_search(d, q).count() == 0


def test_variable_length_numbers():
    draw = random.Random(1)
    values = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**35, 2**62] + [draw.randrange(1 << draw.randrange(1, 63)) for _ in range(500)], np.int64)
    data, begins = lexical.varint(values)
    assert (lexical.unvarint(data) == values).all() and begins[-1] == len(data)
    assert (lexical.unvarint(data[begins[3] : begins[9]]) == values[3:9]).all()
    assert len(lexical.unvarint(b"")) == 0 and lexical.varint(np.zeros(0, np.int64))[0] == b""


def test_equals_its_sql(spark):
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    want = con.execute(queries.OP11_SQL).fetchall()
    got = [tuple(r) for r in queries.op11_search(spark, base).collect()]
    assert len(want) > 0 and sorted(got) == sorted(want)
