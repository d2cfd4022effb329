import random
import re

import duckdb
import pytest

from verdigris import catalog
from verdigris.operators import index, retrieval


@pytest.fixture
def corpus(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(50)] + ["the"] * 30
    docs = [(f"c{i}", " ".join(draw.choices(words, k=draw.randrange(0, 40)))) for i in range(400)] + [("empty", ""), ("none", None)]
    queries = [(i, " ".join(draw.choices(words, k=6))) for i in range(30)] + [(98, "unknown"), (99, None)]
    return spark.createDataFrame(docs, "chunk_id string, text string"), spark.createDataFrame(queries, "query_id int, query string")


@pytest.mark.parametrize("most", [200_000, 40])
def test_search_equals_the_plain_search(spark, corpus, tmp_path, monkeypatch, most):
    monkeypatch.setattr(index, "MOST_GAINS", most)
    docs, queries = corpus
    index.build(docs, f"file://{tmp_path}/index", parts=6)
    found = index.search(index.load(spark, f"file://{tmp_path}/index"), queries, 7)
    want = sorted(tuple(r) for r in retrieval.search(docs, queries, 7).collect())
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 150


def test_only_the_best_of_each_bucket_are_shuffled(spark, corpus, tmp_path):
    docs, queries = corpus
    index.build(docs, f"file://{tmp_path}/index", parts=6)
    held = index.load(spark, f"file://{tmp_path}/index")
    plan = index.search(held, queries, 7)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if re.search(r"\bExchange |WindowGroupLimit|FileScan", line)]
    assert [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line] == [1]
    assert "WindowGroupLimit" in lines[0] and "WindowGroupLimit" in lines[2] and "Bucketed: true" in plan
    # a second session's view of the same folder
    assert index.search(index.load(spark.newSession(), f"file://{tmp_path}/index"), queries, 1).count() == 30


def test_other_forms_are_refused(spark, corpus, tmp_path):
    index.build(corpus[0].limit(3), f"file://{tmp_path}/index", parts=2)
    other = spark.read.parquet(f"file://{tmp_path}/index/manifest").replace(index.SCHEMA, "other", ["schema"])
    other.write.parquet(f"file://{tmp_path}/other/manifest")
    with pytest.raises(ValueError, match="form"):
        index.load(spark, f"file://{tmp_path}/other")


def test_manifest_problems_of_odd_documents_equal_their_sql(spark, tmp_path):
    odd = [(k, None if k % 5 == 1 else "" if k % 5 == 2 else f"text {k}", None if k % 7 == 3 else "" if k % 7 == 4 else "s") for k in range(-130, 200)]
    odd += [(None, "text", "s"), *[(k, text, "s") for k in range(60, 130) for text in ("again", "again", None)]]  # repeated ids
    spark.createDataFrame(odd, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["manifest_problems"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["manifest_problems"](spark, str(tmp_path)).collect()) == want and len(want) > 600


def test_manifest_rules_do_not_depend_on_the_order_of_rows(spark):
    chunks = [("same", "x", "t", ["a"]), ("two", "x", "t", ["a"]), ("two", "y", "t", ["a"]), ("entries", "x", "t", ["a"]), ("none", None, "t", ["a"]), ("one_none", None, "t", ["a"]), ("alone", None, None, []), (None, "x", "", None)]
    entries = [("same", "x"), ("two", "x"), ("entries", "x"), ("entries", None), ("none", None), ("one_none", "x"), ("gone", None), (None, "x")]
    want = [("alone", "no_categories"), ("alone", "no_title"), ("alone", "not_in_manifest"), ("entries", "hash_differs"), ("entries", "id_repeated"), ("gone", "chunk_missing")]
    want += [("one_none", "hash_differs"), ("two", "hash_differs"), ("two", "id_repeated"), ("~", "chunk_missing"), ("~", "no_categories"), ("~", "no_title"), ("~", "not_in_manifest")]
    for step in (1, -1):
        own = spark.createDataFrame(chunks[::step], "chunk_id string, sha256 string, title string, categories array<string>").coalesce(1)
        entry = spark.createDataFrame(entries[::step], "chunk_id string, sha256 string").coalesce(1)
        assert sorted((r.chunk_id or "~", r.rule) for r in index.manifest_problems(own, entry, ("title", "categories")).collect()) == want
        with pytest.raises(ValueError, match="chunks and manifest differ"):
            index.loaded(own.selectExpr("*", *[f"'x' as {c}" for c in ("doc_id", "section", "text", "priority", "url")]), entry)
