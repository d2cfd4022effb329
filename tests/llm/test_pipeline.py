import zlib

import pytest

import corpus_pipeline
from verdigris.llm import queries
from verdigris.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((name, before, docs))
    return out


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns


def test_decisions_take_effect_and_clean_documents_stay(spark, stages):
    from tests.llm.test_decontaminate import brute as contaminated
    from tests.llm.test_neardup import brute as grouped

    by = {n: ({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for n, a, b in stages[:-1]}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity(stages[0][1], labels).collect()}
    assert set(by["toxicity"][1]) == {i for i, s in scores.items() if s < 0.5}
    before, after = by["near_duplicates"]
    assert set(after) == {i for i, _, _, kept in grouped(list(before.items())) if kept}
    before, after = by["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {i for i, (_, hits, _) in contaminated(list(before.items()), items).items() if not hits}
    before, after = by["pii"]
    assert set(before) == set(after) and all(len(r.text) == r.n_chars for r in after.values())
    assert any(before[i] != after[i].text for i in before)


def test_run_is_the_stages_one_after_another(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.drop("sequence_id", "offset").exceptAll(stages[-1][2].drop("sequence_id", "offset")).count() == 0
    assert rows.count() == stages[-1][2].count()


def test_queries_return_their_columns(spark):
    want = {
        "op1_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op2_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op3_topk": ["query_id", "rank", "vec_id", "score"],
        "op6_urlfilter": ["page_id", "host", "path", "rule", "verdict"],
        "op7_lmscore": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op8_pack": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op9_shard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    }
    assert {name: queries.QUERIES[name](spark, SF).columns for name in want} == want
    rows = queries.op10_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


def odd_documents(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (2, a + " more"), (None, a), (None, b), (3, None), (3, None), (4, ""), (5, " \n"), (6, "mail me@example.com or +44 20 7123 4567"), (7, "word " * 60_000 + "end"), (1, "another text under a known number")]
    return spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t), "mine", 1, [1], "k") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int, findings string, candidates int, bands array<int>, `key` string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_empties_repeats_and_clashing_columns(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd_documents(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None} and sum(r.start == 0 for r in rows) == 12
        assert stage(spark, docs.limit(0), SF).count() == 0
        return
    assert out.schema == docs.schema and all(r.findings == "mine" and r.candidates == 1 and r.bands == [1] and r.key == "k" for r in rows)
    assert stage(spark, docs.limit(0), SF).count() == 0
    texts = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:20]) for r in rows)
    if name == "near_duplicates":
        assert [i for i, _ in texts] == [-1, 1, 1, 3, 3, 4, 5, 6, 7]
    else:
        assert len(rows) == 12
    if name == "pii":
        own = next(r for r in rows if r.doc_id == 6)
        assert "7123" not in own.text and not any("me@" in str(v) or "7123" in str(v) for r in rows for v in r)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
