"""Queries without SQL read all rows of their tables."""

from verdigris import catalog
from verdigris.operators import protocol
from verdigris.plans import modelling, protocols

SF = "/root/testdata/sf0.001"


def test_reports_and_components_of_all_rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = catalog.QUERIES["extracted_reports"](spark, SF)
    assert got.count() == events.count() and got.exceptAll(got.dropDuplicates(["event_id"])).isEmpty()
    users = {r[0] for r in events.where("user_id is not null").select("user_id").distinct().collect()}
    shapes = {r.mask for r in catalog.QUERIES["component_shapes"](spark, SF).select("mask").collect()}
    points = events.selectExpr("user_id as mask", "event_id % 7 z", "event_id * 3 % 5 y", "event_id * 5 % 11 x").distinct().collect()
    expected = {}
    for m in users:
        left, found = {(r.z, r.y, r.x) for r in points if r.mask == m}, []
        while left:
            todo, part = [left.pop()], 0
            while todo:
                p = todo.pop()
                part += 1
                near = {q for q in left if 1 <= sum(abs(a - b) for a, b in zip(p, q)) <= 2 and max(abs(a - b) for a, b in zip(p, q)) == 1}
                left -= near
                todo += near
            found.append(part)
        expected[m] = sorted(found)
    rows = catalog.QUERIES["component_labels"](spark, SF).groupBy("mask", "component").count().collect()
    labels = {}
    for r in rows:
        labels.setdefault(r.mask, []).append(r["count"])
    assert {m: sorted(v) for m, v in labels.items()} == {m: k for m, v in expected.items() if (k := [n for n in v if n >= 2])}
    assert shapes == {m for m, v in expected.items() if max(v) >= 4}


def test_all_negatives_can_be_backgrounds(spark, monkeypatch):
    given = []
    plan = protocol.sampling_plan
    monkeypatch.setattr(protocol, "sampling_plan", lambda *a: given.append(a[0]) or plan(*a))
    rows = catalog.QUERIES["sampling_plan"](spark, SF).collect()
    negative = protocols.cohort(spark, SF).where("truth = 'negative'")
    assert given[0].count() == negative.count() > 40
    assert len({r.background_case_id for r in rows}) == min(len(rows), negative.count())


def test_nested_folds_take_all_vectors(spark):
    rows = modelling._instances(spark, SF)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert {r.instance for r in rows.collect()} == {r.vec_id for r in vectors.collect()}
    assert {r.label for r in rows.select("label").distinct().collect()} == {0.0, 1.0}
    assert rows.groupBy("case_id").agg({"label": "min"}).join(rows, "case_id").where("label <> `min(label)`").isEmpty()
