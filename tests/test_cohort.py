import pytest
from pyspark.sql import functions as F

from verdigris.operators import cohort, graph, shapes, stats
from verdigris.sources import readers, writers


def test_sequence_rules_are_tried_in_order(spark):
    rows = spark.createDataFrame([("T2 ADC map", None), ("ep2d", None), ("plain", 800.0), ("T2_HASTE", None), ("t1 vibe arterial", None), ("x", None)], "t string, b double")
    got = [r.c for r in rows.select(cohort.classify_sequence(F.col("t"), F.col("b")).alias("c")).collect()]
    assert got == ["ADC", "DWI", "DWI", "T2", "T1_ARTERIAL", "UNKNOWN"]


def test_phase_and_time(spark):
    row = spark.range(1).select(cohort.phase_of_folder(F.lit(" Fase-Tardia ")).alias("a"), cohort.explicit_phase(F.lit("portal delayed")).alias("b"), cohort.time_of_day(F.lit("010203.5")).alias("t"), cohort.time_of_day(F.lit("01")).alias("n")).first()
    assert (row.a, row.b, row.t, row.n) == ("t1_delayed", None, 3723.5, None)


def test_collapse_refuses_conflicts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "case_id string, v int")
    assert cohort.collapsed(rows, ["case_id"]).count() == 2
    assert cohort.conflicting_duplicates(rows, ["case_id"]).isEmpty()
    with pytest.raises(Exception, match="rows of one key differ"):
        cohort.collapsed(rows.union(spark.createDataFrame([("b", 3)], "case_id string, v int")), ["case_id"]).count()


def test_verdicts_have_three_states(spark):
    training = spark.createDataFrame([("anon-1", "anon-g1")], "case_id string, patient_group_id string")
    cases = spark.createDataFrame([("anon-1", None), ("anon-2", "anon-g1"), ("anon-3", None), ("blind-1", None)], "case_id string, patient_group_id string")
    got = {r.case_id: r.verdict for r in cohort.provenance_verdicts(cases, training).collect()}
    assert got == {"anon-1": "in_sample", "anon-2": "in_sample", "anon-3": "out_of_sample", "blind-1": "unknown"}
    named = spark.createDataFrame([("blind-1", "anon-1")], "id string, original string")
    assert {r.case_id: r.verdict for r in cohort.provenance_verdicts(cases, training, named).collect()}["blind-1"] == "in_sample"


def test_label_columns_are_found_at_any_depth(spark):
    rows = spark.createDataFrame([], "id string, meta struct<a:int,items:array<struct<Label:string>>>")
    assert cohort.label_columns(rows, ["label", "truth"]) == ["meta.items.Label"]


def test_graph_reads(spark):
    schema = "case_id string, dataset_id string, rag_class string, label string, modality string, source_format string, phase string, negative_subtype string, positive_subtype string, phenotype_tags array<string>, limitations array<string>, warnings array<string>"
    rows = spark.createDataFrame([("c1", "d", "negative", "negative", "MR", "nifti", "p", "normal", None, ["focal_fat", "simple_cyst"], ["short"], ["short"]), ("c2", "d", "positive", "positive", "MR", "dicom", "p", None, "hcc", None, [], None)], schema)
    links = graph.edges(rows)
    assert links.where("kind = 'HAS_LIMITATION'").count() == 1 and links.where("kind = 'CAN_MIMIC'").count() == 8
    assert [r.case_id for r in graph.case_context(links, rows, "normal", "focal_fat").collect()] == ["c1"]
    assert [r.case_id for r in graph.case_context(links, rows, "normal", None, matching_only=False).collect()] == ["c1", "c2"]
    assert [r.limitation for r in graph.limitations(links, "normal").collect()] == ["short"]


def test_quantile_definitions(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in range(43)], "g int, v double")
    got = {m: stats.quantile(rows, "v", 0.95, m, ["g"]).first()["quantile"] for m in ("linear", "nearest", "higher", "rounded", "truncated")}
    assert got == {"linear": pytest.approx(39.9), "nearest": 40.0, "higher": 40.0, "rounded": 40.0, "truncated": 39.0}


def test_robust_scale_falls_back(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 6 + [("a", 9.0)] + [("b", 2.0)] * 3, "g string, v double")
    got = {r.g: r.scale for r in stats.robust_scale(rows, "v", ["g"]).collect()}
    assert got["a"] > 0 and got["b"] is None


def test_runs_and_rolling(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 5, 6, 7, 0, 8])] + [("b", 0, 2.0)], "g string, i int, v double")
    runs = {r.g: r.longest_run for r in stats.longest_run(rows, F.col("v") >= 5, ["i"], ["g"]).collect()}
    best = {r.g: r.rolling_maximum for r in stats.rolling_maximum(rows, "v", ["i"], 3, ["g"]).collect()}
    assert runs == {"a": 3, "b": 0} and best == {"a": 6.0, "b": 2.0}


def test_components_touch_over_edges_not_corners(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 1), (0, 1, 2, 2), (0, 2, 3, 3), (0, 9, 9, 9)], "mask int, z int, y int, x int")
    assert shapes.connected_components(rows, "mask").select("component").distinct().count() == 4
    assert shapes.connected_components(rows, "mask", neighbours=26).select("component").distinct().count() == 2
    assert shapes.connected_components(rows, "mask", 2).count() == 2


def test_line_is_linear(spark):
    rows = spark.createDataFrame([(0, 1, 0, 0, i) for i in range(8)], "mask int, component int, z int, y int, x int")
    row = shapes.component_shapes(rows, ["mask", "component"]).first()
    assert row.linearity > 0.99 and row.bbox_fill == 1.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"case_id": "a", "current_label": "positive", "reviewer": "r", "phenotype_tags": ["x"]}\n\n')
    rows = readers.curation(spark, str(tmp_path / "in.jsonl"))
    assert rows.count() == 1
    rule = {r.rule for r in cohort.curation_violations(cohort.curation_rows(rows)).collect()}
    assert rule == {"tag_unknown"}
    (tmp_path / "bad.jsonl").write_text("[1, 2\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.curation(spark, str(tmp_path / "bad.jsonl")).collect()
    writers.csv(rows.select("case_id", "phenotype_tags", "notes"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["phenotype_tags"] == "x"
    with pytest.raises(Exception, match="(?i)exists"):
        writers.csv(rows, str(tmp_path / "csv"))


def test_workbook(spark, tmp_path):
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><t>tumor 1</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>d</t></is></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    rows = readers.workbook(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()
    assert [r.cells for r in rows] == [["id", "", "d"], ["7", "", "tumor 1"]]


def test_stream_counts_and_appends(spark, tmp_path):
    from verdigris.streaming import growing

    schema = spark.createDataFrame([], "case_id string, truth string, prediction string, status string").schema
    (tmp_path / "in").mkdir()
    for turn in (1, 2):
        (tmp_path / "in" / f"{turn}.json").write_text(f'{{"case_id": "{turn}", "truth": "positive", "prediction": "POSITIVA", "status": "decisive"}}\n')
        stream = growing.result_stream(spark, str(tmp_path / "in"), schema)
        growing.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == turn
    query = growing.running_counts(growing.result_stream(spark, str(tmp_path / "in"), schema), "truth").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").first().tp == 2
