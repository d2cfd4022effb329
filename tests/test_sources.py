import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import gates, reports
from verdigris.operators.protocol import canonical_sha256
from verdigris.sources import manifests, readers, writers
from verdigris.streaming import growing


def test_files_pages_and_hashes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.nii.gz").write_bytes(b"1")
    (tmp_path / "a" / "x.nii.txt").write_bytes(b"1")
    (tmp_path / "p.html").write_bytes("café".encode("latin-1"))
    (tmp_path / "q.html").write_bytes("café".encode())
    assert [r.path.rsplit("/", 1)[1] for r in readers.nifti_files(spark, str(tmp_path)).collect()] == ["x.nii.gz"]
    assert {r.html for r in readers.pages(spark, str(tmp_path)).collect()} == {"café"}
    assert {r.sha256 for r in readers.content_hashes(spark, str(tmp_path), "*.gz").collect()} == {hashlib.sha256(b"1").hexdigest()}


def test_archives_and_subjects(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("sub/a.txt", "x")
        book.writestr("../b.txt", "xy")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    assert {(r.member, r["size"], r.safe) for r in readers.archive_members(spark, str(tmp_path / "a.zip")).collect()} == {("sub/a.txt", 1, True), ("../b.txt", 2, False)}
    rows = spark.createDataFrame([(1, " Tumor left"), (1, "other"), (2, "no tumor"), (3, None)], "s int, d string")
    assert {(r.s, r.positive) for r in readers.subject_labels(rows, "s", "d").collect()} == {(1, True), (2, False), (3, None)}


def test_registry_and_sinks(spark, tmp_path):
    row = {"case_id": "c1", "dataset_id": "d", "phenotype_tags": ["a"], "metadata": {"k": "v"}}
    (tmp_path / "r.jsonl").write_text(json.dumps(row) + "\n\n")
    found = readers.registry(spark, str(tmp_path / "r.jsonl")).first()
    assert found.case_id == "c1" and found.phenotype_tags == ["a"] and found.metadata == {"k": "v"} and found.label is None
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "z int, a string")
    writers.json_lines(rows, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"a","z":1}', '{"a":"b","z":2}']
    writers.run_bundle({"x": rows, "y": rows.limit(1)}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "x")).count() == 2 and spark.read.parquet(str(tmp_path / "run" / "y")).count() == 1
    assert writers.markdown(spark.createDataFrame([(0.5, 3)], "rate double, n int"), {"rate": "Rate", "n": "Cases"}, "T") == "# T\n\n| | |\n|---|---:|\n| Rate | 50.0% |\n| Cases | 3 |\n"
    path = str(tmp_path / "done")
    writers.append_pending(rows.limit(1), path, ["z"])
    writers.append_pending(rows, path, ["z"], spark.read.parquet(path))
    writers.append_pending(rows, path, ["z"], spark.read.parquet(path))
    assert sorted(r.z for r in spark.read.parquet(path).collect()) == [1, 2]


def test_streams_keep_one_row_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "t": "2024-01-01T00:00:00"}\n{"k": 1, "t": "2024-01-01T00:01:00"}\n{"k": 2, "t": "2024-01-01T00:00:00"}\n')
    rows = growing.result_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "k int, t timestamp").schema)
    growing.append(growing.once_per_key(rows, "k", "t"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_parts_of_texts_and_expanded_answers(spark):
    got = spark.createDataFrame([("A one. B two!\n\nC", )], "t string").select(T.paragraphs(F.col("t")).alias("p"), T.sentences(F.col("t")).alias("s")).first()
    assert got.p == ["A one. B two!", "C"] and got.s == ["A one.", "B two!", "C"]
    rows = spark.createDataFrame([("POSITIVA", "alta", True, " seen "), ("NEGATIVA", "alta", True, "x")], "state string, confidence string, suspicious boolean, evidence string")
    (full,) = reports.expanded(reports.compact_violations(rows)).collect()
    assert full.summary == "seen" and full.signals == ["seen"] and full.human_review


def test_endpoints_refuse_other_subtypes(spark):
    rows = spark.createDataFrame([("hcc",), (None,)], "s string")
    assert [r.e for r in rows.select(gates.endpoint(F.col("s")).alias("e")).collect()] == ["positive", None]
    with pytest.raises(Exception, match="unknown subtype"):
        spark.createDataFrame([("new",)], "s string").select(gates.endpoint(F.col("s")).alias("e")).collect()


def write(path, value):
    path.write_text(json.dumps(value))


def test_dataset_manifest(spark, tmp_path):
    case = {"case_id": "c1", "label": "positive", "inference": {"volume": "c1/v.nii", "organ_mask": "c1/m.nii"}, "ground_truth": {"lesion_mask": "c1/l.nii"}}
    (tmp_path / "m.yaml").write_text("datasets:\n  - {name: d, format: nifti, root: data, labels_manifest: l.json}\n")
    write(tmp_path / "l.json", {"cases": [case]})
    (row,) = manifests.dataset_manifest(spark, str(tmp_path / "m.yaml")).collect()
    assert (row.dataset, row.case_id, row.label, row.format) == ("d", "c1", "positive", "NIFTI") and row.volume == f"{tmp_path}/data/c1/v.nii" and row.dicom_dir is None
    bad = [[case, case], [{**case, "label": "maybe"}], [{**case, "inference": {**case["inference"], "label": "x"}}], [{**case, "inference": {"volume": "../v.nii", "organ_mask": "m"}}], [{**case, "inference": {"volume": "v"}}], []]
    for cases in bad:
        write(tmp_path / "l.json", {"cases": cases})
        with pytest.raises(ValueError):
            manifests.dataset_manifest(spark, str(tmp_path / "m.yaml"))


def freeze(root, rows, **more):
    text = "".join(json.dumps(r) + "\n" for r in rows)
    (root / "oof_predictions.jsonl").write_text(text)
    body = {"oof_predictions_sha256": hashlib.sha256(text.encode()).hexdigest(), "held_out_labels_used_for_fit_or_threshold": False, **more}
    write(root / "prediction_freeze.json", {**body, "prediction_signature": canonical_sha256(body)})


def test_frozen_predictions(spark, tmp_path):
    freeze(tmp_path, [{"case_id": "a", "score": 0.5}, {"case_id": "b", "score": 1.0}])
    assert manifests.frozen_predictions(spark, str(tmp_path), "case_id string, score double").count() == 2
    (tmp_path / "oof_predictions.jsonl").write_text("{}\n")
    with pytest.raises(ValueError, match="changed"):
        manifests.frozen_predictions(spark, str(tmp_path), "case_id string")
    freeze(tmp_path, [{"case_id": "a", "label": 1}])
    with pytest.raises(ValueError, match="truth"):
        manifests.frozen_predictions(spark, str(tmp_path), "case_id string")
    freeze(tmp_path, [{"case_id": "a"}], held_out_labels_used_for_fit_or_threshold=True)
    with pytest.raises(ValueError, match="held-out"):
        manifests.frozen_predictions(spark, str(tmp_path), "case_id string")
    write(tmp_path / "prediction_freeze.json", {"prediction_signature": "x"})
    with pytest.raises(ValueError, match="signature"):
        manifests.frozen_predictions(spark, str(tmp_path), "case_id string")


def test_json_lines_name_file_and_line(spark, tmp_path):
    lines = [f'{{"id": {i}, "name": "n{i}"}}' for i in range(500)]
    lines[0] = "\ufeff" + lines[0]
    lines[7], lines[100], lines[333], lines[499] = "   ", "[1, 2]", '{"id": "x"}', '{"id": 1'
    (tmp_path / "a b.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "c.jsonl").write_text('{"id": 1}\r\n"text"\r\n{"id": 1}}\n{"id": 1}, {"id": 2}\n{}], [\nnull\n')
    (tmp_path / "empty.jsonl").write_text("\n \n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines_read = readers.numbered_lines(spark, f"file://{tmp_path}")
        assert lines_read.rdd.getNumPartitions() > 10
        good, bad = readers.json_records(spark, f"file://{tmp_path}", "id bigint, name string")
        said = sorted((r["file"].rsplit("/", 1)[1].replace("%20", " "), r["line"], r["reason"]) for r in bad.collect())
        assert said == [("a b.jsonl", 101, "no_object"), ("a b.jsonl", 334, "wrong_type"), ("a b.jsonl", 500, "invalid_json"), ("c.jsonl", 2, "no_object"), *[("c.jsonl", k, "invalid_json") for k in (3, 4, 5)], ("c.jsonl", 6, "no_object"), ("empty.jsonl", 0, "empty_file")]
        rows = good.where("_file like '%b.jsonl'").collect()
        assert len(rows) == 496 and all(r["_line"] == r["id"] + 1 and r["name"] == f"n{r['id']}" for r in rows)
        with pytest.raises(ValueError, match=r"a%20b.jsonl:101 \(no_object\)"):
            readers.json_lines(spark, f"file://{tmp_path}", "id bigint, name string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "good.jsonl").write_text('{"id": 1}\n\n{"name": "x", "id": 2, "more": [1]}\n')
    got = readers.json_lines(spark, f"file://{tmp_path}/good.jsonl", "id bigint, name string")
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, "x")]
