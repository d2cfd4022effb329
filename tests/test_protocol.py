import struct

import pytest

from verdigris.operators import protocol
from verdigris.sources import dicom, readers


def element(group, number, kind, value):
    value = value + b" " * (len(value) % 2)
    return struct.pack("<HH", group, number) + (kind + struct.pack("<H", len(value)) if kind else struct.pack("<I", len(value))) + value


def dicom_file(implicit):
    kind = (lambda k: b"") if implicit else (lambda k: k)
    syntax = b"1.2.840.10008.1.2" if implicit else b"1.2.840.10008.1.2.1"
    nested = struct.pack("<HH", 0x0008, 0x1140) + (b"" if implicit else b"SQ\0\0") + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x0008, 0x0060, kind(b"CS"), b"XX") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body = element(0x0008, 0x0060, kind(b"CS"), b"MR") + nested + element(0x0018, 0x0081, kind(b"DS"), b"2.5") + element(0x0020, 0x000E, kind(b"UI"), b"1.2.3") + element(0x0020, 0x0037, kind(b"DS"), b"1\\0\\0\\0\\1\\0") + element(0x0028, 0x0010, kind(b"US"), struct.pack("<H", 512)) + element(0x0028, 0x0011, kind(b"US"), struct.pack("<H", 256))
    return b"\0" * 128 + b"DICM" + element(0x0002, 0x0010, b"UI", syntax) + body + struct.pack("<HH", 0x7FE0, 0x0010) + b"OW\0\0" + struct.pack("<I", 4) + b"pixl"


@pytest.mark.parametrize("implicit", [False, True])
def test_dicom_header(implicit):
    got = dicom.header(dicom_file(implicit))
    assert got["modality"] == "MR" and got["echo_time"] == 2.5 and got["series_uid"] == "1.2.3" and (got["rows"], got["columns"]) == (512, 256)
    assert got["image_orientation"] == [1, 0, 0, 0, 1, 0]
    assert dicom.header(b"not an image") is None


def test_headers_become_series(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.dcm").write_bytes(dicom_file(k % 2 == 0))
    (tmp_path / "bad.dcm").write_bytes(b"x")
    rows = readers.image_headers(spark, str(tmp_path), dicom.SCHEMA, dicom.header)
    series = readers.series_of_headers(rows.where("modality is not null")).collect()
    assert rows.count() == 4 and len(series) == 1 and series[0].frames == 3 and series[0].matrix_sizes == 1


def test_protocol_holds_until_something_changes(spark):
    cases = spark.createDataFrame([("a", "POSITIVE", "d"), ("b", "NEGATIVE", "d")], "case_id string, label string, dataset_id string")
    splits = spark.createDataFrame([("a", 0), ("b", 1)], "case_id string, fold int")
    made = protocol.frozen(cases, splits, {"folds": 2})
    assert protocol.verified(made, cases, splits.orderBy("fold", ascending=False), {"folds": 2}) == []
    moved = spark.createDataFrame([("a", 1), ("b", 0)], "case_id string, fold int")
    assert protocol.verified(made, cases, moved, {"folds": 3}) == ["splits_sha256", "settings_sha256"]
    assert protocol.verified({**made, "cases": 3}, cases, splits, {"folds": 2}) == ["signature", "cases"]


def test_plan_cycles_through_all_backgrounds(spark):
    backgrounds = spark.createDataFrame([(f"b{k}",) for k in range(7)], "case_id string")
    donors = spark.createDataFrame([(f"d{k}", "x") for k in range(3)], "case_id string, label string")
    rows = protocol.sampling_plan(backgrounds, donors, {"x": 12, "none": 4}, 5).collect()
    assert len(rows) == 16 == len({r.case_id for r in rows})
    uses = [sum(r.background_case_id == f"b{k}" for r in rows) for k in range(7)]
    assert max(uses) - min(uses) <= 1
    assert sorted(sum(r.donor_case_id == f"d{k}" for r in rows) for k in range(3)) == [4, 4, 4]
    assert all(r.donor_case_id is None for r in rows if r.label == "none")


def test_inference_rows_must_not_know_the_truth(spark):
    rows = spark.createDataFrame([("a", "POSITIVA", "positive")], "case_id string, prediction string, truth string")
    with pytest.raises(ValueError):
        protocol.attach_truth(rows, rows)
