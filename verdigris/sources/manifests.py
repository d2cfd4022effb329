"""Sources that are checked before they are read: dataset and label manifests, and frozen out-of-fold predictions."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.protocol import canonical_sha256

#: What inference sections must not name, and the formats and labels of cases.
PROTECTED = ("label", "lesion_mask", "lesion_mask_path", "annotations")
FORMATS, LABELS = ("DICOM", "NIFTI"), ("positive", "negative")
CASE = "dataset string, case_id string, format string, root string, dicom_dir string, volume string, organ_mask string, label string, lesion_mask string"


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"one file expected: {path}")
    return rows[0]["value"]


def _mapping(spark: SparkSession, path: str) -> dict:
    """A JSON or, where its parser is installed, YAML file's mapping."""
    text = _text(spark, path)
    try:
        value = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as missing:
            raise ValueError(f"{path} is no JSON, and there is no YAML parser") from missing
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"no mapping: {path}")
    return value


def _inside(root: str, value: object, needed: bool, name: str) -> str | None:
    """A path below ``root``; one that leaves it, or a needed one that is missing, is an error."""
    if not value:
        if needed:
            raise ValueError(f"{name} is missing")
        return None
    path = posixpath.normpath(posixpath.join(root, str(value)))
    if path != root and not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name} is outside its root: {value}")
    return path


def _case(dataset: Mapping, root: str, item: Mapping) -> tuple:
    name, kind = str(dataset["name"]), str(dataset["format"]).upper()
    case, label = str(item.get("case_id") or "").strip(), str(item.get("label") or "").lower()
    where = f"{name}/{case}"
    asked, known = (item.get(k) or {} for k in ("inference", "ground_truth"))
    if not case or label not in LABELS:
        raise ValueError(f"a case without id or label: {where}")
    if leaked := set(PROTECTED) & set(asked):
        raise ValueError(f"the inference section of {where} names {sorted(leaked)}")
    image = kind != "DICOM"
    paths = [_inside(root, asked.get(key), needed, f"{key} of {where}") for key, needed in (("dicom_dir", not image), ("volume", image), ("organ_mask", image))]
    return (name, case, kind, root, *paths, label, _inside(root, known.get("lesion_mask"), False, f"lesion_mask of {where}"))


def dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of the datasets that a manifest names, joined with each dataset's own label file on (dataset, case).

    Paths are relative to the manifest, and to the dataset's root below it. Unknown formats or labels,
    repeated cases, paths outside the root and labels in inference sections are errors. Manifests
    describe cohorts; they are read by the driver.
    """
    folder, rows = posixpath.dirname(path), []
    datasets = _mapping(spark, path).get("datasets")
    if not isinstance(datasets, list) or not datasets:
        raise ValueError(f"no datasets in {path}")
    for dataset in datasets:
        if not dataset.get("name") or str(dataset.get("format")).upper() not in FORMATS or not dataset.get("root") or not dataset.get("labels_manifest"):
            raise ValueError(f"a dataset needs name, format, root and labels_manifest: {dataset.get('name')}")
        root = posixpath.normpath(posixpath.join(folder, str(dataset["root"])))
        cases = _mapping(spark, posixpath.join(folder, str(dataset["labels_manifest"]))).get("cases")
        if not cases:
            raise ValueError(f"no cases of {dataset['name']}")
        rows += [_case(dataset, root, item) for item in cases]
    if len({r[:2] for r in rows}) < len(rows):
        raise ValueError("a case is named twice")
    return spark.createDataFrame(rows, CASE)


def frozen_predictions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Out-of-fold predictions (oof_predictions.jsonl) whose freeze (prediction_freeze.json) still holds.

    Its signature, the file's hash and the statement that no held-out label was used are checked; rows
    that bring a label or ground truth are an error, found in the file's text by one scan.
    """
    freeze = _mapping(spark, f"{root}/prediction_freeze.json")
    body = {k: v for k, v in freeze.items() if k != "prediction_signature"}
    if freeze.get("prediction_signature") != canonical_sha256(body):
        raise ValueError("the signature does not hold")
    path = f"{root}/oof_predictions.jsonl"
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
    if digest != freeze.get("oof_predictions_sha256"):
        raise ValueError("the predictions were changed")
    if freeze.get("held_out_labels_used_for_fit_or_threshold") is not False:
        raise ValueError("held-out labels were used")
    names = F.map_keys(F.from_json("value", "map<string,string>"))
    if not spark.read.text(path).where(F.trim("value") != "").where(F.arrays_overlap(names, F.array(F.lit("label"), F.lit("ground_truth")))).isEmpty():
        raise ValueError("predictions bring their truth")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
