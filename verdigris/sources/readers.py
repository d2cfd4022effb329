"""Sources: JSON lines, curation and registry rows, workbooks, image headers, files by pattern, HTML pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import IO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import decoded

#: Columns of registry and curation rows.
REGISTRY = (
    "schema string, case_id string, series_id string, dataset_id string, dataset_name string, rag_class string, label string, negative_subtype string, positive_subtype string, phenotype_tags array<string>, modality string, source_format string, dicom_original boolean, nifti_original boolean, derived_from string, sequence_or_phase string, body_region string, raw_path string, annotation_path string, has_segmentation boolean, source_url string, clinical_use_allowed boolean, research_only boolean, review_status string, limitations array<string>, warnings array<string>, metadata map<string,string>"
)
CURATION = "case_id string, current_label string, recommended_label string, recommended_negative_subtype string, recommended_positive_subtype string, phenotype_tags array<string>, reviewer string, review_status string, notes string"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line, text) of text files, lines counted from 1 in each file; a byte order mark is left out.

    Large files stay split: lines are counted by split, the counts of a file's earlier splits are
    added up, and a row's place in its own split does the rest. Texts are not moved.
    """
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths))
    # rows of a split follow one another in their task, so their ids differ from its first one by their place
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("text"))
    splits = rows.groupBy("file", "__split").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(splits.select("file", "__split", "__first", before.alias("__before")), ["file", "__split"])
    line = F.col("__before") + F.col("__id") - F.col("__first") + 1
    return placed.select("file", line.alias("line"), F.when(line == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")).alias("text"))


def json_records(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records of JSON-lines files with the columns of ``schema``, _file and _line, and the quarantine (file, line, reason, text) of all other lines.

    Reasons: ``invalid_json``, ``no_object``, ``wrong_type`` (an object with a field of another type than
    the schema's), and ``empty_file`` with line 0 for a file without any record. Blank lines are skipped.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*kind.fields, T.StructField("__corrupt", T.StringType())])
    lines = numbered_lines(spark, paths).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    # parsers stop behind the first value; a mark behind it, which no text holds, shows that the line is one value and no more
    mark = F.md5("text")
    value = F.try_parse_json(F.concat(F.lit("["), "text", F.lit(',"'), mark, F.lit('"]')))
    read = lines.withColumns({"__value": value, "__row": F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})})
    reason = F.when(~mark.eqNullSafe(F.try_variant_get("__value", "$[1]", "string")), "invalid_json").when(~F.schema_of_variant(F.variant_get("__value", "$[0]", "variant")).startswith("OBJECT"), "no_object").when(F.col("__row").isNull() | F.col("__row.__corrupt").isNotNull(), "wrong_type")
    read = read.withColumn("__reason", reason).drop("__value")
    good = read.where("__reason is null").select(*[F.col(f"__row.`{f.name}`").alias(f.name) for f in kind.fields], F.col("file").alias("_file"), F.col("line").alias("_line"))
    bad = read.where("__reason is not null").select("file", "line", F.col("__reason").alias("reason"), "text")
    listed = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("file"))
    empty = listed.join(lines.select("file").distinct(), "file", "left_anti").select("file", F.lit(0).cast("bigint").alias("line"), F.lit("empty_file").alias("reason"), F.lit(None).cast("string").alias("text"))
    return good, bad.unionByName(empty)


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Rows of JSON-lines files; a line that is no object of the schema's types is an error that names file and line, and so is a file without records. Blank lines are skipped."""
    good, bad = json_records(spark, paths, schema)
    problems = bad.orderBy("file", "line").limit(5).collect()
    if problems:
        raise ValueError("lines that cannot be taken: " + ", ".join(f"{r['file']}:{r['line']} ({r['reason']})" for r in problems))
    return good.drop("_file", "_line")


def registry(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return json_lines(spark, paths, REGISTRY)


def curation(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, CURATION)


def files(spark: SparkSession, root: str, pattern: str = "*", excluded: Sequence[str] = ()) -> DataFrame:
    """(path, length, modified) of files under a folder by name pattern; content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    for part in excluded:
        found = found.where(~F.col("path").rlike(re.escape(part).replace(r"\*", ".*")))
    return found


def nifti_files(spark: SparkSession, root: str, excluded: Sequence[str] = ()) -> DataFrame:
    return files(spark, root, "*.nii*", excluded).where(F.col("path").rlike(r"\.nii(\.gz)?$"))


def content_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256), to be joined with a manifest."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"))


def pages(spark: SparkSession, root: str, pattern: str = "*.html") -> DataFrame:
    """(path, html): one row a file, UTF-8 or else Latin-1."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", decoded(F.col("content")).alias("html"))


def _local(tag: str) -> str:
    """An element's name without its namespace."""
    return tag.rpartition("}")[2]


def _shared_strings(part: IO[bytes]) -> list[str]:
    """The strings of a workbook in order; each may be cut into runs."""
    found, runs = [], []
    for _, node in ElementTree.iterparse(part):
        name = _local(node.tag)
        if name == "t":
            runs.append(node.text or "")
        elif name == "si":
            found.append("".join(runs))
            runs = []
            node.clear()
    return found


def _place(reference: str) -> int:
    """The column (from 0) of a cell's reference such as AB12, a number in base 26 with digits A to Z."""
    letters = reference.rstrip("0123456789").upper()
    return sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else 0


def workbook_rows(content: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> Iterator[list[str]]:
    """Cells of a sheet as text, row by row as the sheet is read; what a row leaves out is empty, rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                shared = _shared_strings(part)
        with book.open(sheet) as part:
            row: list[str] = []
            value, runs = "", []
            for _, node in ElementTree.iterparse(part):
                name = _local(node.tag)
                if name == "v":
                    value = node.text or ""
                elif name == "t":
                    runs.append(node.text or "")
                elif name == "c":
                    text = {"inlineStr": "".join(runs), "s": shared[int(value)] if value and node.get("t") == "s" else ""}.get(node.get("t"), value)
                    at = _place(node.get("r") or "")
                    row += [""] * (at + 1 - len(row))
                    row[at] = text.strip()
                    value, runs = "", []
                elif name == "row":
                    if row:
                        yield row
                    row = []
                    node.clear()


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of workbooks: path, row number and cells; the first row usually names the columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(workbook_rows(bytes(content)))
                yield pd.DataFrame({"path": name, "row": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def subject_labels(rows: DataFrame, subject: str, description: str, prefix: str = "tumor") -> DataFrame:
    """Whether any description of a subject begins with a word."""
    return rows.groupBy(subject).agg(F.bool_or(F.startswith(F.lower(F.trim(description)), F.lit(prefix))).alias("positive"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, safe) of zip archives; a safe name stays inside the folder that it is unpacked to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    rows = [(name, m.filename, m.file_size, not (m.filename.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", m.filename))) for m in book.infolist()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "safe"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, size bigint, safe boolean")


def image_headers(spark: SparkSession, root: str, schema: str, parse: Callable[[bytes], dict | None], pattern: str = "*.dcm") -> DataFrame:
    """Header rows of image files by a parser of one file's bytes (null: not readable); pixels are the parser's to skip."""
    kinds = T.StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p.as_py(), **(parse(c.as_buffer().to_pybytes()) or {})} for p, c in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", "content").mapInArrow(run, kinds)


def series_of_headers(headers: DataFrame, key: Sequence[str] = ("series_uid", "echo_time", "modality")) -> DataFrame:
    """Series from header rows: frames, matrix sizes and contrast, by uid, echo and modality; ids are hashed."""
    uid = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]), 256), 1, 24)
    return headers.withColumn("series_key", uid).groupBy("series_key", *key).agg(F.count("*").alias("frames"), F.count_distinct("rows", "columns").alias("matrix_sizes"), F.bool_or(F.col("contrast").isNotNull()).alias("contrast_present"), F.collect_set("series_description").alias("descriptions"))
