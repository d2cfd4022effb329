"""Sinks: JSON lines, flat CSV, Markdown reports, bundles of a run, and appends that a restarted job can repeat."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(rows: DataFrame, path: str) -> None:
    """One object a row with sorted keys; an existing folder is an error."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Every column as text: null empty, booleans true and false, arrays joined by ;."""
    out = []
    for field in rows.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(F.transform(value, lambda x: x.cast("string")), ";")
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(field.name))
    return rows.select(*out)


def csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("errorifexists").option("header", "true").option("emptyValue", "").csv(path)


def percent(value: float | None) -> str:
    """One decimal, or a dash for nothing."""
    return "—" if value is None else f"{value * 100:.1f}%"


def markdown(report: DataFrame, names: Mapping[str, str], title: str) -> str:
    """A table of the report's first row; a report has one row by construction."""
    row = report.select(*names).first()
    lines = [f"# {title}", "", "| | |", "|---|---:|"]
    return "\n".join(lines + [f"| {label} | {percent(row[c]) if isinstance(row[c], float) or row[c] is None else row[c]} |" for c, label in names.items()]) + "\n"


def run_bundle(tables: Mapping[str, DataFrame], root: str) -> None:
    """Each table of a run in a folder of its own; nothing is overwritten."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{name}")


def append_pending(universe: DataFrame, path: str, keys: Sequence[str], done: DataFrame | None = None) -> None:
    """Append to a checkpoint the rows that ``done`` (what was read of it, null for a first run) lacks; run again, it appends nothing."""
    rows = universe if done is None else universe.join(done.select(*keys).distinct(), list(keys), "left_anti")
    rows.write.mode("append").parquet(path)
