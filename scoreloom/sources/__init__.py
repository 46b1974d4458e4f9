"""Sinks of reports: each sheet becomes a folder of CSV (or Parquet) files below one path that Spark can write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(sheets: Mapping[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """Writes each sheet, as one file since reports are small, and returns the folders. Existing sheets are replaced; array columns are written as text in CSV."""
    if kind not in ("csv", "parquet"):
        raise ValueError("kind is csv or parquet")
    out = []
    for name, df in sheets.items():
        to = f"{path.rstrip('/')}/{name}"
        flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}) if kind == "csv" else df
        writer = flat.coalesce(1).write.mode("overwrite")
        writer.option("header", True).csv(to) if kind == "csv" else writer.parquet(to)
        out.append(to)
    return out
