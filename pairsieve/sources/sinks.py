"""CSV and Markdown output of report tables (already aggregated, a few dozen rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown(table: DataFrame, title: str) -> str:
    """Markdown text of a report table."""
    lines = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    for row in table.toLocalIterator():
        lines.append("| " + " | ".join("" if v is None else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"


def write_markdown(table: DataFrame, title: str, path: str) -> None:
    """The Markdown text as one file under ``path``."""
    lines = [(line,) for line in markdown(table, title).splitlines()]
    table.sparkSession.createDataFrame(lines, "line string").coalesce(1).write.mode("overwrite").text(path)
