"""Document sinks: one JSON row for each document, so its id and its whole text come back as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doclake.operators.markdown import md_to_html


def write_markdown(df: DataFrame, path: str, id: str = "doc_id", text: str = "markdown", partition_by: str | None = None) -> None:
    """Rows ``doc_id, <text>``, in folders by ``partition_by`` where it is given."""
    columns = [df[id].alias("doc_id"), df[text]] + ([df[partition_by]] if partition_by else [])
    writer = df.select(*columns).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_html(df: DataFrame, path: str, id: str, text: str = "markdown", wrap: bool = False, css: str = "") -> None:
    """Converts Markdown rows and writes their HTML, as fragments or whole pages."""
    write_markdown(md_to_html(df, id, text, wrap, css), path, "doc_id", "html")
