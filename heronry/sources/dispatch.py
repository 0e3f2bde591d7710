"""Which parser reads a file: the first rule that matches its MIME type or name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parser_of(mime: Column, name: Column) -> Column:
    """native, pdf, pptx, docx, xlsx or unsupported; suffixes are case-sensitive."""
    mime, name = F.coalesce(mime, F.lit("")), F.coalesce(name, F.lit(""))
    return (
        F.when(mime.contains("application/vnd.google-apps"), "native")
        .when(mime.contains("pdf"), "pdf")
        .when(mime.contains("presentation") | name.endswith(".pptx"), "pptx")
        .when(mime.contains("wordprocessingml") | name.endswith(".docx"), "docx")
        .when(mime.contains("spreadsheetml") | name.endswith(".xlsx") | name.endswith(".xls"), "xlsx")
        .otherwise("unsupported")
    )
