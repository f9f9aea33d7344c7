"""File types: which converter reads an extension, and which formats it can become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = ["markdown", "plain_text", "json"]
#: First match wins, in this order.
CONVERTERS: dict[str, list[str]] = {
    "pdf": [".pdf"],
    "office": [".docx", ".doc", ".odt", ".xlsx", ".xls", ".ods", ".pptx", ".ppt", ".odp"],
    "html": [".html", ".htm", ".xhtml", ".xml"],
    "text": [".txt"],
    "markdown": [".md", ".markdown"],
    "csv": [".csv"],
}
SUPPORTED = {e for es in CONVERTERS.values() for e in es} - {".markdown", ".xhtml"}


class FileTypes:
    def __init__(self):
        self.formats = {e: [*_TEXT, "csv"] if e in (".xlsx", ".xls", ".ods") else _TEXT[1:] if e in (".md", ".markdown") else list(_TEXT) for es in CONVERTERS.values() for e in es} | {".json": _TEXT[:2]}
        self.extensions = {"markdown": "md", "plain_text": "txt", "json": "json", "csv": "csv", "html": "html", "xml": "xml"}
        self.converters: list[tuple[str, list[str], Callable | None]] = [(n, list(e), None) for n, e in CONVERTERS.items()]

    def register_extension(self, ext: str, formats: list[str]) -> None:
        self.formats["." + ext.lower().lstrip(".")] = list(formats)

    def register_format(self, name: str, ext: str) -> None:
        self.extensions[name.lower()] = ext.lstrip(".")

    def register(self, name: str, extensions: list[str], convert: Callable) -> None:
        """Add a converter: a function of a file's bytes that returns (text, metadata)."""
        if not callable(convert):
            raise TypeError("a converter must be callable")
        self.converters.append((name, extensions, convert))

    def converter(self, ext: Column) -> Column:
        """Name of the first converter that takes an extension, else null."""
        out = F.lit(None).cast("string")
        for name, exts, _ in reversed(self.converters):
            out = F.when(ext.isin(exts), F.lit(name)).otherwise(out)
        return out

    def supported(self, ext: Column, only: list[str] | None = None) -> Column:
        return ext.isin(only) if only else ext.isin(sorted(self.formats))

    def table(self, spark: SparkSession) -> DataFrame:
        """(ext, format) rows, for joins; the registry's size, not the data's."""
        return spark.createDataFrame([(e, f) for e, fs in sorted(self.formats.items()) for f in fs], "ext string, format string")
