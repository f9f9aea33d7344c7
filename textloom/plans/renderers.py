"""Rendering of cleaned text, and sinks."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip
from ..session import small_batches

FORMATS = {"markdown": "md", "plain_text": "txt", "json": "json", "csv": "csv", "html": "html", "xml": "xml"}
ALIASES = {"text": "plain_text", "txt": "plain_text", "md": "markdown"}


def format_name(name: str) -> str:
    n = ALIASES.get(name.lower(), name.lower())
    if n not in ("markdown", "plain_text", "json", "csv"):
        raise ValueError(f"unsupported output format: {name}")
    return n


#: Writers by format: (DataFrame, text column, metadata column or none) -> Column of the file's text.
WRITERS: dict[str, tuple[str, Callable]] = {}


def register_writer(name: str, extension: str, render: Callable) -> None:
    """Add an output format; ``render`` takes (content, metadata) columns and returns one."""
    if not callable(render):
        raise TypeError("a writer must be callable")
    WRITERS[name.lower()] = extension.lstrip("."), render


def file_text(fmt: str, content: Column, metadata: Column, block: Column | None = None, position: str = "end") -> tuple[str, Column, Callable[[str], str] | None]:
    """Extension and text of a document's own output file, and what the sink's Python has still to do with it."""
    if fmt.lower() in WRITERS:
        ext, render = WRITERS[fmt.lower()]
        return ext, render(content, metadata), None
    fmt = format_name(fmt)
    if fmt == "markdown":
        text = F.when(content.isNotNull(), markdown(content, block, position)) if block is not None else content
    elif fmt == "json":
        text = F.when(content.isNotNull(), as_json(content, metadata))
    else:
        text = content
    return FORMATS[fmt], text, {"plain_text": plain, "csv": csv_text}.get(fmt)


def default_extension(c: Column) -> Column:
    """Extension of a format's files; txt if unknown."""
    out = F.lit("txt")
    for f, e in FORMATS.items():
        out = F.when(F.lower(c) == f, F.lit(e)).otherwise(out)
    return out


def format_of_extension(c: Column) -> Column:
    """Format of an extension (with or without dot); unknown ones name themselves."""
    x = F.lower(F.regexp_replace(c, "^[.]", ""))
    return F.when(x.isin("md", "markdown"), F.lit("markdown")).when(x.isin("txt", "text"), F.lit("plain_text")).otherwise(x)


def output_format(explicit: Column, path: Column, default: str) -> Column:
    """Explicit format, else by the output path's extension, else the default."""
    ext = F.regexp_extract(path, r"[.]([^./\\]+)$", 1)
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(ext != "", format_of_extension(ext)), F.lit(default))


def output_path(path: Column, source: str, target: str, extension: Column, keep_extension: bool = True) -> Column:
    """The file's place in the mirrored tree. ``keep_extension`` tells a.txt and a.md apart, by a.txt.md and a.md.md."""
    relative = F.when(F.startswith(path, F.lit(source.rstrip("/") + "/")), F.substring(path, len(source.rstrip("/")) + 2, 1 << 20)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))
    base = relative if keep_extension else F.regexp_replace(relative, r"(?<=[^/])[.][^./]+$", "")
    return F.concat(F.lit(target.rstrip("/") + "/"), base, F.lit("."), extension)


def metadata_block(title: Column, author: Column, size_kb: Column, pages: Column, slides: Column, sheets: Column, reduction: Column) -> Column:
    """The Markdown metadata section; null if nothing is known."""
    item = lambda label, c, shape="%s": F.when(c.isNotNull(), F.format_string(f"- {label}: {shape}", c))
    counts = F.coalesce(item("Pages", pages), item("Slides", slides), item("Sheets", sheets))
    items = F.array_compact(F.array(item("Title", title), item("Author", author), item("File Size", size_kb, "%.2f KB"), counts, item("Token Reduction", reduction, "%.2f%%")))
    return F.when(F.size(items) > 0, F.concat(F.lit("## Document Metadata\n\n"), F.array_join(items, "\n")))


def markdown(content: Column, block: Column, position: str = "end") -> Column:
    parts = (content, block) if position == "end" else (block, content)
    return F.concat_ws("\n\n", *parts)


def as_json(content: Column, metadata: Column | None = None) -> Column:
    return F.to_json(F.struct(content.alias("content"), *([metadata.alias("metadata")] if metadata is not None else [])))


def csv_rows(df: DataFrame, key: str, c: str) -> DataFrame:
    """(key, pos, Content): the non-blank lines, stripped."""
    kept = F.filter(F.transform(lines(F.col(c)), strip), lambda x: x != "")
    return df.select(key, F.posexplode(kept).alias("pos", "Content"))


_SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def markdown_tables(text: str, strict: bool = False) -> list[list[list[str]]]:
    """Pipe tables, header first. ``strict``: outer pipes needed, and a table with a row of another width is left out."""
    rows, out, i = text.splitlines(), [], 0
    while i + 1 < len(rows):
        head, rule = rows[i], rows[i + 1]
        ok = "|" in head and "|" in rule and "-" in rule and _SEPARATOR.match(rule)
        if strict:
            ok = ok and head.strip().startswith("|") and head.strip().endswith("|")
        if not ok or len(_cells(head)) != len(_cells(rule)) and not strict:
            i += 1
            continue
        table, i = [_cells(head)], i + 2
        while i < len(rows) and "|" in rows[i] and rows[i].strip():
            table.append(_cells(rows[i]))
            i += 1
        n = len(table[0])
        if not strict:
            out.append([(r + [""] * n)[:n] for r in table])
        elif len(table) > 1 and all(len(r) == n for r in table):
            out.append(table)
    return out


def tables(df: DataFrame, c: str, out: str = "tables", strict: bool = False) -> DataFrame:
    @F.pandas_udf("array<array<array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: markdown_tables(t, strict), na_action="ignore")

    small_batches(df.sparkSession)
    return df.withColumn(out, run(F.col(c)))


def csv_text(text: str) -> str:
    """The first table as CSV, else a Content column of the non-blank lines."""
    found = markdown_tables(text)
    rows = found[0] if found else [["Content"], *([x.strip()] for x in text.splitlines() if x.strip())]
    buf = io.StringIO()
    csv.writer(buf).writerows(rows)
    return buf.getvalue()


_INLINE = [(re.compile(p), to) for p, to in ((r"!\[([^]]*)\]\([^)]*\)", r"\1"), (r"\[([^]]*)\]\([^)]*\)", r"\1"), (r"`([^`]*)`", r"\1"), (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2"), (r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2"))]


def plain(text: str) -> str:
    """Markdown to plain text: headings, lists, quotes, emphasis, links, code and rules lose their marks; table cells are joined by a blank."""
    out: list[str] = []  # blocks
    fence, para, kind = False, [], ""
    rows = text.splitlines()

    def flush():
        nonlocal kind
        if para:
            out.append(("\n" if kind == "li" else " ").join(para) if kind != "code" else "\n".join(para))
            para.clear()
        kind = ""

    heads: set[int] = set()
    i = 0
    while i < len(rows):
        r = rows[i]
        s = r.strip()
        if s.startswith("```"):
            flush()
            fence, kind = not fence, "code" if not fence else ""
        elif fence:
            para.append(r)
        elif not s:
            flush()
        elif re.fullmatch(r"([-*_])(\s*\1){2,}", s):
            flush()
        elif m := re.match(r"#{1,6}\s+(.*?)(\s+#+)?$", s):
            flush()
            heads.add(len(out))
            out.append(_inline(m[1]))
        elif i + 1 < len(rows) and "|" in s and "|" in rows[i + 1] and _SEPARATOR.match(rows[i + 1]):
            flush()
            block = [s]
            i += 2
            while i < len(rows) and "|" in rows[i]:
                block.append(rows[i])
                i += 1
            out.append("\n".join(" ".join(_inline(c) for c in _cells(b)) for b in block))
            continue
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", s):
            if kind != "li":
                flush()
            kind = "li"
            para.append(_inline(m[1]))
        else:
            s = re.sub(r"^(>\s?)+", "", s)
            if kind == "li" and not r[:1].isspace():
                para[-1] += " " + _inline(s)
            else:
                kind = kind or "p"
                para.append(_inline(s))
        i += 1
    flush()
    joined = "\n\n".join(x for x in out)
    joined = re.sub(r"[ \t]+([.,;:!?])", r"\1", joined)
    return re.sub(r"\n{3,}", "\n\n", joined).strip()


def _inline(s: str) -> str:
    for p, to in _INLINE:
        s = p.sub(to, s)
    return s


def plain_by_rules(text: str) -> str:
    """Markdown to plain text by replacements alone."""
    for p, to in ((r"(?m)^#{1,6}\s+(.*?)\s*$", r"\1"), (r"(?m)^\s*[-+*]\s+", ""), (r"[*]+|_+", ""), (r"\[(.*?)\]\([^)]+\)", r"\1"), ("`", ""), (r"(?m)^\s*[-*_]{3,}\s*$", "")):
        text = re.sub(p, to, text)

    def table(m: re.Match) -> str:
        rows = [x for x in m.group().splitlines() if not re.match(r"^\s*\|[-\s:|]+\|\s*$", x)]
        return "\0".join("  ".join(c.strip() for c in x.split("|")[1:-1]) for x in rows) + "\n"  # rows stay together

    text = re.sub(r"(?m)(?:^[ \t]*\|.*\|[ \t]*(?:\n|\Z)){2,}", table, text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r"(\w)\n(\w)", r"\1\n\n\2", text) if "|" not in text else text
    return text.replace("\0", "\n").strip()


def plain_text(df: DataFrame, c: str, out: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(plain, na_action="ignore")

    small_batches(df.sparkSession)
    return df.withColumn(out, run(F.col(c)))


def report_rows(results: DataFrame) -> DataFrame:
    """The per-file report: sizes, reductions, tokens and times."""
    from ..operators.metrics import reduction_percent, size_reduction

    o, p = F.col("original_length"), F.col("processed_length")
    return results.select("path", F.regexp_extract("path", r"[.]([^./]+)$", 1).alias("file_type"), "success", "error", o.alias("input_size"), p.alias("output_size"), size_reduction(o, p).alias("size_reduction"), "original_tokens", "processed_tokens", reduction_percent(F.col("original_tokens"), F.col("processed_tokens")).alias("token_reduction"), "processing_time", F.col("output_path"))


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Rendered rows to files of one format: text lines, JSON lines, CSV or Parquet."""
    w = df.write.mode(mode)
    if fmt in ("markdown", "plain_text"):
        w.option("lineSep", "\n\n").text(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)
