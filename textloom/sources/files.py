"""Files as documents: scan, validate, convert. One row a file; what fails is a row with its error."""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import html as html_ops
from ..operators.metrics import size_columns
from ..operators.validation import LIMIT, LIMITS, extension, file_error, file_name, stem
from . import markdown, office
from .registry import CONVERTERS, FileTypes

#: No file is larger than the largest limit.
MOST_BYTES = max(LIMIT, *LIMITS.values())
METADATA = "file_name string, file_extension string, file_size_bytes bigint, file_size_kb double, file_size_mb double, modified_at timestamp, title string, author string, date string, description string, keywords string, subject string, creator string, last_modified_by string, frontmatter map<string,string>, headings array<struct<level:int,text:string>>, page_count int, paragraph_count int, section_count int, table_count int, sheet_count int, sheets map<string,struct<row_count:int,column_count:int>>, slide_count int, slides_with_notes array<int>, delimiter string, quotechar string, included_header boolean, truncated boolean, original_rows int, processed_rows int"


def glob_of(extensions: list[str]) -> str:
    """A file name pattern of extensions in any case, which the listing itself applies."""
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(any_case("." + e.lower().lstrip(".")) for e in extensions) + "}"


def scan(spark: SparkSession, path: str, recursive: bool = True, extensions: list[str] | None = None, empty: bool = True) -> DataFrame:
    """path, ext, name, stem, length, modified; contents are read only where they are used, and only of ``extensions``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (reader.option("pathGlobFilter", glob_of(extensions)) if extensions else reader).load(path)
    if empty:  # Spark's own listing has empty files, but its readers skip them
        listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in df.inputFiles()], "path string")
        none = listed.join(df.select("path"), "path", "left_anti")
        df = df.unionByName(none.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    df = df.withColumns({"ext": extension(F.col("path")), "name": file_name(F.col("path"))}).withColumn("stem", stem(F.col("path")))
    if extensions:
        df = df.where(F.col("ext").isin(["." + e.lower().lstrip(".") for e in extensions]))
    return df


def sample(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n files, the same for a seed wherever they are read."""
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)


def csv_content(data: str, delimiter: str = ",", quote: str = '"', header: bool = True, max_rows: int = 0) -> tuple[str, dict]:
    """Rows as lines, cells stripped and joined by a blank. ``max_rows`` counts the header; the row that exceeds it is counted as read."""
    out, seen, truncated = [], 0, False
    for row in csv.reader(io.StringIO(data, newline=""), delimiter=delimiter, quotechar=quote):
        seen += 1
        if max_rows and seen > max_rows:
            truncated = True
            break
        if seen == 1 and not header:
            continue
        out.append(" ".join(c.strip() for c in row))
    return "\n".join(out), {"delimiter": delimiter, "quotechar": quote, "included_header": header, "truncated": truncated, "original_rows": seen, "processed_rows": len(out)}


def csv_table(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """A large CSV file's rows as lines: (content), by Spark's own reader."""
    df = spark.read.csv(path, sep=sep, quote=quote, header=False, multiLine=True)
    return df.select(F.concat_ws(" ", *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns]).alias("content"))


def pdf_content(data: bytes) -> tuple[str, dict]:
    """Needs a PDF library, of which none comes with this package."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise RuntimeError("no PDF reader installed") from None
    reader = PdfReader(io.BytesIO(data))
    meta: dict = {"page_count": len(reader.pages)}
    try:
        for k in ("title", "author", "subject", "creator"):
            if v := getattr(reader.metadata, k, None):
                meta[k] = str(v)
    except Exception as e:
        meta["metadata_extraction_error"] = str(e)
    text = "\n\n".join(p.extract_text() or "" for p in reader.pages).strip()
    if not text:
        raise ValueError("no text in this PDF")
    return text, meta


def convert_bytes(data: bytes, ext: str, name: str, options: dict) -> tuple[str, dict]:
    if ext == ".pdf":
        return pdf_content(data)
    if ext in (".html", ".htm", ".xhtml", ".xml"):
        return html_ops.convert(data.decode("utf-8", "replace"), ext == ".xml", options.get("preserve_links", True), options.get("compat", False))
    if ext == ".csv":
        return csv_content(data.decode("utf-8-sig"), options.get("delimiter", ","), options.get("quotechar", '"'), options.get("include_header", True), options.get("max_rows", 0))
    if ext in (".md", ".markdown", ".txt"):
        text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        return text, {}
    return office.convert(data, ext, name, options.get("max_rows", office.MAX_ROWS) or office.MAX_ROWS, options.get("max_cols", office.MAX_COLS))


def convert(files: DataFrame, options: dict | None = None, types: FileTypes | None = None, kinds: str = "jvm python none") -> DataFrame:
    """Adds content, metadata and error. Text and Markdown stay in the JVM; the other kinds cross to Python once.

    ``kinds``: where the caller knows that ``files`` hold only some of these, the others are left out of the plan.
    """
    types, options = types or FileTypes(), options or {}
    own = {e: f for _, es, f in types.converters if f for e in es}
    fields = [f.split(" ", 1) for f in METADATA.split(", ")]
    given = {k: t for k, t in fields if k not in ("file_name", "file_extension", "file_size_bytes", "file_size_kb", "file_size_mb", "modified_at", "frontmatter", "headings")}

    @F.pandas_udf("text string, error string, " + ", ".join(f"{k} {t}" for k, t in given.items()))
    def run(data: pd.Series, ext: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for d, e, n in zip(data, ext, name, strict=True):
            row: dict = dict.fromkeys(["text", "error", *given])
            try:
                text, meta = own[e](d) if e in own else convert_bytes(d, e, n, options)
                row |= {"text": text} | {k: v for k, v in meta.items() if k in given}
            except Exception as x:
                row["error"] = f"{type(x).__name__}: {x}"
            rows.append(row)
        return pd.DataFrame(rows, columns=["text", "error", *given], dtype=object)

    kind = types.converter(F.col("ext"))
    plain = kind.isin("text", "markdown")
    df = files.withColumn("converter", kind)
    jvm, py = df.where(plain), df.where(~plain)
    lost = df.where(kind.isNull())
    valid = F.is_valid_utf8("content")
    text = F.regexp_replace(F.when(valid, F.decode("content", "UTF-8")), "\r\n?", "\n")
    jvm = jvm.withColumns({"_text": text, "_error": F.when(~valid, F.lit("not UTF-8"))})
    jvm = markdown.read(jvm.drop("content"), "_text")
    is_md = F.col("converter") == "markdown"
    jvm = jvm.withColumns({"content": F.when(is_md, F.col("content")).otherwise(F.col("_text")), "frontmatter": F.when(is_md, F.col("frontmatter")), "headings": F.when(is_md & (F.size("headings") > 0), F.col("headings"))})
    for k, t in given.items():
        lifted = F.try_element_at("frontmatter", F.lit(k)) if k in markdown.LIFTED and t == "string" else F.lit(None)
        jvm = jvm.withColumn(k, lifted.cast(t))
    py = py.withColumn("_r", run("content", "ext", "name")).withColumns({"_text": F.col("_r.text"), "_error": F.col("_r.error"), "frontmatter": F.lit(None).cast("map<string,string>"), "headings": F.lit(None).cast("array<struct<level:int,text:string>>")} | {k: F.col(f"_r.{k}") for k in given})
    py = py.withColumn("content", F.col("_text")).drop("_r")
    lost = lost.withColumns({"_text": F.lit(None).cast("string"), "_error": F.lit("no converter for this type"), "content": F.lit(None).cast("string"), "frontmatter": F.lit(None).cast("map<string,string>"), "headings": F.lit(None).cast("array<struct<level:int,text:string>>")} | {k: F.lit(None).cast(t) for k, t in given.items()})
    chosen = [d for k, d in (("jvm", jvm), ("python", py), ("none", lost)) if k in kinds.split()]
    out = chosen[0]
    for d in chosen[1:]:
        out = out.unionByName(d)
    sizes = size_columns(F.col("length"))
    meta: dict[str, Column] = {"file_name": F.col("name"), "file_extension": F.col("ext"), "file_size_bytes": F.col("length"), "file_size_kb": sizes["file_size_kb"], "file_size_mb": sizes["file_size_mb"], "modified_at": F.col("modificationTime")}
    struct = F.struct(*[(meta[k] if k in meta else F.col(k)).alias(k) for k, _ in fields])
    empty = F.when(F.col("_error").isNull() & (F.coalesce(F.length("content"), F.lit(0)) == 0), F.lit("empty conversion"))
    return out.select("path", "ext", "stem", "content", struct.alias("metadata"), F.coalesce("_error", empty).alias("error"))


def load(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True, check: bool = True, strict: bool = False, options: dict | None = None) -> DataFrame:
    """Scan, check and convert a folder or a file.

    The listing picks each kind's files by name, and the reader those within the size limit, so
    that a file is opened for one kind only and not at all where a check fails by its length.
    """
    listing = scan(spark, path, recursive, extensions)
    wanted = {e for es in CONVERTERS.values() for e in es} & {"." + e.lower().lstrip(".") for e in extensions or [x for es in CONVERTERS.values() for x in es]}
    local = F.regexp_replace("path", "^file:/*", "/")
    bad = file_error(local, F.col("length"), strict) if check else F.lit(None).cast("string")
    parts = []
    for kind, exts in (("jvm", [*CONVERTERS["text"], *CONVERTERS["markdown"]]), ("python", [e for n in ("pdf", "office", "html", "csv") for e in CONVERTERS[n]])):
        if mine := [e for e in exts if e in wanted]:
            d = scan(spark, path, recursive, mine, empty=False)
            d = d.where(F.col("length") <= MOST_BYTES).where(bad.isNull()) if check else d
            parts.append(convert(d, options, kinds=kind))
    plain = listing.drop("content").withColumns({"_bad": bad, "_kind": FileTypes().converter(F.col("ext"))})
    why = F.coalesce("_bad", F.when(F.col("_kind").isNull(), F.lit("no converter for this type")), F.when(F.col("length") == 0, F.lit("empty conversion")))
    meta = convert(listing.limit(0), options, kinds="none").schema["metadata"].dataType
    sizes = size_columns(F.col("length"))
    known = {"file_name": F.col("name"), "file_extension": F.col("ext"), "file_size_bytes": F.col("length"), "file_size_kb": sizes["file_size_kb"], "file_size_mb": sizes["file_size_mb"], "modified_at": F.col("modificationTime")}
    about = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in meta.fields])
    rest = plain.withColumn("_why", why).where("_why IS NOT NULL").select("path", "ext", "stem", F.lit(None).cast("string").alias("content"), F.when(F.col("_bad").isNull(), about).alias("metadata"), F.col("_why").alias("error"))
    out = rest
    for d in parts:
        out = out.unionByName(d)
    return out
