"""Checks of paths, sizes, types and contents as columns: null where all is well, else the reason."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

MB = 1 << 20
LIMITS = {"pdf": 50 * MB, "docx": 30 * MB, "xlsx": 20 * MB, "txt": 200 * MB}
LIMIT = 300 * MB
DANGEROUS = sorted(f".{x}" for x in "app asp aspx bat cgi cmd com dll exe jar js msi php pl ps1 py scr sh so vbs".split())
SENSITIVE = ["/bin", "/etc", "/sbin", "/usr/bin", "/usr/sbin", "/var", "/Library", "/System", "/private", "/Users/*/Library", r"C:\Program Files", r"C:\Windows", r"C:\Users\*\AppData"]
MIME = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "pdf": "application/pdf", "doc": "application/msword", "json": "application/json", "xml": "text/xml", "rtf": "application/rtf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "zip": "application/zip", "exe": "application/x-msdos-program", "js": "text/javascript", "py": "text/x-python", "mp4": "video/mp4", "xhtml": "application/xhtml+xml",
}
ALLOWED = {m for e, m in MIME.items() if e in "txt html md csv pdf doc docx xls xlsx ppt pptx rtf json".split()} | {"application/xml"}
#: Name and pattern of what looks like an attack; the first three and the last also apply to contents.
SUSPICIOUS = {
    "sql_quote": r"(?i)'|--|#|%27|%23",
    "sql_assignment": r"(?i)(?:=|%3D)[^\n]*(?:'|--|;|%27|%3B)",
    "shell": r"&#|\\|[|]|;",
    "traversal": r"\.\.[/\\]",
    "script": r"(?is)<script.*?>.*?</script>",
    "iframe": r"(?is)<iframe.*?>.*?</iframe>",
    "javascript": r"(?i)javascript\s*:",
    "encoded_program": r"(?i)base64.*(?:exe|dll|bat|sh|cmd|vbs)",
}
CONTENT = ["sql_quote", "sql_assignment", "shell", "encoded_program"]


def extension(path: Column) -> Column:
    """Suffix of the last part, with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]([.][^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)[.][^.]+$", "")


def first_error(*checks: Column) -> Column:
    return F.coalesce(*checks)


def path_error(path: Column, strict: bool = True, allow_temp: bool = False) -> Column:
    """Traversal, suspicious signs (``strict``), a dangerous extension, or a sensitive place."""
    checks = [F.when(F.regexp_like(path, F.lit(SUSPICIOUS["traversal"])), F.lit("path traversal"))]
    if strict:
        bad = F.lit(False)
        for name, p in SUSPICIOUS.items():
            if name != "traversal":
                bad = bad | F.regexp_like(path, F.lit(p))
        checks.append(F.when(bad, F.lit("suspicious path")))
    checks.append(F.when(extension(path).isin(DANGEROUS), F.lit("dangerous extension")))
    sensitive = is_sensitive(path)
    if allow_temp:
        sensitive = sensitive & ~F.regexp_like(path, F.lit("^(?:/private)?/(?:var/folders|tmp)/"))
    checks.append(F.when(sensitive, F.lit("sensitive location")))
    return first_error(*checks)


def is_sensitive(path: Column) -> Column:
    out = F.lit(False)
    for p in SENSITIVE:
        if "*" in p:
            pattern = "^" + ".*?".join(_escaped(x) for x in p.split("*"))
            out = out | F.regexp_like(path, F.lit(pattern))
        else:
            out = out | F.startswith(path, F.lit(p))
    return out


def _escaped(x: str) -> str:
    return "".join(c if c.isalnum() or c in "/ " else "\\" + c for c in x)


def size_limit(ext: Column) -> Column:
    out = F.lit(LIMIT)
    for e, n in LIMITS.items():
        out = F.when(ext == f".{e}", F.lit(n)).otherwise(out)
    return out.cast("long")


def size_error(path: Column, length: Column) -> Column:
    return F.when(length > size_limit(extension(path)), F.lit("too large"))


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for e, m in MIME.items() for x in (f".{e}", m)])
    return F.try_element_at(table, extension(path))


def mime_error(path: Column) -> Column:
    """Unknown types pass unless their extension is dangerous; known ones must be allowed."""
    m = mime_type(path)
    return F.when(m.isNull() & extension(path).isin(DANGEROUS), F.lit("dangerous extension")).when(m.isNotNull() & ~m.isin(*sorted(ALLOWED)), F.lit("type not allowed"))


def name_error(path: Column) -> Column:
    return F.when(F.regexp_like(file_name(path), F.lit(r"[\x00-\x1f\"*:<>?|]")), F.lit("unsafe output name"))


def file_error(path: Column, length: Column, strict: bool = True) -> Column:
    return first_error(path_error(path, strict), size_error(path, length), mime_error(path))


def suspicious(c: Column, content: bool = True) -> Column:
    """Names of the patterns found."""
    names = CONTENT if content else list(SUSPICIOUS)
    return F.array_compact(F.array(*[F.when(F.regexp_like(c, F.lit(SUSPICIOUS[n])), F.lit(n)) for n in names]))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def intact(content: Column, expected: Column) -> Column:
    return digest(content) == F.lower(expected)


def result_error(content: Column, processed: Column) -> Column:
    return first_error(F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit("empty conversion")), F.when(F.coalesce(F.length(processed), F.lit(0)) == 0, F.lit("empty result")))


def sanitized_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", "_"), r"(?U)[^-.\w\s]", "_")


def sheet_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^-.\w\s]", "_")


def escaped_pipes(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def permission_error(path: str, write: bool = False) -> str | None:
    """On the driver: may this path be read (and written)?"""
    if not os.path.exists(path):
        return "missing"
    if not os.access(path, os.R_OK):
        return "not readable"
    return "not writable" if write and not os.access(path, os.W_OK) else None


def output_error(path: str) -> str | None:
    """On the driver: make the parent folder; may the file be written, and is its name safe?"""
    p = Path(path)
    if any(c in '"*:<>?|' or ord(c) < 32 for c in p.name):
        return "unsafe output name"
    try:
        p.parent.mkdir(parents=True, exist_ok=True)
    except OSError as e:
        return f"no folder: {e}"
    return None if os.access(p.parent, os.W_OK) else "not writable"
