"""Word, Excel and PowerPoint files by zipfile and ElementTree: text and metadata of one file's bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"
CP = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
MAX_ROWS, MAX_COLS = 1000, 20


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, name = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    if root is None:
        return {}
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:]) for r in root}


def _core(z: zipfile.ZipFile) -> dict:
    root = _xml(z, "docProps/core.xml")
    if root is None:
        return {}
    get = lambda tag: (root.findtext(tag) or "").strip() or None
    return {"title": get(f"{DC}title"), "author": get(f"{DC}creator"), "last_modified_by": get(f"{CP}lastModifiedBy")}


def _pipe(rows: list[list[str]]) -> list[str]:
    if not rows:
        return []
    n = len(rows[0])
    line = lambda r: "| " + " | ".join((c.replace("\n", " ") for c in (r + [""] * n)[:n])) + " |"
    return [line(rows[0]), "| " + " | ".join(["---"] * n) + " |", *map(line, rows[1:])]


def _run_text(p) -> str:
    return "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else "" for t in p.iter())


def docx(data: bytes, name: str = "document.docx") -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(f"{W}body")
        styles = _xml(z, "word/styles.xml")
        names = {s.get(f"{W}styleId"): s.find(f"{W}name").get(f"{W}val") for s in styles.iter(f"{W}style") if s.find(f"{W}name") is not None} if styles is not None else {}
        meta = _core(z)
    out = [f"# {meta.get('title') or name.rsplit('.', 1)[0]}", ""]
    paragraphs = body.findall(f"{W}p")
    for p in paragraphs:
        text = _run_text(p).strip()
        if not text:
            continue
        style = p.find(f"{W}pPr/{W}pStyle")
        sid = style.get(f"{W}val") if style is not None else ""
        label = names.get(sid, sid)
        if m := re.match(r"(?i)heading\s*(\d)", label):
            out += ["#" * int(m[1]) + " " + text, ""]
        elif label.lower().startswith("list"):
            out.append("* " + text)
        else:
            out += [text, ""]
    tables = body.findall(f"{W}tbl")
    for i, t in enumerate(tables):
        rows = [["\n".join(_run_text(p) for p in c.iter(f"{W}p")).strip() for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")]
        out += ["", f"### Table {i + 1}", "", *_pipe(rows), ""]
    meta |= {"paragraph_count": len(paragraphs), "section_count": max(1, len(list(body.iter(f"{W}sectPr")))), "table_count": len(tables)}
    return "\n".join(out).strip(), meta


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(v: str) -> str:
    try:
        f = float(v)
        return str(int(f)) if f == int(f) and "." not in v and "e" not in v.lower() else repr(f) if "." in v else v
    except ValueError:
        return v


def xlsx(data: bytes, name: str = "", max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in strings.findall(f"{X}si")] if strings is not None else []
        book = _xml(z, "xl/workbook.xml")
        rels = _rels(z, "xl/workbook.xml")
        out, sheets = [], {}
        for i, s in enumerate(book.iter(f"{X}sheet")):
            title = re.sub(r"[^-.\w\s]", "_", s.get("name"))
            if i:
                out += ["", "---", ""]
            out += [f"## {title}", ""]
            try:
                rows: list[list[str]] = []
                for row in _xml(z, rels[s.get(f"{R}id")][1]).iter(f"{X}row"):
                    cells: list[str] = []
                    for c in row.findall(f"{X}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [""] * (at - len(cells) + 1)
                        kind, v = c.get("t"), c.findtext(f"{X}v") or ""
                        cells[at] = shared[int(v)] if kind == "s" and v else "".join(t.text or "" for t in c.iter(f"{X}t")) if kind == "inlineStr" else {"1": "True", "0": "False"}.get(v, v) if kind == "b" else _number(v)
                    n = int(row.get("r") or len(rows) + 1)
                    rows += [[]] * (n - len(rows) - 1)
                    rows.append(cells)
                width = max((len(r) for r in rows), default=0)
                total = max(0, len(rows) - 1)
                sheets[s.get("name")] = {"row_count": total, "column_count": width}
                if not width:
                    out.append("*Empty sheet*")
                    continue
                shown = [[c.replace("|", "\\|").replace("\n", "<br>") for c in (r + [""] * width)[: min(width, max_cols)]] for r in rows[: max_rows + 1]]
                out += _pipe(shown)
                if total > max_rows:
                    out += ["", f"*Note: showing {max_rows} of {total} rows*"]
                if width > max_cols:
                    out += ["", f"*Note: showing {max_cols} of {width} columns*"]
            except Exception as e:
                out.append(f"*Error reading sheet: {e}*")
    return "\n".join(out).strip(), {"sheet_count": len(sheets), "sheets": sheets}


def _paragraphs(shape) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in shape.iter(f"{A}p")).strip()


def pptx(data: bytes, name: str = "") -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = _rels(z, "ppt/presentation.xml")
        ids = [e.get(f"{R}id") for e in _xml(z, "ppt/presentation.xml").iter(f"{P}sldId")]
        out, noted = [], []
        for i, rid in enumerate(ids, 1):
            part = rels[rid][1]
            title, texts = "", []
            for sp in _xml(z, part).iter(f"{P}sp"):
                text = _paragraphs(sp)
                ph = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                if ph is not None and ph.get("type") in ("title", "ctrTitle") and not title:
                    title = text
                elif text:
                    texts.append(text)
            if i > 1:
                out += ["", "---", ""]
            out += [f"## Slide {i}" + (f": {title}" if title else ""), ""]
            out += [f"* {t}" for t in texts] if len(texts) + bool(title) > 1 else texts
            notes = next((p for k, p in _rels(z, part).values() if k == "notesSlide"), None)
            if notes and (root := _xml(z, notes)) is not None:
                said = "\n".join(filter(None, (_paragraphs(sp) for sp in root.iter(f"{P}sp") if (ph := sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is None or ph.get("type") not in ("sldImg", "sldNum"))))
                if said:
                    noted.append(i)
                    out += ["", "**Notes:**", "", said]
    return "\n".join(out).strip(), {"slide_count": len(ids), "slides_with_notes": noted}


def convert(data: bytes, ext: str, name: str = "", max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> tuple[str, dict]:
    if ext == ".docx":
        return docx(data, name or "document.docx")
    if ext == ".xlsx":
        return xlsx(data, name, max_rows, max_cols)
    if ext == ".pptx":
        return pptx(data, name)
    if ext in (".doc", ".odt", ".ppt", ".odp"):
        return f"# {name.rsplit('.', 1)[0]}\n\n*{ext[1:].upper()} files are listed, but not read.*", {}
    raise ValueError(f"no reader for {ext}")
