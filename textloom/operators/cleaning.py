"""Cleaning operators. Each takes a DataFrame and a text column and returns the DataFrame with the column cleaned.

They work inside the JVM but for ``merge_short_paragraphs`` and ``normalize_unicode``,
which share one Arrow crossing in a pipeline. Intermediate arrays are columns of
their own, so that no expression is worked out twice. A null text stays null.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import S, any_in, column_keep, folded, guarded, let, lines, matches, python_each, strip, stripped_lines, sub

#: Bullet signs by code point.
_BULLETS = "".join(chr(x) for x in [0x2022, 0xB7, 0x29BF, 0x29BE, 0x2043, 0x204C, 0x204D, 0x25E6, 0x25AA, 0x25AB, 0x25D8, 0x25D9, 0x27A2, 0x27A3, 0x27A4, 0x25CF, 0x25CB, 0x25FC, 0x25FB, 0x25BA, 0x25BB, 0x25B7, 0x25B9, 0x2794, 0x2192, 0x21D2, 0x27F9, 0x27FE, 0x27F6, 0x21DD, 0x21E2, 0x2937, 0x27FC, 0x27FF, 0x2933, 0x293B, 0x2914, 0x27F4])
BULLETS = "[" + _BULLETS + "]"

_LABELS = ["confidential", "draft", "internal use only", "copyright", "all rights reserved"]
_MARK = "(?:##?#? )?"
FURNITURE = [
    r"^\d+$",
    rf"(?i:^{_MARK}page\s+\d+(?:\s+of\s+\d+)?(?:\s*[-\\/|]\s*.*)?$)",
    rf"(?i:^{_MARK}(?:{'|'.join(_LABELS)})$)",
    r"^\d\d?[-/]\d\d?[-/]\d{2,4}$",
    r"^(?:Ref(?:erence)?|Doc(?:ument)?)\s*[:#]?\s*[-\w]+$",
    rf"^(?:{'|'.join(['Cc', 'Date', 'From', 'Sent', 'Subject', 'To'])}):$",
    rf"(?i:^{_MARK}\s*(?:header|footer)$|^##\s*footer$)",
]
BOILERPLATE = [
    "all rights reserved[.]?.*",
    "confidentiality notice:.*",
    r"this (?:document|email) (?:is|contains) confidential.*",
    "disclaimer:.*",
    "if you (?:are not|have received).*in error.*",
    "sent from my (?:android|ipad|iphone|mobile device)",
    rf"(?:{'|'.join(['email', 'fax', 'phone', 'tel'])}):\s*[-\w.@+]+",
    r"copyright\s+©?\s*\d{4}.*",
    "privacy policy.*",
    "please (?:see|find) (?:attached|the attached) (?:document|file)",
]
REPEATED, FURNITURE_LENGTH, LEAST_KEPT = 3, 100, 0.05
PARAGRAPH_KEY = 20
SHORT = 80


def _with(df: DataFrame, c: str, f) -> DataFrame:
    return df.withColumn(c, f(F.col(c)))


def standardize_lists(df: DataFrame, c: str) -> DataFrame:
    """Bullets and dashes at line starts become ``* ``; blank lines before them go too."""
    df = _with(df, c, lambda x: sub(x, rf"^[{S}]*{BULLETS}+ *", "* ", "m"))
    return _with(df, c, lambda x: sub(x, rf"^[{S}]*[—–-] *", "* ", "m"))


def format_headings(df: DataFrame, c: str) -> DataFrame:
    """Short lines after a blank one get ``##`` (under 25 characters) or ``###`` (under 60)."""
    df = df.withColumn("_l", F.split(F.col(c), "\n", -1)).withColumn("_s", F.transform("_l", strip))
    blank = lambda i: F.coalesce(F.get(F.col("_s"), i) == "", F.lit(True))

    def line(x, i):
        s = F.get(F.col("_s"), i)
        size = F.length(s)
        plain = (size > 0) & ~F.substring(s, 1, 1).isin("#", "*", "-")
        heading = plain & (size < 60) & blank(i - 1)  # 60 to 79 characters qualify, but stay as they are
        return F.when(heading & (size < 25), F.concat(F.lit("## "), s)).when(heading, F.concat(F.lit("### "), s)).otherwise(x)

    return df.withColumn(c, F.array_join(F.transform("_l", line), "\n")).drop("_l", "_s")


def is_furniture(line: Column) -> Column:
    """Of a stripped line: is it a page number, a label, a date, a reference or a mail header?"""
    return matches(line, "|".join(FURNITURE))


def remove_headers_footers(df: DataFrame, c: str) -> DataFrame:
    """Drop page furniture, and lines under 100 characters from their third occurrence on; unless under 5 % would be left."""
    rows = F.transform(lines(F.col(c)), lambda x: F.struct(strip(x).alias("s"), x.alias("x")))
    df = df.withColumn("_l", rows)
    df = df.withColumn("_n", F.size("_l")).withColumn("_l", F.filter("_l", lambda r: (r["s"] == "") | ~is_furniture(r["s"])))
    df = column_keep(df, "_l", "_l", lambda r: r["s"], REPEATED - 1, lambda r: (r["s"] == "") | (F.length(r["s"]) >= FURNITURE_LENGTH))
    few = F.size(F.filter("_l", lambda r: r["s"] != "")) < F.col("_n") * LEAST_KEPT
    text = F.array_join(F.transform("_l", lambda r: F.when(r["s"] == "", F.lit("")).otherwise(r["x"])), "\n")
    empty = F.col(c) == ""
    return df.withColumn(c, F.when(few | empty, F.col(c)).otherwise(text)).drop("_l", "_n")


def remove_footnotes(df: DataFrame, c: str) -> DataFrame:
    """Drop lines that start with a number and hold a URL."""
    df = df.withColumn("_l", lines(F.col(c)))
    keep = F.filter("_l", lambda x: ~matches(x, r"^[ \t]*\d+[).]?\s+.*?https?://\S"))
    return df.withColumn(c, F.array_join(keep, "\n")).drop("_l")


def clean_whitespace(df: DataFrame, c: str) -> DataFrame:
    """Tabs and runs of blanks to one blank, no blanks at line ends, one blank line at most."""
    x = F.replace(F.col(c), F.lit("\t"), F.lit(" "))
    for sign, pattern, to in (("  ", " {2,}", " "), (" \n", " +\n", "\n"), ("\r\n", "\r\n", "\n"), ("\n\n\n", "\n{3,}", "\n\n")):
        x = guarded(x, lambda v: F.contains(v, F.lit(sign)), lambda v: F.regexp_replace(v, pattern, to))  # noqa: B023
    return df.withColumn(c, strip(x))


def join_paragraph_lines(df: DataFrame, c: str) -> DataFrame:
    """One line a paragraph; lines that start with a heading or list mark stay."""
    x = stripped_lines(F.col(c))
    x = sub(x, r"(?<=[^\n])\n(?=[^\n])(?!(?:[-*+>]|#{1,6}|\d+[.)])[^\S\n]+)", " ")
    return df.withColumn(c, strip(F.regexp_replace(x, "\n{2,}", "\n\n")))


def _key(x: Column) -> Column:
    return sub(F.lower(x), rf"[{S}]+", " ")


def remove_duplicates(df: DataFrame, c: str) -> DataFrame:
    """Drop repeated paragraphs of more than 20 characters, and repeated sentences inside a paragraph."""
    df = df.withColumn("_p", F.filter(F.transform(F.split(F.col(c), rf"(?dU)\n[{S}]*\n", -1), strip), lambda p: p != ""))
    df = column_keep(df, "_p", "_p", _key, 1, lambda p: F.length(_key(p)) <= PARAGRAPH_KEY)

    # sentences of all paragraphs in one array, so that one sort by (paragraph, key, place) shows the repeated ones
    split = lambda p, j: F.transform(F.split(p, rf"(?dU)(?<=[.!?])[{S}]+", -1), lambda x, i: F.struct(j.alias("j"), _key(strip(x)).alias("k"), i.alias("i"), x.alias("x")))
    df = df.withColumn("_s", F.array_sort(F.flatten(F.transform("_p", split))))
    new = lambda r, n: F.coalesce((F.get("_s", n - 1)["j"] != r["j"]) | (F.get("_s", n - 1)["k"] != r["k"]), F.lit(True))
    df = df.withColumn("_s", F.array_sort(F.transform(F.filter("_s", new), lambda r: F.struct(r["j"], r["i"], r["x"]))))
    join = lambda r, n: F.concat(F.when(n == 0, "").when(F.get("_s", n - 1)["j"] == r["j"], " ").otherwise("\n\n"), r["x"])
    return df.withColumn(c, F.array_join(F.transform("_s", join), "")).drop("_p", "_s")


#: One of these, in lower case, is in every text that a boilerplate rule changes.
_ANCHORS = ["all rights reserved", "confidentiality notice:", "this document", "this email", "disclaimer:", "if you are not", "if you have received", "sent from my ", "email:", "fax:", "phone:", "tel:", "copyright", "privacy policy", "please see", "please find"]


def remove_boilerplate_text(df: DataFrame, c: str) -> DataFrame:
    """Cut ten kinds of legal and mail boilerplate, most of them to the line's end."""

    def rules(x):
        for pattern in BOILERPLATE:
            x = sub(x, pattern, "", "i")
        return x

    return df.withColumn(c, guarded(F.col(c), lambda x: let(folded(x), lambda f: any_in(f, _ANCHORS)), rules))


def merged_short(text: str) -> str:
    """Specification of ``merge_short_paragraphs`` for one text."""
    out, held = [], ""
    for line in text.splitlines():
        s = line.strip()
        if not s:
            out += [held, ""] if held else [""]
            held = ""
        elif 0 < len(held) < SHORT and held[-1] not in ".!?:;" and held[0] not in "#-*>|" and s[0] not in "#-*>|":
            held = f"{held} {s}"
        else:
            if held:
                out.append(held)
            held = s
    return "\n".join([*out, held] if held else out)


def nfc(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def merge_short_paragraphs(df: DataFrame, c: str) -> DataFrame:
    """Join a line under 80 characters that ends no sentence with the next one; never across a blank line."""
    return python_each(df, c, merged_short)


def normalize_unicode(df: DataFrame, c: str) -> DataFrame:
    """NFC."""
    return python_each(df, c, nfc)


def merge_and_normalize(df: DataFrame, c: str) -> DataFrame:
    """Both of the above in one crossing to Python."""
    return python_each(df, c, lambda t: nfc(merged_short(t)))


def strip_text(df: DataFrame, c: str) -> DataFrame:
    return _with(df, c, strip)
