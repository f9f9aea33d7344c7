"""Markdown sources: front matter and headings."""

from __future__ import annotations

import datetime
import json


import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip

_BLOCK = r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)"
LIFTED = ("title", "author", "date", "description", "tags", "categories")


def front_matter(c: Column) -> Column:
    """The block between a first line --- and the next; null if there is none."""
    return F.when(F.regexp_like(c, F.lit(_BLOCK)), F.regexp_extract(c, _BLOCK, 1))


def body(c: Column) -> Column:
    return F.regexp_replace(c, _BLOCK, "")


def headings(c: Column) -> Column:
    """array<struct<level:int,text:string>> of the # headings, by stripped line."""
    p = r"(?dU)^(#{1,6})\s+(.+?)(?:\s+#{1,6})?$"
    found = F.filter(F.transform(lines(c), strip), lambda x: F.regexp_like(x, F.lit(p)))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(x, p, 1)).alias("level"), F.regexp_extract(x, p, 2).alias("text")))


def _plain(v):
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def parsed_front_matter(text: str | None) -> dict[str, str] | None:
    """Keys and values; nested values and lists as JSON, dates as ISO. Null if it isn't a YAML mapping."""
    if not text:
        return None
    try:
        got = yaml.safe_load(text)
    except yaml.YAMLError:
        return None
    if not isinstance(got, dict):
        return None
    return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in _plain(got).items()}


def read(df: DataFrame, c: str) -> DataFrame:
    """Adds content (the body), frontmatter (a map) and headings."""

    @F.pandas_udf("map<string,string>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(parsed_front_matter)

    df = df.withColumns({"content": body(F.col(c)), "frontmatter": parse(front_matter(F.col(c)))})
    return df.withColumn("headings", headings(F.col("content")))


