"""Text primitives as columns, with Python's str and re semantics.

Java regexes are prefixed with (?dU): Unicode classes, and only \\n ends a line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import small_batches

#: What str.strip removes.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
#: One blank, as Python's \s has it, for use inside a character class.
S = r"\s\x1c-\x1f"


def sub(c: Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(c, F.lit(f"(?dU{flags}){pattern}"), F.lit(to))


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_like(c, F.lit(f"(?dU{flags}){pattern}"))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def unix_lines(c: Column) -> Column:
    """Every line end that str.splitlines knows as \\n."""
    return F.regexp_replace(c, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")


def lines(c: Column) -> Column:
    """str.splitlines."""
    return F.split(F.regexp_replace(unix_lines(c), r"\n\z", ""), "\n", -1)


def stripped_lines(c: Column) -> Column:
    """Each line stripped, in one text."""
    return sub(unix_lines(c), rf"^[{S}&&[^\n]]+|[{S}&&[^\n]]+$", "", "m")


def folded(c: Column) -> Column:
    """Lower case, as case-blind regexes see ASCII letters: four other signs count as i, s or k."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


def let(x: Column, f) -> Column:
    """f(x) with x worked out once however often f uses it.

    As an expression it holds x once, so that a filter on the result, which the optimiser moves below
    projections by putting expressions in place of names, doesn't multiply it.
    """
    return F.get(F.transform(F.array(x), f), F.lit(0))


def guarded(x: Column, cond, f) -> Column:
    """f(x) where cond(x) holds: a cheap search spares most texts the rewrite."""
    return let(x, lambda v: F.when(cond(v), f(v)).otherwise(v))


def python_each(df, c: str, f):
    """Column ``c`` by a Python function of one text. Null stays null.

    Input and result are each referred to twice, which keeps the optimiser from merging the
    Python call with the expressions of earlier and later steps.
    """

    def run(s: pd.Series, null: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    small_batches(df.sparkSession)
    return settled(df.withColumn(c, F.pandas_udf(run, "string")(F.col(c), F.isnull(c))), c)


def settled(df, c: str):
    """No change, but two references to ``c``: what follows isn't merged with what made it. Python functions of
    expressions with nested lambdas aren't split off by the optimiser, and fail."""
    return df.withColumn(c, F.when(F.length(c) == 0, F.lit("")).otherwise(F.col(c)))


def any_in(c: Column, parts: list[str]) -> Column:
    """Is one of the parts in the text?"""
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def column_keep(df, items: str, out: str, key, times: int = 1, exempt=None):
    """``items`` without the occurrences of a key after the first ``times``; ``exempt``: items that always stay.

    Sorting by (key, place) makes this n log n in a document's items, where looking
    each item up among the earlier ones is quadratic.
    """
    rows = F.transform(F.col(items), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    df = df.withColumn("_sorted", F.array_sort(rows))

    def stays(r, i):
        earlier = F.get(F.col("_sorted"), i - times)
        again = F.coalesce(earlier["k"] == r["k"], F.lit(False))
        return ~again | exempt(r["x"]) if exempt is not None else ~again

    df = df.withColumn("_kept", F.filter(F.col("_sorted"), stays))
    back = F.array_sort(F.transform(F.col("_kept"), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    return df.withColumn(out, F.transform(back, lambda r: r["x"])).drop("_sorted", "_kept")
