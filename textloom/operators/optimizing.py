"""Operators that shorten text. Same shape as in ``cleaning``: DataFrame and column in, DataFrame out."""

from __future__ import annotations

import json
import re
import textwrap
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import DOMAINS, REDUNDANT, SIMPLER
from ..functions.text import any_in, folded, guarded, let, lines, python_each, strip, sub


def remove_redundant_phrases(df: DataFrame, c: str) -> DataFrame:
    """Fifteen wordy phrases, in order, inside words too."""

    def rules(x):
        for phrase, to in REDUNDANT.items():
            x = sub(x, phrase, to, "i")
        return x

    return df.withColumn(c, guarded(F.col(c), lambda x: let(folded(x), lambda f: any_in(f, list(REDUNDANT))), rules))


def condense_repetitive_patterns(df: DataFrame, c: str) -> DataFrame:
    """Repeated words to the first, then drop lines equal to the last non-blank line."""
    w = r"[\p{L}\p{N}_]"  # combining marks aren't part of a word
    x = sub(F.col(c), rf"(?<!{w})({w}++)(?=\s)(?:\s+\1(?!{w}))+", "$1", "i")

    def kept(rows):
        full = lambda r: r["s"] != ""
        new = lambda f: F.filter(f, lambda r, i: F.coalesce(F.get(f, i - 1)["s"] != r["s"], F.lit(True)))
        return F.array_sort(F.concat(let(F.filter(rows, full), new), F.filter(rows, lambda r: ~full(r))))

    rows = F.transform(lines(x), lambda x, i: F.struct(i.alias("i"), strip(x).alias("s"), x.alias("x")))
    return df.withColumn(c, F.array_join(F.transform(let(rows, kept), lambda r: r["x"]), "\n"))


def remove_excessive_punctuation(df: DataFrame, c: str) -> DataFrame:
    """Runs of end marks to the last one, runs of dashes or underscores to one."""
    x = F.regexp_replace(c, "[.!?]+([.!?])", "$1")
    x = guarded(x, lambda v: F.contains(v, F.lit("--")), lambda v: F.regexp_replace(v, "--+", "-"))
    return df.withColumn(c, guarded(x, lambda v: F.contains(v, F.lit("__")), lambda v: F.regexp_replace(v, "__+", "_")))


def simplify_citations(df: DataFrame, c: str) -> DataFrame:
    """(Lee et al., 2019) and (Lee, 2019) to [Lee et al. 2019] and [Lee 2019]."""

    def rules(x):
        x = sub(x, r"[(]([^,)]+?et al[.]?)?,?\s+(\d{4})[^)]*[)]", "[$1 $2]")
        return sub(x, r"[(]([a-zA-Z']+),?\s+(\d{4})[^)]*[)]", "[$1 $2]")

    return df.withColumn(c, guarded(F.col(c), lambda x: F.contains(x, F.lit("(")), rules))


def simplify_urls(df: DataFrame, c: str) -> DataFrame:
    """URLs without scheme, www, query and fragment."""
    rule = lambda x: sub(x, r"https?://(?:www[.])?([^\s/]+)([^#?\s]*)(?:[?]\S*)?(?:#\S*)?", "$1$2")
    return df.withColumn(c, guarded(F.col(c), lambda x: F.contains(x, F.lit("://")), rule))


def wrapped(text: str, width: int) -> str:
    """Specification of ``optimize_line_length`` for one text."""
    fill = textwrap.TextWrapper(width, break_long_words=False)
    return "\n".join(x if not x.strip() or x.startswith(("#", "* ", "- ", "| ")) else fill.fill(x) for x in text.split("\n"))


def optimize_line_length(df: DataFrame, c: str, width: int) -> DataFrame:
    """Wrap lines but headings, list items and table rows."""
    return python_each(df, c, lambda t: wrapped(t, width))


def simplify_text(df: DataFrame, c: str) -> DataFrame:
    """Common phrases, units and titles by their short forms."""
    x = F.col(c)
    for short, phrases in SIMPLER.items():
        here = lambda v: let(folded(v), lambda f: any_in(f, phrases))  # noqa: B023, E731
        x = guarded(x, here, lambda v: sub(v, rf"\b(?:{'|'.join(phrases)})\b", short, "i"))  # noqa: B023
    return df.withColumn(c, x)


class DomainTerms:
    """Replacement of terms that follows the case of what it replaces.

    A term with an empty replacement stays, and a term whose key isn't in lower case
    never matches; both are so in what this engine is to agree with.
    """

    def __init__(self, domains: list[str] | None = None, custom: dict[str, str] | None = None):
        self.terms: dict[str, str] = {}
        for d in domains or []:
            self.add_domain(d)
        self.add(custom or {})

    def add_domain(self, domain: str) -> None:
        self.terms |= DOMAINS.get(domain, {})

    def add(self, terms: dict[str, str]) -> None:
        self.terms |= terms

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.terms, indent=2, sort_keys=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> DomainTerms:
        return cls(custom=json.loads(Path(path).read_text(encoding="utf-8")))

    def function(self):
        terms = dict(self.terms)
        if not terms:
            return lambda t: t
        find = re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", re.I)

        def one(m: re.Match) -> str:
            was = m.group()
            to = terms.get(was.lower())
            if not to:
                return was
            if was.islower():
                return to
            if was.isupper():
                return to.upper()
            return to[:1].upper() + to[1:] if was[0].isupper() else to

        return lambda t: find.sub(one, t)

    def apply(self, df: DataFrame, c: str) -> DataFrame:
        return python_each(df, c, self.function())


def base_forms(word: str) -> list[str]:
    """Likely base forms of an English word: as noun, then as verb."""
    out = []
    for end, to in (("ies", "y"), ("sses", "ss"), ("es", "e"), ("es", ""), ("s", "")):
        if word.endswith(end) and not word.endswith("ss"):
            out.append(word[: -len(end)] + to)
    for end, to in (("ied", "y"), ("ing", "e"), ("ing", ""), ("ed", "e"), ("ed", "")):
        if word.endswith(end) and len(word) > len(end) + 2:
            out.append(word[: -len(end)] + to)
    return out


class Vocabulary:
    """Shorter synonyms for long words, from a table of word -> synonyms. Ties in length go by the alphabet."""

    def __init__(self, synonyms: dict[str, list[str]], least: int = 4, lemma=None):
        self.synonyms, self.least = synonyms, least
        self.lemma = lemma or (lambda w: next((b for b in base_forms(w) if b in synonyms), w))

    def candidates(self, word: str) -> list[str]:
        found = {s.replace("_", " ") for s in self.synonyms.get(word, [])}
        return sorted((s for s in found if s != word and len(s) < len(word)), key=lambda s: (len(s), s))

    def simplify(self, text: str) -> str:
        def one(m: re.Match) -> str:
            was = m.group()
            if len(was) < self.least or not was.isalpha():
                return was
            low = was.lower()
            base = self.lemma(low)
            got = self.candidates(base) or (self.candidates(low) if base != low else [])
            if not got:
                return was
            return got[0].title() if was.istitle() else got[0][:1].upper() + got[0][1:] if was[0].isupper() else got[0]

        return re.sub(r"\w+", one, text)

    def apply(self, df: DataFrame, c: str) -> DataFrame:
        return python_each(df, c, self.simplify)


def sanitize_markup(df: DataFrame, c: str) -> DataFrame:
    """Text without tags and comments; entities stay as they are."""
    x = F.regexp_replace(F.col(c), "(?s)<!--.*?-->", "")
    return df.withColumn(c, F.regexp_replace(x, "</?[A-Za-z][^<>]*>", ""))
