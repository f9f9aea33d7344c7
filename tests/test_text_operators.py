"""Every text operator against a plain specification, over random texts made of what it acts on."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import dictionaries
from textloom.operators import cleaning, optimizing

PARTS = ["word", "Word", "the", "the ", " x", "\n", "\n\n", "\n \n", "  ", "\t", "# ", "## T", "* a", "- b", "1. c", "12", "Page 3 of 9", "CONFIDENTIAL", "Docker", "end.", "What?!", "...", "--", "__", "é", "é", "|", "> q", "\r\n", "• d", "– e", "In order to", "A paragraph that is long enough.", "same line", "Copyright © 2020 X", "tel: 55", "(Lee, 2019)", "https://www.a.b/c?d#e", "3) see http://x.y"]


def texts():
    r = random.Random(7)
    out = ["", "a", "\n", " \n ", "one line", "no end\n", "# H\ntext\nmore\n\n- a\nb\n\n\nlast", "x" * 5000, "\n" * 50 + "z"]
    return out + ["".join(r.choice(PARTS) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 30))) for _ in range(250)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = texts()
    return spark.createDataFrame(list(enumerate(rows)), "i int, t string").cache()


def check(corpus, op, spec, change=True):
    rows = op(corpus.withColumn("out", F.col("t")), "out").select("i", "t", "out").collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert r.out == spec(r.t), (r.t, r.out, spec(r.t))
    if change:
        assert any(r.out != r.t for r in rows) and any(r.out == r.t for r in rows)


def whitespace(t):
    t = t.replace("\t", " ")
    for p, to in ((" {2,}", " "), (" +\n", "\n"), ("\r\n", "\n"), ("\n{3,}", "\n\n")):
        t = re.sub(p, to, t)
    return t.strip()


def test_clean_whitespace(corpus):
    check(corpus, cleaning.clean_whitespace, whitespace)


def joined(t):
    out, now, before = [], None, ""
    for s in [x.strip() for x in t.splitlines()]:
        if not s:
            if now is not None:
                out.append(now)
                now = None
            if out and out[-1] != "":
                out.append("")
        elif now is None or not before or re.match(r"(#{1,6}|[-*+>]|\d+[.)])\s+", s):
            if now is not None:
                out.append(now)
            now = s
        else:
            now += " " + s
        before = s
    return "\n".join(out + ([now] if now is not None else [])).strip()


def test_join_paragraph_lines(corpus):
    check(corpus, cleaning.join_paragraph_lines, joined)


def headings(t):
    rows = t.split("\n")
    bare = [x.strip() for x in rows]
    blank = lambda i: not 0 <= i < len(bare) or bare[i] == ""
    out = []
    for i, (x, s) in enumerate(zip(rows, bare, strict=True)):
        if s and s[0] not in "#*-" and blank(i - 1) and len(s) < 60:
            x = ("## " if len(s) < 25 else "### ") + s
        out.append(x)
    return "\n".join(out)


def test_format_headings(corpus):
    check(corpus, cleaning.format_headings, headings)


def test_lists(corpus):
    check(corpus, cleaning.standardize_lists, lambda t: re.sub(r"^\s*[-–—] *", "* ", re.sub(rf"^\s*{cleaning.BULLETS}+ *", "* ", t, flags=re.M), flags=re.M))


def furniture(t):
    rows, seen, out = t.splitlines(), {}, []
    for x in rows:
        s = x.strip()
        if not s:
            out.append("")
        elif not any(re.search(p, s) for p in cleaning.FURNITURE):
            seen[s] = seen.get(s, 0) + 1
            if seen[s] < 3 or len(s) >= 100:
                out.append(x)
    return t if rows and sum(bool(x) for x in out) / len(rows) < 0.05 else "\n".join(out)


def test_headers_and_footers(corpus):
    check(corpus, cleaning.remove_headers_footers, furniture)


def once(t):
    seen, out = set(), []
    for p in (x.strip() for x in re.split(r"\n\s*\n", t)):
        key = re.sub(r"\s+", " ", p.lower())
        if not p or key in seen and len(key) > 20:
            continue
        seen.add(key)
        had, kept = set(), []
        for s in re.split(r"(?<=[.!?])\s+", p):
            k = " ".join(s.lower().split())
            if k not in had:
                had.add(k)
                kept.append(s)
        out.append(" ".join(kept).strip())
    return "\n\n".join(out)


def test_duplicates(corpus):
    check(corpus, cleaning.remove_duplicates, once)


def test_footnotes(corpus):
    check(corpus, cleaning.remove_footnotes, lambda t: "\n".join(x for x in t.splitlines() if not re.search(r"^[ \t]*\d+[.)]?\s+.*?https?://\S", x)))


def test_boilerplate(corpus):
    def spec(t):
        for p in cleaning.BOILERPLATE:
            t = re.sub(p, "", t, flags=re.I)
        return t

    check(corpus, cleaning.remove_boilerplate_text, spec)


def test_merge_and_nfc(corpus):
    check(corpus, cleaning.normalize_unicode, lambda t: unicodedata.normalize("NFC", t))
    check(corpus, cleaning.merge_short_paragraphs, cleaning.merged_short)
    assert cleaning.merged_short("a short line\ngoes on\n\nnew\n1. one\n- two") == "a short line goes on\n\nnew 1. one\n- two"
    assert cleaning.merged_short("Ends here.\nnext") == "Ends here.\nnext"


def test_phrases(corpus):
    def spec(t):
        for p, to in dictionaries.REDUNDANT.items():
            t = re.sub(p, to, t, flags=re.I)
        return t

    check(corpus, optimizing.remove_redundant_phrases, spec)


def condensed(t):
    t = re.sub(r"(\b\w+\b)(\s+\1\b)+", r"\1", t, flags=re.I)
    out, last = [], None
    for x in t.splitlines():
        s = x.strip()
        if s and s == last:
            continue
        out.append(x)
        last = s or last
    return "\n".join(out)


def test_condense(corpus):
    check(corpus, optimizing.condense_repetitive_patterns, condensed)


def test_punctuation_citations_urls(corpus):
    check(corpus, optimizing.remove_excessive_punctuation, lambda t: re.sub("_{2,}", "_", re.sub("-{2,}", "-", re.sub("[.!?]+([.!?])", r"\1", t))))
    check(corpus, optimizing.simplify_citations, lambda t: t.replace("(Lee, 2019)", "[Lee 2019]"), change=False)
    check(corpus, optimizing.simplify_urls, lambda t: re.sub(r"https?://(?:www[.])?([^\s/]+)([^#?\s]*)([?]\S*)?(#\S*)?", r"\1\2", t))


def test_examples(spark):
    def one(op, text):
        return op(spark.createDataFrame([(text,)], "t string"), "t").first()[0]

    assert one(optimizing.simplify_citations, "(Ray et al., 2020, p. 3) ( 2020) (in 2021)") == "[Ray et al. 2020] [ 2020] [in 2021]"
    assert one(optimizing.simplify_urls, "http://a.org?q=1") == "a.org?q=1"
    assert one(optimizing.simplify_text, "For instance, 3 Hours") == "e.g., 3 hr"
    assert one(optimizing.remove_redundant_phrases, "within order to") == "withto"
    assert one(optimizing.sanitize_markup, "<p>a &lt; b</p><!-- c -->") == "a &lt; b"
    assert one(cleaning.standardize_lists, "a\n\n- b") == "a\n* b"
    assert one(lambda d, c: optimizing.optimize_line_length(d, c, 10), "# a long heading\none two three four") == "# a long heading\none two\nthree four"
    assert one(cleaning.clean_whitespace, None) is None
    assert one(cleaning.remove_headers_footers, None) is None


def test_domain_terms(spark, tmp_path):
    d = optimizing.DomainTerms(["technical"], {"foo bar": "fb"})
    f = d.function()
    assert f("machine learning, Machine learning, MACHINE LEARNING, Foo Bar") == "ML, ML, ML, Fb"
    assert optimizing.DomainTerms(["legal"]).function()("For the avoidance of doubt") == "For the avoidance of doubt"
    assert f("JavaScript Object Notation") == "JavaScript Object Notation"
    d.save(str(tmp_path / "d.json"))
    assert optimizing.DomainTerms.load(str(tmp_path / "d.json")).terms == d.terms
    df = spark.createDataFrame([("pursuant to law",), (None,)], "t string")
    assert [r.t for r in optimizing.DomainTerms(["legal"]).apply(df, "t").collect()] == ["per law", None]


def test_vocabulary():
    v = optimizing.Vocabulary({"utilize": ["use", "employ"], "purchase": ["buy", "get"], "big": ["l"]})
    assert v.simplify("Utilizing it, they purchased a BIG thing") == "Use it, they buy a BIG thing"
    assert v.candidates("purchase") == ["buy", "get"]
