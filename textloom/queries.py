"""Queries over the driver's tables, each with the SQL that DuckDB agrees with where SQL can say it.

The tables hardly hold what the operators act on, so each query plants triggers into
every row with an expression that both engines share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dictionaries import REDUNDANT, SIMPLER
from .operators import cleaning, html, metrics, optimizing, validation, windows
from .plans import parallel, renderers
from .plans.pipeline import Pipeline, processed
from .sources import files, markdown
from .session import EACH, small_batches, spread
from .sources.registry import FileTypes

NL, TAB, CR = "chr(10)", "chr(9)", "chr(13)"
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), EACH)


def _planted(spark: SparkSession, sf_dir: str, planted: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(planted).alias("inp"))


def _text(name: str, planted: str, op: Callable[[DataFrame, str], DataFrame], sql: str | None = None) -> None:
    """A query (doc_id, out, changed) of a text operator over planted documents; ``sql``: the operator on ``inp``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _planted(spark, sf_dir, planted).withColumn("out", F.col("inp"))
        return op(df, "out").select("doc_id", "out", (F.col("out") != F.col("inp")).alias("changed"))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"WITH i AS (SELECT doc_id, {planted} AS inp FROM documents), o AS (SELECT doc_id, inp, {sql} AS out FROM i) SELECT doc_id, out, out <> inp AS changed FROM o"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _replaced(x: str, *rules: tuple[str, str], flags: str = "g") -> str:
    for pattern, to in rules:
        to = to if to.startswith("chr(") else "'" + to + "'"
        x = f"regexp_replace({x}, '{pattern}', {to}, '{flags}')"
    return x


def _lines(x: str = "inp") -> str:
    return f"string_split({x}, chr(10))"


# ---- cleaning

_BLANKS = f"'  ' || {TAB} || 'A' || {TAB} || {TAB} || 'b   c  ' || {NL} || {NL} || {NL} || {NL} || text || CASE WHEN doc_id % 2 = 0 THEN '   ' || {NL} || 'x' || {CR} || {NL} || 'y ' ELSE '' END"
_CLEAN = f"trim({_replaced(f'replace({_replaced(f'replace(inp, {TAB}, {chr(39)} {chr(39)})', (' {2,}', ' '), (' +\\n', 'chr(10)'))}, {CR} || {NL}, {NL})', ('\\n{3,}', 'chr(10) || chr(10)'))}, {WS})"
_text("clean_whitespace", _BLANKS, cleaning.clean_whitespace, _CLEAN)

_NOTE = f"text || {NL} || CASE WHEN doc_id % 3 = 0 THEN '12. see https://a.org/x' ELSE 'see https://a.org/x' END || {NL} || ' 7 http://b.org' || {NL} || '9) none here'"
_text("remove_footnotes", _NOTE, cleaning.remove_footnotes, f"array_to_string(list_filter({_lines()}, lambda x: NOT regexp_matches(x, '^[ \\t]*\\d+[).]?\\s+.*?https?://\\S')), {NL})")

_LEGAL = f"text || {NL} || CASE doc_id % 5 WHEN 0 THEN 'Copyright © 2020 Acme, Inc.' WHEN 1 THEN 'Tel: 555-1234 now' WHEN 2 THEN 'Please find attached document here' WHEN 3 THEN 'x Privacy Policy and more' ELSE 'plain' END || {NL} || 'Sent from my iPhone today'"
_text("remove_boilerplate", _LEGAL, cleaning.remove_boilerplate_text, _replaced("inp", *[(p.replace(".*", "[^\\n]*") if p != cleaning.BOILERPLATE[6] else p, "") for p in cleaning.BOILERPLATE], flags="gi"))

_LISTS = f"text || {NL} || {NL} || '• one' || {NL} || '  - two' || {NL} || '– three' || CASE WHEN doc_id % 2 = 0 THEN {NL} || '---' ELSE '' END"
_text("standardize_lists", _LISTS, cleaning.standardize_lists, _replaced("inp", (f"(?m)^\\s*{cleaning.BULLETS}+ *", "* "), ("(?m)^\\s*[—–-] *", "* ")))

_HEADS = f"'Title ' || doc_id || {NL} || {NL} || text || {NL} || {NL} || 'A heading of some thirty signs' || {NL} || 'next' || {NL} || {NL} || CASE WHEN doc_id % 2 = 0 THEN '* item' ELSE 'The end' END"
_S = f"trim(x, {WS})"
_near = lambda i: f"coalesce(trim({_lines()}[{i}], {WS}) = '', true)"
_text(
    "format_headings", _HEADS, cleaning.format_headings,
    f"array_to_string(list_transform({_lines()}, lambda x, i: CASE WHEN length({_S}) BETWEEN 1 AND 59 AND left({_S}, 1) NOT IN ('#', '*', '-') AND (i = 1 OR {_near('greatest(i - 1, 1)')}) THEN CASE WHEN length({_S}) < 25 THEN '## ' ELSE '### ' END || {_S} ELSE x END), {NL})",
)

_PAGES = f"'Page ' || doc_id || ' of 9' || {NL} || 'CONFIDENTIAL' || {NL} || text || {NL} || 'again' || {NL} || 'again' || {NL} || {NL} || ' again' || {NL} || '12/03/2020' || {NL} || CASE WHEN doc_id % 2 = 0 THEN 'Docker' ELSE 'Ref: A-1' END || {NL} || 'Subject:' || {NL} || 'last'"
_text("remove_headers_footers", _PAGES, cleaning.remove_headers_footers)
_FURNITURE = "^\\d+$|^\\d\\d?[-/]\\d\\d?[-/]\\d{2,4}$|^(Ref(erence)?|Doc(ument)?)\\s*[:#]?\\s*[-\\pL\\pN_]+$|^(Cc|Date|From|Sent|Subject|To):$"
_FURNITURE_I = "^(##?#? )?page\\s+\\d+(\\s+of\\s+\\d+)?(\\s*[-\\\\/|]\\s*.*)?$|^(##?#? )?(" + "|".join(cleaning._LABELS) + ")$|^(##?#? )?\\s*(header|footer)$|^##\\s*footer$"
ORACLE_SQL["remove_headers_footers"] = f"""
WITH i AS (SELECT doc_id, {_PAGES} AS inp FROM documents),
l AS (SELECT doc_id, inp, t.pos, t.line, trim(t.line, {WS}) AS s FROM i, unnest({_lines()}) WITH ORDINALITY AS t(line, pos)),
k AS (SELECT * FROM l WHERE s = '' OR NOT (regexp_matches(s, '{_FURNITURE}') OR regexp_matches(s, '{_FURNITURE_I}', 'i'))),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) AS nth FROM k),
o AS (SELECT doc_id, inp, string_agg(CASE WHEN s = '' THEN '' ELSE line END, {NL} ORDER BY pos) AS out, count(*) FILTER (WHERE s <> '') AS kept FROM n WHERE s = '' OR nth < 3 OR length(s) >= 100 GROUP BY doc_id, inp),
p AS (SELECT doc_id, inp, CASE WHEN kept < 0.05 * len({_lines()}) THEN inp ELSE out END AS out FROM o)
SELECT doc_id, out, out <> inp AS changed FROM p"""

_BROKEN = f"'# Head' || {NL} || 'a first line' || {NL} || '  and its end' || {NL} || '- item' || {NL} || 'of two lines' || {NL} || {NL} || {NL} || text || {NL} || '1. one' || CASE WHEN doc_id % 2 = 0 THEN {NL} || '| a | b |' || {NL} || '| c | d |' ELSE '' END"
_text("join_lines", _BROKEN, cleaning.join_paragraph_lines)
ORACLE_SQL["join_lines"] = f"""
WITH i AS (SELECT doc_id, {_BROKEN} AS inp FROM documents),
l AS (SELECT doc_id, inp, t.pos, trim(t.line, {WS}) AS s FROM i, unnest({_lines()}) WITH ORDINALITY AS t(line, pos)),
p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos), '') AS before FROM l),
b AS (SELECT *, sum(CASE WHEN s <> '' AND (before = '' OR regexp_matches(s, '^(#{{1,6}}|[-*+>]|\\d+[.)])\\s+')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM p),
g AS (SELECT doc_id, inp, block, string_agg(s, ' ' ORDER BY pos) AS t, arg_min(before, pos) AS first_before FROM b WHERE s <> '' GROUP BY doc_id, inp, block),
o AS (SELECT doc_id, inp, string_agg(CASE WHEN block = 1 THEN '' WHEN first_before = '' THEN {NL} || {NL} ELSE {NL} END || t, '' ORDER BY block) AS out FROM g GROUP BY doc_id, inp)
SELECT doc_id, out, out <> inp AS changed FROM o"""

_TWICE = f"text || {NL} || {NL} || 'A paragraph that comes twice. It says so.  it SAYS so. End!' || {NL} || ' ' || {NL} || 'short one' || {NL} || {NL} || 'a paragraph that comes twice.   It says so. it says so. end!' || {NL} || {NL} || 'short one' || CASE WHEN doc_id % 2 = 0 THEN {NL} || {NL} || text ELSE '' END"
_PARAS = f"list_filter(list_transform(string_split_regex(inp, '\\n\\s*\\n'), lambda p: trim(p, {WS})), lambda p: p <> '')"
_KEY = "regexp_replace(lower(p), '\\s+', ' ', 'g')"
_text("dedup_paragraphs", _TWICE, cleaning.remove_duplicates)
_SENT = "string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
ORACLE_SQL["dedup_paragraphs"] = f"""
WITH i AS (SELECT doc_id, {_TWICE} AS inp FROM documents), a AS (SELECT doc_id, inp, {_PARAS} AS ps FROM i),
k AS (SELECT *, list_transform(ps, lambda p: {_KEY}) AS ks FROM a),
f AS (SELECT doc_id, inp, list_filter(ps, lambda p, j: list_position(ks, {_KEY}) = j OR length({_KEY}) <= 20) AS ps FROM k),
u AS (SELECT doc_id, inp, t.pos, t.p, {_SENT} AS ss FROM f, unnest(ps) WITH ORDINALITY AS t(p, pos)),
v AS (SELECT *, list_transform(ss, lambda p: trim({_KEY}, {WS})) AS sk FROM u),
o AS (SELECT doc_id, inp, string_agg(trim(array_to_string(list_filter(ss, lambda p, j: list_position(sk, trim({_KEY}, {WS})) = j), ' '), {WS}), {NL} || {NL} ORDER BY pos) AS out FROM v GROUP BY doc_id, inp)
SELECT doc_id, out, out <> inp AS changed FROM o"""

_text("merge_short_paragraphs", f"'a short line' || {NL} || 'joins this' || {NL} || 'ends here.' || {NL} || '- item' || {NL} || text", cleaning.merge_short_paragraphs)
_text("nfc", "CASE WHEN doc_id % 3 = 0 THEN 'e\u0301' ELSE '\u00e9' END || text", cleaning.normalize_unicode, "nfc_normalize(inp)")

# ---- optimizing

_text("redundant_phrases", f"'In order to ' || text || {NL} || CASE doc_id % 4 WHEN 0 THEN 'due to the fact that x' WHEN 1 THEN 'It is worth noting that y' WHEN 2 THEN 'A number of z' ELSE 'no' END", optimizing.remove_redundant_phrases, _replaced("inp", *REDUNDANT.items(), flags="gi"))
_text("excessive_punctuation", f"text || ' What?! Yes... ' || {NL} || '---' || {NL} || '__bold__' || CASE WHEN doc_id % 2 = 0 THEN '!!!' ELSE '!' END", optimizing.remove_excessive_punctuation, _replaced("inp", ("[.!?]+([.!?])", "\\1"), ("--+", "-"), ("__+", "_")))
_text("simplify_citations", "text || ' (Lee, 2019) and (Ray et al., 2020, p. 3)' || CASE WHEN doc_id % 2 = 0 THEN ' (in 2020)' ELSE ' ( 2021)' END", optimizing.simplify_citations, _replaced("inp", ("[(]([^,)]+?et al[.]?)?,?\\s+(\\d{4})[^)]*[)]", "[\\1 \\2]"), ("[(]([a-zA-Z''']+),?\\s+(\\d{4})[^)]*[)]".replace("'''", "''"), "[\\1 \\2]")))
_text("simplify_urls", "text || ' https://www.a.com/p/q?x=1#f http://b.org?q=1' || CASE WHEN doc_id % 2 = 0 THEN ' https://c.net#top' ELSE '' END", optimizing.simplify_urls, _replaced("inp", ("https?://(?:www[.])?([^\\s/]+)([^#?\\s]*)(?:[?]\\S*)?(?:#\\S*)?", "\\1\\2")))
_text("simplify_text", "text || ' For example, 5 kilograms in 2 hours' || CASE WHEN doc_id % 2 = 0 THEN ' and so on' ELSE ' by Professor X' END", optimizing.simplify_text, _replaced("inp", *[(rf"\b({'|'.join(ps)})\b", s) for s, ps in SIMPLER.items()], flags="gi"))
_text("condense_repetitions", f"'the The cat' || {NL} || 'Head' || {NL} || {NL} || 'Head' || {NL} || text", optimizing.condense_repetitive_patterns)
_text("line_wrap", "text", lambda df, c: optimizing.optimize_line_length(df, c, 80))
_text("domain_terms", "'The Machine Learning model, PURSUANT TO law. ' || text", optimizing.DomainTerms(["technical", "legal"]).apply)
_text("vocab_simplify", "'Utilizing Purchased things. ' || text", optimizing.Vocabulary({"utilize": ["use", "apply"], "purchase": ["buy"]}).apply)
_text("sanitize_markup", "'<b>x</b> 3 < 4 &amp; <!-- no -->' || text", optimizing.sanitize_markup, _replaced("inp", ("(?s)<!--.*?-->", ""), ("</?[A-Za-z][^<>]*>", "")))
_text("plain_text_render", f"'# Head' || {NL} || {NL} || 'Some *bold* `code` [link](http://a.b).' || {NL} || {NL} || '- item' || {NL} || {NL} || text", lambda df, c: renderers.plain_text(df, c, c))


@_query("default_pipeline")
def default_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps that are on by default, and each document's metrics."""
    df = _planted(spark, sf_dir, f"'Page ' || doc_id || ' of 9' || {NL} || text || {NL} || {NL} || 'In order to  end!! (Lee, 2019)' || {NL} || {NL} || 'Copyright © 2020 X'")
    out = processed(df, "inp")
    return out.select("doc_id", "processed", "original_length", "processed_length", "original_tokens", "processed_tokens", "text_length_reduction_percent", "token_reduction_percent", "success", "error")


# ---- windows

_UNNEST = f"WITH i AS (SELECT doc_id, {{0}} AS inp FROM documents), l AS (SELECT doc_id, CAST(t.pos - 1 AS INTEGER) AS pos, t.line, trim(t.line, {WS}) AS s FROM i, unnest({_lines()}) WITH ORDINALITY AS t(line, pos))"


@_query("repeated_lines", _UNNEST.format(_PAGES) + ", n AS (SELECT doc_id, pos, s, CAST(row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) AS INTEGER) AS nth FROM l) SELECT * FROM n WHERE nth >= 3 AND s <> ''")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.occurrence(windows.exploded(_planted(spark, sf_dir, _PAGES), "doc_id", "inp"), "doc_id")
    return rows.where("nth >= 3 AND s <> ''").select("doc_id", "pos", "s", "nth")


@_query("consecutive_dup_lines", _UNNEST.format(_PAGES) + ", n AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l) SELECT doc_id, pos, s FROM n WHERE s <> '' AND s = b")
def consecutive_dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.repeats_last(windows.exploded(_planted(spark, sf_dir, _PAGES), "doc_id", "inp"), "doc_id")
    return rows.where("again").select("doc_id", "pos", "s")


@_query("line_blocks", _UNNEST.format(_BROKEN) + ", n AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos), '') AS b, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY pos), '') AS a FROM l) SELECT doc_id, pos, b = '' AS blank_before, a = '' AS blank_after, sum(CASE WHEN s <> '' AND b = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS block FROM n")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.exploded(_planted(spark, sf_dir, _BROKEN), "doc_id", "inp")
    return windows.blocks(windows.neighbours(rows, "doc_id"), "doc_id").select("doc_id", "pos", "blank_before", "blank_after", "block")


# ---- metrics

_TOKENS = "len(regexp_extract_all({0}, '[\\pL\\pN_]+|[.,!?;:]'))"


@_query("token_estimate", f"SELECT doc_id, CAST({_TOKENS.format('text')} AS INTEGER) AS tokens, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", metrics.token_estimate(F.col("text")).alias("tokens"), metrics.word_estimate(F.col("text")).alias("words"))


_MEASURED = f"WITH i AS (SELECT doc_id, lang, {_BLANKS} AS inp FROM documents), o AS (SELECT *, {_CLEAN} AS out FROM i), m AS (SELECT doc_id, lang, CAST(length(inp) AS INTEGER) AS original_length, CAST(length(out) AS INTEGER) AS processed_length, CAST({_TOKENS.format('inp')} AS INTEGER) AS original_tokens, CAST({_TOKENS.format('out')} AS INTEGER) AS processed_tokens FROM o)"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_BLANKS).alias("inp")).withColumn("out", F.col("inp"))
    return metrics.measured(cleaning.clean_whitespace(df, "out"), "inp", "out")


_PERCENT = "CASE WHEN original_{0} = 0 THEN 0.0 ELSE round_even(100 - processed_{0} / original_{0} * 100, 2) END"


@_query("length_metrics", f"{_MEASURED} SELECT doc_id, original_length, processed_length, original_tokens, processed_tokens, {_PERCENT.format('length')} AS text_length_reduction_percent, {_PERCENT.format('tokens')} AS token_reduction_percent FROM m")
def length_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("doc_id", "original_length", "processed_length", "original_tokens", "processed_tokens", "text_length_reduction_percent", "token_reduction_percent")


@_query("reduction_by_lang", f"{_MEASURED} SELECT lang, sum(original_length)::BIGINT AS original, sum(processed_length)::BIGINT AS processed, count(*) AS files FROM m GROUP BY ROLLUP (lang)")
def reduction_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_with_total(_measured(spark, sf_dir), "lang", original="original_length", processed="processed_length")


@_query("mean_reduction", f"{_MEASURED} SELECT round(avg({_PERCENT.format('length')}), 6) AS mean_reduction FROM m")
def mean_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).agg(F.round(F.avg("text_length_reduction_percent"), 6).alias("mean_reduction"))


@_query("directory_summary", f"{_MEASURED}, r AS (SELECT *, doc_id % 10 <> 0 AS success FROM m), b AS (SELECT count(*) AS total, sum(success::INT)::BIGINT AS successful, coalesce(sum(original_tokens) FILTER (WHERE success AND original_tokens > 0 AND processed_tokens > 0), 0)::BIGINT AS original_tokens, coalesce(sum(processed_tokens) FILTER (WHERE success AND original_tokens > 0 AND processed_tokens > 0), 0)::BIGINT AS processed_tokens FROM r) SELECT total, successful, total - successful AS failed, original_tokens, processed_tokens, CASE WHEN original_tokens > 0 THEN round_even((original_tokens - processed_tokens) / original_tokens * 100, 6) END AS token_reduction_percent FROM b")
def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.directory_summary(_measured(spark, sf_dir).withColumn("success", F.col("doc_id") % 10 != 0))


@_query("op_stats", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS average, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type")
def op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.operation_stats(_table(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("average", "median")], "least", "most", F.round("stdev", 6).alias("stdev"))


@_query("size_metrics", "SELECT doc_id, round_even(strlen(text) / 1024, 2) AS file_size_kb, CASE WHEN n_chars = 0 THEN 0.0 ELSE 1 - (n_chars // 2) / n_chars END AS size_reduction FROM documents")
def size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    half = F.expr("n_chars div 2")
    return d.select("doc_id", metrics.size_columns(F.octet_length("text"))["file_size_kb"].alias("file_size_kb"), F.when(F.col("n_chars") == 0, F.lit(0.0)).otherwise(1 - half / F.col("n_chars")).alias("size_reduction"))


_TAGS = {"markup": "[#|%]", "question": "[?]", "licence": "(?i)licen[sc]e", "token": "token"}


@_query("topic_tags", "WITH t AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _TAGS.items()) + "], lambda x: x IS NOT NULL) AS tags FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(tags) = 0 THEN ['uncategorised'] ELSE tags END, ',') AS tags FROM t")
def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic whose pattern occurs; a default where none does."""
    tags = F.array_compact(F.array(*[F.when(F.regexp_like("text", F.lit(p)), F.lit(n)) for n, p in _TAGS.items()]))
    return _table(spark, sf_dir, "documents").withColumn("t", tags).select("doc_id", F.array_join(F.when(F.size("t") == 0, F.array(F.lit("uncategorised"))).otherwise(F.col("t")), ",").alias("tags"))


# ---- paths and validation

_PATH = "CASE doc_id % 11 WHEN 0 THEN '/data/a/Report ' || doc_id || '.PDF' WHEN 1 THEN '/data/' || source || '/x.tar.gz' WHEN 2 THEN '/etc/passwd.txt' WHEN 3 THEN '/data/../x.md' WHEN 4 THEN '/data/run.sh' WHEN 5 THEN '/data/o''brien.docx' WHEN 6 THEN '/Users/me/Library/n.csv' WHEN 7 THEN '/data/none' WHEN 8 THEN '/data/v.mp4' WHEN 9 THEN '/data/t.xlsx' ELSE '/data/b/' || doc_id || '.md' END"
_P = f"WITH p AS (SELECT doc_id, n_chars * 20000 AS size, {_PATH} AS path FROM documents), e AS (SELECT *, lower(regexp_extract(path, '[^/\\\\]([.][^./\\\\]+)$', 1)) AS ext, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM p)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 20000).alias("size"), F.expr(_PATH.replace("o''brien", "o\\'brien")).alias("path"))


@_query("path_parts", _P + " SELECT doc_id, ext, name, regexp_replace(name, '(.)[.][^.]+$', '\\1') AS stem FROM e")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", validation.extension(p).alias("ext"), validation.file_name(p).alias("name"), validation.stem(p).alias("stem"))


_LIMIT = f"CASE ext {' '.join(f'WHEN {chr(39)}.{e}{chr(39)} THEN {n}' for e, n in validation.LIMITS.items())} ELSE {validation.LIMIT} END"
_MIME = f"CASE ext {' '.join(f'WHEN {chr(39)}.{e}{chr(39)} THEN {chr(39)}{m}{chr(39)}' for e, m in validation.MIME.items())} END"
_quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
_SIZE_ERROR = f"CASE WHEN size > {_LIMIT} THEN 'too large' END"
_MIME_ERROR = f"CASE WHEN {_MIME} IS NULL AND ext IN ({_quoted(validation.DANGEROUS)}) THEN 'dangerous extension' WHEN {_MIME} IS NOT NULL AND {_MIME} NOT IN ({_quoted(sorted(validation.ALLOWED))}) THEN 'type not allowed' END"
_BAD = " OR ".join(f"regexp_matches(path, '{p.replace(chr(39), chr(39) * 2)}')" for n, p in validation.SUSPICIOUS.items() if n != "traversal")
_SENSITIVE = " OR ".join(f"starts_with(path, '{p}')" if "*" not in p else f"regexp_matches(path, '^{'.*?'.join(validation._escaped(x) for x in p.split('*'))}')" for p in validation.SENSITIVE)
_PATH_ERROR = f"CASE WHEN regexp_matches(path, '\\.\\.[/\\\\]') THEN 'path traversal' WHEN {_BAD} THEN 'suspicious path' WHEN ext IN ({_quoted(validation.DANGEROUS)}) THEN 'dangerous extension' WHEN {_SENSITIVE} THEN 'sensitive location' END"


@_query("file_checks", f"{_P} SELECT doc_id, {_SIZE_ERROR} AS size_error, {_MIME} AS mime, {_MIME_ERROR} AS mime_error, {_PATH_ERROR} AS path_error, coalesce({_PATH_ERROR}, {_SIZE_ERROR}, {_MIME_ERROR}) AS error FROM e")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("path"), F.col("size")
    return _paths(spark, sf_dir).select("doc_id", validation.size_error(p, n).alias("size_error"), validation.mime_type(p).alias("mime"), validation.mime_error(p).alias("mime_error"), validation.path_error(p).alias("path_error"), validation.file_error(p, n).alias("error"))


_ODD = "text || CASE doc_id % 4 WHEN 0 THEN ' a -- b' WHEN 1 THEN ' x=1; y' WHEN 2 THEN ' base64 x.exe' ELSE '' END"


@_query("suspicious_scan", f"WITH i AS (SELECT doc_id, {_ODD} AS inp FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(inp, '{validation.SUSPICIOUS[n].replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n in validation.CONTENT) + "], lambda x: x IS NOT NULL), ',') AS found FROM i")
def suspicious_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(spark, sf_dir, _ODD).select("doc_id", F.array_join(validation.suspicious(F.col("inp")), ",").alias("found"))


@_query("sha256", "SELECT doc_id, sha256(text) AS digest, sha256(text) = sha256(text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' ' END) AS intact FROM documents")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text").cast("binary")
    other = validation.digest(F.expr("text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' ' END").cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", validation.digest(t).alias("digest"), validation.intact(t, other).alias("intact"))


@_query("sanitize_names", "SELECT doc_id, regexp_replace(regexp_replace('a/b:c' || chr(10) || left(text, 30) || '|é', '[\\x00-\\x1f\\x7f]', '_', 'g'), '[^-.\\pL\\pN_\\s]', '_', 'g') AS name, replace('a|' || doc_id, '|', '\\|') AS cell FROM documents")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("'a/b:c' || chr(10) || left(text, 30) || '|é'")
    return _table(spark, sf_dir, "documents").select("doc_id", validation.sanitized_filename(raw).alias("name"), validation.escaped_pipes(F.expr("'a|' || doc_id")).alias("cell"))


def _converters() -> str:
    from .sources.registry import CONVERTERS

    return "CASE " + " ".join(f"WHEN ext IN ({_quoted(es)}) THEN '{n}'" for n, es in CONVERTERS.items()) + " END"


@_query("converter_lookup", f"{_P} SELECT doc_id, ext, {_converters()} AS converter FROM e")
def converter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _paths(spark, sf_dir).withColumn("ext", validation.extension(F.col("path")))
    return d.select("doc_id", "ext", FileTypes().converter(F.col("ext")).alias("converter"))


_FORMATS = ", ".join(f"('{e}', '{f}')" for e, fs in sorted(FileTypes().formats.items()) for f in fs)


@_query("format_lookup", f"{_P}, f(ext, format) AS (VALUES {_FORMATS}) SELECT doc_id, e.ext, format FROM e LEFT JOIN f ON e.ext = f.ext")
def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's possible formats; the registry is a fixed table of some fifty rows."""
    d = _paths(spark, sf_dir).withColumn("ext", validation.extension(F.col("path")))
    return d.join(F.broadcast(FileTypes().table(spark)), "ext", "left").select("doc_id", "ext", "format")


@_query("unsupported_files", f"{_P}, f(ext, format) AS (VALUES {_FORMATS}) SELECT doc_id, path FROM e WHERE ext NOT IN (SELECT ext FROM f)")
def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _paths(spark, sf_dir).withColumn("ext", validation.extension(F.col("path")))
    return d.join(F.broadcast(FileTypes().table(spark).select("ext").distinct()), "ext", "left_anti").select("doc_id", "path")


@_query("output_paths", f"""WITH p AS (SELECT doc_id, {_PATH} AS path, CASE doc_id % 3 WHEN 0 THEN 'JSON' WHEN 1 THEN 'plain_text' ELSE 'other' END AS fmt FROM documents)
SELECT doc_id, CASE lower(fmt) WHEN 'json' THEN 'json' WHEN 'plain_text' THEN 'txt' ELSE 'txt' END AS ext, '/out/' || CASE WHEN starts_with(path, '/data/') THEN substr(path, 7) ELSE regexp_extract(path, '([^/]*)$', 1) END || '.' || CASE lower(fmt) WHEN 'json' THEN 'json' ELSE 'txt' END AS target FROM p""")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _paths(spark, sf_dir).withColumn("fmt", F.expr("CASE doc_id % 3 WHEN 0 THEN 'JSON' WHEN 1 THEN 'plain_text' ELSE 'other' END"))
    d = d.withColumn("ext", renderers.default_extension(F.col("fmt")))
    return d.select("doc_id", "ext", renderers.output_path(F.col("path"), "/data", "/out", F.col("ext")).alias("target"))


# ---- sources and rendering

_MD = f"CASE WHEN doc_id % 2 = 0 THEN '---' || {NL} || 'title: T ' || doc_id || {NL} || 'tags: [a, b]' || {NL} || '---' || {NL} ELSE '' END || '# One #' || {NL} || text || {NL} || '  ### H3 # Also' || {NL} || '#no'"
_FM = "(?s)\\A---[ \\t]*\\n(.*?\\n)?---[ \\t]*(?:\\n|\\z)"


@_query("markdown_headings", f"WITH i AS (SELECT doc_id, {_MD} AS inp FROM documents), l AS (SELECT doc_id, t.pos, trim(t.line, {WS}) AS s FROM (SELECT doc_id, regexp_replace(inp, '{_FM}', '') AS b FROM i), unnest(string_split(b, {NL})) WITH ORDINALITY AS t(line, pos)), h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS nth, length(regexp_extract(s, '^(#+)', 1))::INTEGER AS level, regexp_extract(s, '^#{{1,6}}\\s+(.+?)(?:\\s+#{{1,6}})?$', 1) AS heading FROM l WHERE regexp_matches(s, '^(#{{1,6}})\\s+(.+?)(?:\\s+#{{1,6}})?$')) SELECT * FROM h")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _planted(spark, sf_dir, _MD).select("doc_id", F.posexplode(markdown.headings(markdown.body(F.col("inp")))).alias("p", "h"))
    return h.select("doc_id", (F.col("p") + 1).alias("nth"), F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


@_query("front_matter", f"WITH i AS (SELECT doc_id, {_MD} AS inp FROM documents) SELECT doc_id, CASE WHEN regexp_matches(inp, '{_FM}') THEN regexp_extract(inp, 'title: (T \\d+)', 1) END AS title, regexp_replace(inp, '{_FM}', '') AS body FROM i")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = markdown.read(_planted(spark, sf_dir, _MD), "inp")
    return d.select("doc_id", F.try_element_at("frontmatter", F.lit("title")).alias("title"), F.col("content").alias("body"))


@_query("csv_content_rows", _UNNEST.format(_PAGES) + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, s AS Content FROM l WHERE s <> ''")
def csv_content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renderers.csv_rows(_planted(spark, sf_dir, _PAGES), "doc_id", "inp")


_META = ("CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id END", "CASE WHEN doc_id % 3 = 0 THEN source END", "CASE WHEN doc_id % 5 = 0 THEN n_chars / 4.0 END", "CASE WHEN doc_id % 7 = 0 THEN doc_id END", "CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 END")


@_query("metadata_block", f"WITH m AS (SELECT doc_id, text, {_META[0]} AS a, {_META[1]} AS b, {_META[2]} AS c, {_META[3]} AS d, {_META[4]} AS e FROM documents), k AS (SELECT doc_id, text, array_to_string(list_filter(['- Title: ' || a, '- Author: ' || b, '- File Size: ' || printf('%.2f', c::DOUBLE) || ' KB', coalesce('- Pages: ' || d, '- Slides: ' || e)], lambda x: x IS NOT NULL), {NL}) AS items FROM m) SELECT doc_id, text || CASE WHEN items = '' THEN '' ELSE {NL} || {NL} || '## Document Metadata' || {NL} || {NL} || items END AS out FROM k")
def metadata_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d, e = (F.expr(x) for x in _META)
    none = F.lit(None).cast("long")
    block = renderers.metadata_block(a, b, c.cast("double"), d, e, none, none.cast("double"))
    return _table(spark, sf_dir, "documents").select("doc_id", renderers.markdown(F.col("text"), block).alias("out"))


@_query("json_render", "SELECT doc_id, json_extract_string(to_json({'content': text}), '$.content') AS content FROM documents")
def json_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = renderers.as_json(F.col("text"), F.struct("lang", "source"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.get_json_object(j, "$.content").alias("content"))


_MD_TABLE = f"text || {NL} || {NL} || '| a | b |' || {NL} || '| --- | --- |' || {NL} || '| ' || doc_id || ' | x |'"


@_query("markdown_tables", "SELECT doc_id, 0 AS row, 'a' AS first, 'b' AS second FROM documents UNION ALL SELECT doc_id, 1, CAST(doc_id AS VARCHAR), 'x' FROM documents")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each document's last table."""
    d = renderers.tables(_planted(spark, sf_dir, _MD_TABLE), "inp")
    rows = d.select("doc_id", F.posexplode(F.element_at("tables", -1)).alias("row", "cells"))
    return rows.select("doc_id", "row", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@_query("csv_convert", "SELECT doc_id, 'id name' || chr(10) || doc_id || ' ' || lang || ', x' AS content, 3 AS original_rows FROM documents")
def csv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV texts with a row limit."""

    @F.pandas_udf("content string, original_rows int")
    def run(s):
        import pandas as pd

        return pd.DataFrame([(t, m["original_rows"]) for t, m in (files.csv_content(x, max_rows=2) for x in s)], columns=["content", "original_rows"])

    raw = F.expr(f"'id, name' || {NL} || doc_id || ',' || chr(34) || lang || ', x' || chr(34) || {NL} || 'a,b' || {NL} || 'c,d'")
    return _table(spark, sf_dir, "documents").select("doc_id", run(raw).alias("r")).select("doc_id", "r.*")


# ---- pages


@_query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@_query("html_to_markdown")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html.html_to_markdown(_table(spark, sf_dir, "pages"), "html")
    return d.select("page_id", "content", "metadata.*", "error")


@_query("html_tables", "SELECT page_id, 'h' AS a, CAST(page_id AS VARCHAR) AS b FROM pages")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last table of each page, after one is added."""
    d = _table(spark, sf_dir, "pages").withColumn("html", F.expr("html || '<table><tr><th>h</th></tr><tr><td>' || page_id || '</td></tr></table>'"))
    t = F.element_at("tables", -1)
    return html.html_tables(d, "html").select("page_id", t[0][0].alias("a"), t[1][0].alias("b"))


@_query("html_by_path", "SELECT page_id, regexp_matches(url, '^https?://') AND (regexp_extract(lower(regexp_replace(url, '^https?://[^/?#]*|[?#].*$', '', 'g')), '[^/]([.][^./]+)$', 1) IN ('', '.htm', '.html', '.xhtml', '.xml')) AS is_html FROM pages")
def html_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.is_html(F.col("url")).alias("is_html"))


# ---- execution


@_query("process_items", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id * 2 AS VARCHAR) END AS result, doc_id % 5 <> 0 AS success FROM documents")
def process_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arbitrary function, of which every fifth call fails; failures are rows."""

    def double(x: int) -> str:
        if x % 5 == 0:
            raise ValueError("every fifth")
        return str(x * 2)

    return parallel.process_items(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", double).select("doc_id", "result", "success")


@_query("stream_clean", ORACLE_SQL["clean_whitespace"])
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on a stream of the table's files, written once by a file sink."""
    from .streaming import stream

    where = _scratch(spark)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = stream.parquet_files(spark, f"{sf_dir}/documents.parque[t]", source)  # a pattern, as the table may be a file or a folder
    s = docs.select("doc_id", F.expr(_BLANKS).alias("inp")).withColumn("out", F.col("inp"))
    s = stream.cleaned(s, "out", Pipeline([("clean_whitespace", cleaning.clean_whitespace)]))
    s = s.select("doc_id", "out", (F.col("out") != F.col("inp")).alias("changed"))
    stream.to_files(s, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{where}/out")


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors share; a temporary one only where the session names none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/textloom/stream-{uuid.uuid4().hex[:12]}"
