"""Command line: process, generate-config, list-presets, list-formats, version."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from .plans import config as cfg
from .plans import renderers

VERSION = "0.1.0"


def _process(a: argparse.Namespace) -> int:
    from .operators.metrics import directory_summary
    from .operators.performance import Timings
    from .plans import sinks
    from .plans.pipeline import Pipeline, processed
    from .session import local
    from .sources.files import load

    times = Timings()
    spark = local()
    over = dict(cfg.option(o) for o in a.option)
    config = cfg.Config.load(a.config) if a.config else cfg.create(a.preset or a.level, over)
    for k, v in over.items():
        config.set(k, v)
    single = os.path.isfile(a.input)
    ext_of = os.path.splitext(a.output)[1] if single else ""
    fmt = a.format or (renderers.ALIASES.get(ext_of[1:].lower(), ext_of[1:].lower()) if ext_of[1:].lower() in (*renderers.ALIASES, *renderers.FORMATS, *renderers.WRITERS) else "markdown")
    docs = load(spark, a.input, a.extensions.split(",") if a.extensions else None, not a.no_recursive)
    m = F.col("metadata")
    # every document goes through once: what failed to load keeps its error
    done = processed(docs.withColumnRenamed("error", "load_error"), "content", Pipeline.from_config(config))
    done = done.withColumn("error", F.coalesce("load_error", "error")).withColumn("success", F.col("error").isNull())
    block = renderers.metadata_block(m["title"], m["author"], m["file_size_kb"], m["page_count"], m["slide_count"], m["sheet_count"], F.col("token_reduction_percent"))
    shown = block if config.get("output.markdown.include_metadata", True) else None
    ext, text, render = renderers.file_text(fmt, F.col("processed"), m, shown, config.get("output.markdown.metadata_position", "end"))
    done = done.withColumn("text", text).withColumn("text", F.when(F.col("success"), F.col("text")))
    done = done.withColumn("target", F.lit(a.output if ext_of else os.path.join(a.output, f"{os.path.splitext(os.path.basename(a.input))[0]}.{ext}"))) if single else sinks.with_target(done, os.path.abspath(a.input), a.output, ext, a.keep_extension)
    if not a.overwrite and os.path.exists(a.output) and (not os.path.isdir(a.output) or os.listdir(a.output)):
        print(f"{a.output} exists; use --overwrite", file=sys.stderr)
        return 2
    narrow = done.select("path", "target", "text", "success", "error", "original_length", "processed_length", "original_tokens", "processed_tokens")
    with times.operation("process"):
        rows = sinks.write_files(narrow, render=render).withColumn("error", F.coalesce("error", "write_error")).withColumn("success", F.col("error").isNull()).drop("write_error").cache()  # no texts
        s = directory_summary(rows).first()
    print(f"{s.total} files, {s.successful} processed, {s.failed} failed")
    if s.token_reduction_percent is not None:
        print(f"tokens: {s.original_tokens:,} to {s.processed_tokens:,} ({s.token_reduction_percent:.2f}% fewer)")
    if a.report:
        seconds = F.lit(times.seconds["process"][0] / max(1, s.total))  # of a file, on average: files run side by side
        renderers.report_rows(rows.withColumn("processing_time", seconds).withColumn("output_path", F.when(F.col("success"), F.col("target")))).write.mode("overwrite").option("header", True).csv(a.report)
    if a.performance_report:
        times.save(a.performance_report)
    rows.unpersist()
    return 0 if s.failed == 0 else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("process")
    q.add_argument("input")
    q.add_argument("output")
    q.add_argument("--format", help="markdown, plain_text, json, csv or a registered one; by the output's extension for a single file")
    q.add_argument("--keep-extension", action="store_true", help="a.txt becomes a.txt.md, apart from a.md")
    q.add_argument("--report", help="folder for a CSV report of all files")
    q.add_argument("--performance-report", help="JSON file for timings")
    q.add_argument("--config")
    q.add_argument("--preset")
    q.add_argument("--level", default="standard")
    q.add_argument("--option", action="append", default=[], help="key=value")
    q.add_argument("--extensions")
    q.add_argument("--no-recursive", action="store_true")
    q.add_argument("--overwrite", action="store_true")
    g = sub.add_parser("generate-config")
    g.add_argument("output")
    g.add_argument("--kind", default="standard")
    g.add_argument("--option", action="append", default=[])
    for name in ("list-presets", "list-formats", "version"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    if a.command == "process":
        return _process(a)
    if a.command == "generate-config":
        cfg.create(a.kind, dict(cfg.option(o) for o in a.option)).save(a.output)
    elif a.command == "list-presets":
        for n in sorted(cfg.PRESETS):
            print(f"{n}: {cfg.PRESETS[n][1]} ({cfg.PRESETS[n][0]:,} tokens)")
    elif a.command == "list-formats":
        from .sources.registry import CONVERTERS

        for n, exts in CONVERTERS.items():
            print(f"{n}: {', '.join(sorted(exts))}")
    else:
        print(VERSION)
    return 0


if __name__ == "__main__":
    sys.exit(main())
