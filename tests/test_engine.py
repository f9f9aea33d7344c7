"""Configuration, pipeline, metrics, windows, validation, parallel execution, streaming, command line."""

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.operators import cleaning, metrics, validation, windows
from textloom.plans import config as cfg
from textloom.operators.performance import Timings, throughput, tokens_by
from textloom.plans import parallel, renderers, sinks
from textloom.plans.pipeline import Pipeline, processed
from textloom.streaming import stream

ON = ["format_headings", "remove_headers_footers", "clean_whitespace", "join_paragraph_lines", "remove_duplicates", "remove_boilerplate_text", "merge_short_paragraphs", "normalize_unicode", "strip_text", "remove_redundant_phrases", "condense_repetitive_patterns", "remove_excessive_punctuation", "simplify_citations"]


def test_steps_by_configuration():
    assert cfg.Config().steps() == ON
    assert "standardize_lists" in cfg.Config({"structure": {"preserve_lists": False}}).steps()
    assert cfg.Config({"cleaning": {"enabled": False}, "optimization": {"enabled": False}}).steps() == ["format_headings"]
    assert cfg.Config({"processing": {"cleaning_level": "minimal"}}).steps() == ON[:9]
    old = {"processors": {"content_cleaner": {"clean_whitespace": False}}}
    assert "clean_whitespace" in cfg.Config(old).steps() and "clean_whitespace" not in cfg.Config(old, compat=True).steps()


def test_config_access(tmp_path):
    c = cfg.create("standard", {"a.b.c": 1, "cleaning": {"remove_footnotes": True}})
    assert c.get("a.b.c") == 1 and c.get("a.x", 5) == 5 and c.get("a.b.c.d", 6) == 6 and c.section("cleaning") == {"remove_footnotes": True}
    c.save(str(tmp_path / "c.yaml"))
    assert cfg.Config.load(str(tmp_path / "c.yaml")).values == c.values
    assert cfg.merge({"a": {"b": 1}, "c": 2}, {"a": {"d": 3}, "c": {"e": 1}}) == {"a": {"b": 1, "d": 3}, "c": {"e": 1}}
    with pytest.raises(ValueError):
        cfg.preset("none")
    assert cfg.create("rag").get("general.token_limit") == 2048 and cfg.create("nonsense").steps() == ON
    assert [cfg.option(x) for x in ("a=true", "b=3", "c=1.5", "d.e=x=y")] == [("a", True), ("b", 3), ("c", 1.5), ("d.e", "x=y")]


def test_pipeline_composes_in_order(spark):
    text = "Title\n\nPage 1 of 2\nfirst  line\nsecond line.\n\n12\n\nIn order to to see.\n\nIn order to to see.\n\nCopyright © 2020 X"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, t string")
    p = Pipeline.from_config()
    got = {r.i: r.o for r in p.apply(df, "t", "o").collect()}
    assert got[1].startswith("## Title\n\n") and "Page" not in got[1] and "to see." in got[1] and "## 12" in got[1] and "2020" not in got[1]
    assert got[2] == "" and got[3] is None
    steps = df.withColumn("o", F.col("t"))
    for n in ON:
        steps = (getattr(cleaning, n, None) or dict(p.steps)[n])(steps, "o")
    assert {r.i: r.o for r in steps.collect()} == got
    own = p.register("upper", lambda d, c: d.withColumn(c, F.upper(c)), before="strip_text")
    assert own.names.index("upper") == own.names.index("strip_text") - 1


def test_processed_reports_failures(spark):
    rows = {r.i: r for r in processed(spark.createDataFrame([(1, "some text here"), (2, ""), (3, "   "), (4, None)], "i int, t string"), "t").collect()}
    assert rows[1].success and rows[1].error is None
    assert rows[2].error == "empty conversion" and rows[3].error == "empty result" and rows[4].error == "empty conversion"


def test_metrics(spark):
    df = spark.createDataFrame([("a" * 31, "b" * 16, 2.0, 2048), ("", "", 0.0, 0)], "r string, p string, s double, n int")
    a, b = metrics.measured(df, "r", "p", "s", "n").collect()
    assert (a.text_length_reduction_percent, a.characters_per_second, a.kb_per_second) == (48.39, 15.5, 1.0)
    assert (b.text_length_reduction_percent, b.characters_per_second) == (0.0, None)
    t = spark.createDataFrame([("Hello, world! It's 5:30.",)], "t string").select(metrics.token_estimate(F.col("t")).alias("a"), metrics.word_estimate(F.col("t")).alias("b")).first()
    assert (t.a, t.b) == (10, 4)
    r = spark.createDataFrame([(True, 10, 5), (True, 30, 15), (False, 5, 5), (True, 0, 0)], "success boolean, original_tokens int, processed_tokens int")
    s = metrics.directory_summary(r).first()
    assert (s.total, s.successful, s.failed, s.original_tokens, s.token_reduction_percent) == (4, 3, 1, 40, 50.0)
    e = metrics.directory_summary(r.where("false")).first()
    assert (e.total, e.successful, e.token_reduction_percent) == (0, 0, None)
    o = metrics.operation_stats(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "op string, s double"), "op", "s").orderBy("op").collect()
    assert (o[0].average, o[0].median, round(o[0].stdev, 4), o[1].stdev) == (2.0, 2.0, 1.4142, None)
    report = metrics.metrics_report({"processing_time_seconds": 1.0, "original_length": 12345, "processed_length": 10, "text_length_reduction_percent": 99.9})
    assert "12,345" in report and "99.90%" in report and "Token" not in report


def test_window_forms_agree_with_array_forms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr("text || chr(10) || 'x' || chr(10) || 'x' || chr(10) || chr(10) || 'x' || chr(10) || 'end'").alias("t"))
    rows = windows.exploded(docs, "doc_id", "t")
    kept = windows.occurrence(rows, "doc_id").where("nth < 3 OR length(s) >= 100").where(~cleaning.is_furniture(F.col("s")) | (F.col("s") == ""))
    a = {r.doc_id: r.o for r in windows.joined(kept, "doc_id", "o").collect()}
    b = {r.doc_id: r.t for r in cleaning.remove_headers_footers(docs, "t").collect()}
    assert a == b
    again = windows.repeats_last(rows, "doc_id")
    assert again.where("again AND s = 'x'").count() == 2 * docs.count()


def test_validation(spark):
    paths = ["/data/a.txt", "/data/../b.txt", "/data/o'b.txt", "/x/run.sh", "/etc/a.txt", "/Users/me/Library/a.md", "/data/big.xlsx", "/data/v.mp4", "/data/noext"]
    df = spark.createDataFrame([(p, 21 << 20) for p in paths], "p string, n long")
    p = F.col("p")
    got = {r.p: r.e for r in df.select("p", validation.file_error(p, F.col("n")).alias("e")).collect()}
    assert list(got.values()) == [None, "path traversal", "suspicious path", "dangerous extension", "sensitive location", "sensitive location", "too large", "type not allowed", None]
    names = df.limit(1).select(validation.sanitized_filename(F.lit("a/b:c\n\td")).alias("a"), validation.stem(F.lit("/x/a.tar.gz")).alias("b"), validation.extension(F.lit("/x/.hidden")).alias("c"), validation.suspicious(F.lit("x=1; <script>a</script>")).alias("d")).first()
    assert (names.a, names.b, names.c, names.d) == ("a_b_c__d", "a.tar", "", ["sql_assignment", "shell"])
    assert validation.permission_error("/nonexistent") == "missing" and validation.output_error("/tmp/a:b") == "unsafe output name"


def test_parallel(spark):
    df = spark.range(10).withColumnRenamed("id", "original_index")

    def f(x):
        if x % 5 == 0:
            raise ValueError(x)
        return float(x)

    got = parallel.process_items(df, "original_index", f, "double")
    assert got.where("NOT success").count() == 2 and "ValueError" in got.where("NOT success").first().error
    assert [r.original_index for r in parallel.ordered(got).collect()] == [1, 2, 3, 4, 6, 7, 8, 9]
    assert parallel.map_reduce(df, "original_index", f) == 40.0
    assert parallel.process_batches(df, lambda b: b.head(1), "original_index long").count() >= 1


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"Title {i}\n\na   line\nof text {i}")
    s = stream.cleaned(stream.text_files(spark, str(tmp_path / "in")), "value")
    stream.to_files(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = Pipeline.from_config().apply(spark.read.text(str(tmp_path / "in"), wholetext=True), "value")
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.value for r in batch.collect())
    seen = []
    stream.each_batch(s, str(tmp_path / "cp2"), lambda d, n: seen.append(d.count())).awaitTermination()
    assert sum(seen) == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("Some  text.\n")
    (tmp_path / "in" / "sub" / "c.md").write_text("Other  words here.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "in" / "b.json").write_text("{}")
    into = str(tmp_path / "out")
    assert cli.main(["process", str(tmp_path / "in"), into, "--report", str(tmp_path / "r"), "--performance-report", str(tmp_path / "p.json")]) == 1
    assert "3 files, 2 processed, 1 failed" in capsys.readouterr().out
    assert sorted(str(p.relative_to(into)) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.md", "sub/c.md"]
    assert (tmp_path / "out" / "a.md").read_text().startswith("## Some text.") and "File Size" in (tmp_path / "out" / "a.md").read_text()
    assert "Other words here." in (tmp_path / "out" / "sub" / "c.md").read_text()
    report = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.csv(str(tmp_path / "r"), header=True, inferSchema=True).collect()}
    assert report["a.txt"].success and report["a.txt"].output_path.endswith("out/a.md") and report["b.json"].error and '"process"' in (tmp_path / "p.json").read_text()
    assert cli.main(["process", str(tmp_path / "in"), into]) == 2
    assert cli.main(["process", str(tmp_path / "in" / "sub" / "c.md"), str(tmp_path / "one.csv")]) == 0
    assert (tmp_path / "one.csv").read_text().startswith("Content\n## Other words here.")  # joined lines are no table any more
    assert cli.main(["process", str(tmp_path / "in" / "a.txt"), str(tmp_path / "one"), "--format", "json"]) == 0
    assert '"content":"## Some text."' in (tmp_path / "one" / "a.json").read_text()
    assert cli.main(["generate-config", str(tmp_path / "c.yaml"), "--option", "cleaning.remove_footnotes=true"]) == 0
    assert cfg.Config.load(str(tmp_path / "c.yaml")).get("cleaning.remove_footnotes") is True
    for command in ("list-presets", "list-formats", "version"):
        assert cli.main([command]) == 0


def test_plan_has_one_crossing_and_no_shuffle(spark, sf):
    p = Pipeline.from_config().apply(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_timings(spark, tmp_path):
    t = Timings()

    @t.timed()
    def work():
        return 5

    assert work() == work() == 5
    with pytest.raises(ValueError), t.operation("fails"):
        raise ValueError
    assert t.stats()["work"]["count"] == 2 and t.report()["total_operations"] == 3
    rows = {r.operation: r for r in metrics.operation_stats(t.frame(spark), "operation", "seconds").collect()}
    assert rows["work"].n == 2 and rows["fails"].n == 1
    df = spark.createDataFrame([("a b c", 2.0), (None, 0.0)], "t string, s double").withColumn("n", tokens_by(lambda: str.split)(F.col("t")))
    assert throughput(df, "n", "s").first() == (2, 3, 1.5)


def test_registered_writer(spark, tmp_path):
    renderers.register_writer("shout", ".loud", lambda content, metadata: F.upper(content))
    ext, text, _ = renderers.file_text("Shout", F.col("t"), F.lit(None))
    df = spark.createDataFrame([("/in/x/a.txt", "hi"), ("/in/b.txt", None)], "path string, t string").withColumn("text", text)
    rows = {r.path: r for r in sinks.write_files(sinks.with_target(df, "/in", str(tmp_path), ext)).collect()}
    assert (tmp_path / "x" / "a.txt.loud").read_text() == "HI" and rows["/in/x/a.txt"].written_bytes == 2 and rows["/in/b.txt"].written_bytes is None
    with pytest.raises(TypeError):
        renderers.register_writer("bad", "x", None)


def test_tasks_and_batches_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A table above SPREAD_BYTES in one row group, or in small files that share a split, goes to tasks of EACH bytes; Python gets small batches."""
    from textloom import queries, session

    for k in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")
    docs = spark.range(20000).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text")
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    monkeypatch.setattr(queries, "EACH", 100_000)
    for name, files in (("one", 1), ("many", 16)):
        docs.repartition(files).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries._table(spark, f"{tmp_path}/{name}", "documents")
        assert got.rdd.getNumPartitions() >= 10 and sorted(got.collect()) == sorted(docs.collect())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == session.BATCH_ROWS
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == session.BATCH_BYTES
